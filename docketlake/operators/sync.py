"""Content-hash synchronisation, snapshots, upserts and corpus deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(*columns: str) -> Column:
    """sha256 of the columns' JSON, in the order given; null and missing differ from empty."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def precedent_uid(precedent_id: Column, title: Column, date: Column) -> Column:
    """Id, '#', first twelve digits of the sha256 of the title's letters and digits in lower case, '|', the date."""
    plain = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "")
    return F.concat(precedent_id, F.lit("#"), F.substring(F.sha2(F.concat(plain, F.lit("|"), F.coalesce(date, F.lit(""))), 256), 1, 12))


def incremental_sync(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """(key, action): insert, update, refresh (only derived fields changed), unchanged or remove.

    Both sides: key, content_hash, derived_hash; one row a key. A null stored derived hash counts as changed.
    """
    s = stored.select(key, F.col("content_hash").alias("old"), F.col("derived_hash").alias("old_d"), F.lit(True).alias("there"))
    n = incoming.select(key, F.col("content_hash").alias("new"), F.col("derived_hash").alias("new_d"), F.lit(True).alias("comes"))
    action = (
        F.when(F.col("there").isNull(), "insert").when(F.col("comes").isNull(), "remove").when(~F.col("old").eqNullSafe(F.col("new")), "update")
        .when(~F.col("old_d").eqNullSafe(F.col("new_d")), "refresh").otherwise("unchanged")
    )
    return s.join(n, key, "full").select(key, action.alias("action"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The stored rows with those of `incoming` in place of theirs; written as a new snapshot by the caller."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def append_only(stored: DataFrame, incoming: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(all rows, refused rows): rows whose key is stored already or comes twice are refused whole."""
    counted = incoming.withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    clash = counted.join(stored.select(key).distinct().withColumn("__old", F.lit(True)), key, "left")
    bad = (F.col("__n") > 1) | F.col("__old").isNotNull()
    return stored.unionByName(clash.filter(~bad).drop("__n", "__old")), clash.filter(bad).drop("__n", "__old")


def delete_ids(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return stored.join(ids.select(key).distinct(), key, "left_anti")


def refresh_payload(stored: DataFrame, payload: DataFrame, key: str, vector: str = "vec") -> DataFrame:
    """New payload columns with the stored vectors; rows without new payload keep theirs."""
    kept = stored.join(payload.select(key), key, "left_anti")
    return kept.unionByName(payload.join(stored.select(key, vector), key), allowMissingColumns=True)


def snapshot_hash(rows: DataFrame, key: str, digest: str, digits: int = 4) -> DataFrame:
    """One row (snapshot_hash): independent of row order and partitioning.

    Lines 'key:hash' are folded in 16 ** digits groups by the key's md5, each hashed over its sorted lines; the group
    hashes are folded by all but two digits in turn, until one is left. The groups are fixed, so that a hash can be
    compared with an older one; four digits keep a group below 20,000 lines up to a billion rows, more digits beyond.
    """
    folded = rows.select(F.substring(F.md5(F.col(key).cast("string")), 1, digits).alias("g"), F.concat(F.col(key).cast("string"), F.lit(":"), F.col(digest)).alias("line"))
    while True:
        folded = folded.groupBy("g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("h"))
        if not digits:
            return folded.select(F.col("h").alias("snapshot_hash"))
        digits = max(0, digits - 2)
        folded = folded.select(F.substring("g", 1, digits).alias("g"), F.concat("g", F.lit(":"), "h").alias("line"))


def first_seen(rows: DataFrame, key: str, digest: str, order: list[str]) -> DataFrame:
    """Duplicates by key in order: (key, n_rows, n_contents, conflict) of keys that stand more than once."""
    return (
        rows.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_distinct(digest).alias("n_contents"), F.min_by(digest, F.struct(*order)).alias("kept"))
        .filter("n_rows > 1").withColumn("conflict", F.col("n_contents") > 1)
    )


def duplicate_groups(rows: DataFrame, digest: str, id: str) -> DataFrame:
    return rows.groupBy(digest).agg(F.count("*").alias("n_rows"), F.min(id).alias("first_id"), F.max(id).alias("last_id")).filter("n_rows > 1")
