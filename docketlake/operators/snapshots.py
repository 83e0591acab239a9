"""Changes between consecutive full snapshots, by content-defined chunks of the key-sorted rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlake.plans.session import cut, parallelism


def row_digest(columns: Sequence[str]) -> Column:
    """128-bit digest of a row's content. Null, empty string and empty list all differ; element order counts."""
    if not columns:
        return F.unhex(F.md5(F.lit("")))
    return F.unhex(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})))


def version_pairs(df: DataFrame, version: str) -> DataFrame:
    """(older, newer) for each version but the first, whatever numbers are skipped. One row a version."""
    w = Window.orderBy("newer")
    return (
        df.select(F.col(version).alias("newer")).distinct()
        .select(F.lag("newer").over(w).alias("older"), "newer").filter("older is not null")
    )


def _chunker(mask: int, longest: int):
    """Cuts the sorted rows of a partition into chunks and gives each row its chunk's first key and digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            pdf = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            # A chunk starts where the key's hash says so: the place depends on content alone, so that inserted
            # or removed rows shift no later boundary. Very long chunks are cut by length, which costs matches only.
            starts = ((pdf["h"] & mask) == 0) | (pdf["v"] != pdf["v"].shift())
            group = starts.cumsum()
            group = group * 1_000_000 + pdf.groupby(group).cumcount() // longest
            last = group.iloc[-1]
            rest = pdf[group == last].reset_index(drop=True)
            yield from _digest(pdf[group != last], group[group != last])
        if rest is not None and len(rest):
            yield from _digest(rest, pd.Series(0, index=rest.index))

    def _digest(pdf: pd.DataFrame, group: pd.Series) -> Iterator[pd.DataFrame]:
        if not len(pdf):
            return
        parts = []
        for _, g in pdf.groupby(group, sort=False):
            m = hashlib.blake2b(digest_size=16)
            for k, d in zip(g["k"], g["d"]):
                raw = k.encode("utf-8", "surrogatepass")
                m.update(len(raw).to_bytes(4, "little") + raw + d)
            parts.append(g[["v", "k", "d"]].assign(start=g["k"].iloc[0], chunk=m.digest()))
        yield pd.concat(parts, ignore_index=True)

    return run


def snapshot_changes(
    df: DataFrame,
    key: str,
    version: str,
    order_by: str,
    ignore: Sequence[str] = (),
    chunk_rows: int = 64,
) -> DataFrame:
    """Rows (version, key, change_kind) with change_kind inserted, updated or removed against the version before.

    Of several rows of a key in one version the one with the latest `order_by` counts (a null order_by is oldest;
    among equal ones the greatest digest, so the choice is stable). Rows without key or version are no records and
    are left out. Every column other than key, version, order_by and `ignore` is content, extra ones included; two
    contents are equal only if they are equal in every way. An empty table, or one version, gives no rows.

    Plan: each row is reduced to a 16-byte digest before anything is shuffled; sorted by (version, key) the digests
    are cut into content-defined chunks of about `chunk_rows` rows; chunks whose first key and digest stand in the
    other version of a pair too are dropped whole; only rows of the chunks left over meet in the key join.
    """
    skip = {key, version, order_by, *ignore}
    slim = (
        df.filter(F.col(key).isNotNull() & F.col(version).isNotNull())
        .select(
            F.col(version).alias("v"),
            F.col(key).cast("string").alias("k"),
            F.struct(F.col(order_by).alias("o"), row_digest([c for c in df.columns if c not in skip]).alias("d")).alias("od"),
        )
        .groupBy("v", "k")
        .agg(F.max("od")["d"].alias("d"))
    )
    slim = cut(slim.withColumn("h", F.xxhash64("k")))
    kind = dict(slim.dtypes)["v"]
    mask = (1 << max(0, chunk_rows - 1).bit_length()) - 1
    rows = cut(
        slim.repartitionByRange(parallelism(df.sparkSession), "v", "k")
        .sortWithinPartitions("v", "k")
        .mapInPandas(_chunker(mask, 64 * (mask + 1)), f"v {kind}, k string, d binary, start string, chunk binary")
    )
    pairs = version_pairs(df.filter(F.col(key).isNotNull() & F.col(version).isNotNull()), version)
    chunks = rows.select("v", "start", "chunk").distinct()
    new = pairs.join(chunks, pairs.newer == chunks.v).select("newer", "start", "chunk")
    old = pairs.join(chunks, pairs.older == chunks.v).select("newer", "start", "chunk")
    on = ["newer", "start", "chunk"]
    # One pass finds the chunks of only one side; `side` says whose they are.
    odd = (
        new.withColumn("n", F.lit(1)).withColumn("o", F.lit(0))
        .unionByName(old.withColumn("n", F.lit(0)).withColumn("o", F.lit(1)))
        .groupBy(*on).agg(F.sum("n").alias("n"), F.sum("o").alias("o"))
        .filter("n = 0 or o = 0")
        .join(pairs, "newer")
        .select("newer", "start", F.when(F.col("n") > 0, F.col("newer")).otherwise(F.col("older")).alias("v"))
    )
    kept = rows.select("v", "k", "d", "start").join(odd, ["v", "start"])
    is_new = F.col("v") == F.col("newer")
    return (
        kept.groupBy("newer", "k")
        .agg(F.max(F.when(is_new, F.col("d"))).alias("n"), F.max(F.when(~is_new, F.col("d"))).alias("o"))
        .filter(~F.col("n").eqNullSafe(F.col("o")))
        .select(
            F.col("newer").alias(version),
            F.col("k").alias(key),
            F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "removed").otherwise("updated").alias("change_kind"),
        )
    )
