"""Schemas that drift between the files of a feed: profile, match, report and unify."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlake.plans.session import cut

#: Files of a feed are keyed by these.
FILE = ["feed", "file_name", "file_date"]
#: Share of equal values, as a fraction, and number of comparable records that a rename needs.
RENAME_SHARE = (9, 10)
RENAME_LEAST = 3


def _type(v: object) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (int, float)):
        return "number"
    return "array" if isinstance(v, list) else "object"


def canonical(v: object) -> str:
    """JSON text that is equal for equal JSON values: keys sorted, 1 and 1.0 alike, true and 1 not."""
    if isinstance(v, dict):
        return "{" + ",".join(json.dumps(k) + ":" + canonical(v[k]) for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(canonical, v)) + "]"
    if isinstance(v, float):
        if v != v or v in (float("inf"), float("-inf")):
            return repr(v)
        return str(int(v)) if v.is_integer() else str(Fraction(v))
    return json.dumps(v)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _object(raw: str | None) -> dict | None:
    try:
        v = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def _walk(record: dict, before: str = "") -> Iterator[tuple[str, object]]:
    stack = [(before, record)]
    while stack:
        at, node = stack.pop()
        for k, v in node.items():
            path = f"{at}.{k}" if at else k
            yield path, v
            if isinstance(v, dict):
                stack.append((path, v))


def _parser(record_key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep, ids, marks, fields = [], [], [], []
            for i, raw in enumerate(pdf["raw_json"]):
                record = _object(raw)
                if record is None:
                    continue
                keep.append(i)
                own = record.get(record_key)
                ids.append(own if isinstance(own, str) else None if own is None else canonical(own))
                marks.append(_hash(raw))
                fields.append([{"path": p, "kind": _type(v), "value": None if v is None else _hash(canonical(v))} for p, v in _walk(record)])
            if not keep:
                continue
            yield pdf.iloc[keep][[*FILE, "received_at", "line_no"]].assign(record_id=ids, mark=marks, fields=fields)

    return run


def parse_lines(files: DataFrame, record_key: str) -> DataFrame:
    """One row per distinct line that is a JSON object: file, record_id, fields (path, kind, value hash), latest.

    `latest` marks, of several lines of a record id in a file, the one that was received last (then the highest line
    number); its values stand for the record. Lines that are no JSON object (null, blank, broken, a list) are left out.
    """
    kinds = dict(files.dtypes)
    out = (
        f"feed {kinds['feed']}, file_name {kinds['file_name']}, file_date {kinds['file_date']}, received_at {kinds['received_at']}, "
        f"line_no {kinds['line_no']}, record_id string, mark bigint, fields array<struct<path:string,kind:string,value:bigint>>"
    )
    lines = files.select(*FILE, "received_at", "line_no", "raw_json").filter("feed is not null and file_name is not null and file_date is not null").mapInPandas(_parser(record_key), out)
    # One shuffle serves both the removal of repeated lines and the choice of the latest line of a record.
    by = ["feed", "file_name", "record_id"]
    once = (
        lines.repartition(*by)
        .groupBy(*FILE, "record_id", "mark")
        .agg(F.max(F.struct("received_at", "line_no", "mark")).alias("at"), F.first("fields").alias("fields"))
    )
    w = Window.partitionBy(*by).orderBy(F.desc("at"))
    return once.withColumn("latest", F.col("record_id").isNotNull() & (F.row_number().over(w) == 1)).drop("at")


def profile(entries: DataFrame) -> DataFrame:
    """(file, path, kind): the kind of most non-null values of a path in a file (ties: first by alphabet), or null."""
    counts = entries.groupBy(*FILE, "path", "kind").agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col("kind").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("kind"))))
    return counts.groupBy(*FILE, "path").agg(best["kind"].alias("kind"))


def file_pairs(files: DataFrame) -> DataFrame:
    """(feed, file_name, older): each file and the one of its feed with the next earlier date (of several, the last by name)."""
    dates = files.groupBy("feed", "file_date").agg(F.max("file_name").alias("name"))
    w = Window.partitionBy("feed").orderBy("file_date")
    before = dates.select("feed", "file_date", F.lag("name").over(w).alias("older"))
    return files.select(*FILE).distinct().join(before, ["feed", "file_date"]).filter("older is not null").select("feed", "file_name", "older")


def _below(changes: DataFrame) -> DataFrame:
    """Leaves out paths below another changed path of the same pair of files."""
    up = F.expr("transform(sequence(1, greatest(size(split(path, '[.]')) - 1, 1)), i -> concat_ws('.', slice(split(path, '[.]'), 1, i)))")
    deep = changes.filter(F.instr("path", ".") > 0).select("feed", "file_name", "path", F.explode(up).alias("above"))
    tops = changes.select("feed", "file_name", F.col("path").alias("above")).distinct()
    hidden = deep.join(tops, ["feed", "file_name", "above"]).select("feed", "file_name", "path").distinct()
    return changes.join(hidden, ["feed", "file_name", "path"], "left_anti")


def assign(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a largest-weight bipartite matching; weights at or below zero are no edges.

    Shortest augmenting paths with row and column prices, one path a row.
    """
    n, m = weights.shape
    size = max(n, m)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : n + 1, 1 : m + 1] = -np.maximum(weights, 0)
    price_r, price_c = np.zeros(size + 1), np.zeros(size + 1)
    owner, came = np.zeros(size + 1, int), np.zeros(size + 1, int)
    for row in range(1, size + 1):
        owner[0], col = row, 0
        slack, seen = np.full(size + 1, np.inf), np.zeros(size + 1, bool)
        while owner[col]:
            seen[col] = True
            r = owner[col]
            left = cost[r] - price_r[r] - price_c
            better = ~seen & (left < slack)
            slack[better], came[better] = left[better], col
            free = np.where(seen, np.inf, slack)
            free[0] = np.inf
            step = free.argmin()
            delta = free[step]
            price_r[owner[seen]] += delta
            price_c[seen] -= delta
            slack[~seen] -= delta
            col = step
        while col:
            owner[col], col = owner[came[col]], came[col]
    return [(r - 1, c - 1) for c in range(1, m + 1) if 0 < (r := owner[c]) <= n and weights[r - 1, c - 1] > 0]


def _match(pdf: pd.DataFrame) -> pd.DataFrame:
    olds, news = sorted(set(pdf["old_path"])), sorted(set(pdf["path"]))
    w = np.zeros((len(olds), len(news)))
    at_old, at_new = {p: i for i, p in enumerate(olds)}, {p: i for i, p in enumerate(news)}
    for o, n, s in zip(pdf["old_path"], pdf["path"], pdf["score"]):
        w[at_old[o], at_new[n]] = s
    got = assign(w)
    return pd.DataFrame({"feed": pdf["feed"].iloc[0], "file_name": pdf["file_name"].iloc[0], "path": [news[c] for _, c in got], "old_path": [olds[r] for r, _ in got]})


def schema_changes(files: DataFrame, record_key: str) -> DataFrame:
    """Rows (feed, file_name, field_path, change_kind, detail) of each file against the one of its feed before it.

    files: feed, file_name, file_date, received_at, line_no, raw_json; other columns are ignored, rows without feed,
    file name or date left out. Kinds: retyped (detail old>new), added, removed, renamed (detail the old path). Paths
    below a changed path are not reported; a path whose values are all null has no type and is not retyped. An empty
    table or a feed of one file gives no rows.

    Plan: each line is parsed once, in Arrow batches, to (path, type, value hash); types and presence are counted with
    map-side aggregation. Only values of paths that were added or removed meet, by record id and value hash; renames
    are a largest-weight bipartite matching of the few candidate paths of each pair of files, weighed by the share of
    equal values, then by value sketches (HyperLogLog), type and likeness of the names.
    """
    lines = cut(parse_lines(files, record_key))
    return _changes(lines)


def _changes(lines: DataFrame) -> DataFrame:
    entries = lines.select(*FILE, F.inline("fields"))
    paths = cut(profile(entries))
    pairs = cut(file_pairs(lines.select(*FILE).distinct()))
    new = pairs.join(paths.drop("file_date"), ["feed", "file_name"]).select("feed", "file_name", "path", F.col("kind").alias("new"), F.lit(1).alias("n"))
    old = pairs.join(paths.drop("file_date").withColumnRenamed("file_name", "older"), ["feed", "older"]).select("feed", "file_name", "path", F.col("kind").alias("old"), F.lit(1).alias("o"))
    both = new.join(old, ["feed", "file_name", "path"], "full")
    kind = (
        F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed")
        .when(F.col("old") != F.col("new"), "retyped")
    )
    changes = cut(_below(both.withColumn("change_kind", kind).filter("change_kind is not null").select("feed", "file_name", "path", "change_kind", "old", "new")))
    renames = cut(_renames(lines, pairs, changes))
    gone = renames.select("feed", "file_name", F.col("old_path").alias("path"), F.lit("removed").alias("change_kind"))
    come = renames.select("feed", "file_name", "path", F.lit("added").alias("change_kind"))
    rest = changes.join(gone.unionByName(come), ["feed", "file_name", "path", "change_kind"], "left_anti")
    detail = F.when(F.col("change_kind") == "retyped", F.concat("old", F.lit(">"), "new")).otherwise("")
    return rest.select("feed", "file_name", F.col("path").alias("field_path"), "change_kind", detail.alias("detail")).unionByName(
        renames.select("feed", "file_name", F.col("path").alias("field_path"), F.lit("renamed").alias("change_kind"), F.col("old_path").alias("detail"))
    )


def _renames(lines: DataFrame, pairs: DataFrame, changes: DataFrame) -> DataFrame:
    pair = ["feed", "file_name"]
    # Only pairs of files with both an added and a removed path can hold a rename.
    open_pairs = changes.groupBy(*pair).agg(F.count_if(F.col("change_kind") == "added").alias("a"), F.count_if(F.col("change_kind") == "removed").alias("r")).filter("a > 0 and r > 0").select(*pair)
    pairs = pairs.join(open_pairs, pair)
    latest = lines.filter("latest").select("feed", "file_name", "record_id", "fields")
    new_ids = latest.join(pairs, pair).select("feed", "file_name", "record_id", "fields")
    old_ids = latest.withColumnRenamed("file_name", "older").join(pairs, ["feed", "older"]).select("feed", "file_name", "record_id", F.col("fields").alias("old_fields"))
    # One row a record that stands in both files, with the fields of either.
    common = new_ids.join(old_ids, [*pair, "record_id"])
    added = changes.filter("change_kind = 'added'").select(*pair, "path")
    removed = changes.filter("change_kind = 'removed'").select(*pair, F.col("path").alias("old_path"))
    n_vals = cut(
        common.select(*pair, "record_id", F.inline("fields")).filter("value is not null")
        .join(added, [*pair, "path"]).select(*pair, "record_id", "path", "kind", "value")
    )
    o_vals = cut(
        common.select(*pair, "record_id", F.inline("old_fields")).filter("value is not null")
        .select(*pair, "record_id", F.col("path").alias("old_path"), F.col("kind").alias("old_kind"), "value")
        .join(removed, [*pair, "old_path"])
    )
    n_sum = n_vals.groupBy(*pair, "path").agg(F.count("*").alias("n"), F.hll_sketch_agg("value", F.lit(10)).alias("n_sketch"), F.max("kind").alias("kind"))
    o_sum = o_vals.groupBy(*pair, "old_path").agg(F.count("*").alias("o"), F.hll_sketch_agg("value", F.lit(10)).alias("o_sketch"), F.max("old_kind").alias("old_kind"))
    equal = (
        o_vals.join(n_vals, [*pair, "record_id", "value"])
        .groupBy(*pair, "old_path", "path").agg(F.count("*").alias("equal"))
        .filter(F.col("equal") * RENAME_SHARE[1] >= RENAME_LEAST * RENAME_SHARE[0])
    )
    together = (
        o_vals.select(*pair, "record_id", "old_path").join(equal, [*pair, "old_path"])
        .join(n_vals.select(*pair, "record_id", "path"), [*pair, "record_id", "path"])
        .groupBy(*pair, "old_path", "path").agg(F.max("equal").alias("equal"), F.count("*").alias("both"))
    )
    alike = F.hll_sketch_estimate("o_sketch") + F.hll_sketch_estimate("n_sketch") - F.hll_sketch_estimate(F.hll_union("o_sketch", "n_sketch"))
    alike = F.try_divide(alike, F.greatest(F.hll_sketch_estimate("o_sketch"), F.hll_sketch_estimate("n_sketch"), F.lit(1)))
    name = 1 - F.levenshtein("old_path", "path") / F.greatest(F.length("old_path"), F.length("path"), F.lit(1))
    score = F.col("equal") / F.col("any") + 0.01 * alike + 0.01 * (F.col("kind") == F.col("old_kind")).cast("int") + 0.001 * name
    candidates = (
        together.join(n_sum, [*pair, "path"]).join(o_sum, [*pair, "old_path"])
        .withColumn("any", F.col("n") + F.col("o") - F.col("both"))
        .filter((F.col("any") >= RENAME_LEAST) & (F.col("equal") * RENAME_SHARE[1] >= F.col("any") * RENAME_SHARE[0]))
        .select(*pair, "old_path", "path", F.coalesce(score, F.lit(0.0)).alias("score"))
    )
    kinds = dict(lines.dtypes)
    return candidates.groupBy(*pair).applyInPandas(_match, f"feed {kinds['feed']}, file_name {kinds['file_name']}, path string, old_path string")


def _identities(pdf: pd.DataFrame) -> pd.DataFrame:
    """Follows the renames of one feed through its files: each path of a file gets the last name of its field."""
    now: dict[str, int] = {}
    last: dict[int, str] = {}
    out = []
    for _, file in pdf.sort_values(["file_date", "file_name"]).groupby(["file_date", "file_name"], sort=True):
        paths = set(file["path"])
        moved = {p: o for p, o in zip(file["path"], file["old_path"]) if isinstance(o, str)}
        own = {}
        for p in sorted(paths):
            i = now.get(moved.get(p, p))
            if i is None:
                i = len(last)
            last[i] = p
            own[p] = i
        now = {**{p: i for p, i in now.items() if p not in moved.values()}, **own}
        out += [(file["feed"].iloc[0], file["file_name"].iloc[0], p, i) for p, i in own.items()]
    return pd.DataFrame([(f, n, p, last[i]) for f, n, p, i in out], columns=["feed", "file_name", "path", "field"])


def _leaves(record_key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for feed, name, date, at, line, raw in zip(*(pdf[c] for c in (*FILE, "received_at", "line_no", "raw_json"))):
                record = _object(raw)
                if record is None:
                    continue
                own = record.get(record_key)
                own = own if isinstance(own, str) else None if own is None else canonical(own)
                text = {p: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for p, v in _walk(record) if not isinstance(v, dict) and v is not None}
                out.append((feed, name, date, at, line, own, _hash(raw), list(text.items())))
            if out:
                yield pd.DataFrame(out, columns=[*FILE, "received_at", "line_no", "record_id", "mark", "fields"])

    return run


def unified_records(files: DataFrame, record_key: str) -> DataFrame:
    """All records in one table: file, line, record_id and `fields`, a map from the field's last name to its value.

    A field that was renamed has one name throughout its feed: the last one. Values are strings as they stand, other
    values as JSON, so that a retyped field stays one column; nested objects are leaves with dotted names. Repeated
    lines count once (the first line number is given). Lines that are no JSON object are left out. If two fields of a
    record end under one name, the one that bears the name in the file counts.
    """
    lines = cut(parse_lines(files, record_key))
    changes = _changes(lines)
    seen = lines.select(*FILE, F.inline("fields")).select(*FILE, "path").distinct()
    moved = changes.filter("change_kind = 'renamed'").select("feed", "file_name", F.col("field_path").alias("path"), F.col("detail").alias("old_path"))
    kinds = dict(files.dtypes)
    # A renamed object carries the paths below it along.
    up = F.expr("transform(sequence(1, size(split(path, '[.]'))), i -> concat_ws('.', slice(split(path, '[.]'), 1, i)))")
    above = seen.withColumn("above", F.explode(up)).join(moved.withColumnRenamed("path", "above"), ["feed", "file_name", "above"])
    moved_all = above.groupBy("feed", "file_name", "path").agg(F.max(F.struct(F.length("above").alias("l"), F.concat("old_path", F.expr("substring(path, length(above) + 1)")).alias("old_path")))["old_path"].alias("old_path"))
    names = (
        seen.join(moved_all, ["feed", "file_name", "path"], "left")
        .groupBy("feed").applyInPandas(_identities, f"feed {kinds['feed']}, file_name {kinds['file_name']}, path string, field string")
    )
    raw = files.filter("feed is not null and file_name is not null and file_date is not null").select(*FILE, "received_at", "line_no", "raw_json")
    out = ", ".join(f"{c} {kinds[c]}" for c in (*FILE, "received_at", "line_no")) + ", record_id string, mark bigint, fields array<struct<path:string,value:string>>"
    rows = raw.mapInPandas(_leaves(record_key), out)
    once = rows.groupBy(*FILE, "record_id", "mark").agg(F.min("line_no").alias("line_no"), F.first("fields").alias("fields"))
    entries = once.select(*FILE, "line_no", "record_id", "mark", F.explode_outer("fields").alias("f")).select(*FILE, "line_no", "record_id", "mark", F.col("f.path").alias("path"), F.col("f.value").alias("value"))
    named = entries.join(names, ["feed", "file_name", "path"], "left")
    one = named.groupBy(*FILE, "line_no", "record_id", "mark", "field").agg(F.max(F.struct((F.col("field") == F.col("path")).alias("own"), "path", "value"))["value"].alias("value"))
    return one.groupBy(*FILE, "line_no", "record_id", "mark").agg(
        F.map_from_entries(F.filter(F.array_sort(F.collect_list(F.struct("field", "value"))), lambda e: e["field"].isNotNull())).alias("fields")
    ).drop("mark")
