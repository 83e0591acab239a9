"""Snapshots, references and drift: small cases and brute force."""

import datetime as dt
import json
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketlake.operators import drift, references, snapshots
from docketlake.plans import training


def rows(df):
    return sorted(tuple(r) for r in df.collect())


SNAP = "version int, key string, at int, text string, items array<string>, h string, chunk int"


def test_snapshots_small(spark):
    df = spark.createDataFrame(
        [
            (1, "a", 1, "x", [], "p", 1), (1, "b", 1, "x", None, None, 1), (1, "c", None, None, ["1", "2"], "", 1), (1, "c", 5, "new", ["1", "2"], "", 1),
            (1, None, 1, "x", [], "p", 1), (4, "a", 1, "x", [], "p", 1), (4, "a", 1, "x", [], "p", 1), (4, "b", 1, "x", [], None, 1),
            (4, "c", 5, "new", ["2", "1"], "", 1), (4, "d", 1, "", None, None, None), (9, "d", 1, None, None, None, None),
        ],
        SNAP,
    )
    got = rows(snapshots.snapshot_changes(df, "key", "version", "at"))
    assert got == [(4, "b", "updated"), (4, "c", "updated"), (4, "d", "inserted"), (9, "a", "removed"), (9, "b", "removed"), (9, "c", "removed"), (9, "d", "updated")]
    assert rows(snapshots.snapshot_changes(df.filter("version = 1"), "key", "version", "at")) == []
    assert rows(snapshots.snapshot_changes(df.limit(0), "key", "version", "at")) == []
    assert rows(snapshots.snapshot_changes(df.select("version", "key", "at"), "key", "version", "at"))[0] == (4, "d", "inserted")


def test_snapshots_against_brute_force(spark):
    rng = np.random.default_rng(3)
    keys = [f"K{i:05d}" for i in range(3000)]
    now, data, want = {k: 0 for k in keys}, [], []
    for v in (1, 2, 5):
        if v > 1:
            for k in rng.choice(keys, 40, replace=False):
                if k in now and rng.random() < 0.4:
                    del now[k]
                    want.append((v, k, "removed"))
                elif k in now:
                    now[k] += 1
                    want.append((v, k, "updated"))
                else:
                    now[k] = 0
                    want.append((v, k, "inserted"))
        data += [(v, k, 1, "long " * 500 + str(t)) for k, t in now.items()]
    df = spark.createDataFrame(pd.DataFrame(data, columns=["version", "key", "at", "text"]))
    assert rows(snapshots.snapshot_changes(df, "key", "version", "at", chunk_rows=16)) == sorted(want)


def test_matching_chunks_are_dropped():
    run = snapshots._chunker(7, 100)
    base = pd.DataFrame({"v": 1, "k": [f"{i:04d}" for i in range(500)], "d": [b"x" * 16] * 500, "h": [hash(str(i)) for i in range(500)]})
    other = pd.concat([base.iloc[:200], base.iloc[201:]]).assign(v=2)
    cut = [pd.concat(run(iter([t[:37], t[37:400], t[400:]]))) for t in (base, other)]
    a, b = (set(zip(t["start"], t["chunk"])) for t in cut)
    assert sum(map(len, cut)) == 999 and len(a & b) >= len(a) - 2


def test_references_small(spark):
    t = lambda m: dt.datetime(2020, m, 1)
    parents = spark.createDataFrame(
        [("A_1", t(2), None), ("A_2", t(1), t(3)), ("A_2", t(1), t(3)), ("A_2", t(5), None), ("A_3", None, None), ("B", t(1), None), (None, t(1), None), ("A_007", t(1), None)],
        "id string, start timestamp_ntz, end timestamp_ntz",
    )
    refs = [("A_1", 1), ("A_1", 2), ("A_2", 2), ("A_2", 3), ("A_2", 6), ("A_3", 6), ("A_4", 6), ("A_4", None), ("A_1", None), ("B", 6), ("B_1", 6), (None, 6), ("", 6), ("A_7", 6), ("A_007", 6), ("A_99999999999999999999", 6), ("A_1", 1)]
    df = spark.createDataFrame([("r", 7, i, m and t(m)) for i, m in refs], "ref_table string, ref_id long, id string, t timestamp_ntz")
    got = {(r.missing_id, r.reason, r.ref_month) for r in references.orphan_references(df, parents).collect()}
    assert got == {
        ("A_1", "late", "2020-01"), ("A_2", "deleted", "2020-03"), ("A_3", "late", "2020-06"), ("A_4", "missing", "2020-06"), ("A_4", "missing", None),
        ("B_1", "missing", "2020-06"), ("A_7", "missing", "2020-06"), ("A_99999999999999999999", "missing", "2020-06"),
    }
    assert references.orphan_references(df.limit(0), parents).count() == 0
    assert references.orphan_references(df, parents.limit(0)).filter("reason <> 'missing'").count() == 0


def test_runs_join_contiguous_numbers(spark):
    ids = spark.createDataFrame([(f"S_{n}",) for n in [*range(1, 2000), 5000, 65535, 65536, 65537]], "id string")
    assert rows(references.key_runs(ids).select("stem", "first", "last")) == [("S_", 1, 1999), ("S_", 5000, 5000), ("S_", 65535, 65535), ("S_", 65536, 65537)]


def brute_drift(pdf):
    """The definition, file by file, in plain Python."""
    files, dates = defaultdict(dict), {}
    for r in pdf.sort_values(["received_at", "line_no"]).itertuples():
        dates.setdefault(r.feed, {})[r.file_date] = r.file_name
        record = drift._object(r.raw_json)
        files[(r.feed, r.file_name)]
        if record is not None:
            files[(r.feed, r.file_name)][r.raw_json] = record
    out = []
    for feed, by_date in dates.items():
        names = [by_date[d] for d in sorted(by_date)]
        for older, newer in zip(names, names[1:]):
            lines = [list(files[(feed, n)].values()) for n in (older, newer)]
            kinds, values = [], []
            for records in lines:
                seen, by_id = defaultdict(Counter), {}
                for rec in records:
                    flat = dict(drift._walk(rec))
                    by_id[rec.get("statute_id")] = flat
                    for p, v in flat.items():
                        seen[p].update([drift._type(v)] if v is not None else [])
                kinds.append({p: min(c, key=lambda k: (-c[k], k)) if c else None for p, c in seen.items()})
                values.append(by_id)
            old, new = kinds
            ret = {p for p in old.keys() & new.keys() if old[p] and new[p] and old[p] != new[p]}
            rem, add = old.keys() - new.keys(), new.keys() - old.keys()
            ups = ret | rem | add
            top = lambda p: not any(p.startswith(u + ".") for u in ups)  # noqa: B023, E731
            rem, add = {p for p in rem if top(p)}, {p for p in add if top(p)}
            out += [(feed, newer, p, "retyped", f"{old[p]}>{new[p]}") for p in ret if top(p)]
            ids = (values[0].keys() & values[1].keys()) - {None}
            pairs = []
            for o in rem:
                for n in add:
                    both = [(values[0][i].get(o), values[1][i].get(n)) for i in ids]
                    both = [x for x in both if x != (None, None)]
                    same = sum(a is not None and b is not None and drift.canonical(a) == drift.canonical(b) for a, b in both)
                    if len(both) >= 3 and same >= 0.9 * len(both):
                        pairs.append((-same / len(both), o, n))
            for _, o, n in sorted(pairs):
                if o in rem and n in add:
                    out.append((feed, newer, n, "renamed", o))
                    rem.remove(o)
                    add.remove(n)
            out += [(feed, newer, p, "removed", "") for p in rem] + [(feed, newer, p, "added", "") for p in add]
    return sorted(out)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_drift_against_brute_force(spark, scale):
    path = f"/root/testdata/{scale}"
    want = brute_drift(pd.read_parquet(f"{path}/law_files.parquet"))
    assert want and rows(training.p4_found(spark, path)) == want


FILES = "feed string, file_name string, file_date date, received_at timestamp_ntz, line_no int, raw_json string, path string"


def lines(day, records, feed="f"):
    d = dt.date(2020, 1, day)
    return [(feed, f"{feed}/{day}", d, dt.datetime(2020, 2, day), i, r if r is None or isinstance(r, str) else json.dumps(r), "x") for i, r in enumerate(records)]


def test_drift_small(spark):
    first = [{"id": f"s{i}", "a": i, "n": {"x": [i]}, "gone": None, "t": 1} for i in range(5)]
    second = [{"id": f"s{i}", "b": float(i), "m": {"x": [i]}, "t": "1"} for i in range(5)]
    df = spark.createDataFrame(lines(1, [*first, first[0], None, "", "[1]", "{bad"]) + lines(2, second) + lines(3, []) + [(None, "z", None, None, 1, "{}", None)], FILES)
    got = rows(drift.schema_changes(df, "id"))
    assert got == [("f", "f/2", "b", "renamed", "a"), ("f", "f/2", "gone", "removed", ""), ("f", "f/2", "m", "renamed", "n"), ("f", "f/2", "t", "retyped", "number>string")]
    unified = drift.unified_records(df, "id").collect()
    assert len(unified) == 10 and all({"b", "m.x", "t", "id"} <= set(r.fields) for r in unified)
    assert rows(drift.schema_changes(df.limit(0), "id")) == [] and drift.unified_records(df.limit(0), "id").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=3, max_size=3), min_size=1, max_size=4))
def test_assignment_is_largest(table):
    from itertools import permutations

    w = np.array(table, float)
    got = sum(w[r, c] for r, c in drift.assign(w))
    n, m = w.shape
    pad = np.zeros((max(n, m),) * 2)
    pad[:n, :m] = w
    assert got == max(sum(pad[i, p[i]] for i in range(len(pad))) for p in permutations(range(len(pad))))
