"""Case records: views, sealed access, item lists, source ids, references between drafts and records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Session states after which the truth about a case may be read.
UNSEALED = ("VERDICT", "EVALUATED", "REFLECTED")


def allow(rows: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Only the allowed columns; unknown names are an error, so a view can't grow by accident."""
    lost = [c for c in allowed if c not in rows.columns]
    if lost:
        raise ValueError(f"no such columns: {', '.join(lost)}")
    return rows.select(*allowed)


def agent_view(cases: DataFrame, hidden: Sequence[str], known: Sequence[str]) -> DataFrame:
    """The case without its hidden columns; a column the schema doesn't know fails."""
    odd = [c for c in cases.columns if c not in known]
    if odd:
        raise ValueError(f"unknown fields: {', '.join(odd)}")
    return cases.drop(*hidden)


def part(precedents: DataFrame, key: str, parts: dict[str, Sequence[str]], name: str) -> DataFrame:
    """(key, text): the fields of a part joined by line feeds; null and empty ones add nothing."""
    fields = [F.when(F.length(F.col(c)) > 0, F.col(c)) for c in parts[name]]
    return precedents.select(key, F.concat_ws("\n", *fields).alias("text"))


def permitted(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds `scope` and `allowed` to requests (role, store, op) by the policy (role, store, op, scope); none: refused."""
    return requests.join(policy, ["role", "store", "op"], "left").withColumn("allowed", F.col("scope").isNotNull())


def unsealed(truth: DataFrame, sessions: DataFrame) -> DataFrame:
    """Truth rows (case_id) that may be read: a session about the case has reached a state after the verdict."""
    done = sessions.filter(F.col("state").isin(*UNSEALED)).select("case_id").distinct()
    return truth.join(done, "case_id", "left_semi")


def reviewable(truth: DataFrame, sessions: DataFrame) -> DataFrame:
    """Truth rows of cases no session exists for yet."""
    return truth.join(sessions.select("case_id").distinct(), "case_id", "left_anti")


def own_turns(private: DataFrame, sessions: DataFrame, side: str) -> DataFrame:
    """A side's private turns of sessions past the verdict, in order of turn."""
    done = sessions.filter(F.col("state").isin(*UNSEALED)).select("session_id").distinct()
    return private.filter(F.col("side") == side).join(done, "session_id", "left_semi").orderBy("session_id", "turn")


def current_predicates(predicates: DataFrame, items: DataFrame) -> DataFrame:
    """Approved predicates whose item (statute_id, field, item_index) still has the hash they were written for."""
    now = items.select("statute_id", "field", F.col("pos").alias("item_index"), F.col("hash").alias("now"))
    return predicates.filter("status = 'APPROVED'").join(now, ["statute_id", "field", "item_index"]).filter("now = item_hash").drop("now")


def approved_text(texts: DataFrame, approvals: DataFrame) -> DataFrame:
    """(name, usable): a text is usable only if its exact sha256 is approved under its name."""
    ok = approvals.filter("status = 'APPROVED'").select("name", F.col("sha256").alias("h"), F.lit(True).alias("ok")).distinct()
    return texts.withColumn("h", F.sha2("text", 256)).join(ok, ["name", "h"], "left").select("name", F.coalesce("ok", F.lit(False)).alias("usable"))


def flatten_items(cases: DataFrame, lists: dict[str, str]) -> DataFrame:
    """(case_id, item_id, kind, claim, sources): several lists of items of a case as one; lists: column to kind.

    Each list holds structs (id, claim, sources). A null list has no items.
    """
    out = None
    for column, kind in lists.items():
        one = cases.select("case_id", F.explode(column).alias("i")).select("case_id", F.col("i.id").alias("item_id"), F.lit(kind).alias("kind"), F.col("i.claim").alias("claim"), F.col("i.sources").alias("sources"))
        out = one if out is None else out.unionByName(one)
    return out


def without_dates(cases: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Cases without the key dates of these labels, and which labels a case lacked (column `absent`)."""
    kept = F.filter("key_dates", lambda d: ~d["label"].isin(*labels))
    absent = F.array_except(F.array(*map(F.lit, labels)), F.transform("key_dates", lambda d: d["label"]))
    return cases.withColumn("absent", absent).withColumn("key_dates", kept)


def ambiguous_lookup(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(wanted, uid): by uid if the id contains '#', else by bare id, and then only if exactly one row carries it."""
    by_id = rows.groupBy("precedent_id").agg(F.count("*").alias("n"), F.min("uid").alias("one")).filter("n = 1").select(F.col("precedent_id").alias("wanted"), F.col("one").alias("b"))
    by_uid = rows.select(F.col("uid").alias("wanted"), F.col("uid").alias("a")).distinct()
    j = wanted.select("wanted").distinct().join(by_uid, "wanted", "left").join(by_id, "wanted", "left")
    return j.select("wanted", F.when(F.contains("wanted", F.lit("#")), F.col("a")).otherwise(F.col("b")).alias("uid"))


def source_text(ids: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(case_id, source_id, text): P4 is a paragraph, P4.S1 its first sentence; what there isn't is '(not found)'.

    paragraphs: case_id, para_id, sentences.
    """
    split = F.split("source_id", r"\.S")
    j = ids.withColumn("para_id", split[0]).withColumn("n", F.try_element_at(split, F.lit(2)).try_cast("int")).join(paragraphs, ["case_id", "para_id"], "left")
    sentence = F.when(F.col("n") >= 1, F.try_element_at("sentences", F.col("n")))
    text = F.when(F.size(split) == 1, F.array_join("sentences", " ")).otherwise(sentence)
    return j.select("case_id", "source_id", F.coalesce(text, F.lit("(not found)")).alias("text"))


def invisible_sources(items: DataFrame, visible: DataFrame) -> DataFrame:
    """(case_id, item_id, source_id): sources of draft items that are not visible. visible: case_id, source_id."""
    return items.select("case_id", "item_id", F.explode("sources").alias("source_id")).join(visible, ["case_id", "source_id"], "left_anti").select("case_id", "item_id", "source_id").distinct()


def reconcile(findings: DataFrame, framed: DataFrame) -> DataFrame:
    """(case_id, issue_id, problem): findings without a framed issue (NOT_FRAMED) and issues without a finding (NO_FINDING)."""
    f = findings.select("case_id", "issue_id").distinct().withColumn("f", F.lit(True))
    g = framed.select("case_id", "issue_id").distinct().withColumn("g", F.lit(True))
    p = F.when(F.col("g").isNull(), "NOT_FRAMED").when(F.col("f").isNull(), "NO_FINDING")
    return f.join(g, ["case_id", "issue_id"], "full").select("case_id", "issue_id", p.alias("problem")).filter("problem is not null")


def exclusion_closure(excluded: DataFrame, renamed: DataFrame) -> DataFrame:
    """(id): excluded ids and what they were renamed or folded into. renamed: old_id, new_id."""
    return excluded.select("id").unionByName(excluded.join(renamed, excluded.id == renamed.old_id).select(F.col("new_id").alias("id"))).distinct()


def first_occurrence(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def suffixes(rows: DataFrame, id: str, digest: str, order: Sequence[str]) -> DataFrame:
    """Adds `new_id`: of unlike contents under one id the first keeps it, later ones get _B, _C and so on; equal ones share."""
    first = rows.groupBy(id, digest).agg(F.min(F.struct(*order)).alias("at"))
    n = F.row_number().over(Window.partitionBy(id).orderBy("at"))
    tail = F.when(n == 1, "").when(n <= 26, F.concat(F.lit("_"), F.chr(n + 64))).otherwise(F.concat(F.lit("_"), n.cast("string")))
    return rows.join(first.withColumn("new_id", F.concat(F.col(id).cast("string"), tail)).drop("at"), [id, digest])


def ticks(items: DataFrame, ticked: DataFrame) -> DataFrame:
    """(case_id, done): whether every item of a case is ticked ok."""
    return items.join(ticked, ["case_id", "item_id"], "left").groupBy("case_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("done"))


def plan_guards(plan: DataFrame, mode: str, barred: Sequence[str]) -> DataFrame:
    """(case_id, rule): cases of a barred split, TEST cases in LEARN mode, and cases planned twice."""
    bad = F.array_compact(F.array(F.when(F.col("split").isin(*barred), F.lit("BARRED_SPLIT")), F.when((F.col("split") == "TEST") & F.lit(mode == "LEARN"), F.lit("TEST_IN_LEARN"))))
    own = plan.select("case_id", F.explode(bad).alias("rule"))
    return own.unionByName(plan.groupBy("case_id").count().filter("count > 1").select("case_id", F.lit("PLANNED_TWICE").alias("rule"))).distinct()


def evidence_class(findings: DataFrame) -> DataFrame:
    """(case_id, class): LAW_ONLY, EVIDENCE_DECIDED or MIXED by the drivers of a case's findings."""
    d = findings.groupBy("case_id").agg(F.collect_set("driver").alias("d"))
    only = lambda v: F.col("d") == F.array(F.lit(v))
    return d.select("case_id", F.when(only("LAW"), "LAW_ONLY").when(only("EVIDENCE"), "EVIDENCE_DECIDED").otherwise("MIXED").alias("class"))


def court_numbering(lines: DataFrame, most_first: int, jump: int) -> DataFrame:
    """(doc_id, line, number): lines that open a numbered paragraph.

    A line's leading number opens one if none was opened yet and it is at most most_first, or if it is above the last
    opened one by no more than `jump`. Each answer depends on the one before, so a document's candidates are folded in
    order; only lines that start with a number are collected.
    """
    n = F.regexp_extract("text", r"^\s*([0-9]{1,4})[.)]", 1)
    c = lines.select("doc_id", "line", n.try_cast("int").alias("n")).filter("n is not null")
    all_c = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "n"))).alias("c"))
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<struct<line:int,n:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        opens = F.when(s["last"].isNull(), x["n"] <= most_first).otherwise((x["n"] > s["last"]) & (x["n"] <= s["last"] + jump))
        hit = F.struct(x["line"].cast("int").alias("line"), x["n"].alias("n"))
        return F.struct(F.when(opens, x["n"]).otherwise(s["last"]).alias("last"), F.when(opens, F.concat(s["out"], F.array(hit))).otherwise(s["out"]).alias("out"))

    return all_c.select("doc_id", F.inline(F.aggregate("c", start, step)["out"])).withColumnRenamed("n", "number")
