"""Checks of drafts, quotes, names and checklists."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions import text as T


def first_like(texts: list[str], least: float) -> list[tuple[int, float]]:
    """(place of the first kept text it is like by `least`, matching-blocks ratio) of each text in turn.

    A text that is like no kept one is kept: its own place, 1.0.
    """
    kept, out = [], []
    matcher = difflib.SequenceMatcher()
    for i, t in enumerate(texts):
        matcher.set_seq2(t)
        hit = None
        for j in kept:
            matcher.set_seq1(texts[j])
            # both are upper bounds of the ratio
            if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least and (ratio := matcher.ratio()) >= least:
                hit = (j, ratio)
                break
        if hit is None:
            kept.append(i)
            hit = (i, 1.0)
        out.append(hit)
    return out


def same_id_copies(rows: DataFrame, id: str, key: str, text: str, least: float) -> DataFrame:
    """(key, kept_key, similarity): later rows of an id, by key, that are like a kept one by `least` or more.

    A row is compared with every kept row before it and goes to the first it is like; if there is none it is kept
    itself. Equal texts are collapsed before, so that an id's work is the square of its distinct kept texts. A null
    text is like nothing.
    """
    r = rows.filter(F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(key).alias("key"), F.col(text).alias("text")).withColumn("digest", F.sha2("text", 256))
    distinct = r.groupBy("id", "digest").agg(F.min("key").alias("key"), F.first("text").alias("text"))
    ids = distinct.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("key", "digest", "text"))).alias("t"))
    kinds = dict(r.dtypes)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["t"]):
                out += [(i, x["digest"], t[j]["key"], ratio) for x, (j, ratio) in zip(t, first_like([x["text"] for x in t], least))]
            yield pd.DataFrame(out, columns=["id", "digest", "kept_key", "similarity"])

    found = ids.filter(F.size("t") > 1).mapInPandas(fold, f"id {kinds['id']}, digest string, kept_key {kinds['key']}, similarity double")
    alone = ids.filter(F.size("t") == 1).select("id", F.col("t")[0]["digest"].alias("digest"), F.col("t")[0]["key"].alias("kept_key"), F.lit(1.0).alias("similarity"))
    return r.select("id", "digest", "key").join(found.unionByName(alone), ["id", "digest"]).filter("key <> kept_key").select(F.col("key").alias(key), "kept_key", "similarity")


def draft_checks(drafts: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(draft_id, problem) of drafts (draft_id, quote, source_text, value_date, term): NOT_VERBATIM, NOT_UNIQUE,
    DATE_NOT_IN_QUOTE, UNKNOWN_TERM. A null quote is not verbatim."""
    n = T.quote_places(F.coalesce("source_text", F.lit("")), F.coalesce("quote", F.lit("")))
    wrong = F.array_compact(
        F.array(
            F.when(n == 0, F.lit("NOT_VERBATIM")), F.when(n > 1, F.lit("NOT_UNIQUE")),
            F.when(F.col("value_date").isNotNull() & ~F.coalesce(F.array_contains(T.dates(F.col("quote")), F.col("value_date")), F.lit(False)), F.lit("DATE_NOT_IN_QUOTE")),
            F.when(F.col("term").isNotNull() & ~F.col("term").isin(*vocabulary), F.lit("UNKNOWN_TERM")),
        )
    )
    return drafts.select("draft_id", F.explode(wrong).alias("problem"))


def date_written(text: Column, day: Column) -> Column:
    """Whether a date stands in a text: 4.3.2020 (padded or not, with / or - or blanks), 4th of March 2020, Mar. 4, 2020
    or 2020-03-04; months by their first three letters, in any case."""
    d, y = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    m, word = F.month(day).cast("string"), F.substring(F.element_at(F.array(*map(F.lit, T.MONTHS)), F.month(day)), 1, 3)
    ordinal = F.concat(F.lit("0?"), d, F.lit("(?:st|nd|rd|th)?"))
    forms = (
        F.concat(F.lit(r"(?:^|[^0-9])0?"), d, F.lit(r"\s*[./-]\s*0?"), m, F.lit(r"\s*[./-]\s*"), y, F.lit("(?:[^0-9]|$)")),
        F.concat(F.lit(r"(?:^|[^0-9])"), ordinal, F.lit(r"\s+(?:of\s+)?"), word, F.lit(r"[a-z]*\.?,?\s+"), y),
        F.concat(word, F.lit(r"[a-z]*\.?\s+"), ordinal, F.lit(r",?\s+"), y),
        F.date_format(day, "yyyy-MM-dd"),
    )
    return F.regexp_like(F.lower(text), F.concat_ws("|", *forms))


def literal_problems(literals: DataFrame) -> DataFrame:
    """(fact_id, problem): key dates or amounts that their sources don't write. literals: fact_id, source_text, day, amount."""
    bad_day = F.col("day").isNotNull() & ~F.coalesce(date_written(F.col("source_text"), F.col("day")), F.lit(False))
    bad_sum = F.col("amount").isNotNull() & ~F.coalesce(F.array_contains(T.amounts(F.col("source_text")), F.col("amount").cast("bigint")), F.lit(False))
    return literals.select("fact_id", F.explode(F.array_compact(F.array(F.when(bad_day, F.lit("DATE_NOT_WRITTEN")), F.when(bad_sum, F.lit("AMOUNT_NOT_WRITTEN"))))).alias("problem"))


def units(c: Column, words: dict[str, int]) -> Column:
    """Numbers of a quote, alone and times each unit word that stands anywhere in it."""
    numbers = F.transform(T.numbers(c), lambda x: x.try_cast("double"))
    low = F.lower(c)
    factors = F.array_compact(F.array(F.lit(1.0), *[F.when(F.contains(low, F.lit(w)), F.lit(float(n))) for w, n in words.items()]))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(numbers, lambda x: F.transform(factors, lambda f: x * f)))))


def fidelity(claims: DataFrame, least: float) -> DataFrame:
    """(claim_id, rejected, reasons) of claims (claim_id, text, quote, known, exhibit_kind, has_exhibit, confidence, second).

    Rejected unless verbatim, of known ids, with an exhibit where the kind needs one, confident by `least`, and not
    denied by a second check; an unanswered second check keeps a rejection.
    """
    verbatim = F.coalesce(F.contains(T.squeeze(F.col("text")), T.squeeze(F.col("quote"))) & (F.col("quote") != ""), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(~verbatim, F.lit("NOT_VERBATIM")), F.when(~F.coalesce("known", F.lit(False)), F.lit("UNKNOWN_ID")),
            F.when(F.col("exhibit_kind") & ~F.coalesce("has_exhibit", F.lit(False)), F.lit("NO_EXHIBIT")), F.when(F.coalesce("confidence", F.lit(0.0)) < least, F.lit("LOW_CONFIDENCE")),
            F.when(F.col("second") == F.lit(False), F.lit("DENIED")),
        )
    )
    return claims.select("claim_id", (F.size(reasons) > 0).alias("rejected"), reasons.alias("reasons"))


def zero_confidence(readings: Column, text: Column, known: list[str]) -> Column:
    """Readings (name, quote, confidence): unknown names dropped, confidence 0 where the quote isn't verbatim."""
    kept = F.filter(readings, lambda r: r["name"].isin(*known))
    return F.transform(kept, lambda r: F.struct(r["name"].alias("name"), r["quote"].alias("quote"), F.when(F.contains(text, r["quote"]) & (r["quote"] != ""), r["confidence"]).otherwise(0.0).alias("confidence")))


def tracked_equality(claims: DataFrame, held: DataFrame) -> DataFrame:
    """(claim_id, key, state): HOLDS, FAILS, or UNKNOWN where no value is held; equality is exact, of decimals."""
    j = claims.join(held, "key", "left")
    same = F.col("claimed").cast("decimal(38,9)") == F.col("value").cast("decimal(38,9)")
    return j.select("claim_id", "key", F.when(F.col("value").isNull(), "UNKNOWN").when(same, "HOLDS").otherwise("FAILS").alias("state"))


def residual_names(texts: DataFrame, names: DataFrame, least: int = 4) -> DataFrame:
    """(doc_id, word, first_at): capitalised words of names that still stand in a text, in order of first place."""
    words = names.select(F.explode(F.split("name", "[^A-Za-z]+")).alias("word")).filter((F.length("word") >= least) & F.col("word").rlike("^[A-Z]")).distinct()
    said = texts.select("doc_id", F.posexplode(F.split("text", "[^A-Za-z]+")).alias("at", "word")).groupBy("doc_id", "word").agg(F.min("at").alias("first_at"))
    return said.join(words, "word").select("doc_id", "word", "first_at")


def pseudonyms(texts: DataFrame, forms: dict[str, str]) -> DataFrame:
    """Replaces names by their pseudonyms in `text`, longest form first; short capital forms keep to their case."""
    ordered = sorted(forms.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    out = F.col("text")
    for name, new in ordered:
        flags = "" if name.isupper() else "(?i)"
        out = F.regexp_replace(out, rf"{flags}(?<![A-Za-z]){_quote(name)}(?![A-Za-z])", new)
    return texts.withColumn("text", out)


def _quote(name: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in name)


def remove_running_text(lines: DataFrame, least: int) -> DataFrame:
    """(doc_id, text): header lines of `least` signs or more that stand twice in the body are cut out of it, longest first.

    lines: doc_id, header (array), body. One cut changes what the next one finds, so a document is rewritten in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for header, body in zip(pdf["header"], pdf["body"]):
                for h in sorted({h for h in header if h and len(h) >= least}, key=lambda h: (-len(h), h)) if header is not None and body is not None else ():
                    if body.count(h) >= 2:
                        body = body.replace(h, "")
                out.append(body)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": out})

    return lines.select("doc_id", "header", "body").mapInPandas(run, f"doc_id {dict(lines.dtypes)['doc_id']}, text string")


def header_line(lines: DataFrame, heading: str) -> DataFrame:
    """(doc_id, line): where the body starts: a line that is the heading alone, in any case, beats one that holds it in capitals."""
    own = F.regexp_replace(F.upper(F.trim("text")), r"\s+", "") == heading.upper().replace(" ", "")
    inside = F.contains("text", F.lit(heading.upper()))
    ranked = lines.withColumn("p", F.when(own, 0).when(inside, 1)).filter("p is not null")
    return ranked.groupBy("doc_id").agg(F.min(F.struct("p", "line"))["line"].alias("line"))


def json_value(c: Column, path: str) -> Column:
    """A scalar at a dotted path of JSON text; objects, arrays and what there isn't give null."""
    v = F.get_json_object(c, "$." + path)
    return F.when(~v.rlike(r"^\s*[\[{]"), v)
