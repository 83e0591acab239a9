"""Overlap between texts and entities: n-gram leakage, shared names, furniture lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.text import appeal_numbers, n_gram_hashes, words

# Words that name kinds of companies and parties, and so tell none apart. Words of trades are a parameter.
GENERIC = "ltd limited llp pvt private holdings industries company corporation and the of vs anr ors bank".split()


def distinctive(c: Column, least: int = 3, generic: Sequence[str] = GENERIC) -> Column:
    """Distinct words of a name, in order, that tell it apart: no generic ones, of `least` letters or more."""
    return F.array_distinct(F.filter(words(c), lambda w: (F.length(w) >= least) & ~w.isin(*generic)))


def leakage(views: DataFrame, sealed: DataFrame, visible: DataFrame | None, n: int) -> DataFrame:
    """(key, source_id, n_leaked): n-grams of sealed texts that stand in the view of the same key but not in what was visible.

    views: key, text; sealed: key, source_id, text; visible: key, text. The grams join by key and gram, so a common gram
    meets only its own key; grams are hashed to eight bytes before the shuffle.
    """

    def grams(df: DataFrame, *keep: str) -> DataFrame:
        return df.filter("key is not null").select(*keep, F.explode(n_gram_hashes(words(F.col("text")), n)).alias("g")).distinct()

    wanted = grams(sealed, "key", "source_id")
    # Only the keys that have sealed texts need their views cut into runs.
    seen = grams(views.join(sealed.select("key").distinct(), "key", "left_semi"), "key")
    if visible is not None:
        seen = seen.join(grams(visible, "key"), ["key", "g"], "left_anti")
    return wanted.join(seen, ["key", "g"], "left_semi").groupBy("key", "source_id").agg(F.count("*").alias("n_leaked"))


def shared_names(titles: DataFrame, names: DataFrame, needed: int = 2, generic: Sequence[str] = GENERIC, case_numbers: DataFrame | None = None) -> DataFrame:
    """(title_id, name_id, n_shared, reason): titles that seem to concern the same dispute as a name's.

    titles: title_id, text and, with case_numbers, numbers (array of 'n/yyyy'); names: name_id, text, variants, kind,
    role. A PERSON counts only with a role in the cause title and by all the distinctive words, `needed` or more, of one
    form of the name. Of banks and authorities a word counts only together with a shared number: reason NUMBER. Of any
    other party the first distinctive word and `needed` words, of the name or its variants, must be there. reason NAME.
    case_numbers: name_id, number: the numbers of the case a name belongs to.

    The join is on the rarest word of a form that must be there, so that a frequent word brings few titles together; the
    rest is counted on the pair.
    """
    t = titles.select("title_id", distinctive(F.col("text"), 1, ()).alias("t"), *(["numbers"] if case_numbers is not None else []))
    n = names.select("name_id", "kind", "role", distinctive(F.col("text"), generic=generic).alias("n"), F.coalesce("variants", F.array().cast("array<string>")).alias("variants")).distinct()
    every = F.transform(F.concat(F.array(F.array_join("n", " ")), F.transform("variants", lambda v: F.array_join(distinctive(v, generic=generic), " "))), lambda s: F.filter(F.split(s, " "), lambda w: w != ""))
    person = n.filter("kind = 'PERSON' and role is not null").select("name_id", F.explode(every).alias("must")).filter(F.size("must") >= needed)
    person = person.select("name_id", "must", F.col("must").alias("all"), F.size("must").alias("needed"))
    firm = n.filter("kind not in ('PERSON', 'BANK', 'AUTHORITY') and size(n) > 0")
    firm = firm.select("name_id", F.slice("n", 1, 1).alias("must"), F.array_distinct(F.flatten(every)).alias("all"), F.lit(needed).alias("needed"))
    forms = person.unionByName(firm).distinct()
    said = t.select("title_id", F.explode("t").alias("w"))
    common = said.groupBy("w").agg(F.count("*").alias("df"))
    must = forms.select("*", F.explode("must").alias("w")).join(common, "w")
    rare = must.groupBy("name_id", "must", "all", "needed").agg(F.min(F.struct("df", "w"))["w"].alias("w"))
    shared = F.size(F.array_intersect("t", "all"))
    met = said.join(rare, "w").join(t.select("title_id", "t"), "title_id").withColumn("n_shared", shared)
    by_name = met.filter((F.size(F.array_except("must", "t")) == 0) & (F.col("n_shared") >= F.col("needed"))).groupBy("title_id", "name_id").agg(F.max("n_shared").alias("n_shared"))
    out = by_name.withColumn("reason", F.lit("NAME"))
    if case_numbers is None:
        return out
    numbered = t.select("title_id", "t", F.explode("numbers").alias("number")).join(case_numbers.select("name_id", "number").distinct(), "number")
    word = numbered.join(n.select("name_id", F.array_distinct(F.flatten(every)).alias("all")), "name_id").withColumn("n_shared", F.size(F.array_intersect("t", "all")))
    by_number = word.filter("n_shared > 0").groupBy("title_id", "name_id").agg(F.max("n_shared").alias("n_shared")).withColumn("reason", F.lit("NUMBER"))
    return out.unionByName(by_number.join(by_name, ["title_id", "name_id"], "left_anti"))


def identified(answers: DataFrame, names: DataFrame, case_numbers: DataFrame, needed: int = 2, generic: Sequence[str] = GENERIC) -> DataFrame:
    """(case_id, known): whether an answer to 'which case is this?' names a party, by `needed` distinctive words or all it
    has, or a number of the case. answers: case_id, text; names: case_id, name; case_numbers: case_id, number."""
    a = answers.select("case_id", words(F.col("text")).alias("t"), appeal_numbers(F.col("text")).alias("numbers"))
    n = names.select("case_id", distinctive(F.col("name"), generic=generic).alias("n")).filter(F.size("n") > 0).distinct()
    named = a.join(n, "case_id").filter(F.size(F.array_intersect("t", "n")) >= F.least(F.lit(needed), F.size("n"))).select("case_id")
    numbered = a.select("case_id", F.explode("numbers").alias("number")).join(case_numbers.select("case_id", "number").distinct(), ["case_id", "number"], "left_semi").select("case_id")
    hit = named.union(numbered).distinct().withColumn("known", F.lit(True))
    return answers.select("case_id").distinct().join(hit, "case_id", "left").select("case_id", F.coalesce("known", F.lit(False)).alias("known"))


def recalled_names(answers: DataFrame, names: DataFrame) -> DataFrame:
    """(case_id, name): names an answer gives in full, or by two of their distinctive words, case and all.

    answers: case_id, text; names: case_id, name. Names meet only the answers of their own case.
    """
    ws = F.array_distinct(F.filter(F.split("name", "[^A-Za-z0-9]+"), lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(*GENERIC)))
    j = answers.join(names.withColumn("ws", ws).distinct(), "case_id")
    hits = F.size(F.filter("ws", lambda w: F.contains(F.col("text"), w)))
    return j.filter(F.contains(F.col("text"), F.col("name")) | (hits >= 2)).select("case_id", "name").distinct()


def furniture(lines: DataFrame, share: float) -> DataFrame:
    """(doc_id, pattern, pages): lines that stand, digits aside, on max(2, ceil(share * pages)) pages of their document.

    lines: doc_id, page, text.
    """
    key = F.regexp_replace(F.trim("text"), "[0-9]+", "#")
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("all_pages"))
    per = lines.select("doc_id", "page", key.alias("pattern")).filter("pattern <> ''").groupBy("doc_id", "pattern").agg(F.count_distinct("page").alias("pages"))
    return per.join(pages, "doc_id").filter(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("all_pages") * share))).select("doc_id", "pattern", "pages")


def merge_spans(spans: DataFrame, k: int) -> DataFrame:
    """(doc_id, start, end): overlapping spans of a document merged, the first k of them."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("island", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return opened.filter(F.col("island") <= k).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
