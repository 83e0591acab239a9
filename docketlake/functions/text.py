"""Scalar text functions as Columns. All give null for null unless stated."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Number words of Indian amounts.
LAKH, CRORE = 100_000, 10_000_000


def squeeze(c: Column) -> Column:
    """White space runs become one blank, ends are trimmed, letters lowered."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once: a lambda's body would compute a plain expression anew for each element."""
    return F.transform(F.array(c), f)[0]


def n_grams(tokens: Column, n: int) -> Column:
    """Distinct n-grams of a token array as text; none where it is shorter (a sequence must never run backwards)."""
    return once(tokens, lambda w: F.array_distinct(F.transform(_starts(w, n), lambda i: F.array_join(F.slice(w, i, n), " "))))


def n_gram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of the distinct n-grams of a token array; none where it is shorter."""
    return once(tokens, lambda w: F.array_distinct(F.transform(_starts(w, n), lambda i: F.xxhash64(F.slice(w, i, n)))))


def _starts(w: Column, n: int) -> Column:
    return F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))


def amounts(c: Column) -> Column:
    """Distinct whole amounts written in digits, sorted, times lakh or crore (also lac, cr) where that follows, truncated.

    Every number counts, whatever stands before it; numbers of more than twenty digits are left out.
    """
    found = F.regexp_extract_all(c, F.lit(r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?\s*(?:/-)?\s*(?:crores?|cr\b|lakhs?|lacs?)?)"), F.lit(1))

    def value(m: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(m, r"^([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("decimal(24,4)")
        unit = F.when(F.lower(m).rlike("cr"), F.lit(CRORE)).when(F.lower(m).rlike("la"), F.lit(LAKH)).otherwise(F.lit(1))
        return F.floor(number * unit).try_cast("bigint")

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, value))))


# Month names in order.
MONTHS = "january february march april may june july august september october november december".split()
_MONTH = "|".join(MONTHS)


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def dates(c: Column) -> Column:
    """Distinct dates written d.m.yyyy (also with / or -), '4th day of March, 2019' or 'March 4th, 2019', in any case,
    sorted; impossible ones are left out, never repaired."""
    low = F.lower(c)
    every = lambda p: F.regexp_extract_all(low, F.lit(p), F.lit(0))
    part = lambda m, p: F.regexp_extract(m, p, 1)
    month = lambda m: F.array_position(F.array(*map(F.lit, MONTHS)), part(m, f"({_MONTH})")).cast("string")
    figures = F.transform(every(r"\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}\b"), lambda m: _day(part(m, "([0-9]{4})$"), part(m, "^[0-9]+[./-]([0-9]+)"), part(m, "^([0-9]+)")))
    day_first = F.transform(every(rf"\b[0-9]{{1,2}}(?:st|nd|rd|th)?\s+(?:day\s+of\s+)?(?:{_MONTH}),?\s+[0-9]{{4}}\b"), lambda m: _day(part(m, "([0-9]{4})$"), month(m), part(m, "^([0-9]+)")))
    month_first = F.transform(every(rf"\b(?:{_MONTH})\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\s+[0-9]{{4}}\b"), lambda m: _day(part(m, "([0-9]{4})$"), month(m), part(m, "^[a-z]+\\s+([0-9]+)")))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(figures, day_first, month_first))))


def iso_date(c: Column) -> Column:
    """A real date written exactly yyyy-mm-dd, else null."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date"))


def appeal_numbers(c: Column) -> Column:
    """Distinct 'number/year' of 'No. n of yyyy' (also Nos, n/yyyy) and of a bare n/yyyy, years 1900 to 2099, leading zeros stripped."""
    plain = lambda m: F.concat(F.regexp_replace(F.regexp_extract(m, r"([0-9]{1,6})\s*(?:[oO][fF]|/)", 1), "^0+(?=[0-9])", ""), F.lit("/"), F.regexp_extract(m, "([0-9]{4})$", 1))
    named = F.regexp_extract_all(c, F.lit(r"(?i)\bNos?\.?\s*[0-9]{1,6}\s*(?:of|/)\s*(?:19|20)[0-9]{2}\b"), F.lit(0))
    bare = F.regexp_extract_all(c, F.lit(r"(?<![0-9/])[0-9]{1,6}\s*/\s*(?:19|20)[0-9]{2}\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(F.concat(named, bare), plain)))


def numbers(c: Column) -> Column:
    """Numbers in digits, in Indian or international grouping, without their separators."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?"), F.lit(0)), lambda m: F.regexp_replace(m, ",", ""))


def sentences(c: Column, least_words: int = 6) -> Column:
    """Sentences end after . ; or : before white space and a capital or bracket; shorter ones than least_words are left out."""
    return F.filter(F.split(c, r"(?<=[.;:])\s+(?=[A-Z(\[])"), lambda s: F.size(F.split(F.trim(s), r"\s+")) >= least_words)


_PROTECTED = ("Mr.", "Mrs.", "Ms.", "Dr.", "No.", "Nos.", "Ltd.", "Pvt.", "Rs.", "v.", "vs.", "Ors.", "Anr.")


def sentences_protected(c: Column) -> Column:
    """Sentences by full stop before a capital; the dots of common short forms end none."""
    out = c
    for a in _PROTECTED:
        out = F.regexp_replace(out, rf"\b{a[:-1]}\.", a[:-1] + "\u0001")
    parts = F.split(out, r"(?<=[.?!])\s+(?=[A-Z(])")
    return F.transform(parts, lambda s: F.translate(s, "\u0001", "."))


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def cap(c: Column, most: int) -> Column:
    """The first `most` signs, with a mark if there were more."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def cap_list(items: Column, most: int) -> Column:
    """The first items joined by commas, then '+k more'."""
    rest = F.size(items) - most
    return F.when(rest > 0, F.concat(F.array_join(F.slice(items, 1, most), ", "), F.lit(" +"), rest.cast("string"), F.lit(" more"))).otherwise(F.array_join(items, ", "))


#: The form of a section's head, a number and a label in capitals, and the parts that are left out or kept.
SECTION = r"(?:^|\s)[0-9]+\.\s+([A-Z][A-Z /&-]*[A-Z]):\s*"
LEFT_OUT, RATIO_PARTS = ("PARTY IDENTITIES",), 3


def sections(c: Column) -> Column:
    """Parts '1. LABEL: text' as structs (label, text) in order; none where there is no numbered label."""
    labels = F.regexp_extract_all(c, F.lit(SECTION), F.lit(1))
    texts = F.split(c, SECTION)
    return F.zip_with(labels, F.slice(texts, 2, F.greatest(F.size(labels), F.lit(0))), lambda k, v: F.struct(k.alias("label"), F.trim(v).alias("text")))


def _labelled(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda s: s["text"] != ""), lambda s: F.concat(s["label"], F.lit(": "), s["text"]))


def _or_whole(c: Column, parts: Column) -> Column:
    whole = F.filter(F.array(F.trim(c)), lambda t: t != "")
    return F.when(F.size(sections(c)) > 0, parts).otherwise(whole)


def facts_sections(c: Column) -> Column:
    """'LABEL: text' of each part with text, those of LEFT_OUT excepted; without parts the whole text, if there is any."""
    return _or_whole(c, _labelled(F.filter(sections(c), lambda s: ~s["label"].isin(*LEFT_OUT))))


def ratio_parts(c: Column) -> Column:
    """'LABEL: text' of those of the first RATIO_PARTS parts that have text; without parts the whole text."""
    return _or_whole(c, _labelled(F.slice(sections(c), 1, RATIO_PARTS)))


def ratio_passage(c: Column) -> Column:
    """The first RATIO_PARTS parts, empty ones too, as one passage; without parts the whole text."""
    parts = F.transform(F.slice(sections(c), 1, RATIO_PARTS), lambda s: F.concat(s["label"], F.lit(": "), s["text"]))
    return F.when(F.size(sections(c)) > 0, F.array_join(parts, " ")).otherwise(F.trim(c))


def core_rule(c: Column) -> Column:
    """The first of ratio_parts; empty where there is none."""
    return F.coalesce(F.try_element_at(ratio_parts(c), F.lit(1)), F.lit(""))


def token_windows(c: Column, limit: int) -> Column:
    """Words packed greedily into windows of at most `limit` signs; a longer word is a window of its own."""
    ws = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    start = F.array().cast("array<string>")

    def add(a: Column, w: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        fits = (F.size(a) > 0) & (F.length(last) + 1 + F.length(w) <= limit)
        return F.when(fits, F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(last, F.lit(" "), w)))).otherwise(F.concat(a, F.array(w)))

    return F.aggregate(ws, start, add)


def greedy_batches(items: Column, sizes: Column, budget: int) -> Column:
    """Batch number of each item, in order: a new batch when the budget would be passed; an oversize item is alone."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("used"))

    def add(s: Column, x: Column) -> Column:
        opens = (F.size(s["out"]) > 0) & (s["used"] + x > budget)
        n = F.when(opens, s["n"] + 1).otherwise(s["n"])
        return F.struct(F.concat(s["out"], F.array(n)).alias("out"), n.alias("n"), F.when(opens, x).otherwise(s["used"] + x).cast("bigint").alias("used"))

    return F.aggregate(F.transform(sizes, lambda x: x.cast("bigint")), start, add)["out"]


def first_marker(c: Column, markers: list[str]) -> Column:
    """The first of the configured markers that the text contains, in any case; null if none."""
    low = F.lower(c)
    return F.coalesce(*[F.when(F.contains(low, F.lit(m.lower())), F.lit(m)) for m in markers])


def is_precedent(c: Column) -> Column:
    return F.contains(c, F.lit("#")) | c.rlike("^[0-9]{4}")


def clean_source_id(c: Column) -> Column:
    """Brackets stripped; P14(v) is P14."""
    return F.regexp_extract(F.regexp_replace(c, r"[\[\]\s]", ""), r"^([A-Za-z]+[0-9]+(?:\.S[0-9]+)?)", 1)


def claim_id(turn: Column, place: Column) -> Column:
    return F.format_string("T%02d-C%d", turn.cast("int"), place.cast("int"))


def doubled_i(id: Column, shown: Column) -> Column:
    """An id without its brackets; if it isn't shown but is with one leading I less, that."""
    bare = F.regexp_replace(id, r"[\[\]]", "")
    less = F.regexp_replace(bare, "^II", "I")
    return F.when(F.array_contains(shown, bare), bare).when(F.array_contains(shown, less), less).otherwise(bare)


def strip_cite_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*\[cite: ?[0-9, ]+\]", "")


def template(text: str, values: dict[str, Column]) -> Column:
    """Named substitution: each {name} of the text becomes its value (null counts as empty)."""
    out = F.lit(text)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def last_json_object(c: Column) -> Column:
    """The last line of a text that is a JSON object, as a map of strings; null if none is."""
    maps = F.transform(F.split(c, "\n"), lambda line: F.when(line.rlike(r"^\s*\{.*\}\s*$"), F.from_json(line, "map<string,string>")))
    return F.try_element_at(F.filter(maps, lambda m: m.isNotNull() & (F.size(m) > 0)), F.lit(-1))


def rupee_fix(c: Column) -> Column:
    """A euro sign before a number in Indian grouping was a rupee sign."""
    return F.regexp_replace(c, r"€(?= ?[0-9]{1,2}(?:,[0-9]{2})+,[0-9]{3})", "₹")


@F.pandas_udf(StringType())
def source_normal(texts: pd.Series) -> pd.Series:
    """NFKC, plain quotes and dashes, no soft hyphens, single blanks."""
    table = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "­": None})
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).translate(table).split()))


def quote_places(text: Column, quote: Column) -> Column:
    """How often a quote stands in a text, after squeezing both; 0 for an empty quote."""
    t, q = squeeze(text), squeeze(quote)
    return F.when(q == "", 0).otherwise(F.size(F.split(F.replace(t, q, F.lit("\u0001")), "\u0001")) - 1)


def quote_at(text: Column, quote: Column) -> Column:
    """The first place (from 1) of a quote in a text, both squeezed; 0 where it doesn't stand there or is empty."""
    q = squeeze(quote)
    return F.when(q == "", 0).otherwise(F.instr(squeeze(text), q))


def quote_pages(text: Column, quote: Column) -> Column:
    """Numbers, from 1, of the pages (separated by form feeds) that hold a quote."""
    q = squeeze(quote)
    held = F.transform(F.split(text, "\f"), lambda p, i: F.when((q != "") & F.contains(squeeze(p), q), i + 1))
    return F.array_compact(held)


def quote_context(text: Column, quote: Column, signs: int) -> Column:
    """The quote's first place with up to `signs` signs on either side; empty where it doesn't stand there."""
    t, at = squeeze(text), quote_at(text, quote)
    start = F.greatest(at - signs, F.lit(1))
    return F.when(at > 0, F.substring(t, start, at - start + F.length(squeeze(quote)) + signs)).otherwise("")


#: Forms of case citations and of a court's registration numbers.
CITATIONS = (
    r"[A-Z][\w.&'-]*(?:\s+[A-Z&][\w.&'-]*)*\s+(?:v\.|vs\.?|versus)\s+[A-Z]",
    r"\([0-9]{4}\)\s*[0-9]+\s*SCC\b",
    r"(?i)\b[0-9]{4}\s+SCC\s+OnLine\b",
    r"\bAIR\s+[0-9]{4}\b",
    r"(?i)\(\s*supra\s*\)",
)
REGISTRATION = (
    r"(?i)\bNos?\.\s*[0-9]{1,6}(?:\s*(?:,|and|&)\s*[0-9]{1,6})*(?:\s*(?:of|/)\s*(?:19|20)[0-9]{2}\b|/[A-Za-z][\w/()-]*?(?:19|20)[0-9]{2}\b)"
    r"|\(IB\)\s*[-/]?\s*[0-9]{1,6}\s*[/(]\s*\(?[A-Za-z][\w/()-]*?(?:19|20)[0-9]{2}\b"
    r"|\b[0-9]{1,6}\s*(?:/\s*[A-Za-z]{2,}|\(\s*[A-Za-z]{2,}\s*\))(?:\s*/\s*[A-Za-z]{2,})*\s*/?\s*(?:19|20)[0-9]{2}\b"
)


def citation_hits(c: Column) -> Column:
    """Case citations in a text, form by form, as they stand there."""
    return F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in CITATIONS])


def registration_hits(c: Column) -> Column:
    """Registration numbers of cases, those with a year, as they stand there."""
    return F.regexp_extract_all(c, F.lit(REGISTRATION), F.lit(0))


def window_places(c: Column, limit: int) -> Column:
    """Numbers of the windows of at most `limit` words (tokens of a word-count tokenizer) a text is cut into."""
    n = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.when(n > 0, F.sequence(F.lit(0), F.ceil(n / limit).cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def renamed_keys(c: Column, old: str, new: str) -> Column:
    """JSON text with a key of that name renamed wherever it stands as a key."""
    return F.regexp_replace(c, rf'"{old}"(\s*:)', f'"{new}"$1')
