"""Tokenizer against another implementation; round trips of garbled text; mixtures."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketlake.llm import mixture, mojibake, queries, tokenize

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def theirs():
    t = tokenizers.Tokenizer.from_file(tokenize.TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ours(texts):
    flat, sizes = tokenize.encoder(tokenize.TOKENIZER).encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("ab \n'sé€", max_size=60), min_size=1, max_size=5))
def test_ids_of_any_text(theirs, texts):
    assert ours(texts) == [theirs(t) for t in texts]


def test_ids_of_long_words(theirs):
    rng = random.Random(1)
    texts = ["a" * 5000, "".join(rng.choice("abcdefgh") for _ in range(3000)), "<|endoftext|> as text", "x" * 401 + " " + "y" * 399, "", None, "अ" * 900]
    assert ours(texts) == [theirs(t) if t else [] for t in texts]


def test_p7_covers_the_corpus(spark, sf, theirs):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in queries.p7_ids(spark, sf).collect()}
    assert got == {i: theirs(t) if t else [] for i, t in docs.items()}
    clash = spark.createDataFrame([(1, "a b", "c"), (1, "a b", "c"), (None, None, None)], "doc_id int, text string, out string")
    assert sorted(map(str, (r.ids for r in tokenize.token_ids(clash, ["doc_id", "text", "out"]).collect()))) == ["[64, 275]", "[64, 275]", "[]"]
    assert tokenize.token_counts(clash.limit(0), ["doc_id"]).count() == 0


CORRECT = [
    "plain", "The seal bears the letters Ã and Â, and the maker’s mark reads “Ñandú Æther”.", "Crédit Véronde S.A. and Müllbach GmbH kept a 50 ½ % share • ratio 3 × 4.",
    "A AÇÃO DE RECUPERAÇÃO, NO ÂMBITO DA SESSÃO, ÓRGÃO", "Арбитражный управляющий подал заявление «в срок» № 5, ВПЕРЁД", "परिसमापक ने ₹40469 की मांग का नोटिस भेजा।",
    "203 °C – see annexure €-269 §16 ±3 𝐈𝐭𝐞𝐦 café ​ ⚖️ naïve coöperate ÜBERÄNDERUNG déjà… «Où» est-il ? L’été", "CAFÉ» À» Größe ŒUVRE Łódź Ελλάδα שלום مرحبا 日本語 한국어",
]


@pytest.mark.parametrize("text", CORRECT)
def test_correct_text_is_left_alone(text):
    assert mojibake.repair(text) == (text, 0, False)


@pytest.mark.parametrize("text", [CORRECT[1], CORRECT[2], CORRECT[3], CORRECT[5], "Суд просил отсрочку на 317 дней", "the homebuyers’ association – “as is” … ₹5"])
@pytest.mark.parametrize("wrong", ["latin-1", "mac_roman", "cp437", "cp850", "twice"])
def test_round_trips(text, wrong):
    def misread(t):
        return "".join(next((k for k, v in mojibake.CODECS["cp1252"].bytes.items() if v == b), chr(b)) if b > 127 else chr(b) for b in t.encode())

    garbled = misread(misread(text)) if wrong == "twice" else text.encode().decode(wrong)
    got, layers, found = mojibake.repair(garbled)
    assert found and layers >= 1 and got == text


def test_single_bytes_and_lost_signs():
    for text, meant, shown in [("La société débitrice a déclaré une créance", "cp1252", "cp1251"), ("Должник сослался на статью 43", "cp1251", "cp1252"), ("L'appelante a été mise en demeure à défaut", "cp1252", "mac_roman")]:
        assert mojibake.repair(text.encode(meant).decode(shown)) == (text, 1, True)
    assert mojibake.repair("a fact the board�s r�sum� omits")[2] and mojibake.repair("Ltd. â¦ Appellant") == ("Ltd. … Appellant", 0, True)


def test_repair_of_a_table(spark):
    df = spark.createDataFrame([(1, "â€™" * 2000, "x"), (2, None, None), (3, "", ""), (4, "fine é", "x"), (1, "â€™" * 2000, "x")], "doc_id int, text string, layers string")
    got = [tuple(r) for r in mojibake.repair_texts(df, ["doc_id"]).collect()]
    assert got == [(1, "’" * 2000, 1)] * 2 and mojibake.repair_texts(df.limit(0), ["doc_id"]).count() == 0


def test_raking_meets_margins():
    cells = pd.DataFrame([(s, l, t, 100.0 * (1 + i), c) for i, (s, c) in enumerate([("a", 1), ("b", 4), ("c", 2)]) for l in "xy" for t in "pq"], columns=["source", "lang", "topic", "tokens", "cap"])
    w = mixture.rake(cells, {"a": 0.3, "b": 0.5, "c": 0.2}, 1000.0)
    used = (w * cells["tokens"]).groupby(cells["source"]).sum()
    assert abs(used - pd.Series({"a": 300, "b": 500, "c": 200})).max() < 1e-6 and (w <= cells["cap"] + 1e-9).all()
    short = mixture.rake(cells, {"a": 0.9, "b": 0.1}, 1000.0)
    used = (short * cells["tokens"]).groupby(cells["source"]).sum()
    assert abs(used["a"] - 400) < 1e-6 and used["c"] < 1e-6


def test_mixture_of_the_corpus(spark, sf):
    got = queries.p8_report(spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == 9 and (got["most_repeats"] <= got["max_repeats"]).all() and abs(got["reached_share"].sum() - 1) < 1e-9
    full = got["tokens_used"] < got["tokens_there"] * got["max_repeats"] * 0.99
    total = got["tokens_there"].sum()
    assert (abs(got["tokens_used"] - got["target_share"] * total)[full] < 0.02 * total).all()
    docs = spark.createDataFrame([(1, None, "en", "t", 5), (2, "a", None, None, 0), (3, "a", None, None, 7), (4, "b", "en", "t", 9)], "doc_id int, source string, lang string, topic string, n_tokens long")
    goals = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats int")
    assert [tuple(r) for r in mixture.mix(docs, goals).collect()] == [(3, "a", 7, 1)]
    assert mixture.mix(docs.limit(0), goals).count() == 0 and mixture.mix(docs, goals.limit(0)).count() == 0


@pytest.mark.parametrize("name", mojibake.MISREAD)
def test_planted_misreadings_are_found_and_mostly_restored(name):
    """Clean texts of the corpus, wholly and one word of each, with UTF-8 read as another encoding."""
    duckdb = pytest.importorskip("duckdb")
    texts = [r[0] for r in duckdb.connect().execute("SELECT DISTINCT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE regexp_matches(text, '[^\\x00-\\x7F]') ORDER BY text").fetchall()]
    clean = [t for t in texts if not mojibake.repair(t)[2]][:150]
    signs = {b: c for c, b in reversed(mojibake.CODECS[name].bytes.items())}
    show = lambda t: "".join(chr(b) if b < 128 else signs[b] for b in t.encode())
    found = exact = n = 0
    for t in clean:
        at = next(i for i, c in enumerate(t) if ord(c) > 127)
        a, b = t.rfind(" ", 0, at) + 1, t.find(" ", at) if " " in t[at:] else len(t)
        for garbled in (show(t), t[:a] + show(t[a:b]) + t[b:]):
            out, _, bad = mojibake.repair(garbled)
            n, found, exact = n + 1, found + bad, exact + (out == t)
    assert found >= 0.98 * n and exact >= (0.5 if name == "iso8859_15" else 0.97) * n
