"""Personal information: the stated kinds and what does not count; trees against a plain fit."""

import numpy as np
import pytest

from docketlake.llm import boosting, personal, queries


@pytest.fixture(scope="module")
def model():
    return personal.train(personal.Words(frozenset("the of and a in was by to loan account company interest form survey".split())))


CASES = [
    ("Ask <a.person [at] mail [dot] example> or ring +91 59741 96064 / (0191) 555 0178 in the evening.", {("EMAIL", "a.person [at] mail [dot] example"), ("PHONE", "+91 59741 96064"), ("PHONE", "(0191) 555 0178")}),
    ("Possession went to Smt. Marin Kallova (PAN qwert1234z), living at Flat 18-B, Blue Kiln Apartments, Tannery Road, Tolvik-013623.", {("NAME", "Marin Kallova"), ("ID_NUMBER", "qwert1234z"), ("ADDRESS", "Flat 18-B, Blue Kiln Apartments, Tannery Road, Tolvik-013623")}),
    ("Going by what Justice Kallova held, no rent is due. Mr. Chairman closed the sitting.", {("NAME", "Kallova")}),
    ("Shri M. Kallova gave his DIN: 93798398 and passport X0364143.", {("NAME", "M. Kallova"), ("ID_NUMBER", "93798398"), ("ID_NUMBER", "X0364143")}),
    ("The bid of Kallova Tanneries Industries Limited was turned down on 04.12.2017.", set()),
    ("Its GSTIN 77CJCBO9770F1Z5 has lapsed. Loan account 76490868306952 is overdue.", set()),
    ("The manual hangs on data.bidding.example as file 53225398. Interest runs @ 9% on Rs. 15,53,28,825.", set()),
    ("", set()),
]


@pytest.mark.parametrize("text, want", CASES)
def test_kinds(model, text, want):
    assert {(personal.KINDS[k], text[a:b]) for k, a, b in model.find(text)} == want


def test_held_out_accuracy(model):
    assert all(v > 0.9 for v in model.held_out.values()), model.held_out


def test_long_text(model):
    text = ("nothing to see here, " * 20_000) + "Notice reached Mr. Marin Kallova on time."
    assert [text[a:b] for _, a, b in model.find(text)] == ["Marin Kallova"]


def test_tables(spark, model):
    df = spark.createDataFrame([(1, CASES[2][0], "x"), (1, CASES[2][0], "x"), (2, None, "x"), (3, "", "x"), (4, CASES[4][0], "x")], "id int, text string, kind2 string")
    assert [tuple(r)[:3] for r in personal.find(df, model, ["id"]).collect()] == [(1, "NAME", "Kallova")] * 2
    got = {(r.id, r.redacted, r.n_found) for r in personal.redact(df, model, ["id"]).collect()}
    assert got == {(1, CASES[2][0].replace("Kallova", "[NAME]"), 1), (2, None, 0), (3, "", 0), (4, CASES[4][0], 0)}
    assert personal.find(df.limit(0), model, ["id"]).count() == 0


def test_query(spark, sf):
    got = queries.p2_found(spark, sf)
    assert got.columns == ["src", "row_id", "seg", "kind", "pii_text"] and got.count() == got.distinct().count() > 100
    assert queries.p2_redacted(spark, sf).filter("redacted rlike '@[a-z]+[.]'").count() == 0


def test_trees_separate_a_rule():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (3000, 5)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 3] > 3)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    p = trees.score(x[2000:])
    cut = boosting.best_threshold(p, y[2000:])
    assert ((p >= cut) == y[2000:]).mean() > 0.99


def test_common_words_come_from_every_distinct_text(spark, monkeypatch):
    monkeypatch.setattr(personal, "train", lambda common: common)
    copied = [("write to marin.kallova@mail.test about the parcel",)] * 50
    mails = [(f"the case {i} names oskar.vell@mail.test or ilse dot vell at mail dot test",) for i in range(3)]
    many = [(f"the case {i} went on",) for i in range(9000)] + [(f"the case {i} went astray",) for i in range(20)] + [(f"the case {i} went amiss",) for i in range(2)]
    df = spark.createDataFrame(copied + mails + many + [(None,), ("",)], "text string")
    common = personal.fitted(df)
    assert {"the", "case", "went", "on", "astray"} <= common.lower
    assert not common.lower & {"marin", "parcel", "oskar", "ilse", "vell", "amiss"}
    assert personal.fitted(df.limit(0)) == personal.Words(frozenset())


def test_costly_patterns_run_only_where_they_can_match(monkeypatch):
    class Never:
        def search(self, *_):
            pytest.fail("ran in vain")

        findall = finditer = match = search

    for name in ("_AT", "_AT_WORD", "_EMAIL", "_SPOKEN", "_PHONE", "_ADDRESS", "_COMPANY_IN", "_COMPANY", "_FIRM_WORD"):
        monkeypatch.setattr(personal, name, Never())
    text = "The clerk of Kallova said that 9.5 per cent fell due. Both Sides left at noon."
    assert personal.propose(text, frozenset({"both", "sides", "the"})) == []
    assert personal._words(text) >= {"clerk", "said", "noon", "Kallova", "Sides"}


def test_gates_lose_no_match():
    import random
    import re

    r = random.Random(4)
    pieces = ["at", "dot", " at ", " dot ", "Ltd", "Lımıted", "İnc", "Pvt", "Mr", "Mrs.", "dr", "shri", "Smt", "Hon'ble", "Flat 3", "h. no. 4", "Shop 12", "ſhop 3", "MG Road, 5", "12", "1234", "5678 9012", "abcde1234f", "(091)", "+91", " ", "  ", "\n", ", ", ".", "@", "[at]", "Kumar", "Ana Bel", "ANA", "A.", "O'Neil", "of", "é", "_", "-", "/", "Bank", "K."]
    made = personal._Maker(3)
    texts = [made.text()[0] for _ in range(500)] + ["".join(r.choice(pieces) for _ in range(r.randrange(1, 30))) for _ in range(8000)]
    firm = re.compile(r"([A-Z][A-Za-z]{2,})\s+(?:Ltd|Limited|LLP|LLC|Inc|Pvt|Private|Corp|Corporation|GmbH|Industries|Holdings)\b", re.I)
    at = lambda found: [(m.start(), m.end()) for m in found]
    for t in texts:
        low = personal._lowered(t)
        assert personal._has_at(t) == bool(personal._AT.search(t)) and personal._has_at_word(t, low) == bool(personal._AT_WORD.search(t))
        assert at(personal._all(personal._RUN, personal._RUN_START, t)) == at(personal._RUN.finditer(t))
        assert at(personal._all(personal._ADDRESS, personal._HOUSE_START, t)) == at(personal._ADDRESS.finditer(t))
        assert personal._EIGHT.search(t) or not personal._PHONE.search(t)
        assert all(gate.search(t) or not p.search(t) for p, gate in zip(personal._IDS, personal._ID_HINTS))
        assert any(f in low for f in personal._FORMS) or not (personal._COMPANY_IN.search(t) or personal._COMPANY.search(t))
        assert personal._FIRM_WORD.findall(t) == firm.findall(t)
        assert {w for x in t.split() for w in personal._token_words(x)} == {*personal._LOWER.findall(t), *(w.title() for w in personal._CAPITAL.findall(t))}
