"""Garbled text from wrong character encoding: round-trip repair, layer by layer, as long as a garbling cost drops."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings in which UTF-8 is known to be misread.
MISREAD = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp866", "koi8_r", "iso8859_15")
#: (shown, meant): one single-byte encoding misread as another.
SINGLE = (
    ("cp1251", "cp1252"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp1251"), ("koi8_r", "cp1251"),
    ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "koi8_r"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"),
)


def _table(name: str) -> dict[str, int]:
    """Letter to byte, for bytes from 0x80. What an encoding leaves open is read as the control sign of that number;
    for cp1252, which is often mixed up with latin-1, both the sign and the control sign of a byte are known."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
        if name == "cp1252":
            table.setdefault(chr(b), b)
    return table


class _Codec:
    def __init__(self, name: str) -> None:
        self.name, self.bytes = name, _table(name)
        of = lambda low, high: "[" + "".join(re.escape(c) for c, b in self.bytes.items() if low <= b <= high) + "]"
        more = of(0x80, 0xBF)
        one = f"{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF4)}{more}{{3}}"
        self.run = re.compile(f"(?:{one})+")

    def encode(self, text: str) -> bytes | None:
        try:
            return b"".join(bytes([self.bytes[c]]) if ord(c) > 127 else c.encode() for c in text)
        except KeyError:
            return None


CODECS = {name: _Codec(name) for name in {*MISREAD, *(n for pair in SINGLE for n in pair)}}


@lru_cache(maxsize=1 << 16)
def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250:
        return "latin"
    name = unicodedata.name(c, "")
    return name.split(" ")[0].lower() if unicodedata.category(c)[0] in "LM" else "common"


@lru_cache(maxsize=1 << 16)
def _weight(c: str) -> float:
    """Cost of a sign in a text: ordinary letters and signs little, what hardly any text holds much."""
    o, kind = ord(c), unicodedata.category(c)
    if o < 0x80:
        return 0
    if kind in ("Cn", "Co", "Cs") or 0x80 <= o < 0xA0:
        return 6
    if 0x180 <= o < 0x300 or 0x2500 <= o < 0x25A0:  # rare Latin, phonetic and modifier letters; box drawing
        return 5
    return 1


def _accepts(old: str, new: str, before: str, after: str, known: set[str]) -> bool:
    """Whether a decoded run costs less than what stands there. A lone letter of another script than its
    surroundings counts as rare, unless a longer run of that script was decoded in the same text."""
    cost = 0.0
    for c in new:
        script = _script(c)
        lone = script not in ("latin", "common") and script not in known and len(new) < 2 and not (before and _script(before) == script)
        cost += 4 if lone else _weight(c)
    if cost >= sum(map(_weight, old)):
        return False
    # In a text of its own script, such a run may be chance: letters of the same script touch it.
    for c, near in ((old[0], before), (old[-1], after)):
        if near and near.isalpha() and ord(near) > 0x24F and _script(near) == _script(c) != "latin":
            return False
    return True


def _utf8_pass(text: str, codec: _Codec, known: set[str]) -> tuple[str, int]:
    gain = 0

    def fix(m: re.Match) -> str:
        nonlocal gain
        old = m[0]
        try:
            new = codec.encode(old).decode("utf-8")
        except UnicodeDecodeError:
            return old
        if not _accepts(old, new, text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1], known):
            return old
        gain += len(old) - len(new)
        if len(new) > 1:
            known.update(_script(c) for c in new)
        return new

    out = codec.run.sub(fix, text)
    return out, gain


#: Cyrillic letters that look like Latin ones; a word that mixes only these in is a look-alike, not a misreading.
_ALIKE = set("асеорхуіјѕһԁАВЕКМНОРСТХУІЈЅ")
_WORD = re.compile(r"[^\s]*[^\x00-\x7f\s][^\s]*")
_JOINERS = set("’‘ʼ'-‐‑–—…·/.@&_­​‌‍⁠﻿₹°®™©“”„§№†‡•×½¼¾ºª")


@lru_cache(maxsize=1 << 17)
def word_cost(word: str) -> float:
    """How unlike any written word this is: scripts mixed between neighbours, signs inside, capitals within, accents in a row."""
    cost, accents = 0.0, 0
    odd = [_kind(c) for c in word]
    for i, (c, kind) in enumerate(zip(word, odd)):
        before, after = odd[i - 1] if i else "", odd[i + 1] if i + 1 < len(odd) else ""
        if kind in ("latin", "accent") and after not in ("", "latin", "accent", "sign", "digit", "joiner", "mark") and c not in _ALIKE:
            cost += 3 if word[i + 1] not in _ALIKE else 0
        elif kind not in ("latin", "accent", "sign", "digit", "joiner", "mark") and after in ("latin", "accent") and c not in _ALIKE:
            cost += 3
        elif kind == "sign" and "latin" in (before, after) and {before, after} <= {"latin", "accent", "sign", ""} and (before == after == "latin" or ord(c) > 0x2000 and c not in "€"):
            cost += 2
        if kind == "joiner" and before == after == "latin" and c not in "’‘ʼ'-‐‑–—…·/.@&_­​‌‍⁠﻿“”":
            cost += 2
        if c == "”" and after == "latin" and before in ("", "latin"):
            cost += 1
        if kind == "accent" and c.isupper() and i and word[i - 1].islower() and ord(word[i - 1]) < 128:
            cost += 2
        accents = accents + 1 if kind == "accent" else 0
        if accents >= 3:
            cost += 1
    return cost


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    if c in _JOINERS:
        return "joiner"
    o, cat = ord(c), unicodedata.category(c)
    if cat[0] == "L":
        return "latin" if o < 128 else "accent" if o < 0x250 else _script(c)
    return "digit" if cat[0] == "N" and o < 0x2000 else "mark" if cat[0] == "M" else "sign"


def _single_pass(text: str) -> tuple[str, float]:
    words = {m[0]: word_cost(m[0]) for m in _WORD.finditer(text)}
    bad = sum(words.values())
    if bad < 2:
        return text, 0
    best: tuple[float, str] = (0, text)
    for shown, meant in SINGLE:
        codec, swaps, drop = CODECS[shown], {}, 0.0
        for w, cost in words.items():
            raw = codec.encode(w)
            if raw is None:
                continue
            try:
                new = raw.decode(meant)
            except UnicodeDecodeError:
                continue
            saved = cost - word_cost(new)
            if any(_weight(c) > 1 for c in new):
                continue
            if new != w and (saved > 0 or (saved == 0 and cost == 0 and _follows(w, shown, meant))):
                swaps[w] = new
                drop += saved
        if drop > best[0] and drop >= 2:
            best = drop, _WORD.sub(lambda m, s=swaps: s.get(m[0], m[0]), text)
    return best[1], best[0]


def _follows(word: str, shown: str, meant: str) -> bool:
    """A word that costs nothing either way goes along with its text if its signs are not of the text's own script."""
    foreign = [c for c in word if ord(c) > 127]
    if shown in ("cp1251", "koi8_r", "cp866") and meant == "cp1252":
        return all(_script(c) == "cyrillic" for c in foreign)
    if meant == "cp1252":  # a lone sign that was an accented letter, as "à" in French
        return word.encode(shown).decode(meant).isalpha() and not word.isalpha() or _script(word[0]) == "greek" and len(word) == 1
    if meant in ("cp1251", "koi8_r"):
        return all(_kind(c) == "accent" for c in foreign) and len(foreign) == len(word.strip(".,;:()0123456789-"))
    return False


#: What is left where signs were lost on the way: the replacement sign, or a lead sign without its followers.
_LOST = re.compile(
    "�|â(?:[\u0080-\u009f¦‚]|€)|à[¤¥]|ï»|ðŸ|ã€|Â(?=[£§°±«»©®·½¼¾])|Ã[\u0080-\u009f©¨¼¶¤ª±³¡­º§£¢]|Ã(?=[a-z])|â(?=[A-Z])|(?<=[a-zé])â(?=[\\s.,;:)]|$)|(?<=\\s)â(?=\\s)"
    "|вЂ|Г[©¨ј¶¤]|ГѓВ|В(?=[§°±])|‚Ä|√[©®°¥†ß§¢£±≥∫º]|‡§|‡•|ΓÇ|├[⌐ñ╝╢ó║│]|┬[▒░º]|ÔÇ|Óñ|Óѕ|├®|Ôé"
)


#: Lost signs that what is left still tells: bytes that cp1252 has no sign for, and dropped control signs.
_RESTORED = (
    (re.compile("à¥(?:[�?]|(?![\u0080-\u00bf]))(?=[\u0900-\u097f\\s])|(?<=[\u0900-\u097f])à¥[�? ]?"), "्"),
    (re.compile("â¦"), "…"),
    (re.compile("â€[�?]|â€(?=\\s)"), "”"),
    (re.compile(r"(?<=[a-z])â(?=s?[\s.,;:)])"), "’"),
)


#: Two signs that could be a lead and a following byte under some encoding, and the signs that lost ones begin with: a text
#: without them is not searched further.
_PAIR = re.compile("[" + "".join(re.escape(c) for k in MISREAD for c, b in CODECS[k].bytes.items() if b >= 0xC2) + "][" + "".join(re.escape(c) for k in MISREAD for c, b in CODECS[k].bytes.items() if b <= 0xBF) + "]")
_LOST_FIRST = re.compile("[�âàïðãÂÃвГВ‚√‡Γ├┬ÔÓ]")


def repair(text: str) -> tuple[str, int, bool]:
    """(repaired text, layers undone, whether the text was garbled). Signs that were lost stay lost."""
    layers = 0
    # Each layer undone makes the text shorter, so the loop ends.
    while _PAIR.search(text):
        best: tuple[int, str] = (0, text)
        for name in MISREAD:
            codec = CODECS[name]
            if codec.run.search(text):
                known: set[str] = set()
                out, gain = _utf8_pass(text, codec, known)
                if known:
                    out, gain = _utf8_pass(text, codec, known)
                if gain > best[0]:
                    best = gain, out
        if not best[0]:
            break
        text, layers = best[1], layers + 1
    out, drop = _single_pass(text)
    if drop:
        text, layers = out, layers + 1
    lost = bool(_LOST_FIRST.search(text)) and bool(_LOST.search(text))
    if lost:
        for gap, sign in _RESTORED:
            text = gap.sub(sign, text)
    if layers and text.startswith("﻿"):
        text = text[1:]
    return text, layers, bool(layers) or lost


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [repair(t) for t in pdf["__text"]]
        yield pdf.drop(columns="__text").assign(repaired=[g[0] for g in got], layers=[g[1] for g in got], garbled=[g[2] for g in got])


def repair_texts(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, repaired (string), layers (int) of the rows whose text is garbled; other rows are left out.

    A text is garbled if some encoding, undone strictly, lowers its cost, or if lost signs show that it was. Null,
    empty and pure ASCII texts never are and don't reach Python. Repeated rows stay repeated. No shuffle.
    """
    kinds = dict(df.dtypes)
    wide = df.filter(F.col(text).rlike(r"[^\x00-\x7F]")).select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "repaired string, layers int, garbled boolean"])
    return wide.mapInPandas(_run, schema).filter("garbled").drop("garbled")
