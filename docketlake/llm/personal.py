"""Personal information inside free text: proposed spans, boosted trees, calibrated thresholds, typed placeholders."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlake.llm.boosting import Trees, best_threshold, fit
from docketlake.plans.session import cut

KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
#: Share of the distinct texts that a lower-case word must stand in to be common, and training texts made for the fit.
COMMON_SHARE, TRAINING_TEXTS = 1 / 2000, 2400

_DOT = r"(?:\.|\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+)"
_LOCAL = r"[\w+%-]++(?:(?:\.|\s*[\[({]\s*dot\s*[\])}]\s*)[\w+%-]++)*+"
_HOST = rf"[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)+"
_EMAIL = re.compile(rf"{_LOCAL}(?:\s*@\s*|\s*[\[({{<]\s*at\s*[\])}}>]\s*){_HOST}", re.I)
_SPOKEN = re.compile(rf"[\w+%-]+(?:\s+dot\s+[\w+%-]+|\.[\w+%-]+)*\s+at\s+[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}\b", re.I)
_EMAIL_LOCAL = re.compile(rf"(?<![\w+%-]){_LOCAL}(?=(?:\s*@\s*|\s*[\[({{<]\s*at\s*[\])}}>]\s*){_HOST})", re.I)
_SPOKEN_LOCAL = re.compile(rf"[\w+%-]+(?:\s+dot\s+[\w+%-]+|\.[\w+%-]+)*(?=\s+at\s+[a-z0-9-]+(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}\b)", re.I)
_AT = re.compile(r"@|[\[({<]\s*at\s*[\])}>]", re.I)
_AT_WORD = re.compile(r"\bat\s+[\w-]+(?:\.[a-z]|\s+dot\b|\s*[\[({<]\s*dot)", re.I)
_DOT_NEXT = re.compile(r"\.(?i:[a-z])")
_DIGITS = re.compile(r"\d(?:[\d\s().-]{5,}\d|\d{3})")
_EIGHT = re.compile(r"\d(?:[ \t.()-]{0,4}\d){7}")
_PHONE = re.compile(r"(?<![\w₹.,/+-])(?:\+\s?\d|\(\s?\+?\d|\d)(?:[ \t.-]{0,2}[()]?[ \t]?\d){7,15}(?!\w|[.,/-]\d)")
_DAY = re.compile(r"\d{4}-\d\d-\d\d|\d\d?\s?[.-]\s?\d\d?\s?[.-]\s?\d{4}")
_IDS = tuple(
    re.compile(rf"(?<![\w/-])(?:{x})(?![\w]|[/-]\w)", re.I)
    for x in (r"[a-z]{5}[ -]{0,2}\d{4}[ -]{0,2}[a-z]", r"\d{4}([ -]{0,2})\d{4}\1\d{4}", r"\d{8}", r"[a-z]\d{7}", r"[a-z]{3}\d{7}", r"[a-z]{2}\d{6,8}")
)
_ID_HINTS = tuple(re.compile(x) for x in (r"\d\d{3}[ -]{0,2}(?i:[a-z])", r"\d(?<![\w/-].)\d{3}[ -]{0,2}\d{4}[ -]{0,2}\d{4}", r"\d(?<![\w/-].)\d{7}", r"\d(?<=(?i:[a-z]).)\d{6}", r"\d(?<=(?i:[a-z]{3}).)\d{6}", r"\d(?<=(?i:[a-z]{2}).)\d{5}"))
_ID_HINT = re.compile(r"\d\d{3}(?:\d\d|[ -]{1,2}\d{4}|[ -]{0,2}[A-Za-z](?![A-Za-z]))")
_HOUSE = r"(?:(?:flat|plot|house|door|villa|shop|apartment|unit|bungalow|quarter|block|h)\s*\.?\s*(?:no|number|#)?\s*\.?\s*[a-z]?-?\d[\w/-]*|\d{1,4}(?:/\d+)*[a-z]?(?:-[a-z0-9]+)?(?=\s*,|\s+[A-Z]))"
_HOUSE_AT, _STREET_AT = re.compile(rf"(?i:{_HOUSE})"), re.compile(r"[A-Z][\w\s]+,\s*\d")
_PART = r"(?:\d{1,4}(?:st|nd|rd|th)?\s+)?[A-Z][A-Za-z’']*(?:\s+(?:[A-Z][A-Za-z’']*|of|the)){0,4}(?:\s+\d{1,3}(?!\s?\d))?"
_PIN = r"(?:\s*[,–-]?\s*(?:PIN(?:\s*code)?\s*[:.-]?\s*)?\d{3}\s{0,2}\d{3}(?!\d))"
_ADDRESS = re.compile(rf"(?<![\w/,.])(?:(?i:{_HOUSE})(?:\s*,\s*|\s+(?=[A-Z]))|(?=[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s*,\s*\d)){_PART}(?:\s*,\s*(?!PIN){_PART}){{1,5}}{_PIN}?")
_NUMBER_START = re.compile(r"[\dA-Z](?<![\w/,.].)(?:(?<=\d)|(?=[a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s*,\s*\d))")
_HOUSE_START = re.compile(r"[\dA-Zfphdvsaubqſ](?<![\w/,.].)(?:(?<=\d)|(?<=[A-Z])(?=[a-z]+\s+[A-Z][a-z])|(?i:(?<=f)lat|(?<=p)lot|(?<=h)|(?<=d)oor|(?<=v)illa|(?<=s)hop|(?<=a)partment|(?<=u)nit|(?<=b)(?:ungalow|lock)|(?<=q)uarter))")
_HOUSE_WORDS, _HOUSE_LETTER = ("flat", "plot", "house", "door", "villa", "shop", "apartment", "unit", "bungalow", "quarter", "block"), re.compile(r"h\s*\.?\s*(?:no|number|#)?\s*\.?\s*[a-z]?-?\d")
_ADDRESS_HINTS = re.compile(r",\s*\d"), re.compile(r"\d[^,]{0,40},\s*[\dA-Z]")
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Dr|Shri|Sri|Smt|Kumari|Kum|Adv|Advocate|Prof|Professor|Justice|Hon'ble|Sir|Madam|Sh)"
_HIGH_TITLES, _LOW_TITLES = [*_TITLE[3:-1].split("|"), *"MRS? MS DR SHRI SRI SMT KUMARI ADV PROF JUSTICE".split()], "shri smt sri mrs? ms dr kumari adv prof justice".split()
_TITLED, _HIGH_TITLED = (re.compile("(?:" + "|".join(rf"{x[0]}(?<!\w.){x[1:]}" for x in titles) + r")\b(?:\s*\.)?\s*(?=[A-Z])") for titles in ([*_HIGH_TITLES, *_LOW_TITLES], _HIGH_TITLES))
_LOW_TITLE = re.compile(r"(?:shri|s[mr]t|sri|mrs?|ms|dr|kumari|adv|prof|justice)[\s.]+[A-Z]")
_TOKEN = r"(?:(?:[A-Z]['’])?[A-Z][a-z]+(?:-[A-Z][a-z]+)?|[A-Z]{2,}|[A-Z](?:\s?\.|(?=\s)))"
_RUN = re.compile(rf"(?<![\w@.-])(?:{_TOKEN}(?:\s*,\s+|\s+|(?<=\.)))+{_TOKEN}(?![\w@])(?!\.\w)")
_RUN_START = re.compile(r"[A-Z](?<![\w@.-].)")
_NAME_AT = re.compile(rf"{_TOKEN}(?:(?:\s+|(?<=\.)){_TOKEN}){{0,3}}")
_SPLIT = re.compile(rf"{_TOKEN}")
_COMMA_TOKEN = re.compile(rf"\s*,\s+{_TOKEN}")
_COMPANY = re.compile(r"\s*(?:[A-Z][\w&’'-]*\s+){0,4}(?:Ltd|Limited|LLP|LLC|Inc|Pvt|Private|Corp|Corporation|Company|GmbH|Bank|Trust|Industries|Holdings|Foundation|Society)\b", re.I)
_COMPANY_IN = re.compile(r"\b(?:Ltd|Limited|LLP|LLC|Inc|Pvt|Private|Corp|Corporation|GmbH|Bank|Trust|Industries|Holdings|Foundation)\b", re.I)
_FIRM_WORD = re.compile(r"(?<![A-Z])([A-Z]{3,}+)\s+(?:Ltd|Limited|LLP|LLC|Inc|Pvt|Private|Corp|Corporation|GmbH|Industries|Holdings)\b", re.I)
#: A part, in lower case, of every legal form above; those of _FIRM_WORD come first.
_FORMS = ("ltd", "limited", "llp", "llc", "inc", "pvt", "private", "corp", "gmbh", "industries", "holdings", "company", "bank", "trust", "foundation", "society")
_FIRM_FORMS = _FORMS[:11]
_STREET = re.compile(r"\b(?:road|street|lane|avenue|marg|cross|sector|nagar|colony|enclave|towers?|heights|court|apartments?|residency|phase|layout|block|market|chowk|bazaar|path|gali)\b", re.I)
_OFFICE = re.compile(r"\b(?:chairman|chairperson|president|registrar|members?|director|counsel|liquidator|secretary|judge|speaker|commissioner|resolution|professional|technical|judicial|officer|solicitor|attorney)\b", re.I)
_MONTH = re.compile(r"\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b", re.I)
_ID_LABEL = re.compile(r"(?:\bpan\b|permanent account|aadhaar|aadhar|\buid\b|\bdin\b|director identification|passport|travel document|voter|epic|electoral|citizen|income[ -]tax|identity|licen[cs]e|national id)[^\d]{0,16}$", re.I)
_PHONE_LABEL = re.compile(r"(?:\btel|phone|mobile|\bcall|contact|reached|\bfax|whatsapp|\bcell\b|\bring\b|dial)[^.;]{0,40}$", re.I)
_OTHER_LABEL = re.compile(r"(?:account|\ba/c\b|\bifsc|\butr\b|\bneft|\brtgs|transfer|transaction|cheque|draft|invoice|\bbill\b|receipt|voucher|challan|policy|consignment|registration|\bcin\b|\bllpin|\bgstin?\b|\btin\b|reference|petition|appeal|suit|\bcase\b|application|section|order|dated|serial|tender|survey|\brs|inr|₹)\W*(?:nos?|numbers?|id)?\W*(?:is|was|are|:)?\W*$", re.I)
_MONEY = re.compile(r"(?:₹|\brs\.?|\binr)\s*[\d,.]*$", re.I)
_RELATION = re.compile(r"(?:\b[sdwcf]/o\.?|\b(?:son|daughter|wife|widow|husband|father|mother|brother|sister|heirs?|advocate|witness|driver|guardian|owner|tenant|proprietor|partner|nominee|director)(?: of|,)?|\b(?:named|namely|called|alias|one|by|to|from|of|with|for|and|that|when|while|as|told|asked))\s*$", re.I)
_AFTER_NAME = re.compile(r"(?:['’]s?\s|\s*\(|\s+(?:was|is|has|had|did|does|will|would|could|can|may|might|who|whom|whose|and|or|as|on|by|at|to|for|in|with|from|of)\b|\s+[a-z]+(?:ed|es|s|t|d)\b|,\s+(?:aged|resident|residing|who|whose|the|a|an|son|daughter|wife|[sdw]/o)\b)")
_PLACE = re.compile(r"\b(?:at|in|near|of the|from|to|the)\s*$", re.I)
_PLACE_AFTER = re.compile(r"\s+(?:bench|branch|plant|unit|property|warehouse|office|factory|mill|site|depot|project|court|city|town|village|district|area|market|road|street|lane|avenue|marg)\b", re.I)
_TITLE_END = re.compile(rf"(?<!\w){_TITLE}(?:\s*\.)?\s*$", re.I)
_NO_NAME = re.compile(rf"{_MONTH.pattern}|{_TITLE}|Rs|INR", re.I)
_WORDS = re.compile(r"[A-Za-z]+")
_CAPITAL = re.compile(r"(?<![A-Za-z])(?:[A-Z][a-z]{2,}|[A-Z]{3,})(?![A-Za-z])")
_LOWER = re.compile(r"(?<!\S)[a-z]{2,}(?=[\s,;.]|$)")


@dataclass
class Span:
    kind: int
    form: int
    start: int
    end: int


@dataclass(frozen=True)
class Words:
    """What the corpus says of words: those common in lower case, with a capital, and before the legal form of a firm."""

    lower: frozenset[str]
    capital: frozenset[str] = frozenset()
    firm: frozenset[str] = frozenset()


# Searches below are as those of the pattern alone; what comes before them only tells where it can't match, at less cost.


def _lowered(text: str) -> str:
    """In lower case, with the signs that match i and s where case is ignored in their place."""
    if "İ" in text or "ı" in text or "ſ" in text:
        text = text.replace("İ", "i").replace("ı", "i").replace("ſ", "s")
    return text.lower()


def _has_at(text: str) -> bool:
    return "@" in text or (("(" in text or "[" in text or "<" in text or "{" in text) and bool(_AT.search(text)))


def _has_at_word(text: str, low: str) -> bool:
    return "at" in low and ("dot" in low or bool(_DOT_NEXT.search(text))) and bool(_AT_WORD.search(text))


def _all(pattern: re.Pattern, starts: re.Pattern, text: str) -> Iterator[re.Match]:
    """pattern.finditer(text), tried only where `starts` allows."""
    end = 0
    for s in starts.finditer(text):
        if s.start() >= end and (m := pattern.match(text, s.start())):
            end = m.end()
            yield m


def propose(text: str, common: frozenset[str]) -> list[Span]:
    """Overlapping spans that may be personal information. High recall; the trees choose."""
    out, low = [], _lowered(text)
    if _has_at(text):
        out += [Span(0, 0 if "@" in m[0] else 1, m.start(), m.end()) for m in _EMAIL.finditer(text)]
    if _has_at_word(text, low):
        out += [Span(0, 2, m.start(), m.end()) for m in _SPOKEN.finditer(text)]
    if _DIGITS.search(text):
        for m in _PHONE.finditer(text) if _EIGHT.search(text) else ():
            if not _DAY.match(m[0]):
                head = m[0].lstrip("( ")
                # A bracket that closes behind the number is not its own.
                start = m.start() if m[0].count("(") == m[0].count(")") else m.end() - len(head)
                out.append(Span(1, 0 if head[0] == "+" else 1 if head.startswith("00") else 2 if head[0] == "0" else 3, start, m.end()))
        for form, pattern in enumerate(_IDS) if _ID_HINT.search(text) else ():
            if _ID_HINTS[form].search(text):
                out += [Span(2, form, m.start(), m.end()) for m in pattern.finditer(text)]
    for m in _all(_ADDRESS, _HOUSE_START if any(x in low for x in _HOUSE_WORDS) or _HOUSE_LETTER.search(low) else _NUMBER_START, text) if any(x.search(text) for x in _ADDRESS_HINTS) else ():
        s = m[0]
        out.append(Span(3, 0, m.start(), m.end()))
        # Up to each comma, and up to the last words too: the end may be no part of the address.
        out += [Span(3, 1, m.start(), m.start() + len(s[:i].rstrip())) for i in [i for i, c in enumerate(s) if c == ","][1:]]
        bare = re.sub(rf"{_PIN}$", "", s)
        if len(bare) == len(s):
            out += [Span(3, 2, m.start(), m.start() + w.start()) for w in list(re.finditer(r"\s+", bare))[-2:] if bare.rfind(",") < w.start() - 1]
    for m in (_TITLED if _LOW_TITLE.search(text) else _HIGH_TITLED).finditer(text):
        n = _NAME_AT.match(text, m.end())
        if n:
            tokens = [t.end() for t in takewhile(lambda t: not _NO_NAME.fullmatch(t[0]), _SPLIT.finditer(text, n.start(), n.end()))]
            if not tokens:
                continue
            out += [Span(4, 0, n.start(), e) for e in tokens[:5]]
            rest = _COMMA_TOKEN.match(text, tokens[0])
            if rest:
                out.append(Span(4, 1, n.start(), rest.end()))
    firms = any(x in low for x in _FORMS)
    for m in _all(_RUN, _RUN_START, text):
        tokens = [(t.start(), t.end()) for t in _SPLIT.finditer(text, m.start(), m.end())]
        rare = [not _is_common(text[a:b], common) for a, b in tokens]
        # A run that is or leads into a company's name holds no person's.
        if not any(a and b for a, b in zip(rare, rare[1:])) or (firms and (_COMPANY_IN.search(m[0]) or _COMPANY.match(text, m.end()))):
            continue
        for i in range(len(tokens)):
            if not rare[i]:
                continue
            for j in range(i + 1, min(i + 5, len(tokens))):
                if not rare[j]:
                    break
                inner = text[tokens[i][1] : tokens[j][0]]
                commas = inner.count(",")
                if commas > 1 or (commas and (j > i + 1 or "." in inner)):
                    continue
                out.append(Span(4, 3 if commas else 2, tokens[i][0], tokens[j][1]))
    return out


def _is_common(token: str, common: frozenset[str]) -> bool:
    t = token.strip(" .")
    return len(t) > 1 and (t.lower() in common or bool(_NO_NAME.fullmatch(t)))


def features(text: str, spans: list[Span], known: Words) -> np.ndarray:
    """Format and context of each span, as numbers."""
    common = known.lower
    out = np.zeros((len(spans), 37), np.float32)
    for i, s in enumerate(spans):
        t, before, after = text[s.start : s.end], text[max(0, s.start - 60) : s.start], text[s.end : s.end + 50]
        groups = re.findall(r"\d+", t)
        words = _WORDS.findall(t)
        prev, nxt = text[s.start - 1 : s.start], text[s.end : s.end + 1]
        tokens = [x.group() for x in _SPLIT.finditer(t)] if s.kind == 4 else []
        longer = any(o.kind == s.kind and o.start <= s.start and o.end >= s.end and (o.start, o.end) != (s.start, s.end) for o in spans)
        right = any(o.kind == s.kind and o.start == s.start and o.end > s.end for o in spans)
        # What is around is only looked at where it can tell something about the kind.
        number, name, place = s.kind in (1, 2), s.kind == 4, s.kind >= 3
        out[i] = (
            s.kind, s.form, len(t), sum(map(len, groups)), len(groups), max(map(len, groups), default=0), len(words),
            sum(1 << k for k, c in enumerate("+(.- /@,\n") if c in t), _sign(prev), _sign(nxt),
            name and bool(_TITLE_END.search(before)), number and bool(_ID_LABEL.search(before)), number and bool(_PHONE_LABEL.search(before)), number and bool(_OTHER_LABEL.search(before)), number and bool(_MONEY.search(before)),
            name and bool(_COMPANY.match(after)), name and bool(_COMPANY_IN.search(t)), sum(w.lower() in common for w in words),
            bool(words) and words[0].lower() in common, bool(words) and words[-1].lower() in common,
            name and bool(_RELATION.search(before)), name and bool(_AFTER_NAME.match(after)), place and bool(_PLACE.search(before)), place and bool(_PLACE_AFTER.match(after)),
            s.kind == 3 and bool(re.search(r"\d{3}\s{0,2}\d{3}$", t)), place and len(_STREET.findall(t)), t.count(","), name and bool(_OFFICE.search(t)), place and bool(_MONTH.search(t)), longer, right,
            sum(w.title() in known.capital for w in words), sum(w.title() in known.firm for w in words), bool(words) and words[-1].title() in known.firm,
            sum(len(x.strip(" .")) == 1 for x in tokens), t.isupper(), s.kind == 3 and (bool(_HOUSE_AT.match(t)) or bool(_STREET_AT.match(t))),
        )
    return out


def _sign(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;" else 9 if c == ":" else 5 if c in "(<[" else 6 if c == "/" else 7 if c in "₹$€" else 8


# Training texts: made sentences with marked spans and with what only looks like personal data. They are written from
# what is publicly known of such writing (notices, letters, leases, logs, deeds), not from any table; slots are filled
# with made words. <N> name, <A> address, <E> e-mail, <P> phone, <L> labelled identity number; {W} a capitalised made
# word, {F} a firm, {c} a place, {nK} K digits, {AK} K letters, {d} a date, {m} an amount.

_SYLLABLES = "ka ra mi to ven lu sha dor pel ist ana kur bel fo rin das qu ol mar ze tha vi run gal neb osh uri ham jo wen sil tru eb ock ny ash".split()
_STREET_KINDS = "Road Street Lane Avenue Marg Path Crescent Terrace Circle Bypass".split()
_HOUSE_KINDS = "Towers Residency Apartments Heights Villas Enclave Mansion Gardens".split()
_TRADES = "Cement Chemicals Logistics Hotels Minerals Polymers Dairy Cables Beverages Glass Carriers Fisheries Granites Plywood Software Pumps Bearings Leather Jewels Printers".split()
_FIRMS = ["Limited", "Ltd.", "Ltd", "LLP", "Private Limited", "Pvt. Ltd.", "Pvt Ltd", "Industries Limited", "Holdings Pvt. Ltd.", "Corporation", "Bank", "Trust"]
_PLAIN = [
    "Rent for the shop fell due on {d} and stayed unpaid.", "Water reached the ground floor after midnight.", "{F} shipped {n3} crates in {y} under consignment {n8}.", "A draft of {m} drawn on {F} came back.",
    "Both engineers of {F} visited the {c} factory twice.", "Its GSTIN {n2}{A5}{n4}{A1}1Z{n1} was printed on every bill.", "Companies are told apart by the CIN L{n5}{A2}{y}PLC{n6}.", "The LLPIN is {A3}-{n4} and the TIN {n11}.",
    "NEFT reference {A4}{n12} shows {m} leaving a/c no. {n12}.", "IFSC {A4}0{n6} belongs to the {c} branch.", "Please quote invoice {n7} or order id {n10} when paying.", "Policy {n9} lapsed; premium {m} had been due on {d}.", "Vide FIR No. {n3}/{y} and Case No. {n4} of {y}.",
    "Tender {n8} closed at noon, tender {n7} a day later.", "Clause {n2}.{n1} prevails over Schedule {A1}.", "Article {n2} read with Rule {n1} governs refunds.", "Growth was 4.{n1} per cent @ {n2} units an hour.", "Prices rose from {m} to {m} within {n2} weeks.", "Rainfall of {n3} mm was measured at {c} and {c}.",
    "A helpline is open from 9.30 to 17.45 daily.", "Train {n5} leaves {c} at 06:{n2} and halts thrice.", "The map sheet {n2}/{A1}/{n2} covers the village.", "Plans hang in the {c} office, next to the {c} depot.", "Forms are found at www.{w}.example or at {w}.{w}.example.", "Meter {n8} was read on {d}; meter {n6} was not.",
    "Sir, the Committee regrets the delay.", "Madam Chairperson, members of the Board, thank you.", "My Lord, the Registrar will report on {d}.", "Our Company Secretary and the Chief Financial Officer signed off.", "The Official Liquidator wrote to the Deputy Commissioner.", "Learned Senior Advocate made no submission.", "Hon'ble Supreme Court has settled the question.",
    "{F} merged with {F} in {y}.", "Between {F}, {F} and {F} no contract exists.", "{F} and {W} {t} fought over a trade mark.", "As guarantor {F} was sued first, then {F}.", "Since its {c} mill burned down, {F} moved to {c}.", "Shares in {F} traded at {m} on {d}.", "{F}, through {F}, bought the {c} site.", "Goods lay with {F}; {F} insured them.",
    "{W} {t} had changed its name to {F} by {y}.", "A notice by {F} dated {d} was ignored.", "Letters from {F} to {F} of {d}.", "National Company Law Tribunal, {c} Bench, heard it.", "Indian Contract Act and Transfer of Property Act apply.", "EMI of {m} was debited {n2} times.", "Loan account {n14} and deposit {n11} were merged.", "Lot {n4}-{n5}-{n4} passed inspection.",
    "Serial numbers {n4} {n4} {n3} to {n4} {n4} {n3} are void.", "Ward {n2}, booth {n3}, polled on {d}.", "Batch {A1}{n7} was recalled by {F}.", "Vehicle {A2} {n2} {A2} {n4} was towed from {c}.", "Cargo {A2}{n7} left {c} on {d}.", "Docket {A3}{n6} remains open.", "ISBN {n3}-{n10} is out of print.", "The Hague and Geneva Conventions were cited.", "RTI reply {n5}/{y} runs to {n2} pages.", "UTR {A4}N{n11} of {d} was traced.",
]
_HOLDING = [
    "This deed is made between <N>, <L>, and {F}.", "I, <N>, aged {n2} years, do solemnly affirm.", "<N> has let the first floor at <A> to <N>.", "Parcel for <N>, <A>, could not be handed over.", "Kindly ring <P> or mail <E>.", "Tel. <P>, fax <P>", "Phone: <P>; e-mail: <E>", "WhatsApp us on <P>.",
    "Mobile no. <P> belongs to <N>.", "You may dial <P> between ten and five.", "For refunds contact <N> (<P>).", "Queries go to <E> with a copy for <E>.", "<E> bounced on {d}.", "From: <E>", "Sent by <N> <<E>> on {d}.", "The applicant holds <L>.",
    "<N> (<L>) owns half.", "Identity was proved by <L> and <L>.", "Copies of <L> are attached.", "<L> was found to be forged.", "Her <L> expired in {y}.", "KYC papers: <L>; <L>; <P>.", "Notice was pasted at <A>.", "They lived at <A> until {y}.", "Address for service: <A>.", "Goods were stored at <A> and at <A>.",
    "The flat, <A>, is under attachment.", "Permanent address: <A>; <P>.", "A bailiff went to <A> but found it locked.", "<N> told the officer that <N> was abroad.", "Present: <N>, <N> and <N>.", "Heard <N> for the landlord.", "<N> appeared for {F}; <N> for the bank.", "Mediation by <N> failed.", "The will names <N> as heir.",
    "Payments to <N> stopped after {d}.", "<N>, wife of <N>, signed as nominee.", "<N> S/o <N>, r/o <A>.", "Receipt given by <N> for {m}.", "<N>'s cheque was dishonoured.", "The letter of <N> dated {d} is denied.", "Driver <N> lost control near {c}.", "Witness 2: <N>; witness 3: <N>.", "Dear <N>, your claim is closed.", "Yours faithfully, <N>",
    "<N> was promoted at {F} in {y}.", "When <N> resigned, {F} appointed <N>.", "<N> and {F} are jointly liable.", "{F} paid <N> {m}.", "Loans were taken by <N> from {F} and by {F} from <N>.", "Director <N>, <L>, was disqualified.", "Legal heirs of <N>: <N>, <N>.", "Title passed from <N> to <N> on {d}.", "Minutes were taken by <N>; <N> dissented.", "A message from <P> said so.",
    "CCTV shows <N> leaving at 21:{n2}.", "It was <N> who wrote the note.", "Nobody but <N> knew the code.", "According to the diary <N> left on {d}.", "Complaint by <N>, mobile <P>, <E>.", "Surety: <N>, <L>, <A>.", "<N> could be traced only through <P>.", "Post reaches <N> at <A>.", "\n<A>\n<P>", "Meet <N> at <A> on {d}.", "The tenant (<N>) and his brother (<N>) agreed.", "Signed\n<N>\n<L>", "Examined: <N> on {d}.", "Caller <P> gave no name.", "Write c/o <N>, <A>.",
]

# Besides whole sentences: what may stand before and after a slot, for personal data and for what only looks like it alike.
_BEFORE = {
    "<N>": ["Money came in through", "We met", "The seller,", "Two sons of", "It is pleaded that", "Keys lay with", "Rent went to", "An order in favour of", "Acting for", "A plea against", "The buyer named", "Her uncle", "No one but", "Going by the letter from", "Under the will of", "Surveyor", "The clerk said that", "Copy to:", "Attested:", "(", "W-4:", "Since", "Per", "They asked", "Our agent,", "W-1:", "a person called", "The bond mentions", "Counsel, namely", "An affidavit by one", "The report lists", "In the view of"],
    "<A>": ["The shop stands at", "Deliver to", "Summons went to", "A room in", "They shifted from", "Place of work:", "Site:", "Goods lie at", "(", "The court visited", "Send it to", "A copy for", "Books are kept at", "We own"],
    "<E>": ["Reply to", "Mail:", "A note from", "See", "<", "(", "<", "Or write:", "the mailbox", "Send scans to", "Reports come from"],
    "<P>": ["Ring", "Mobile:", "Calls reach", "Ask at", "(", "He texted", "Office line", "Contact", "Try"],
    "<L>": ["A scan of", "Holder of", "(", "He gave", "Verified against", "Her", "Copy of", "It bears", "Details:"],
    "{X}": ["Money came in through", "We met", "The seller,", "A plea against", "Acting for", "Rent went to", "The report lists", "Going by the letter from", "W-4:", "Deliver to", "Site:", "Send it to", "A note from", "Ring", "See", "(", "A scan of", "Verified against", "It is pleaded that", "Since", "In the view of", "The bond mentions", "Copy to:", "Under", ""],
}
_AFTER = [".", ",", ";", ")", " and left.", ", as agreed.", " on {d}.", " for {m}.", " the next day.", " in vain.", " was noted.", " is disputed.", " ({W} file).", "; nothing came of it.", " twice.", ". Then it rained.", ". {F} objected.", ". Later the rent rose.", " it is said.", " some money came.", ", later the sole heir,", ", aged {n2}", "\n", " / ", " as agent of {F}.", " that day. Nobody saw it.", ">", " with {F}.", " had {n2}.", " as owner.", " or {F}."]
_LOOKS = ["{F}", "{F}", "{F} and {F}", "{W} {t}", "{c}", "the {c} bench", "the {c} property", "invoice {n8}", "account {n11}", "UTR {A4}{n10}", "file {n8}", "{m}", "{d}", "Clause {n2}", "GSTIN {n2}{A5}{n4}{A1}1Z{n1}", "CIN U{n5}{A2}{y}PTC{n6}", "page {n3}", "Mr. Chairman", "Mr. Speaker", "Madam President", "Mr. Secretary", "Dr. Registrar", "Mrs. Chairperson", "ref. {A3}{n7}", "STATEMENT OF CLAIM:", "TERMS OF SALE:", "LIST OF DATES:", "FINAL AWARD:", "OPENING REMARKS:", "ANNUAL RETURN:", "GENERAL NOTES:", "BOARD MINUTES:", "SCHEDULE OF RENTS:"]


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.families = [self.word().title() for _ in range(80)]

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((2, 3, 3, 4))))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def letters(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))

    def name(self) -> tuple[str, str]:
        r, first, last = self.r, self.word().title(), self.word().title() if self.r.random() < 0.5 else self.r.choice(self.families)
        title = r.choice(["Mr.", "Mrs.", "Ms.", "Dr.", "Shri", "Smt.", "Sri", "Prof.", "Justice", "Adv.", "Kumari", "MR.", "shri", "Mr", "Ms"]) + " "
        form = r.randrange(9)
        if form == 0:
            return title, last
        text = (f"{first} {last}", f"{first} {last}", f"{first} {last}", f"{first[0]}. {last}", f"{first[0]}.{last}", f"{last}, {first}", f"{first} {self.letters(1)}. {last}", f"{first} {last}".upper())[form - 1]
        return ("" if form == 6 or r.random() < 0.35 else title), text

    def phone(self) -> str:
        d = self.digits
        return self.r.choice([f"+91 5{d(4)} {d(5)}", f"+915{d(9)}", f"+91-5{d(9)}", f"0091 5{d(2)} {d(3)} {d(4)}", f"05{d(9)}", f"5{d(9)}", f"5{d(4)}-{d(5)}", f"+44 7700 900{d(3)}", f"+1 (555) 555-0{d(3)}", f"(0191) 555 0{d(3)}", f"0191-5550{d(3)}", f"+91.5{d(3)}.{d(3)}.{d(3)}"])

    def number(self) -> tuple[str, str]:
        d, up, r = self.digits, self.letters, self.r
        kind = r.randrange(5)
        if kind == 0:
            a, b, c = up(5), d(4), up(1)
            v = r.choice([a + b + c, f"{a} {b} {c}", f"{a}-{b}-{c}", (a + b + c).lower()])
            return r.choice(["PAN ", "PAN: ", "PAN No. ", "income tax number "]), v
        if kind == 1:
            a = [d(4) for _ in range(3)]
            return r.choice(["Aadhaar No. ", "UID ", "citizen number ", "Aadhaar "]), r.choice(["", " ", "-"]).join(a)
        if kind == 2:
            return r.choice(["DIN ", "DIN: "]), d(8)
        return (r.choice(["passport ", "passport No. ", "travel document "]), up(1) + d(7)) if kind == 3 else (r.choice(["voter card ", "EPIC No. "]), up(3) + d(7))

    def firm(self) -> str:
        r, w = self.r, self.word().title()
        return r.choice([f"{w} {r.choice(_TRADES)}", f"{w} {r.choice(_TRADES)}", w, f"{w} {self.word().title()}", f"{w} & {self.word().title()}"]) + " " + r.choice(_FIRMS)

    def date(self) -> str:
        d, m, y = self.r.randrange(1, 29), self.r.randrange(1, 13), self.r.randrange(1990, 2026)
        long = "January February March April May June July August September October November December".split()[m - 1]
        return self.r.choice([f"{d:02}.{m:02}.{y}", f"{d} {long} {y}", f"{long} {d}, {y}", f"{y}-{m:02}-{d:02}", f"{d}/{m}/{y}", f"{d}-{m}-{y}"])

    def amount(self) -> str:
        return self.r.choice([f"Rs. {self.digits(2)},{self.digits(2)},{self.digits(3)}", f"₹{self.digits(8)}", f"INR {self.digits(5)}", f"₹ {self.digits(2)}.{self.digits(2)} crore", f"Rs {self.digits(1)}.{self.digits(2)} lakh"])

    def address(self) -> str:
        r = self.r
        street = " ".join([*(self.word().title() for _ in range(r.choice((1, 1, 2)))), *r.choice(([], ["Old"], ["Fort"], ["East"])), r.choice(_STREET_KINDS)])
        house, city = f"{self.word().title()} {r.choice(_HOUSE_KINDS)}", self.word().title()
        n = r.randrange(1, 400)
        head = r.choice([f"Flat {n % 90}-{self.letters(1)}, {house}, {street}", f"Plot No. {n}, Sector {n % 60 + 1}", f"Door No. {n}, {n % 8 + 2}th Cross, {street}", f"H. No. {n}, {street}", f"{n}/{n % 30}, {street}", f"{n} {street}", f"{house}, {n} {street}"])
        pin = self.digits(6)
        return f"{head}, {city}" + r.choice(["", "", f" - {pin}", f"-{pin}", f", PIN {pin}", f" {pin}", f" {pin[:3]} {pin[3:]}"])

    def mail(self) -> str:
        a, b, host, r = self.word(), self.word(), self.word(), self.r
        local = r.choice([f"{a}.{b}", f"{a}_{b[0]}", f"{a}{self.digits(2)}", f"{b[0]}{a}", f"{a}+claims", f"{a}-{b}"])
        full = host + r.choice([".test", ".example", ".co.example", ".invalid", ".com"])
        v = r.choice([f"{local}@{full}"] * 3 + [f"{local} @ {full}", f"{local}[at]{full}", f"{local}(at){full}", f"{local} [at] " + full.replace(".", " [dot] "), f"{local} at " + full.replace(".", " dot ")])
        return v.upper() if r.random() < 0.1 else v

    def sentence(self, part: int, parts: int) -> str:
        """One of the sentences of this part, or one composed of its pieces."""
        r, mine = self.r, lambda v: r.choice(v[part::parts])
        kind = r.random()
        if kind < 0.5:
            return mine(_PLAIN if kind < 0.22 else _HOLDING)
        slot = r.choice(["<N>", "<N>", "<N>", "<A>", "<E>", "<P>", "<L>", "{X}", "{X}", "{X}", "{X}"])
        before = mine(_BEFORE[slot])
        return f"{before}{'' if before in '(<' else ' '}{mine(_LOOKS) if slot == '{X}' else slot}{mine(_AFTER)}"

    def text(self, part: int = 0, parts: int = 1) -> tuple[str, set[tuple[int, int, int]]]:
        """A text of up to four sentences and its spans (kind, start, end)."""
        r, out, spans = self.r, "", set()
        for _ in range(r.randrange(1, 5)):
            for piece in re.split(r"(\{\w+\}|<[NALEP]>)", self.sentence(part, parts)):
                if piece[:1] == "{":
                    code, n = piece[1], int(piece[2:-1] or 1) if piece[2:-1].isdigit() or not piece[2:-1] else 1
                    piece = {"n": lambda: self.digits(n), "A": lambda: self.letters(n), "w": self.word, "W": lambda: self.word().title(), "c": lambda: self.word().title(), "F": self.firm, "t": lambda: r.choice(_TRADES), "d": self.date, "m": self.amount, "y": lambda: str(r.randrange(1990, 2026)), "L": lambda: "".join(self.number())}[code]()
                elif re.fullmatch(r"<[NALEP]>", piece):
                    head, v, kind = "", "", "EPLAN".index(piece[1])
                    if piece[1] == "N":
                        head, v = self.name()
                    elif piece[1] == "L":
                        head, v = self.number()
                    else:
                        v = {"E": self.mail, "P": self.phone, "A": self.address}[piece[1]]()
                    out += head
                    spans.add((kind, len(out), len(out) + len(v)))
                    piece = v
                out += piece
            out += " "
        if r.random() < 0.12:  # some texts have odd spacing
            wide, moved = "", {}
            for i, c in enumerate(out):
                moved[i] = len(wide)
                wide += "  " if c == " " else c
            moved[len(out)] = len(wide)
            spans = {(k, moved[a], moved[b - 1] + 1) for k, a, b in spans}
            out = wide
        return out, spans


@dataclass
class Model:
    trees: Trees
    thresholds: np.ndarray
    words: Words
    held_out: dict[str, float] = field(default_factory=dict)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        return self.find_all([text])[0]

    def find_all(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) in each text: spans above their kind's threshold, the surest first, none over another."""
        proposed = [propose(t, self.words.lower) for t in texts]
        some = [features(t, s, self.words) for t, s in zip(texts, proposed) if s]
        if not some:
            return [[] for _ in texts]
        p = self.trees.score(np.concatenate(some))
        out, at = [], 0
        for spans in proposed:
            out.append(_pick(spans, p[at : at + len(spans)], self.thresholds))
            at += len(spans)
        return out


def _pick(spans: list[Span], p: np.ndarray, thresholds: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans above their kind's threshold, the surest first, none over another, in order."""
    picked: list[tuple[int, int, int]] = []
    mine = [(v, s) for v, s in zip(p, spans) if v >= thresholds[s.kind]]
    for _, s in sorted(mine, key=lambda m: (-round(float(m[0]), 3), m[1].start - m[1].end, m[1].start, m[1].kind)):
        if all(s.end <= a or s.start >= b for _, a, b in picked):
            picked.append((s.kind, s.start, s.end))
    return sorted(picked, key=lambda v: v[1])


#: Parts of the made sentences, of which one is held out, and the weight of recall in the F score that sets a threshold:
#: a name left in a text is worse than a word too many replaced.
FOLDS, RECALL = 2, 2.0


@lru_cache(maxsize=4)
def train(words: Words, texts: int = TRAINING_TEXTS, seed: int = 11) -> Model:
    """Fits trees to spans proposed in made texts.

    Sentences, not texts, are held out: every text is made of the sentences of one of FOLDS parts, each part is scored by
    trees fitted to the others, and these scores set the thresholds and the F1 in `held_out`. The trees that are
    returned are fitted to all parts.
    """
    make = _Maker(seed)
    made = [make.text(i % FOLDS, FOLDS) for i in range(texts)]
    pieces = (*_PLAIN, *_HOLDING, *_AFTER, *_LOOKS, *(b for v in _BEFORE.values() for b in v))
    lower = words.lower | {w for t in pieces for w in _LOWER.findall(t)}
    # Words of trades are common with a capital and in firms, and so are, with a capital, some family names.
    capital = words.capital | set(_TRADES) | {w.title() for t in pieces for w in _CAPITAL.findall(t)} | set(make.families[::2])
    known = Words(frozenset(lower), frozenset(capital), words.firm | set(_TRADES))
    spans = [propose(t, known.lower) for t, _ in made]
    x = np.concatenate([features(t, s, known) for (t, _), s in zip(made, spans) if s])
    y = np.concatenate([np.array([(s.kind, s.start, s.end) in truth for s in own], float) for (_, truth), own in zip(made, spans) if own])
    part = np.concatenate([np.full(len(own), i % FOLDS) for i, own in enumerate(spans)])
    p = np.zeros(len(x))
    parts = [fit(x[part != f], y[part != f]) for f in range(FOLDS)]
    for f, trees in enumerate(parts):
        p[part == f] = trees.score(x[part == f])
    thresholds = np.array([best_threshold(p[m], y[m], RECALL) if (m := x[:, 0] == k).any() else 0.5 for k in range(len(KINDS))])
    thresholds = np.clip(thresholds, 0.1, 0.5)
    model = Model(fit(x, y), thresholds, known)
    # F1 of the whole search: what the scores of the held-out parts pick, against all that is marked, proposed or not.
    picked, at = [], 0
    for own in spans:
        picked.append(set(_pick(own, p[at : at + len(own)], thresholds)))
        at += len(own)
    for k, kind in enumerate(KINDS):
        hit = sum(s[0] == k for mine, (_, truth) in zip(picked, made) for s in mine & truth)
        both = sum(s[0] == k for mine, (_, truth) in zip(picked, made) for s in (*mine, *truth))
        model.held_out[kind] = 2 * hit / max(1, both)
    return model


def _words(text: str) -> set[str]:
    """Words of a text without the local parts of its e-mail addresses, which are often names: in lower case, with a
    capital, and, marked by a sign, before the legal form of a firm."""
    if _has_at(text):
        text = _EMAIL_LOCAL.sub("@", text)
    low = _lowered(text)
    if _has_at_word(text, low):
        text = _SPOKEN_LOCAL.sub("@", text)
    firms = _FIRM_WORD.findall(text) if any(x in low for x in _FIRM_FORMS) else ()
    return {*chain.from_iterable(map(_token_words, set(text.split()))), *("&" + w.title() for w in firms)}


@lru_cache(maxsize=1 << 18)
def _token_words(token: str) -> tuple[str, ...]:
    """Of what stands between blanks: no word holds or looks beyond one."""
    return (*_LOWER.findall(token), *(w.title() for w in _CAPITAL.findall(token)))


def as_words(found: list[str]) -> Words:
    return Words(frozenset(w for w in found if w[0].islower()), frozenset(w for w in found if w[0].isupper()), frozenset(w[1:] for w in found if w[0] == "&"))


def common_words(segments: DataFrame, text: str = "text") -> Words:
    """Words that stand in COMMON_SHARE of all distinct texts, and in two at least.

    Every text is read and copies count once. At most the words of a mean text / COMMON_SHARE pass, so the list is
    bounded whatever the size of the table.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = Counter(w for t in pdf["t"] for w in _words(t))
            n[""] = len(pdf)  # no word is empty: the number of texts
            yield pd.DataFrame({"word": list(n), "n": list(n.values())})

    texts = segments.filter(F.length(text) > 0).select(F.col(text).alias("t")).distinct()
    counts = cut(texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.filter("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    got = [r.word for r in counts.filter((F.col("word") != "") & (F.col("n") >= max(2, total * COMMON_SHARE))).select("word").collect()]
    return as_words(got)


def fitted(segments: DataFrame, text: str = "text") -> Model:
    """A model whose common words come from all distinct texts."""
    return train(common_words(segments, text))


def find(segments: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, kind, pii_text, start: one row per place of personal information in `text`.

    Null and empty texts hold none; texts of any length are read whole. Repeated rows stay repeated. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["__text"].to_list()
            found = model.find_all(texts)
            at = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            flat = [(KINDS[k], t[a:b], a) for t, f in zip(texts, found) for k, a, b in f]
            if not flat:
                continue
            yield pdf.drop(columns="__text").iloc[at].assign(kind=[f[0] for f in flat], pii_text=[f[1] for f in flat], start=[f[2] for f in flat])

    kinds = dict(segments.dtypes)
    rows = segments.filter(F.length(text) > 0).select(*keep, F.col(text).alias("__text"))
    return rows.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "kind string, pii_text string, start int"]))


def redact(segments: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, redacted, n_found: each span is replaced by its kind in square brackets, the rest stays as it is.

    Null and empty texts stay as they are, with n_found 0.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["__text"].to_list()
            found = model.find_all([t or "" for t in texts])
            out = []
            for t, spans in zip(texts, found):
                for k, a, b in reversed(spans):
                    t = f"{t[:a]}[{KINDS[k]}]{t[b:]}"
                out.append(t)
            yield pdf.drop(columns="__text").assign(redacted=out, n_found=[len(f) for f in found])

    kinds = dict(segments.dtypes)
    return segments.select(*keep, F.col(text).alias("__text")).mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "redacted string, n_found int"]))
