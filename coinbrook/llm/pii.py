"""Personal data in plain and in disguised form, with offsets into the source.

Identifiers are looked for in the text itself (the base) and once more in a normalised
text. Normalisation is a chain of transducers, each rewriting pieces of the text and
carrying for every character the source span that it came from: homoglyphs become
ASCII, invisible characters go, runs of digits spelled in seven languages become digits,
and at/dot disguises (bracketed, spoken, or with blanks around the signs) become the
signs. A domain is told by its shape: the last label is a country's two letters, or one
of some thirty endings. Spans found there are mapped back to the source and added
unless a base span holds them.

Defined results: a null text is empty and has no spans; equal rows get equal rows;
overlapping spans of different kinds are all listed; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from coinbrook.llm.common import arrow_step, documents, slices

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does, and takes whole runs, so neither is tried again inside.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Matches of the address pattern from left to right, found from each @ outwards."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Spans by kind as listed in KINDS, then by start."""
    out = emails(text)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


#: Look-alikes of ASCII letters, digits and signs in Cyrillic and Greek, and of signs.
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝɡ" + "АВЕКМНОРСТУХІЈЅ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "οανρυ", "aeopcyxijshdqwg" + "ABEKMHOPCTYXIJS" + "ABEZHIKMNOPTYX" + "oavpu", strict=True)) | dict(zip("․。．＠﹫＋﹢‐‑‒–—−", "...@@++------", strict=True))
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
#: Digits spelled in English, German, French, Spanish, Portuguese, Italian and Dutch.
DIGIT_WORDS = {
    word: digit
    for digit, words in {
        "0": "zero oh null zéro cero nul", "1": "one eins un uno um een", "2": "two zwei zwo deux dos dois due twee", "3": "three drei trois tres três tre drie", "4": "four vier quatre cuatro quatro quattro",
        "5": "five fünf cinq cinco cinque vijf", "6": "six sechs seis sei zes", "7": "seven sieben sept siete sete sette zeven", "8": "eight acht huit ocho oito otto", "9": "nine neun neuf nueve nove negen",
    }.items()
    for word in words.split()
}
#: Words before " at x.com" that make it a place, not an address.
NO_LOCAL_PART = ("available", "look", "looks", "looking", "found", "find", "here", "us", "me", "site", "website", "page", "online", "hosted", "live", "lives", "visit", "is", "are", "was", "be", "it", "them", "more", "and", "or", "out", "up", "work", "works", "working", "shop", "people", "team", "read", "see", "sign", "register", "download", "news", "blog", "arrived", "stay", "located", "based", "directly", "published", "posted", "error", "errors", "line", "failed", "fails", "defined", "raised")


class Glyphs(dict):
    """Code point to its ASCII look-alike, or to itself: the fixed ones, and by rule each letter, digit or sign in another font, width or circle."""

    def __missing__(self, code: int) -> int:
        form, _, one = unicodedata.decomposition(chr(code)).partition("> ")
        ascii_ = int(one, 16) if form in ("<font", "<wide", "<narrow", "<circle") and " " not in one else code
        self[code] = out = ascii_ if ascii_ < 0x80 else code
        return out


_GLYPHS = Glyphs({ord(k): ord(v) for k, v in HOMOGLYPHS.items()})
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_DIGIT_WORD = r"\b(?:" + "|".join(DIGIT_WORDS) + r")\b"
#: At least three digit words with single blanks or hyphens between them.
_DIGIT_RUN = re.compile(rf"{_DIGIT_WORD}(?:[ -]{_DIGIT_WORD}){{2,}}", re.I)
_PLUS_WORD = re.compile(r"\b(?:plus|más|mais|più) (?=[0-9])", re.I)
_BRACKET = {sign: re.compile(rf"\s?[\[({{<]\s?(?:{word})\s?[\])}}>]\s?", re.I) for sign, word in (("@", "at|ät|arroba|arobase|chiocciola|@"), (".", r"dot|punkt|punto|ponto|point|\."))}
_LABELS = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"
#: The last label of a domain: any country's two letters, or one of these; two letters that end names of files are left out.
_ENDING = r"(?:(?!(?:py|js|ts|md|rs|sh|cs|rb|cc|so|mk|ps|gz|hs|vb|db|pm|am)\b)[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|dev|app|online|shop|site|store|tech|cloud|blog|email|mail|museum|coop|aero|jobs|travel|agency|digital|studio|world)(?![A-Za-z0-9-])"
_DOMAIN_AHEAD = rf"(?!www\.)(?=(?:[A-Za-z0-9-]+\.)+{_ENDING})(?=[0-9-]*[A-Za-z])"
#: Not before a determiner: "look at the dot" is no address. Words for the dot go with those for the sign.
_SPOKEN = re.compile(rf"(?<=[A-Za-z0-9]) (?:at (?!(?:the|a|an|this|that|these|those|each|every) )(?={_LABELS} (?:dot|punkt) [A-Za-z])|(?:arroba|chiocciola) (?={_LABELS} (?:punto|ponto) [A-Za-z])|arobase (?={_LABELS} point [A-Za-z]))", re.I)
#: "www." is a site.
_SPOKEN_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])(?!(?:{'|'.join(NO_LOCAL_PART)}) )([A-Za-z0-9][A-Za-z0-9._%+-]*) at {_DOMAIN_AHEAD}", re.I)
#: A sign with blanks on both sides; dots in the domain have them on both sides or on neither.
_SPACED_AHEAD = rf"(?=(?:[A-Za-z0-9-]+(?: \. |\.))+{_ENDING})(?=[0-9-]*[A-Za-z])"
_SPACED_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])(?!(?:{'|'.join(NO_LOCAL_PART)}) )([A-Za-z0-9][A-Za-z0-9._%+-]*) @ {_SPACED_AHEAD}", re.I)
_SPACED_DOMAIN = re.compile(rf"(?<=@)(?:[A-Za-z0-9-]+(?: \. |\.))+{_ENDING}", re.I)
_SPOKEN_DOMAIN = re.compile(rf"(?<=@)(?:{_LABELS}(?: dot {_LABELS})+|[A-Za-z0-9-]+(?: (?:punkt|punto|ponto|point) [A-Za-z0-9-]+)+)", re.I)
_SIGNS = (" at ", " arroba ", " arobase ", " chiocciola ")
_SPOKEN_LOCAL = re.compile(r"(?<=[A-Za-z0-9]) dot (?=[A-Za-z0-9._%+-]+(?: dot [A-Za-z0-9._%+-]+)*@)", re.I)
_SPOKEN_POINT = re.compile(r"(?<=[0-9]) dot (?=[0-9])", re.I)
_DOT_WORD, _AT, _SPACED = re.compile(" (?:dot|punkt|punto|ponto|point) ", re.I), re.compile(f" at {_DOMAIN_AHEAD}", re.I), re.compile(f" @ {_SPACED_AHEAD}", re.I)


class Traced:
    """A text whose characters know the source span they came from; without ``start`` and ``end`` each is its own."""

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] | None = None
        self.end: list[int] | None = None

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])

    def rewrite(self, pattern: re.Pattern, replacement) -> None:
        """Replaces each match; every new character stands for the match's whole source span."""
        parts, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            if self.start is None:
                self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
            a, b = m.span()
            new = replacement(m)
            parts += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        if at:
            self.text = "".join([*parts, self.text[at:]])
            self.start, self.end = start + self.start[at:], end + self.end[at:]


def _spelled(m: re.Match) -> str:
    """Only zeros are no number: "null null null" stands for missing values. Nor are words whose letters only ignored case makes equal, as with a dotless i."""
    digits = [DIGIT_WORDS.get(w.lower(), "") for w in re.split(r"[ -]", m[0])]
    return "".join(digits) if all(digits) and set(digits) != {"0"} else m[0]


_WORDS = tuple(DIGIT_WORDS)


def _may_be_spelled(low: str) -> bool:
    """Whether a digit word stands between two others, by one look at each word: the costly pattern is for such texts only."""
    around = low.replace("-", " ").split(" ")
    return any(w in DIGIT_WORDS and around[i - 1].endswith(_WORDS) and around[i + 1].startswith(_WORDS) for i, w in enumerate(around[:-1]) if i)


def _joined(t: Traced, whole: re.Pattern, sign: re.Pattern) -> None:
    """The sign at the end of each match of ``whole`` (``sign`` with what is before it) becomes @; the word before stays as it is, each character with its own source."""
    if sign.search(t.text):
        marks = {m.end() for m in whole.finditer(t.text)}
        t.rewrite(sign, lambda m: "@" if m.end() in marks else m[0])


def normalise(text: str) -> Traced | None:
    """The text after all transducers; None if none of them has anything to do. Each one sees what those before it wrote."""
    t = Traced(text)
    if not text.isascii():
        if any(_GLYPHS[ord(c)] != ord(c) for c in set(text)):
            t.text = text.translate(_GLYPHS)
        t.rewrite(_INVISIBLE, lambda m: "")
    low = t.text.lower()
    if _may_be_spelled(low):
        t.rewrite(_DIGIT_RUN, _spelled)
    if any(x in low for x in ("plus", "más", "mais", "più")):
        t.rewrite(_PLUS_WORD, lambda m: "+")
    if any(x in low for x in "[({<"):
        for sign, pattern in _BRACKET.items():
            t.rewrite(pattern, lambda m, sign=sign: sign)
    if any(x in low for x in _SIGNS):
        t.rewrite(_SPOKEN, lambda m: "@")
        _joined(t, _SPOKEN_AT, _AT)
    if " @ " in low:
        _joined(t, _SPACED_AT, _SPACED)
        t.rewrite(_SPACED_DOMAIN, lambda m: m[0].replace(" ", ""))
    if "@" in t.text:
        t.rewrite(_SPOKEN_DOMAIN, lambda m: _DOT_WORD.sub(".", m[0]))
    if "dot" in low:
        t.rewrite(_SPOKEN_LOCAL, lambda m: ".")
        t.rewrite(_SPOKEN_POINT, lambda m: ".")
    return t if t.text != text else None


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans, both in code points of ``text``. Added ones lie in no base span; they may overlap one, as a longer disguised address does."""
    base = detect(text)
    t = normalise(text)
    if t is None:
        return base, []
    # Spans of a kind don't overlap, so only the last one that starts before can hold another.
    own = [([s for k, s, _ in base if k == kind], [e for k, _, e in base if k == kind]) for kind in KINDS]
    added = []
    for kind, a, b in detect(t.text):
        a, b = t.source(a, b)
        if not any((i := bisect_right(starts, a)) and ends[i - 1] >= b for starts, ends in own):
            added.append((kind, a, b))
    return base, added


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def scan(df: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added, a row for each row of ``df``; the counts are of base spans."""
    kind = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                base, added = find(text)
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + added), len(added)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=[x.split()[0] for x in kind.split(", ")])

    return arrow_step(documents(df), run, kind)


def redacted(text: str) -> str:
    """``text`` with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    base, added = find(text)
    out, at, last = [], 0, 0
    for kind, a, b in sorted(base + added, key=lambda x: (x[1], -x[2])):
        if a >= last:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = last = max(last, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame) -> DataFrame:
    """``df`` with its column ``text`` redacted (null stays null) and all other columns as they are."""

    def run(batches):
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            texts = pa.array([t if t is None else redacted(t) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, batch.schema.field(at), texts)

    return arrow_step(df, run, df.schema)
