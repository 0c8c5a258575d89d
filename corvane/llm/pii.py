"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Kinds in their order: email, ip, card (Luhn), phone, iban (mod-97), ssn, secret. Base spans of the first four are always
kept. The method adds: cards and phones inside longer digit runs that fail as a whole, IBANs of their country's length whose mod-97 is 1,
social security numbers and phones without country code where a context word stands near, private keys and tokens of known
forms, and other runs of mixed characters whose length and entropy are a secret's where a context word stands before them. An added
span is kept when its score is at least ``THRESHOLD``; spans that an equal or longer span of the same kind overlaps aren't added.

Offsets are code points, the end exclusive. Patterns are anchored so that a run of letters or digits is read
once, which keeps very long runs linear.

Defined results: null and empty texts have no spans; repeated rows give repeated rows; an empty table gives an
empty result; other columns pass through :func:`redact` unchanged and are ignored by :func:`find`.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batched, slices

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE_KINDS = KINDS[:4]
THRESHOLD = 0.5
#: Characters before and after a span in which context words count.
NEAR = 48

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PHONE_INSIDE = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,3}(?![0-9])")
_PHONE_NATIONAL = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}(?![A-Za-z0-9])")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_GROUP = re.compile(r"\x20?[A-Z0-9]+")
#: Countries by the letters and digits of their IBANs; Burundi has an old and a new form.
_IBAN_COUNTRIES = {
    15: "NO", 16: "BE BI", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_LENGTHS = {c: sorted(n for n, own in _IBAN_COUNTRIES.items() if c in own.split()) for c in " ".join(_IBAN_COUNTRIES.values()).split()}
_ALNUM = _LOCAL_CHARS - frozenset("._%+-")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_GROUP = re.compile(r"[0-9]+")
#: First digits and lengths of the large issuers' cards.
_ISSUER = re.compile(r"4[0-9]{15}(?:[0-9]{3})?|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11}|35[0-9]{14}|6[0-9]{15,18}")

#: Secrets that their form gives away: private keys, and tokens with an issuer's prefix.
_SECRET_FORM = re.compile(
    r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----(?:[A-Za-z0-9+/=\s]*+-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----)?"
    r"|(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[opsru]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9_-])"
)
_SECRET_RUN = re.compile(r"(?<![A-Za-z0-9+_-])[A-Za-z0-9+_-]{16,}+={0,2}")
_SECRET_MOST = 512
_HEX = re.compile(r"[0-9a-fA-F]+")

_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "secret": 0.3}
_CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|visa|payment|cvv)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social\s+security)\b", re.I),
    "secret": re.compile(r"(?<![A-Za-z])(?:api[-_ ]?key|key|secret|token|password|passwd|pwd|bearer|credentials?|auth)(?![A-Za-z])", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    text = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str):
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's index, start, end): leftmost non-overlapping matches per kind that pass the kind's test."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


def _score(text: str, kind: int, start: int, end: int) -> float:
    name = KINDS[kind]
    near = bool(_CONTEXT[name].search(text, max(0, start - NEAR), start) or _CONTEXT[name].search(text, end, min(len(text), end + NEAR)))
    return min(1.0, round(_PRIOR[name] + 0.3 * near, 2))


def _cards_inside(text: str):
    """Cards among the separated groups of digit runs that fail as a whole. Of cards that overlap, those of an issuer's
    digits and length come first, then those of at most six groups, then the leftmost, then the shortest."""
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 15 or (14 <= len(d := _digits(m[0])) <= 19 and luhn(d)):
            continue
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        found = []
        for i in range(len(groups)):
            d = ""
            for j in range(i, len(groups)):
                d += text[groups[j][0] : groups[j][1]]
                if len(d) > 19:
                    break
                if len(d) >= 14 and luhn(d):
                    found.append((not _ISSUER.fullmatch(d), j - i >= 6, i, j))
        taken = set()
        for _, _, i, j in sorted(found):
            if taken.isdisjoint(range(i, j + 1)):
                taken.update(range(i, j + 1))
                yield groups[i][0], groups[j][1]


def _iban_ends(text: str, start: int):
    """Ends, longest first, at which an IBAN from ``start`` may end: group ends that give its country's length. Of
    letters that no country has, only the whole candidate is tried."""
    lengths = _IBAN_LENGTHS.get(text[start : start + 2])
    if lengths is None:
        m = _IBAN.match(text, start)
        return [m.end()] if m and 15 <= len(m[0].replace(" ", "")) <= 34 else []
    ends, at, n = [], start, 0
    while n < lengths[-1] and (m := _IBAN_GROUP.match(text, at, at + 36)):
        at, n = m.end(), n + len(m[0].strip(" "))
        if n in lengths and not (at < len(text) and text[at] in _ALNUM):
            ends.append(at)
    return ends[::-1]


def _ibans(text: str):
    free = 0
    for m in _IBAN_HEAD.finditer(text):
        if m.start() >= free and (end := next((b for b in _iban_ends(text, m.start()) if mod97(text[m.start() : b])), None)):
            yield m.start(), end
            free = end


def entropy(text: str) -> float:
    """Bits a character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def _secret(run: str) -> bool:
    """Whether a run of 16 to ``_SECRET_MOST`` characters is as mixed as random ones: letters and digits, of at least 3 bits a
    character in hexadecimal and 3.5 in others, these with a fifth of digits or with both cases."""
    letters, digits = sum(map(str.isalpha, run)), sum(map(str.isdigit, run))
    if not letters or digits < 2 or len(run) > _SECRET_MOST:
        return False
    if _HEX.fullmatch(run):
        return entropy(run) >= 3
    return (5 * digits >= len(run) or (run.upper() != run and run.lower() != run)) and entropy(run) >= 3.5


def _secrets(text: str):
    """(start, end, score) of secrets."""
    for m in _SECRET_FORM.finditer(text):
        yield *m.span(), 0.9
    for m in _SECRET_RUN.finditer(text):
        if _CONTEXT["secret"].search(text, max(0, m.start() - NEAR), m.start()) and _secret(m[0].rstrip("=")):
            yield *m.span(), _score(text, 6, *m.span())


class _Taken:
    """Spans of one kind, none of which overlap."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.end_of: dict[int, int] = {}

    def free(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return not at or self.end_of[self.starts[at - 1]] <= start

    def add(self, start: int, end: int) -> None:
        insort(self.starts, start)
        self.end_of[start] = end


def spans(text: str | None) -> list[tuple[int, int, int, float, bool]]:
    """(kind's index, start, end, score, base) of all spans, by start and then kind."""
    if not text:
        return []
    taken = [_Taken() for _ in KINDS]
    out = [(k, a, b, _score(text, k, a, b), True) for k, a, b in base_spans(text)]
    for k, a, b, *_ in out:
        taken[k].add(a, b)
    added = [(2, a, b) for a, b in _cards_inside(text)]
    if "+" in text:
        added += [(3, *m.span()) for m in _PHONE_INSIDE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    added += [(3, *m.span()) for m in _PHONE_NATIONAL.finditer(text) if _CONTEXT["phone"].search(text, max(0, m.start() - NEAR), m.start())]
    added += [(4, a, b) for a, b in _ibans(text)]
    added += [(5, *m.span()) for m in _SSN.finditer(text)]
    scored = [(k, a, b, _score(text, k, a, b)) for k, a, b in added] + [(6, *x) for x in _secrets(text)]
    for k, a, b, s in scored:
        if s >= THRESHOLD and taken[k].free(a, b):
            taken[k].add(a, b)
            out.append((k, a, b, s, False))
    return sorted(out, key=lambda x: (x[1], x[0]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, score, base>>) for each row."""

    def run(batches):
        for part in slices(batches, text_col):
            found = [spans(t) for t in part.column(text_col).to_pylist()]
            offsets = [0]
            for x in found:
                offsets.append(offsets[-1] + len(x))
            flat = [x for own in found for x in own]
            rows = pa.StructArray.from_arrays(
                [pa.array([KINDS[x[0]] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.int32()), pa.array([x[3] for x in flat], pa.float64()), pa.array([x[4] for x in flat], pa.bool_())],
                ["kind", "start", "end", "score", "base"],
            )
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)], [id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return batched(docs.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int,score:double,base:boolean>>")


def masked(text: str | None) -> str | None:
    """``text`` with each run of overlapping spans replaced by the first one's kind in brackets."""
    found = spans(text)
    if not found:
        return text
    out, at = [], 0
    for i, (k, a, b, _, _) in enumerate(found):
        if i and a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with masked texts; all other columns and all rows stay."""

    def run(batches):
        for part in slices(batches, text_col):
            at = part.schema.get_field_index(text_col)
            yield part.set_column(at, part.schema.field(at), pa.array(map(masked, part.column(at).to_pylist()), part.schema.field(at).type))

    return batched(docs).mapInArrow(run, docs.schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans, the joined forms of all spans, and the counts of secrets and of all spans, from :func:`find`'s rows."""

    def joined(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(of: Column, kind: str) -> Column:
        return F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(base, k) for k in BASE_KINDS]
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count(F.col("spans"), "secret"), F.size("spans").cast("long").alias("n_spans"))
