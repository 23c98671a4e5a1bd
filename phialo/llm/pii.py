"""Personal data: patterns propose spans, checksums confirm them, context words weigh them.

Base kinds are email, ip, card (Luhn) and phone.  The method adds three kinds: iban
(mod-97), ssn and local phone numbers.  Every span has a score: its kind's own, raised where a
word of its kind stands within ``CONTEXT_CHARS`` characters before or behind it, lowered where
a word stands there that speaks against personal data (an example, a version, an order
number).  Base spans stay whatever their score; the others count from ``LEAST_SCORE`` on.

Defined results: a null or empty text has no spans; repeated rows are handled one by one;
an empty table gives an empty table; clashing columns of the input give way.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from phialo.llm import batches

#: Kinds in their order, the base patterns, context words of the added kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # joined by single dots
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18
    FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21
    LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25
    SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20""".split()
}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL = re.compile(r"(?<![0-9+-])(?:\([0-9]{3}\)\x20?|0[0-9]{2,4}[\x20/-]|[0-9]{3}-)[0-9]{3}[\x20-]?[0-9]{3,5}(?![0-9-])")
#: What a match of each kind says by itself: the checksums and the signs of an address say most.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "local": 0.3}
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "tax"),
    "local": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
AGAINST = ("example", "sample", "dummy", "placeholder", "version", "release", "order", "invoice", "isbn", "serial", "beispiel", "exemple", "ejemplo")
CONTEXT_CHARS, CONTEXT_GAIN, CONTEXT_LOSS, LEAST_SCORE = 40, 0.4, 0.4, 0.5


def _any_word(words: tuple[str, ...]) -> re.Pattern[str]:
    return re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})(?!\w)", re.I)


_FOR, _AGAINST = {k: _any_word(w) for k, w in CONTEXT.items()}, _any_word(AGAINST)


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Valid IBANs; what follows behind a blank belongs to one only if its length and checksum say so.

    Of the ends at a blank or the match's end, the one of the country's length goes first, then
    the longest; without a valid one the search goes on behind the start.
    """
    out, m = [], IBAN.search(text)
    while m:
        s, e = m.span()
        ends = [i for i in range(s + 15, e) if text[i] == " "] + [e]
        sizes = {i: i - s - text.count(" ", s, i) for i in ends}
        ends = sorted((i for i in ends if sizes[i] >= 15), key=lambda i: (sizes[i] != IBAN_LENGTHS.get(text[s : s + 2]), -i))
        end = next((i for i in ends if mod97(text[s:i].replace(" ", ""))), None)
        if end:
            out.append((s, end))
        m = IBAN.search(text, end or s + 1)
    return out


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each @ is read leftwards over local characters, then its domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in LOCAL_PART:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            out.append((s, free := m.end()))
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four base kinds."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for run in NUMBERS.finditer(text):
        if run[0].count(".") >= 3:
            # a match ends with its fourth number, and the next one begins with the fifth
            numbers, at = run[0].split("."), run.start()
            for four in (numbers[i : i + 4] for i in range(0, len(numbers) - 3, 4)):
                end = at + sum(map(len, four)) + 3
                if all(len(x) <= 3 and int(x) <= 255 for x in (n.lstrip("0") or "0" for n in four)):
                    out.append((at, 1, end))
                at = end + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def score(text: str, span: tuple[int, int, int]) -> float:
    """Score of a span by its kind and the words around it, 0 to 1."""
    s, kind, e = span
    around = text[max(0, s - CONTEXT_CHARS) : s], text[e : e + CONTEXT_CHARS]
    gain = CONTEXT_GAIN * any(map(_FOR[KINDS[kind]].search, around))
    return round(min(1.0, max(0.0, SCORES[KINDS[kind]] + gain - CONTEXT_LOSS * any(map(_AGAINST.search, around)))), 2)


class Taken:
    """Places of a text that spans hold, as separate ranges in order."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, _, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def take(self, s: int, e: int) -> bool:
        """Whether the range was free; it is taken now."""
        i = bisect_left(self.starts, e)
        if i and self.ends[i - 1] > s:
            return False
        self.starts.insert(i, s)
        self.ends.insert(i, e)
        return True


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the method's own kinds that no base span touches; an iban goes before an ssn before a local number."""
    taken, out = Taken(base), []
    for kind, pattern in (("iban", IBAN), ("ssn", SSN), ("local", LOCAL)):
        for s, e in ibans(text) if kind == "iban" else (m.span() for m in pattern.finditer(text)):
            hit = text[s:e]
            if kind == "ssn" and (hit[:3] in ("000", "666") or hit[0] == "9" or hit[4:6] == "00" or hit[7:] == "0000"):
                continue
            span = (s, KINDS.index(kind), e)
            if score(text, span) >= LEAST_SCORE and taken.take(s, e):
                out.append(span)
    return out


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, each by start, then kind."""
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span replaced by its kind; overlapping spans go as one."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _scan(texts: list[str]) -> dict:
    out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores")}
    for text in texts:
        base, spans = find(text)
        for k, name in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
            out[name].append(sum(x[1] == k for x in base))
        out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
        out["spans"].append(joined(spans))
        out["scores"].append(",".join(f"{score(text, x):.2f}" for x in spans))
    return out


def scan_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (without the text) with counts and digest of base spans, all spans and their scores."""
    added = T.StructType([T.StructField(n, T.LongType()) for n in ("n_email", "n_ip", "n_card", "n_phone")])
    added = added.add("base_sha256", "string").add("spans", "string").add("scores", "string")
    return batches.with_columns(docs, text, added, lambda: _scan)


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind; null texts stay null."""
    from pyspark.sql import functions as F

    added = T.StructType().add("_redacted", "string")
    out = batches.with_columns(docs, text, added, lambda: lambda texts: {"_redacted": [redact(x, find(x)[1]) for x in texts]}, drop_text=False)
    clean = F.when(F.col(text).isNotNull(), F.col("_redacted"))
    return out.select(*[clean.alias(text) if c == text else F.col(c) for c in docs.columns])
