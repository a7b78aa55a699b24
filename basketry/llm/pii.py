"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs, plus signs,
digits, URL schemes, and cue words of identifiers in any case. Parsers then expand each anchor
to the boundaries of an address or account and validate it; an anchor inside what was expanded
before is passed over, so that each character is looked at a few times at most.

The four base kinds give exactly the leftmost non-overlapping matches of their patterns
that pass their checks (a match that fails is dropped, and the search goes on behind it).
The parsers add what the patterns miss, because a greedy match ran into the next number: a
``card`` or ``phone`` of whole digit groups inside a match that failed. They also add more
kinds: ``url`` (a scheme with a host), ``account`` (an IBAN whose check digits hold: of a known
country and its length anywhere, of any other behind a cue), and ``secret`` (a value that a cue
such as ``password`` is set to).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, pieces

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
Span = tuple[int, int]

# The character classes of the kinds, and the anchors.
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?")
_SET = re.compile(r"[\"']?[\x20\t]{0,3}[:=][\x20\t]{0,3}[\"']?([A-Za-z0-9+/_.~-]{8,})")
_IBAN_HEAD = re.compile(r"[A-Z]{2}[0-9]{2}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
#: An account of an unknown country begins at most so many characters behind its cue, or behind the account before it.
ACCOUNT_REACH = 60
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
SECRET_CUES = ("password", "passwd", "passphrase", "secret", "token", "api_key", "api-key", "api key", "apikey", "access_key", "access-key", "accesskey", "private_key", "privatekey")
ACCOUNT_CUES = ("iban", "account")
#: Characters of an IBAN by country.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27,
    GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24,
    ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SC=31, SE=24, SI=19, SK=24, SM=27, SV=28, TN=24, TR=26, UA=29,
    VA=22, VG=24, XK=20,
)
_LOWER = {c: c + 32 for c in range(65, 91)}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("digit", "0123456789"), ("at", "@"), ("plus", "+"), ("url", SCHEMES), ("secret", SECRET_CUES), ("account", ACCOUNT_CUES)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number holds."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * d - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def iban_holds(code: str) -> bool:
    """Whether an IBAN's check digits hold."""
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


class Finder:
    """All spans of a text."""

    def __init__(self):
        self.anchors = _automaton()

    def emails(self, text: str, ats: list[int]) -> list[Span]:
        found, floor = [], 0
        for at in ats:
            if at < floor:
                continue
            start = at
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found.append((start, m.end()))
                floor = m.end()
            else:
                floor = at + 1  # no local part crosses an at-sign
        return found

    @staticmethod
    def _ips(m: re.Match, found: list[Span]) -> None:
        """Adds the addresses in a chain of numbers."""
        if m.end() - m.start() < 7:
            return
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                found.append((at, end))
            at = end + 1

    def _cards(self, m: re.Match, found: list[Span], more: list[Span]) -> None:
        """Adds a run of digits that is a card number, or the groups of it that are one."""
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
            else:
                more += self._grouped_cards(m[0], m.start())

    def _grouped_cards(self, run: str, base: int) -> list[Span]:
        """From the left, the longest sequences of whole groups that are card numbers; a group starts a few at most."""
        groups, out, i = [g.span() for g in _DIGITS.finditer(run)], [], 0
        while i < len(groups):
            digits, best = "", None
            for j in range(i, len(groups)):
                digits += run[slice(*groups[j])]
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and luhn(digits):
                    best = j
            if best is None:
                i += 1
            else:
                out.append((base + groups[i][0], base + groups[best][1]))
                i = best + 1
        return out

    def phones(self, text: str, pluses: list[int]) -> tuple[list[Span], list[Span]]:
        """Base spans, and the leading groups, of 9 to 15 digits, of matches that had too many."""
        found, more, floor = [], [], 0
        for at in pluses:
            if at >= floor and (m := _PHONE.match(text, at)):
                floor = m.end()
                n = sum(map(str.isdigit, m[0]))
                if 9 <= n <= 15:
                    found.append(m.span())
                elif n > 15:
                    n, stop = 0, 0
                    for g in _DIGITS.finditer(text, at, m.end()):
                        n += g.end() - g.start()
                        if n > 15:
                            break
                        stop = g.end() if n >= 9 else 0
                    if stop:
                        more.append((at, stop))
        return found, more

    def _account(self, text: str, start: int, known: bool, found: list[Span]) -> bool:
        """Adds the account that begins at ``start``, of its country's length; where none is known, and ``known`` isn't asked for, the longest."""
        m = _IBAN.match(text, start)
        code = m[0].replace(" ", "") if m else ""
        size = IBAN_LENGTHS.get(code[:2])
        for cut in (size,) if size else () if known else range(min(len(code), 34), 14, -1):
            if len(code) >= cut and iban_holds(code[:cut]):
                stop = start
                while cut:
                    cut -= text[stop] != " "
                    stop += 1
                if not (known and text[stop : stop + 1].isalnum()):
                    found.append((start, stop))
                    return True
        return False

    def _accounts(self, text: str, at: int, found: list[Span]) -> None:
        """Adds the accounts behind a cue that ends at ``at``; where a look-alike fails, the next one is tried."""
        last = at + ACCOUNT_REACH
        at = max(at, found[-1][1] if found else 0)
        while (head := _IBAN_HEAD.search(text, at, last + 4)) and head.start() <= last:
            at = head.start() + 1
            if self._account(text, head.start(), False, found):
                at = found[-1][1]
                last = at + ACCOUNT_REACH

    def find(self, text: str) -> dict[str, list[Span]]:
        """The spans of each kind, in code points, end exclusive; ``card+`` and ``phone+`` are added ones."""
        ats, pluses, ips, cards, more_cards, urls, secrets, accounts = [], [], [], [], [], [], [], []
        ip_floor = card_floor = url_floor = 0
        for end, (kind, size) in self.anchors.iter(text.translate(_LOWER)):
            if kind == "digit":
                if end >= ip_floor:
                    m = _DIGIT_CHAIN.match(text, end)
                    ip_floor = m.end()
                    self._ips(m, ips)
                    if end > 1 and text[end - 2 : end].isalpha() and text[end - 2 : end].isupper() and not text[end - 3 : end - 2].isalnum() and (not accounts or accounts[-1][1] < end):
                        self._account(text, end - 2, True, accounts)
                if end >= card_floor:
                    m = _CARD_RUN.match(text, end)
                    card_floor = m.end() if m else end + 1
                    if m:
                        self._cards(m, cards, more_cards)
            elif kind == "at":
                ats.append(end)
            elif kind == "plus":
                pluses.append(end)
            elif kind == "url":
                if end >= url_floor and (m := _HOST.match(text, end + 1)):
                    urls.append((end + 1 - size, m.end()))
                    url_floor = m.end()
            elif kind == "secret":
                if (m := _SET.match(text, end + 1)) and any(c.isdigit() for c in m[1]) and (not secrets or m.start(1) >= secrets[-1][1]):
                    secrets.append(m.span(1))
            else:
                self._accounts(text, end + 1, accounts)
        phones, more_phones = self.phones(text, pluses)
        return {
            "email": self.emails(text, ats), "ip": ips, "card": cards, "phone": phones,
            "url": urls, "account": accounts, "secret": secrets, "card+": more_cards, "phone+": more_phones,
        }


def find_spans(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id`` and ``spans``, a list of (kind, start, end, base).

    Spans are sorted by start, then by kind as in ``KINDS``; spans of different kinds may overlap.
    The whole text is read, however long, in time linear in its length. Null and empty texts have
    no spans; repeated rows give repeated results; null ids are kept; other columns play no part;
    an empty table gives none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    entry = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in pieces(batches):
            out = []
            for text in batch.column("text").to_pylist():
                found = finder.find(text) if text else {}
                rows = sorted((s, KINDS.index(k.rstrip("+")), e, k in KINDS[:4]) for k, spans in found.items() for s, e in spans)
                out.append([{"kind": KINDS[i], "start": s, "end": e, "base": base} for s, i, e, base in rows])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(entry))], ["doc_id", "spans"])

    return columns(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def span_digests(found: DataFrame) -> DataFrame:
    """``doc_id``, counts of base spans, ``base_sha256``, ``spans``, and counts of the other kinds and of all, of ``find_spans``."""
    base = KINDS[:4]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[number(k) for k in base],
        F.sha2(joined(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *[F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[4:]],
        F.size("spans").cast("long").alias("n_spans"),
    )


def redact_text(finder: Finder, text: str) -> str:
    """``text`` with its spans replaced by their kind in angle brackets; spans that overlap are one, of the first one's kind."""
    parts, at = [], 0
    for s, e, k in sorted((s, -e, k) for k, spans in finder.find(text).items() for s, e in spans):
        if s >= at:
            parts += [text[at:s], f"<{k.rstrip('+')}>"]
        at = max(at, -e)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text`` with every span replaced by its kind in angle brackets.

    No character of any span is left. Null stays null and empty stays empty; very long texts are
    redacted whole; repeated rows give repeated results; null ids are kept; other columns play no
    part; an empty table gives none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in pieces(batches):
            out = [redact_text(finder, text) if text else text for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return columns(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string")
