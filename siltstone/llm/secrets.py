"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they stand.  Weak candidates, which alone mean nothing, are
reported only when parts that complete one another stand close together: an access identifier, a
secret value and an endpoint of one credential.  Each part claims the interval that reaches
``REACH`` characters beyond it within its scope, a stretch of text without a blank line; two parts
join when one's interval covers the other.  The join of parts is an interval join by a sweep: parts come in order of
their starts, those whose interval has ended are put away, and a new part meets the ones that are open.  Parts of
a kind never overlap and have a least length, so no more than a fixed number is open at a time, and the
pairs of a document grow with its length alone.

Roles: ``access`` spans, and weak identifiers such as client_id=..., are identifiers; ``assign`` and
long ``hex`` spans, and weak secret-looking strings, are secrets; addresses of services are endpoints.
Reported besides the strong spans:

* ``secret``: a weak secret that joins an identifier;
* ``identifier``: a weak identifier that joins a secret, strong or weak;
* ``endpoint``: an address that joins an identifier and a secret which join one another.

What is joined, directly or through others, is one credential; ``credentials`` lists the parts of each.
Positions are code points, ends exclusive.  All parts of a document lie in its row, so the join
needs no shuffle; every text is scanned whole.

Edge cases: a null text counts as empty; an empty text has no spans; repeated rows are scanned alike;
spans that start at the same place are ordered by kind, in the order of KINDS; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm.common import ByPlace, chunks, pick

#: Kinds in the order that breaks ties; the first three are the strong ones.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
STRONG = 3
#: Characters between parts of a credential, at most.
REACH = 200
#: Bits a character that a weak secret must have at least.
LEAST_ENTROPY = 3.5

_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_IDENTIFIER = re.compile(
    r"""(?<![A-Za-z0-9_])(?:client_?id|access_?key_?id|account_?id|user_?name|login|user)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""",
    re.ASCII | re.IGNORECASE,
)
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(
    r"""(?:https?|wss?|amqps?|redis|mongodb(?:\+srv)?|postgres(?:ql)?|mysql|jdbc:[a-z]+|s3|sftp|ssh)://[^\s"'<>]{3,}"""
    r"""|(?<![A-Za-z0-9.-])(?:[A-Za-z0-9-]+\.)+(?:amazonaws\.com|azure\.com|windows\.net|googleapis\.com)(?![A-Za-z0-9.-])"""
)
_BREAK = re.compile(r"\n[ \t\r]*\n")


Span = tuple[int, int, str]
#: What a kind of part can be to a credential.
ROLES = {"access": "identifier", "identifier": "identifier", "assign": "secret", "hex": "secret", "secret": "secret", "endpoint": "endpoint"}


def strong_spans(text: str) -> list[Span]:
    """(start, end, kind) of each span that needs no company, in order."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return _in_order(found)


def _in_order(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _looks_random(part: str) -> bool:
    """Of three kinds of characters, and with many different ones."""
    kinds = (any(c.isdigit() for c in part), any(c.islower() for c in part), any(c.isupper() for c in part))
    return all(kinds) and -sum(n / len(part) * math.log2(n / len(part)) for n in Counter(part).values()) >= LEAST_ENTROPY


def _uncovered(spans: list[Span], by: list[Span]) -> list[Span]:
    """Those that overlap none of the others; both sorted by start, the others' ends unordered but few."""
    starts, reach, top = [], [], 0
    for s, e, _ in by:
        top = max(top, e)
        starts.append(s)
        reach.append(top)
    return [x for x in spans if (i := bisect_left(starts, x[1])) == 0 or reach[i - 1] <= x[0]]


def joined_pairs(parts: list[Span], breaks: list[int]) -> Iterator[tuple[Span, Span]]:
    """Pairs of parts in different roles, of one scope and at most REACH apart; breaks are the places where scopes end."""
    open_parts: list[Span] = []
    scope = -1
    for part in sorted(parts):
        own = bisect_left(breaks, part[0])
        if own != scope:
            open_parts, scope = [], own
        open_parts = [x for x in open_parts if part[0] - x[1] <= REACH]
        for other in open_parts:
            if ROLES[other[2]] != ROLES[part[2]]:
                yield other, part
        open_parts.append(part)


def linked(text: str, strong: list[Span]) -> tuple[list[Span], list[list[Span]]]:
    """The weak candidates that stand with what completes them, and the credentials that parts make up, each in order."""
    weak_ids = [(m.start(), m.end(), "identifier") for m in _IDENTIFIER.finditer(text)] if "=" in text or ":" in text else []
    ids = weak_ids + [s for s in strong if s[2] == "access"]
    if not ids:
        return [], []  # nothing can be complete without an identifier
    candidates = [(m.start(), m.end(), "secret") for m in _SECRET.finditer(text) if _looks_random(m.group())]
    weak_secrets = _uncovered(candidates, _in_order(strong + weak_ids))
    endpoints = [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    parts = ids + weak_secrets + [s for s in strong if s[2] != "access"] + endpoints
    near: dict[Span, set[Span]] = {}
    for a, b in joined_pairs(parts, [m.start() for m in _BREAK.finditer(text)]):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    joins: dict[Span, set[Span]] = {}
    for part, others in near.items():
        if part[2] != "endpoint":
            joins[part] = {x for x in others if x[2] != "endpoint"}
    for part, others in near.items():
        if part[2] == "endpoint":
            whole = {x for x in others if not joins[x].isdisjoint(others)}  # an identifier and a secret that join each other
            if whole:
                joins[part] = whole
                for x in whole:
                    joins[x].add(part)
    credentials, seen = [], set()
    for start in sorted(part for part, others in joins.items() if others):
        if start in seen:
            continue
        group, waiting = [], [start]
        seen.add(start)
        while waiting:
            part = waiting.pop()
            group.append(part)
            new = joins[part] - seen
            seen |= new
            waiting += new
        credentials.append(_in_order(group))
    return [part for group in credentials for part in group if KINDS.index(part[2]) >= STRONG], credentials


def linked_spans(text: str, strong: list[Span]) -> list[Span]:
    """(start, end, kind) of each weak candidate that stands with what completes it."""
    return linked(text, strong)[0]


def spans(text: str | None) -> list[Span]:
    """All spans of a text, strong and linked, in order."""
    strong = strong_spans(text or "")
    return _in_order(strong + linked_spans(text or "", strong))


def masked(text: str | None, mask: str = "[{kind}]") -> str | None:
    """The text with every span, or run of overlapping spans, replaced by the name of its first kind."""
    if not text:
        return text
    out, at = [], 0
    for start, end, kind in spans(text):
        if start >= at:
            out += [text[at:start], mask.format(kind=kind)]
        at = max(at, end)
    return "".join(out) + text[at:]


def _joined(found: list[Span], between: str = ",") -> str:
    return between.join(f"{kind}:{start}:{end}" for start, end, kind in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, n_linked, base_sha256, spans, n_credentials, credentials) for every row of docs.

    credentials has the parts of a credential joined by blanks, and credentials joined by semicolons.
    """

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string, n_credentials long, credentials string")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                strong = strong_spans(text or "")
                weak, credentials = linked(text or "", strong)
                count, base = Counter(s[2] for s in strong), _joined(strong)
                both = _joined(_in_order(strong + weak)) if weak else base
                digest = hashlib.sha256(base.encode()).hexdigest()
                rows.append((*(count[k] for k in KINDS[:STRONG]), len(weak), digest, both, len(credentials), ";".join(_joined(c, " ") for c in credentials)))
            yield pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS[:STRONG]), "n_linked", "base_sha256", "spans", "n_credentials", "credentials"])

    return pick(docs, id_col, text_col).select(id_col, scanned(F.col(text_col)).alias("s")).select(id_col, "s.*")


def masked_column(text: Column) -> Column:
    """Each whole text with its spans masked; null stays null."""

    @F.pandas_udf("string")
    def hidden(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in chunks(batches):
            yield pd.Series([masked(t) for t in texts], dtype=object)

    return hidden(text)


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all its rows and columns, with the spans of its texts masked."""
    own = ByPlace(docs)
    text = own.name(text_col)
    return own.back(own.df.withColumn(text, masked_column(F.col(text))))
