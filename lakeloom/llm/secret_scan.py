"""Secret scans: base patterns, and credentials of several parts linked by an interval join.

Strong parts are the base matches (assignments, access identifiers, long hexadecimal runs). Weak parts,
each worthless alone, have a role: an identifier (a short access identifier, a client or account id),
a secret (an opaque mixed run of letters and digits) or an endpoint (a URL or host with a service name).
A text falls into scopes, the blocks between blank lines. Within a scope the parts' intervals are joined in order of
position; a weak part is reported only when a part of another, complementary role (weak or strong) stands in the same
scope. A caller may narrow that to parts within `reach` characters.

Defined cases: a null text is the empty text and has no span; an empty table gives no rows; base matches that
fail their length are dropped without another try; a weak part that overlaps a base match is not reported, and of
two weak parts at one place a named identifier stays; texts and parts of any length are read whole; other columns of
the input are not read; a repeated row gives a row each time.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm.common import read, texts
from lakeloom.llm.spans import Span, Taken, span_rows

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "opaque", "endpoint")
#: The base patterns and the least length of each.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12

#: An identifier that is too short for the base, or an id that is named as one.
IDENTIFIER = re.compile(r"""AKIA[A-Z0-9]{8,13}(?![A-Z0-9])|(?ai:client|account|access|user)[_-]?(?ai:id|key)["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9_-]{4,})""")
NAMES = ("client", "account", "access", "user")
#: A whole run that may be a secret, if letters and digits are mixed; possessive, so a run is passed over once.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_-])")
ENDPOINT = re.compile(r"(?:https?|s3|redis|postgres(?:ql)?|mysql|mongodb|amqps?)://[^\s\"'<>]{3,}")
DIGIT = re.compile(r"[0-9]")
BLANK = re.compile(r"\n[\x20\t\r]*\n")


def base_spans(text: str) -> list[Span]:
    """The base matches. Runs of hexadecimal digits and access identifiers are maximal, so a least length in the pattern drops the same ones."""
    found: list[Span] = []
    low = text.lower()  # only to tell quickly that no keyword is there
    if ("=" in text or ":" in text) and any(k in low for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def weak_parts(text: str, base: list[Span]) -> list[Span]:
    """Candidates outside the base matches, by position; each kind is its role."""
    found: list[Span] = []
    low = text.lower()
    if "AKIA" in text or ("=" in text or ":" in text) and any(k in low for k in NAMES):
        for m in IDENTIFIER.finditer(text):
            found.append(("identifier", *(m.span("value") if m["value"] else m.span())))
    if "://" in text:
        found += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    named, taken = Taken(found), Taken(base)
    if DIGIT.search(text):
        for m in OPAQUE.finditer(text):
            value = m[0]
            if DIGIT.search(value) and len(Counter(value)) >= 10 and any(c.islower() for c in value) and any(c.isupper() for c in value) and named.free(*m.span()):
                found.append(("opaque", *m.span()))
    return sorted((f for f in found if taken.free(f[1], f[2])), key=lambda f: f[1])


ROLE = {"assign": "opaque", "access": "identifier", "hex": "opaque"}


def linked(text: str, base: list[Span], reach: int | None = None) -> list[Span]:
    """The weak parts that have a complementary part in their scope (and within reach).

    An interval join: parts are sorted by start, with the running maximum of their ends per role and scope. Of the
    parts that start before the widened interval's end, that maximum tells whether one ends after its start.
    """
    weak = weak_parts(text, base)
    if not weak:
        return []
    cuts = [m.start() for m in BLANK.finditer(text)]
    at: dict[str, tuple[list[int], list[int], list[int]]] = {}
    for kind, s, e in sorted(base + weak, key=lambda f: f[1]):
        starts, tops, scopes = at.setdefault(ROLE.get(kind, kind), ([], [], []))
        scope = bisect.bisect_right(cuts, s)
        tops.append(max(e, tops[-1]) if scopes and scopes[-1] == scope else e)
        starts.append(s)
        scopes.append(scope)
    reach = len(text) if reach is None else reach
    found = []
    for kind, s, e in weak:
        scope = bisect.bisect_right(cuts, s)
        for role, (starts, tops, scopes) in at.items():
            if role == kind:
                continue
            j = min(bisect.bisect_right(starts, e + reach), bisect.bisect_right(scopes, scope)) - 1
            if j >= 0 and scopes[j] == scope and tops[j] >= s - reach:
                found.append((kind, s, e))
                break
    return found


def scan(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs."""

    def rows(batches):
        return span_rows(batches, base_spans, lambda text, base: linked(text, base, reach), BASE, KINDS, ("n_assign", "n_access", "n_hex"))

    return texts(docs).mapInArrow(rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
