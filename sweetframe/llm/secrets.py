"""Secret scans with multipart credential linking.

Strong patterns stand alone. Weak candidates (identifiers, secret-looking strings, endpoints) are common in clean text, so
they are reported only where complementary parts meet: a secret with an identifier and, where asked, an endpoint, within
one scope. A scope is a stretch of text without a blank line; inside it, parts link if at most ``reach`` code points lie
between them. The join is an interval join by a sorted sweep over the parts of each scope.

Defined cases: null and empty texts have no span; spans are in code points, end exclusive; spans of one kind don't
overlap; a weak part that overlaps a strong span is not reported again; equal spans of two kinds are both reported, in the
order of the kinds; ties of parts link alike, as every part within reach counts; very long texts and parts are scanned whole; repeated rows get the same answer each; an empty table
gives no rows. Only a column is added, under the name that the caller gives it, so that no name can clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sweetframe.llm._common import bounded_batches

# The strong patterns, in the order in which kinds are listed.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")

# Weak parts. An identifier names an account or a key, a key is a string with letters of both cases and two digits, or one
# digit and characters that are spread as those of random strings are, an endpoint is an address that credentials go to.
_ID = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|key_?id|access_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}=*(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}", re.ASCII)
_SCOPE_END = re.compile(r"\n[\x20\x09-\x0D]*\n")
_KEY_HINT = re.compile(r"(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])", re.ASCII | re.DOTALL)
_TWO_DIGITS = re.compile(r"[0-9].*[0-9]", re.DOTALL)
_BITS = 3.5  # of entropy a character: random strings of 16 characters have about 3.8, longer ones more

Span = tuple[int, int, int]  # start, kind, end


def entropy(part: str) -> float:
    """Bits a character by the part's own counts of characters."""
    n = len(part)
    return -sum(k / n * log2(k / n) for k in Counter(part).values())


def strong_spans(text: str) -> list[Span]:
    low = text.lower()
    spans: list[Span] = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def weak_parts(text: str) -> list[Span]:
    parts: list[Span] = []
    low = text.lower()
    if ":" in text or "=" in text:
        if any(w in low for w in ("user", "login", "account", "id")):
            parts += [(m.start(), 3, m.end()) for m in _ID.finditer(text)]
        if "://" in text:
            parts += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    if any(c in text for c in "0123456789"):
        parts += [(m.start(), 4, m.end()) for m in _KEY.finditer(text) if _KEY_HINT.match(m[0]) and (_TWO_DIGITS.search(m[0]) or entropy(m[0].rstrip("=")) >= _BITS)]
    return sorted(parts)


def linked_parts(text: str, strong: list[Span], reach: int) -> list[Span]:
    """The weak parts with a complement in reach: keys with identifiers or endpoints, strong spans counting as keys or ids."""
    weak = weak_parts(text)
    if not weak:
        return []
    starts, furthest = [s for s, _, _ in strong], list(accumulate((e for _, _, e in strong), max))
    weak = [p for p in weak if not (i := bisect_left(starts, p[2])) or furthest[i - 1] <= p[0]]
    ids = sorted((s, e) for s, k, e in [*weak, *strong] if k in (1, 3))
    keys = sorted((s, e) for s, k, e in [*weak, *strong] if k in (0, 2, 4))
    endpoints = sorted((s, e) for s, k, e in weak if k == 5)
    breaks = [m.start() for m in _SCOPE_END.finditer(text)]

    last = {id(o): list(accumulate((e for _, e in o), max)) for o in (ids, keys, endpoints)}  # the last end so far

    def near(part: tuple[int, int], others: list[tuple[int, int]]) -> bool:
        """Does one of the others, sorted, start in part's scope and within reach of it?"""
        scope, ends = bisect_left(breaks, part[0]), last[id(others)]
        at = bisect_left(others, (part[1] + reach + 1, 0)) - 1
        while at >= 0 and ends[at] >= part[0] - reach:
            start, end = others[at]
            if (start, end) != part and part[0] - end <= reach and bisect_left(breaks, start) == scope:
                return True
            at -= 1
        return False

    out = []
    for start, kind, end in weak:
        part = (start, end)
        if kind == 4 and (near(part, ids) or near(part, endpoints) and _labelled(text, start)):
            out.append((start, kind, end))
        elif kind == 3 and near(part, keys):
            out.append((start, kind, end))
        elif kind == 5 and near(part, keys) and near(part, ids):
            out.append((start, kind, end))
    return out


def _labelled(text: str, start: int) -> bool:
    """Is the string assigned to something, as in ``name = string``?"""
    return text[max(0, start - 3) : start].rstrip("\"' ").endswith((":", "="))


def find_secrets(text: str | None, reach: int = 200) -> tuple[list[Span], list[Span]]:
    """(strong spans, spans that linking adds), each sorted by start, then kind."""
    if not text:
        return [], []
    strong = strong_spans(text)
    return strong, linked_parts(text, strong, reach)


def written(spans: list[Span]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(spark: SparkSession, text: Column, reach: int = 200) -> Column:
    """struct<strong, linked> of each text; both are arrays of struct<start, kind, end>."""
    bounded_batches(spark)
    shape = "array<struct<start: int, kind: string, end: int>>"

    @F.pandas_udf(f"struct<strong: {shape}, linked: {shape}>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shown = lambda found: [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in found]
        for texts in batches:
            found = [find_secrets(t, reach) for t in texts]
            yield pd.DataFrame({"strong": [shown(a) for a, _ in found], "linked": [shown(b) for _, b in found]})

    return spans.asNondeterministic()(text)


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span replaced by the mask; overlapping spans by one mask. JVM-side; null stays null."""
    ordered = F.array_sort(spans)
    empty = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    step = lambda a, x: F.when(
        x["start"] >= a["at"], F.struct(F.concat(a["done"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mask)).alias("done"), x["end"].alias("at"))
    ).otherwise(F.struct(a["done"].alias("done"), F.greatest(a["at"], x["end"]).alias("at")))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, empty, step, lambda a: F.concat(a["done"], F.substring(text, a["at"] + 1, F.length(text)))))
