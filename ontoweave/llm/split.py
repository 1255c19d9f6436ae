"""Splitting oversized texts at natural boundaries with an overlap.

Method: agglomerative merging. A text is cut into atomic segments, one after each blank, tab, CR, LF,
``。``, ``！`` or ``？``; adjacent pairs lie in a heap keyed by the strength of the boundary between them,
and the weakest boundaries are merged first while the combined size plus the overlap fits the limit.

Defined results: a null or empty text has no pieces; a text within its limit is one piece; the limit is
``section_chars`` (3000 where null or not positive), lowered to floor(length * max_input_tokens /
input_tokens) where the text has more tokens than allowed, and at least 1 for cutting; the overlap (null
or negative is 0) is half the limit where it is not below the limit. An atom that does not fit together with the overlap is cut
inside: ``cut`` says 'forced' where the atom is longer than the limit, else 'overlap'. Of repeated
requests the one received last counts (ties: the greater text).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import over_rows, spread

DEFAULT_LIMIT = 3000
ATOM = re.compile("[^ \t\r\n。！？]*(?:[ \t\r\n。！？]|$)", re.S)
PIECES = "request_id long, piece_no int, start_char long, end_char long, shared_chars long, size_limit long, cut string, text string"


def piece_limit(length: int, section_chars: int | None, tokens: int | None, most_tokens: int | None, default: int = DEFAULT_LIMIT) -> int:
    limit = section_chars if section_chars is not None and section_chars > 0 else default
    if tokens is not None and most_tokens is not None and tokens > most_tokens and tokens > 0:
        limit = min(limit, length * most_tokens // tokens)
    return limit


def _strength(text: str, end: int) -> int:
    """How natural a cut after position ``end`` is: word < clause < sentence < line < paragraph."""
    tail = text[max(0, end - 3) : end]
    if tail.endswith("\n\n") or tail.endswith("\n\r\n"):
        return 5
    if tail[-1:] in "\r\n":
        return 4
    if tail[-1:] in "。！？" or tail.rstrip(" \t")[-1:] in (".", "!", "?", "…", '"', "”", "»") and tail[-1:] in " \t":
        return 3
    return 2 if tail.rstrip(" \t")[-1:] in (",", ";", ":") else 1


def agglomerate(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, cut) of the cores of the pieces; piece k shares ``overlap`` characters with piece k-1.

    The first core has no overlap before it and so may fill the limit, but is at least as long as the
    overlap it has to give to the second.
    """
    core = limit - overlap
    ends: list[int] = []
    kinds: list[str] = []
    at = 0
    for m in ATOM.finditer(text):
        stop = m.end()
        if stop == m.start():
            continue
        kind = "forced" if stop - m.start() > limit else "overlap"
        while stop - at > (limit if at == 0 else core):
            at += limit if at == 0 else core
            ends.append(at)
            kinds.append(kind)
        if stop >= overlap and stop > at:
            at = stop
            ends.append(at)
            kinds.append("natural")
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
        kinds.append("natural")
    n = len(ends)
    starts = [0, *ends[:-1]]
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

    def pair(i: int, j: int) -> tuple[int, int, int, int]:
        return _strength(text, ends[i]) if kinds[i] == "natural" else 0, ends[j] - starts[i], i, j

    heap = [pair(i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j] and right[i] == j and ends[j] - starts[i] == size) or size > (limit if i == 0 else core):
            continue
        ends[i], kinds[i], right[i], alive[j] = ends[j], kinds[j], right[j], False
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, pair(i, right[i]))
        if left[i] >= 0:
            heapq.heappush(heap, pair(left[i], i))
    out = [(starts[i], ends[i], kinds[i]) for i in range(n) if alive[i]]
    out[-1] = (*out[-1][:2], "end")
    return out


def pieces_of(text: str | None, limit: int, overlap: int | None) -> list[tuple[int, int, int, str]]:
    """(start, end, shared, cut) of every piece, overlap included."""
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text), 0, "end")]
    size = max(1, limit)
    shared = shared_chars(size, overlap)
    return [(s - shared if s else 0, e, shared if s else 0, cut) for s, e, cut in agglomerate(text, size, shared)]


def shared_chars(limit: int, overlap: int | None) -> int:
    """The overlap as asked for; where it would leave no room for new text, half the limit."""
    overlap = max(0, overlap or 0)
    return overlap if overlap < limit else limit // 2


def split_requests(requests: DataFrame, default: int = DEFAULT_LIMIT) -> DataFrame:
    """The pieces (``PIECES``) of every request's text, cut under its own limit."""
    cols = ["text", "section_chars", "overlap_chars", "input_tokens", "max_input_tokens"]
    latest = (
        requests.select("request_id", "received_at", *cols)
        .groupBy("request_id")
        .agg(F.max_by(F.struct(*cols), F.struct("received_at", "text")).alias("r"))
        .select("request_id", "r.*")
    )

    def rows(c: dict[str, list]) -> Iterable[tuple]:
        for rid, text, chars, overlap, tokens, most in zip(*(c[k] for k in ("request_id", *cols))):
            if not text:
                continue
            limit = piece_limit(len(text), chars, tokens, most, default)
            for no, (s, e, shared, cut) in enumerate(pieces_of(text, limit, overlap)):
                yield rid, no, s, e, shared, limit, cut, text[s:e]

    return over_rows(spread(latest), PIECES, rows, batch=256)


def boundaries(pieces: DataFrame) -> DataFrame:
    """(request_id, boundary) of every request that was too long: 'forced' if any cut had to be, else 'natural'."""
    too_long = (F.col("end_char") - F.col("start_char")) > F.col("size_limit")  # only under a limit below 1
    return (
        pieces.groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max(too_long).alias("over"), F.max(F.col("cut") == "forced").alias("forced"))
        .where((F.col("n") > 1) | F.col("over"))
        .select("request_id", F.when(F.col("forced") | F.col("over"), "forced").otherwise("natural").alias("boundary"))
    )
