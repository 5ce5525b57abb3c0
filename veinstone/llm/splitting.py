"""Splitting of oversized items at natural boundaries, with a specified overlap between consecutive pieces.

Balanced targets: the least number of pieces is computed, equal-length targets are placed, and each is snapped to the
strongest boundary near it (paragraph, line, sentence; for paths the path element). If a cut finds no such boundary,
pieces are added, as long as they stay above half of what the limit allows; if no number of pieces gives each cut one,
the number with the fewest weak cuts is taken (the smaller of equals); a weak cut comes after a comma, bar or blank if there is any, so that a text without any boundary is
cut into equal pieces.

Defined results: null and empty items and items within the limit are one piece (null gives none); lengths are counted in
code points; every piece keeps the limit; consecutive pieces of a text share exactly ``overlap`` code points. Of a path
they share the last element; where that element and the next one don't fit in together, they share as much of its end
as fits, up to ``overlap`` code points: the limit goes first. A single element over the limit is split as a text.
Null elements are left out. A row delivered twice counts once; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from strong to weak; a cut comes after the match.
BOUNDARIES = (
    ("paragraph", re.compile(r"\r?\n[^\S\n]*\r?\n\s*")),
    ("line", re.compile(r"\r?\n")),
    ("sentence", re.compile(r"[。！？…!?]+[”’」』）)\"']*|[.;；]+[”’\"')]*(?=\s|\Z)")),
    ("mark", re.compile(r"[,，、|\s]+")),
)
#: Where there is no boundary at all. Cuts at marks or nowhere are made only if more pieces give no better ones.
HARD = "hard"
WEAK = ("mark", HARD)
JOINER = " > "


class Marks:
    """Places after the boundaries of a text, by strength."""

    def __init__(self, text: str):
        self.at = {name: sorted({m.end() for m in pattern.finditer(text)}) for name, pattern in BOUNDARIES}

    def nearest(self, target: float, low: int, high: int) -> tuple[int, str]:
        """The strongest boundary in [low, high], the nearest of equals; else the target itself."""
        for name, places in self.at.items():
            i = bisect.bisect_left(places, target)
            near = [p for p in places[max(0, i - 1) : i + 1] if low <= p <= high]
            if near:
                return min(near, key=lambda p: (abs(p - target), p)), name
        return min(max(round(target), low), high), HARD


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, str]]:
    """Places and strengths of the cuts of a text over the limit."""
    total, step = len(text), limit - overlap
    least = math.ceil((total - overlap) / step)
    marks, best = Marks(text), None
    # First one by one, then by a twentieth more each time; more than twice as many would be shorter than half of what the limit allows.
    n = least - 1
    while (n := max(n + 1, math.ceil(n * 1.05) if n > least + 1 else 0)) <= 2 * least + 1:
        length = (total + (n - 1) * overlap) / n
        found, before = [], 0
        for i in range(1, n):
            # Shorter pieces may not leave more than the rest can hold; longer ones may not pass the limit.
            target = length + (i - 1) * (length - overlap)
            low = max(before + 1, overlap + 1, total - (n - i) * step)
            high = min(before + limit - (overlap if i > 1 else 0), total - (n - i))
            room = max(1, (length - overlap) / 2)
            place = marks.nearest(target, max(low, math.ceil(target - room)), min(high, math.floor(target + room)))
            if place[1] in WEAK:
                place = marks.nearest(target, low, high)
            found.append(place)
            before = place[0]
        hard = sum(s in WEAK for _, s in found)
        if best is None or hard < best[0]:
            best = (hard, found)
        if not hard:
            break
    return best[1]


def split_text(text: str, limit: int = 2000, overlap: int = 100) -> list[tuple[int, int, str]]:
    """(begin, end, boundary at which it begins) of each piece; the first begins at the start."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    if len(text) <= limit:
        return [(0, len(text), "start")]
    places = [(0, "start"), *cuts(text, limit, overlap), (len(text), "end")]
    return [(max(0, a - overlap) if i else 0, b, s) for i, ((a, s), (b, _)) in enumerate(zip(places, places[1:]))]


def split_path(elements: list[str | None], limit: int = 300, overlap: int = 100) -> list[str]:
    """The path as pieces within the limit, cut between elements, sharing one element."""
    parts = [e for e in elements if e is not None]
    if len(JOINER.join(parts)) <= limit:
        return [JOINER.join(parts)]
    units: list[tuple[str, str]] = []  # a unit and what it shares with the piece before when a piece begins with it
    for e in parts:
        if len(e) <= limit:
            units.append((e, ""))
        else:
            for a, b, kind in split_text(e, limit, min(overlap, limit // 3)):
                units.append((e[a:b], kind))
    n = len(units)
    whole = sum(len(u) + len(JOINER) for u, _ in units)
    for pieces in range(math.ceil(whole / limit), n + 1):
        ends, at, k = [], 0, 0
        for i in range(1, pieces):
            target = whole * i / pieces
            start = k
            while k < n and (at + len(units[k][0]) / 2 < target or k == start):
                at += len(units[k][0]) + len(JOINER)
                k += 1
            ends.append(k)
        made = _pieces(units, [0, *sorted({e for e in ends if e < n}), n], limit, overlap)
        if all(len(p) <= limit for p in made):
            return made
    return _pieces(units, list(range(n + 1)), limit, overlap)


def _pieces(units: list[tuple[str, str]], ends: list[int], limit: int, overlap: int) -> list[str]:
    out = []
    for a, b in zip(ends, ends[1:]):
        own = JOINER.join(u for u, _ in units[a:b])
        fragment = units[a][1] not in ("", "start")  # a fragment of an element brings its overlap along
        if a and not fragment:
            shared, room = units[a - 1][0], limit - len(JOINER.join([*(u for u, _ in units[a:b])])) - len(JOINER)
            if len(shared) > room and b - a == 1:
                shared = shared[len(shared) - min(overlap, room) :] if room > 0 else ""
            own = JOINER.join(x for x in (shared, own) if x)
        out.append(own)
    return out


def split_texts(df: DataFrame, key: str, text: str, limit: int = 2000, overlap: int = 100) -> DataFrame:
    """(id, piece_no, pieces, boundary, piece) of the rows over the limit. Only those rows leave the scan."""
    long = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).where(F.length("t") > limit).dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = split_text(t, limit, overlap)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array([n] * n, pa.int32()), pa.array([s for *_, s in found], pa.string()), pa.array([t[x:y] for x, y, _ in found], pa.string())],
                    ["id", "piece_no", "pieces", "boundary", "piece"],
                )

    return long.mapInArrow(run, "id long, piece_no int, pieces int, boundary string, piece string")


def split_paths(df: DataFrame, key: str, path: str, limit: int = 300, overlap: int = 100) -> DataFrame:
    """(id, piece_no, pieces, piece) of the rows whose joined path is over the limit."""
    long = df.select(F.col(key).cast("long").alias("id"), F.col(path).alias("p")).where(F.length(F.array_join("p", JOINER)) > limit).dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = split_path(p, limit, overlap)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(found, pa.string())], ["id", "piece_no", "pieces", "piece"])

    return long.mapInArrow(run, "id long, piece_no int, pieces int, piece string")
