"""Headings as a catalogue of a document: finding their places, ranges of sections, protected blocks, packing.

Rules that go through one document in order are plain functions over that document; frames run them in Arrow batches.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK = re.compile(r"(?m)^(?:#{1,6} |第[0-9一二三四五六七八九十百.]+[章节条]|[0-9]{1,2}(?:\.[0-9]{1,2}){1,3}[ \t])")
_FENCE = re.compile(r"(?ms)^(```|~~~).*?^\1[ \t]*$")


def key(c: Column) -> Column:
    """Title without white space, in lower case."""
    return F.lower(F.regexp_replace(c, "[ \\t\\r\\n　]+", ""))


def locate(anchor: str, text: str, begin: int = 0, window: int | None = None) -> tuple[str, int]:
    """(how, offset) of a title in a text: as it is, without white space, or the line most like it from a ratio of 0.72 on; else ("missing", -1)."""
    end = len(text) if window is None else min(len(text), begin + window)
    if not anchor.strip():
        return "missing", -1
    if (at := text.find(anchor, begin, end)) >= 0:
        return "exact", at
    where = [i for i in range(begin, end) if not text[i].isspace()]
    compact, wanted = "".join(text[i] for i in where), "".join(anchor.split())
    if (at := compact.find(wanted)) >= 0:
        return "compact", where[at]
    best, place, at = 0.0, -1, begin
    for line in text[begin:end].split("\n"):
        own = "".join(line.split())
        if own and abs(len(own) - len(wanted)) <= 0.6 * len(wanted) + 2:
            r = difflib.SequenceMatcher(None, own, wanted, autojunk=False)
            if r.real_quick_ratio() > best and r.quick_ratio() > best and (x := r.ratio()) > best:
                best, place = x, at
        at += len(line) + 1
    return ("line", place) if best >= 0.72 else ("missing", -1)


def pack(sizes: list[int], limit: int) -> list[int]:
    """For each paragraph the number of its pack: packs are filled in order up to the limit; a larger paragraph is a pack of its own."""
    out, n, total = [], -1, limit + 1
    for s in sizes:
        if total + s > limit or total == 0:
            n, total = n + 1, 0
        out.append(n)
        total += s
    return out


def adjust(sections: list[tuple[int, int]], blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sections in order, changed so that no protected block is cut: a block that several share goes whole to the one with the largest part (the first of equals), the others are trimmed."""
    out = [list(s) for s in sections]
    for a, b in blocks:
        parts = [(max(0, min(b, e) - max(a, s)), -i) for i, (s, e) in enumerate(out)]
        shared = [(n, i) for n, i in parts if n > 0]
        if len(shared) < 2:
            continue
        winner = -max(shared)[1]
        for n, i in shared:
            i = -i
            if i == winner:
                out[i] = [min(out[i][0], a), max(out[i][1], b)]
            elif i < winner:
                out[i][1] = min(out[i][1], a)
            else:
                out[i][0] = max(out[i][0], b)
    return [(s, max(s, e)) for s, e in out]


def contents_list(text: str) -> tuple[bool, int]:
    """(whether the text begins with a list of contents, where it ends): five marks of headings or more close together, before the largest gap of over 500 characters, or more than ten within 2,000."""
    marks = [m.start() for m in _MARK.finditer(text)]
    head = [m for m in marks if m < 3000]
    if len(head) < 5:
        return False, 0
    gaps = [(b - a, a) for a, b in zip(head, marks[1:]) if b - a > 500]
    if gaps and (cut := max(gaps, key=lambda g: (g[0], -g[1]))[1]) and sum(m <= cut for m in head) >= 5:
        end = text.find("\n", cut)
        return True, len(text) if end < 0 else end
    near = [m for m in head if m < head[0] + 2000]
    if len(near) > 10:
        end = text.find("\n", near[-1])
        return True, len(text) if end < 0 else end
    return False, 0


def syntax_chunks(text: str, least: int = 80) -> list[tuple[str, int, int, int]]:
    """(path, level, begin, end) of the chunks of a marked-up text: a stack of headings gives the path; headings within fenced code don't count; a section of fewer than ``least`` characters joins the next one of its path's top."""
    code = [m.span() for m in _FENCE.finditer(text)]
    heads = [m for m in re.finditer(r"(?m)^(#{1,6})[ \t]+([^\n]+)$", text) if not any(a <= m.start() < b for a, b in code)]
    out: list[tuple[str, int, int, int]] = []
    stack: list[tuple[int, str]] = []
    if not heads or heads[0].start() > 0:
        out.append(("", 0, 0, heads[0].start() if heads else len(text)))
    for m, end in zip(heads, [*(h.start() for h in heads[1:]), len(text)]):
        level = len(m.group(1))
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, m.group(2).strip()))
        out.append((" > ".join(t for _, t in stack), level, m.start(), end))
    merged: list[tuple[str, int, int, int]] = []
    for path, level, a, b in out:
        if merged and merged[-1][3] - merged[-1][2] < least and merged[-1][0].split(" > ")[0] == path.split(" > ")[0]:
            a = merged.pop()[2]
        if text[a:b].strip():
            merged.append((path, level, a, b))
    return merged


def representative(text: str, terms: list[str], head: int = 900, tail: int = 600, limit: int = 4000) -> str:
    """The beginning, lines of the middle that hold a term (until the limit is reached), and the end; a text no longer than beginning and end together as it is."""
    if len(text) <= head + tail:
        return text
    out, size = [], head + tail
    for line in text[head : len(text) - tail].split("\n"):
        if line.strip() and any(t in line.lower() for t in terms):
            if size + len(line) > limit:
                break
            out.append(line)
            size += len(line)
    return "\n".join([text[:head], *out, text[len(text) - tail :]])


def locate_frame(pairs: DataFrame, id_: str, anchor: str, text: str) -> DataFrame:
    """(id, how, offset). The exact stage is built in; only what it leaves goes through Python."""
    at = F.expr(f"instr(`{text}`, `{anchor}`)")
    found = pairs.where((F.length(F.trim(anchor)) > 0) & F.col(text).isNotNull()).select(F.col(id_).alias("k"), F.col(anchor).alias("a"), F.col(text).alias("t"), at.alias("at"))
    exact = found.where("at > 0").select("k", F.lit("exact").alias("how"), (F.col("at") - 1).cast("int").alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [locate(a, t) for a, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())], ["k", "how", "offset"])

    kind = found.schema["k"].dataType.simpleString()
    rest = found.where("at = 0").select("k", "a", "t").mapInArrow(run, f"k {kind}, how string, offset int")
    return exact.unionByName(rest).withColumnRenamed("k", id_)
