"""Chunking: splitting, headings, section bounds, windows, merging of small parts, and joins of ranges.

Sequential rules run in plain functions over one text or one document at a time; what can be declared stays declared.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^(#{1,6} .{1,80}|第[0-9一二三四五六七八九十百.]+[章节条] ?.{0,60}|[0-9]{1,2}(\.[0-9]{1,2}){1,3} .{1,80})$"


def split_content(text: str | None, limit: int = 2000, overlap: int = 100) -> list[tuple[int, int]]:
    """Pieces of at most ``limit``; a piece ends after the last line end, full stop or semicolon in its second half, and the next begins ``overlap`` earlier, but always advances."""
    if not text:
        return []
    out, at = [], 0
    while True:
        end = min(len(text), at + limit)
        if end < len(text):
            best = max(text.rfind(c, at + limit // 2, end) for c in "\n。；;")
            end = best + 1 if best > at else end
        out.append((at, end))
        if end >= len(text):
            return out
        at = max(end - overlap, at + 1)


def windows(sizes: list[int], budget: int, repeat: int) -> list[tuple[int, int]]:
    """Windows of consecutive blocks within the budget; each begins with the last ``repeat`` blocks of the one before."""
    out, begin = [], 0
    while begin < len(sizes):
        end, total = begin, 0
        while end < len(sizes) and (end == begin or total + sizes[end] <= budget):
            total += sizes[end]
            end += 1
        out.append((begin, end))
        if end == len(sizes):
            break
        begin = max(end - repeat, begin + 1)
    return out


def merge_small(sizes: list[int], least: int) -> list[int]:
    """For each part the number of the part it ends up in: small ones join the next, a small last one the previous."""
    group, n, pending = [], 0, False
    for i, s in enumerate(sizes):
        if i and not pending:
            n += 1
        group.append(n)
        pending = s < least
    if pending and n:
        group = [g if g < n else n - 1 for g in group] if group.count(n) == 1 else group
    return group


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def html_tables(html: str | None) -> list[list[list[str]]]:
    """Tables of HTML as rows of cells; ragged rows are filled with empty cells."""
    if not html:
        return []
    p = _Tables()
    p.feed(html)
    out = []
    for t in p.tables:
        rows = [r for r in t if r]
        width = max((len(r) for r in rows), default=0)
        out.append([r + [""] * (width - len(r)) for r in rows])
    return [t for t in out if t]


def table_markdown(rows: list[list[str]]) -> str:
    if not rows:
        return ""
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * len(rows[0]), *map(line, rows[1:])])


def compact_table(rows: list[list[str]], cells: int = 40) -> str:
    flat = [c for r in rows for c in r if c][:cells]
    return "[表格: " + " | ".join(flat) + "]"


def per_text(df: DataFrame, key: str, text: str, schema: str, make: Callable[[str], list[tuple]]) -> DataFrame:
    """(key, ...) rows that ``make`` gives for each text, in Arrow batches; null texts give none."""
    source = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *r) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in make(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(types)], ["k", *names])

    kind = source.schema["k"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_schema

    full = source.sparkSession.createDataFrame([], f"k {kind}, {schema}").schema
    types = list(to_arrow_schema(full))
    return source.mapInArrow(run, full).withColumnRenamed("k", key)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, offset): lines of each text with the offset of their first character."""
    # The offsets are carried along in one pass over the lines of a text.
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    offsets = F.aggregate("l", begin, lambda s, x: F.struct((s["at"] + F.length(x) + 1).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
    cut = df.where(F.col(text).isNotNull()).select(key, F.split(text, "\n").alias("l"))
    return cut.select(key, F.posexplode(F.arrays_zip(F.col("l").alias("line"), offsets.alias("offset"))).alias("line_no", "x")).select(key, "line_no", "x.line", "x.offset")


def headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that are headings, with level: hash marks, or the number of numbering parts, or 1."""
    l = lines(df, key, text).where(F.col("line").rlike(HEADING))
    hashes = F.length(F.regexp_extract("line", "^(#+) ", 1))
    dots = F.length(F.regexp_replace(F.regexp_extract("line", r"([0-9]{1,2}(\.[0-9]{1,2})*)", 1), "[0-9]", "")) + 1
    return l.withColumn("level", F.when(hashes > 0, hashes).when(F.col("line").rlike("[0-9]"), dots).otherwise(1).cast("int"))


def heading_sessions(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each line with the number of the heading it stands under, 0 before the first."""
    l = lines(df, key, text)
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return l.withColumn("section", F.sum(F.col("line").rlike(HEADING).cast("int")).over(order))


def nest(levels: list[int]) -> list[tuple[int | None, int | None]]:
    """For headings in order: (the next one of its level or above, the last one before of a lower level), as positions. One pass with a stack."""
    ends: list[int | None] = [None] * len(levels)
    parents: list[int | None] = []
    open_: list[int] = []
    for i, level in enumerate(levels):
        while open_ and levels[open_[-1]] >= level:
            ends[open_.pop()] = i
        parents.append(open_[-1] if open_ else None)
        open_.append(i)
    return list(zip(ends, parents))


def section_bounds(h: DataFrame, key: str) -> DataFrame:
    """End and parent of each heading: the next one of its level or above, the last one before of a lower level.

    The headings of one document stand together and are gone through once.
    """
    kind = h.schema[key].dataType.simpleString()
    ordered = h.select(F.col(key).alias("k"), "line_no", "level").repartition("k").sortWithinPartitions("k", "line_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(k, rows):
            at = [r[0] for r in rows]
            found = nest([r[1] for r in rows])
            return [(k, n, v, None if e is None else at[e], None if p is None else at[p]) for (n, v), (e, p) in zip(rows, found)]

        current, rows, out = None, [], []
        for b in batches:
            for k, n, v in zip(*(b.column(i).to_pylist() for i in range(3))):
                if k != current and rows:
                    out += done(current, rows)
                    rows = []
                current = k
                rows.append((n, v))
            if len(out) > 50_000:
                yield batch(out, b.schema.field(0).type)
                out = []
        if rows:
            out += done(current, rows)
            yield batch(out, pa.array([r[0] for r in out]).type)

    def batch(rows, type_) -> pa.RecordBatch:
        types = (type_, pa.int32(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], ["k", "line_no", "level", "end_line", "parent_line"])

    return ordered.mapInArrow(run, f"k {kind}, line_no int, level int, end_line int, parent_line int").withColumnRenamed("k", key)


def overlap_join(a: DataFrame, b: DataFrame, by: list[str], a_range: tuple[str, str], b_range: tuple[str, str], width: int) -> DataFrame:
    """Rows of a and b of equal ``by`` whose half-open ranges overlap. Ranges are cut into buckets of ``width`` and
    joined by bucket; a pair is kept in the bucket in which the later of the two begins, so it comes out once."""

    def bucketed(df: DataFrame, r: tuple[str, str], name: str) -> DataFrame:
        first, last = F.floor(F.col(r[0]) / width), F.floor((F.col(r[1]) - 1) / width)
        return df.where(F.col(r[1]) > F.col(r[0])).withColumn("_bucket", F.explode(F.sequence(first, last)))

    joined = bucketed(a, a_range, "a").join(bucketed(b, b_range, "b"), [*by, "_bucket"])
    meet = (F.col(a_range[0]) < F.col(b_range[1])) & (F.col(b_range[0]) < F.col(a_range[1]))
    return joined.where(meet & (F.col("_bucket") == F.floor(F.greatest(F.col(a_range[0]), F.col(b_range[0])) / width))).drop("_bucket")


def coverage(df: DataFrame, by: list[str], begin: str, end: str) -> DataFrame:
    """Length of the union of ranges, and of the largest gap between them, of each group."""
    order = Window.partitionBy(*by).orderBy(begin, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    r = df.where(F.col(end) > F.col(begin)).withColumn("_b", before)
    new = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(begin), F.coalesce("_b", F.col(begin))))
    gap = F.greatest(F.lit(0), F.col(begin) - F.coalesce("_b", F.col(begin)))
    return r.groupBy(*by).agg(F.sum(new).alias("covered"), F.max(gap).alias("largest_gap"))
