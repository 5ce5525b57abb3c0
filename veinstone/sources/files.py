"""Files as sources: plain text, Markdown, tables, word-processor packages, question lists.

Files are read with ``binaryFile`` and taken apart in Arrow batches where Spark has no reader of its own.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KINDS = {"txt": "text", "md": "markdown", "markdown": "markdown", "csv": "table", "tsv": "table", "html": "html", "htm": "html", "docx": "package", "xlsx": "sheet", "xlsm": "sheet", "json": "json", "jsonl": "json", "parquet": "parquet"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BLOCKS = "path string, block int, label string, text string"


def kind_of(path):
    """Kind of a file by its suffix, ``unsupported`` for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    pairs = [F.lit(x) for p in KINDS.items() for x in p]
    return F.coalesce(F.create_map(*pairs)[suffix], F.lit("unsupported"))


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, kind, content, sha256) of the files of a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return raw.select("path", kind_of(F.col("path")).alias("kind"), "content", F.sha2("content", 256).alias("sha256"))


def decode(content: bytes) -> str:
    """UTF-8 if it is, else the national encodings that decode it, else Latin-1."""
    for encoding in ("utf-8-sig", "gb18030", "latin-1"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def markdown_blocks(text: str) -> list[tuple[str, str]]:
    """(label, text) of blocks parted by empty lines: heading, table or text."""
    out = []
    for b in re.split(r"\n[ \t]*\n", text.replace("\r\n", "\n")):
        b = b.strip("\n")
        if b.strip():
            first = b.lstrip()
            out.append(("heading" if re.match(r"#{1,6} ", first) else "table" if first.startswith("|") else "text", b))
    return out


def package_blocks(content: bytes) -> list[tuple[str, str]]:
    """(label, text) of paragraphs and tables of a word-processor package, in order of flow."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            text = "".join(t.text or "" for t in e.iter(f"{_W}t"))
            style = next((s.get(f"{_W}val", "") for s in e.iter(f"{_W}pStyle")), "")
            if text.strip():
                out.append(("heading" if style.lower().startswith("heading") else "text", text))
        elif e.tag == f"{_W}tbl":
            rows = [["".join(t.text or "" for t in c.iter(f"{_W}t")) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            out.append(("table", "\n".join("\t".join(r) for r in rows)))
    return out


def blocks(df: DataFrame) -> DataFrame:
    """(path, block, label, text) of text, Markdown and package files of ``files``. A broken package gives one block ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, kind, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                try:
                    found = package_blocks(content) if kind == "package" else markdown_blocks(decode(content))
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                    found = [("error", type(e).__name__)]
                rows += [(path, i, label, text) for i, (label, text) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], ["path", "block", "label", "text"])

    return df.where(F.col("kind").isin("text", "markdown", "package")).select("path", "kind", "content").mapInArrow(run, _BLOCKS)


def delimited(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A CSV or TSV file as a table of strings."""
    return spark.read.csv(path, header=header, sep="\t" if path.lower().endswith(".tsv") else ",", multiLine=True, escape='"')


def question_list(spark: SparkSession, path: str) -> DataFrame:
    """(question, answer) of a list with a header: a byte-order mark is dropped, commas of unquoted answers are joined
    again, of equal questions the first counts and takes the first answer that isn't empty."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).withColumn("value", F.regexp_replace("value", "^\\ufeff", ""))
    parts = lines.select("n", F.split("value", ",", 2).alias("p")).where(F.size("p") == 2)
    rows = parts.select("n", F.trim(F.col("p")[0]).alias("question"), F.trim(F.regexp_replace(F.col("p")[1], '^"|"$', "")).alias("answer")).where("question <> ''")
    rows = rows.where(~F.lower("question").isin("question", "问题"))
    filled = F.when(F.col("answer") != "", F.struct("n", "answer"))
    return rows.groupBy("question").agg(F.min("n").alias("n"), F.coalesce(F.min(filled)["answer"], F.lit("")).alias("answer")).withColumn("place", F.row_number().over(Window.orderBy("n"))).select("question", "answer", "place")


_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def sheet_rows(content: bytes) -> list[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of a spreadsheet package: values only, as text; missing cells are empty, missing rows are left out."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = targets.get(sheet.get(f"{_R}id"), "")
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if path not in names:
                continue
            for n, row in enumerate(ET.fromstring(z.read(path)).iter(f"{_S}row"), 1):
                cells: dict[int, str] = {}
                for at, c in enumerate(row.iter(f"{_S}c")):
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    place = at
                    if letters:
                        place = -1
                        for x in letters.group():
                            place = (place + 1) * 26 + ord(x) - 65
                    v = c.find(f"{_S}v")
                    text = v.text or "" if v is not None else "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    cells[place] = shared[int(text)] if c.get("t") == "s" and text else text
                out.append((sheet.get("name", ""), int(row.get("r", n)), [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]))
    return out


def sheets(df: DataFrame) -> DataFrame:
    """(path, sheet, row_no, cells) of the spreadsheets of ``files``. A broken package gives one row of the sheet ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(path, *r) for r in sheet_rows(content)]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, IndexError) as e:
                    rows.append((path, "error", 0, [type(e).__name__]))
            types = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], ["path", "sheet", "row_no", "cells"])

    return df.where(F.col("kind") == "sheet").select("path", "content").mapInArrow(run, "path string, sheet string, row_no int, cells array<string>")


def sheet_package(tables: dict[str, list[list[str]]]) -> bytes:
    """A spreadsheet package of those tables, all cells as text."""
    from xml.sax.saxutils import escape

    out = io.BytesIO()
    main = _S[1:-1]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{_R[1:-1]}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(tables, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="sheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(tables) + 1)) + "</Relationships>")
        for i, rows in enumerate(tables.values(), 1):
            body = "".join(f'<row r="{n}">' + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in r) + "</row>" for n, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as a table: what doesn't parse becomes a row of nulls, nothing is lost and nothing stops."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def graph_import(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, reports) of a graph delivered as parquet tables: entities, relationships, community_reports. Missing columns are null; a relationship whose end is no entity is left out."""

    def read(name: str, schema: dict[str, str]) -> DataFrame:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])

    nodes = read("entities", {"id": "string", "title": "string", "type": "string", "description": "string"}).dropDuplicates(["title"])
    edges = read("relationships", {"source": "string", "target": "string", "description": "string", "weight": "double"})
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("title").alias(end)), end, "left_semi")
    reports = read("community_reports", {"community": "string", "title": "string", "summary": "string", "rank": "double"})
    return nodes, edges.groupBy("source", "target").agg(F.max("weight").alias("weight"), F.min("description").alias("description")), reports
