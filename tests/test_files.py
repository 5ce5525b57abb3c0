import io
import zipfile

from pyspark.sql import functions as F

from veinstone.sources import files, sinks

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
BODY = f'<w:document xmlns:w="{W}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'


def test_blocks_of_files(spark, tmp_path):
    package = io.BytesIO()
    with zipfile.ZipFile(package, "w") as z:
        z.writestr("word/document.xml", BODY)
    for name, content in {"a.md": "# T\n\ntext\nmore\n\n| x |".encode(), "b.txt": "中文".encode("gb18030"), "c.docx": package.getvalue(), "d.docx": b"broken", "e.bin": b"\0"}.items():
        (tmp_path / name).write_bytes(content)
    f = files.files(spark, str(tmp_path))
    assert {r["path"][-5:]: r["kind"] for r in f.collect()}["e.bin"] == "unsupported"
    got = {}
    for r in files.blocks(f).orderBy("path", "block").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["label"], r["text"]))
    assert got["a.md"] == [("heading", "# T"), ("text", "text\nmore"), ("table", "| x |")]
    assert got["b.txt"] == [("text", "中文")]
    assert got["c.docx"] == [("heading", "Title"), ("text", "Some text"), ("table", "a\tb")]
    assert got["d.docx"][0][0] == "error" and "e.bin" not in got


def test_question_list_and_tables(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text("﻿question,answer\nWhy?,because, of it\nHow?,\nHow?,so\n", encoding="utf-8")
    assert [(r["question"], r["answer"]) for r in files.question_list(spark, str(p)).orderBy("place").collect()] == [("Why?", "because, of it"), ("How?", "so")]
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    assert files.delimited(spark, str(tmp_path / "t.tsv")).first().asDict() == {"a": "1", "b": "2"}


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.overwrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "g int, v string"), at, ["g"])
    sinks.overwrite_partitions(spark.createDataFrame([(2, "c")], "g int, v string"), at, ["g"])
    assert sorted((r["g"], r["v"]) for r in spark.read.parquet(at).collect()) == [(1, "a"), (2, "c")]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "y")], "k int, v string")
    assert sorted(tuple(r) for r in sinks.upserted(old, new, ["k"]).collect()) == [(1, "a"), (2, "z"), (3, "y")]
    assert [tuple(r) for r in sinks.without(old, new, ["k"]).collect()] == [(1, "a")]


def test_pointer_switch_keeps_the_former_one(spark, tmp_path):
    at = str(tmp_path / "p")
    change = lambda *r: spark.createDataFrame(list(r), "file_node_id long, generation string")
    sinks.switch_pointer(spark, at, change((1, "g1"), (2, "g1")))
    (tmp_path / "p" / "version=2").mkdir()  # a switch that failed
    import shutil

    shutil.rmtree(tmp_path / "p" / "version=2")
    got = sinks.switch_pointer(spark, at, change((1, "g2")))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "g2", "g1"), (2, "g1", None)]


def test_metrics_text(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0, 3.0, 6.0, 3)], "event_type string, p50 double, p95 double, p99 double, total double, n long")
    assert 'duration_seconds{type="x",quantile="0.95"} 2.0' in sinks.metrics_text(df) and df.agg(F.count("*")).first()[0] == 1
