"""Queries that write tables as files of each kind to the shared folder and read them back through the sources: what comes out must be what SQL finds in the tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from veinstone.operators import chunking as C
from veinstone.operators import graph as G
from veinstone.session import shared_dir
from veinstone.sources import files, sinks
from veinstone.sources.tables import table


def _at(spark, name: str) -> str:
    return f"{shared_dir(spark)}/veinstone/{name}-{uuid.uuid4().hex}"


def json_lines_source(spark, sf):
    """Sections as JSON lines."""
    at = _at(spark, "jsonl")
    table(spark, sf, "kb_section", "id", "section_id", "section_title", "section_path", "section_level").distinct().write.json(at)
    r = files.json_lines(spark, at, "id long, section_id string, section_title string, section_path array<string>, section_level int")
    return r.select("id", "section_id", F.length("section_title").alias("characters"), F.size(F.coalesce("section_path", F.array().cast("array<string>"))).alias("elements"), "section_level")


def delimited_source(spark, sf):
    """Anchors as a delimited file with a header, quotes and line ends in cells."""
    at = _at(spark, "csv")
    a = table(spark, sf, "kb_anchor_registry", "id", "anchor_name", "evidence_quote").distinct()
    a.write.option("header", True).option("escape", '"').option("emptyValue", '""').option("nullValue", "\\N").csv(f"{at}.csv")
    r = spark.read.csv(f"{at}.csv", header=True, multiLine=True, escape='"', nullValue="\\N", schema="id long, anchor_name string, evidence_quote string")
    return r.select("id", F.length("anchor_name").alias("name"), F.length("evidence_quote").alias("quote"))


def text_source(spark, sf):
    """Documents as files of marked-up text, taken apart in blocks by label."""
    d = table(spark, sf, "documents", "doc_id", "text", "source").where("length(text) > 0").select("doc_id", "text")
    # A row that holds the whole text of a file, as the reader of binary files gives it.
    raw = d.select(F.concat(F.lit("/in/"), "doc_id", F.lit(".md")).alias("path"), F.encode("text", "UTF-8").alias("content")).withColumn("kind", files.kind_of(F.col("path")))
    b = files.blocks(raw)
    return b.select(F.regexp_extract("path", "([0-9]+)", 1).cast("long").alias("doc_id"), "label").groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("label") == "table").alias("tables"))


def spreadsheet_source(spark, sf):
    """Targets and sources as sheets of a package: values of each cell."""
    rows = table(spark, sf, "mix_targets").select(F.struct("source", F.col("target_share").cast("string"), F.col("max_repeats").cast("string")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("rows"))  # a table of targets: configuration

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [files.sheet_package({"targets": [[str(x) for x in r.values()] for r in rows]}) for rows in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(["/in/targets.xlsx"] * len(made)), pa.array(made, pa.binary())], ["path", "content"])

    packages = rows.mapInArrow(write, "path string, content binary").withColumn("kind", files.kind_of(F.col("path")))
    s = files.sheets(packages)
    return s.select("sheet", "row_no", F.col("cells")[0].alias("source"), F.round(F.col("cells")[1].cast("double"), 6).alias("target_share"), F.col("cells")[2].cast("int").alias("max_repeats"))


def html_table_source(spark, sf):
    """Tables of contents as HTML, taken apart again: tables, rows and cells of each, and the compact form's length."""
    r = table(spark, sf, "kb_chunk_revision", "id", "content").where("content LIKE '%|%'").groupBy("id").agg(F.max("content").alias("content"))
    rows = F.filter(F.split("content", "\n"), lambda x: x.startswith("| ") & x.endswith(" |"))
    cells = lambda x: F.split(F.regexp_replace(x, "^\\| | \\|$", ""), " \\| ")
    escaped = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<p>x</p><table>"), F.array_join(F.transform(rows, lambda x: F.concat(F.lit("<tr><td>"), F.array_join(F.transform(cells(x), escaped), "</td><td>"), F.lit("</td></tr>"))), ""), F.lit("</table>"))
    h = r.where(F.size(rows) > 0).select("id", html.alias("html"))

    def make(t):
        return [(len(x), sum(len(row) for row in x), C.compact_table(x).count("|") + 1) for x in C.html_tables(t)]

    return C.per_text(h, "id", "html", "rows int, cells int, shown int", make)


def graph_import_source(spark, sf):
    """The section graph delivered as entities, relationships and reports, imported: nodes, edges and reports by kind."""
    at = _at(spark, "graph")
    s = table(spark, sf, "kb_section", "section_id", "section_type", "section_title").groupBy("section_id").agg(F.min("section_type").alias("type"), F.min("section_title").alias("description"))
    s.select(F.col("section_id").alias("id"), F.col("section_id").alias("title"), "type", "description").write.parquet(f"{at}/entities.parquet")
    table(spark, sf, "kb_section", "section_id", "parent_section_id").distinct().where("parent_section_id IS NOT NULL").select(F.col("section_id").alias("source"), F.col("parent_section_id").alias("target")).write.parquet(f"{at}/relationships.parquet")
    table(spark, sf, "kb_section_summary", "id", "section_title", "node_summary").distinct().select(F.col("id").alias("community"), F.col("section_title").alias("title"), F.col("node_summary").alias("summary")).write.parquet(f"{at}/community_reports.parquet")
    nodes, edges, reports = files.graph_import(spark, at)
    return (
        nodes.groupBy(F.coalesce("type", F.lit("none")).alias("kind")).agg(F.count("*").alias("n")).unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), "n"))
        .unionByName(reports.where("summary IS NOT NULL").agg(F.count("*").alias("n")).select(F.lit("reports").alias("kind"), "n"))
    )


def dispatch(spark, sf):
    """Documents by the reader that their name would take (the source stands for the suffix); what no reader takes is unsupported."""
    suffix = F.when(F.col("source") == "scan_desk", ".pdf").when(F.col("source") == "qa_export", ".csv").when(F.col("source") == "branch_memo", ".DOCX").when(F.col("source") == "web_capture", ".html").when(F.col("source") == "partner_feed", ".jsonl").otherwise(".md")
    d = table(spark, sf, "documents", "doc_id", "source").select(F.concat("doc_id", suffix).alias("path"))
    return d.groupBy(files.kind_of(F.col("path")).alias("kind")).agg(F.count("*").alias("n"))


def bulk_index_sink(spark, sf):
    """Chunk documents written to the index by base, a part of them replaced, and read back: rows and newest write of each base."""
    at = _at(spark, "index")
    c = table(spark, sf, "kb_chunk", "id", "kb_id", "content_hash").where("kb_id IS NOT NULL")
    sinks.overwrite_partitions(c.withColumn("written", F.lit(1)), at, ["kb_id"])
    sinks.overwrite_partitions(c.where("kb_id = 7 AND id % 2 = 0").withColumn("written", F.lit(2)), at, ["kb_id"])
    return spark.read.parquet(at).groupBy(F.col("kb_id").cast("long").alias("kb_id")).agg(F.count("*").alias("n"), F.max("written").alias("written"))


def stage_artefacts(spark, sf):
    """One file of JSON lines for each stage of parsing, and what is in them."""
    at = _at(spark, "stages")
    out = None
    for stage, t in (("chunks", "kb_chunk"), ("sections", "kb_section"), ("summaries", "kb_section_summary")):
        table(spark, sf, t, "id", "kb_id").distinct().write.json(f"{at}/stage={stage}")
        p = spark.read.schema("id long, kb_id long").json(f"{at}/stage={stage}").groupBy("kb_id").agg(F.count("*").alias("n"), F.max("id").alias("last")).withColumn("stage", F.lit(stage))
        out = p if out is None else out.unionByName(p)
    return out


def graph_merge_identity(spark, sf):
    """Anchors merged by identity: shared kinds (role, department, system) by base and label, private ones by file as well; the newest values stay."""
    a = table(spark, sf, "kb_anchor_registry", "id", "kb_id", "file_node_id", "anchor_type", "normalized_name", "confidence").where("normalized_name IS NOT NULL").dropDuplicates(["id"])
    shared = F.col("anchor_type").isin("role", "department", "system")
    keyed = a.withColumn("owner", F.when(shared, F.lit(-1)).otherwise(F.col("file_node_id")))
    return G.merge(keyed, ["kb_id", "owner", "anchor_type", "normalized_name"], ["id"], "id", "confidence").select("kb_id", "owner", "anchor_type", "normalized_name", "id")


def graph_sync(spark, sf):
    """Sync of a graph delta: edges of deleted chunks go, edges of the others are laid over what is there; kept, replaced and deleted."""
    c = table(spark, sf, "kb_chunk", "id", "section_id", "del_flag").where("section_id IS NOT NULL")
    old = c.select(F.col("id").alias("src"), F.col("section_id").alias("dst"), F.lit(1).alias("v"))
    new = c.where("NOT coalesce(del_flag, false) AND id % 2 = 0").select(F.col("id").alias("src"), F.col("section_id").alias("dst"), F.lit(2).alias("v"))
    keep = c.where("NOT coalesce(del_flag, false)").select(F.col("id").alias("src"))
    gone = old.join(keep, "src", "left_anti")
    after = sinks.upserted(sinks.without(old, gone, ["src", "dst"]), new, ["src", "dst"])
    return after.groupBy("v").agg(F.count("*").alias("n")).select(F.when(F.col("v") == 2, "replaced").otherwise("kept").alias("what"), "n").unionByName(gone.agg(F.count("*").alias("n")).select(F.lit("deleted").alias("what"), "n"))


def schema_rejects(spark, sf):
    """Edges that a schema of sections and chunks rejects, by type and reason: the type itself, or an end of a type that isn't allowed."""
    from veinstone.plans.graphs import _edges

    e = _edges(spark, sf)
    ok = F.col("type").isin("IN_SECTION", "UNDER")
    end = F.col("src").rlike("^[sc]:") & F.col("dst").rlike("^[sc]:")
    return e.where(~(ok & end)).groupBy("type", F.when(~ok, "type").otherwise("end").alias("reason")).agg(F.count("*").alias("n"))


def chunk_list(spark, sf):
    """Chunks of a base as listed: the newest revision's page and source laid over, by state of review, without figures; 50 by sequence and id."""
    c = table(spark, sf, "kb_chunk", "id", "kb_id", "seq_no", "audit_status", "enabled", "chunk_type", "latest_revision_id", "page_start").where("kb_id = 7 AND audit_status = 'approved' AND enabled AND chunk_type NOT IN ('image', 'figure')")
    r = table(spark, sf, "kb_chunk_revision", "id", "page_start", "revision_source").groupBy(F.col("id").alias("latest_revision_id")).agg(F.max("page_start").alias("own"), F.max("revision_source").alias("origin"))
    j = c.join(r, "latest_revision_id", "left").select("id", "seq_no", F.coalesce("own", "page_start").alias("page"), F.coalesce("origin", F.lit("base")).alias("origin"))
    return j.orderBy("seq_no", "id").limit(50)


def image_evidence(spark, sf):
    """Evidence of figures bound to chunks: those whose chunk is there, and orphans."""
    e = table(spark, sf, "kb_section_summary_evidence", "id", "chunk_id", "evidence_role").distinct().where("evidence_role = 'figure'")
    c = table(spark, sf, "kb_chunk", "id").select(F.col("id").alias("chunk_id"), F.lit(True).alias("there"))
    return e.join(c, "chunk_id", "left").groupBy(F.when(F.col("chunk_id").isNull(), "none").when(F.col("there"), "bound").otherwise("orphan").alias("state")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def rule_merge(spark, sf):
    """Items by rule (from the type of the section) and by model (anchors) for each chunk: the model's item of a kind counts before the rule's."""
    a = table(spark, sf, "kb_anchor_registry", "id", "source_chunk_id", "anchor_type").where("source_chunk_id IS NOT NULL").dropDuplicates(["id"]).select(F.col("source_chunk_id").alias("chunk_id"), F.when(F.col("anchor_type") == "process", "procedure").when(F.col("anchor_type") == "plan", "scope").otherwise(F.col("anchor_type")).alias("code"), F.lit(1).alias("rank"), "id")
    s = table(spark, sf, "kb_section", "section_id", "section_type").where("section_type IS NOT NULL").groupBy("section_id").agg(F.min("section_type").alias("code"))
    r = table(spark, sf, "kb_chunk", "id", "section_id").join(s, "section_id").select(F.col("id").alias("chunk_id"), "code", F.lit(2).alias("rank"), "id")
    best = a.unionByName(r).groupBy("chunk_id", "code").agg(F.min(F.struct("rank", "id")).alias("b"))
    return best.select("chunk_id", "code", F.when(F.col("b.rank") == 1, "model").otherwise("rule").alias("by"), F.col("b.id").alias("id"))


def qa_prebuilt(spark, sf):
    """Pairs built beforehand (title and content), deduped by the question without white space and case; an aligned quote is needed; its quality gives confidence and priority."""
    r = table(spark, sf, "kb_chunk_revision", "id", "chunk_id", "title").where("length(trim(title)) > 0").dropDuplicates(["id"])
    e = table(spark, sf, "kb_section_summary_evidence", "chunk_id", "alignment_status").where("chunk_id IS NOT NULL AND alignment_status IS NOT NULL").groupBy("chunk_id").agg(F.max(F.when(F.col("alignment_status") == "exact", 3).when(F.col("alignment_status") == "lesser", 2).otherwise(1)).alias("q"))
    key = F.lower(F.regexp_replace("title", "[ \\t\\r\\n]+", ""))
    j = r.join(e, "chunk_id").groupBy(key.alias("question")).agg(F.min(F.struct("id", "q")).alias("b"), F.count("*").alias("asked"))
    return j.select("question", F.col("b.id").alias("id"), "asked", F.when(F.col("b.q") == 3, 0.95).when(F.col("b.q") == 2, 0.85).otherwise(0.7).alias("confidence"), (F.col("b.q") * 5).alias("priority"))


def sequence_gaps(spark, sf):
    """Checks of chunks: required fields, repeated keys, and steps of the sequence within each file and generation that aren't 1."""
    c = table(spark, sf, "kb_chunk", "id", "file_node_id", "parse_generation", "seq_no", "content_hash", "section_id")
    w = Window.partitionBy("file_node_id", "parse_generation").orderBy("seq_no", "id")
    step = F.col("seq_no") - F.lag("seq_no").over(w)
    return c.withColumn("step", step).groupBy(F.when(F.col("step").isNull(), "first").when(F.col("step") == 1, "next").when(F.col("step") == 0, "same").otherwise("gap").alias("step"), F.col("section_id").isNull().alias("loose")).agg(F.count("*").alias("n"))


def content_slices(spark, sf):
    """Tables of contents cut in slices of 25 rows: slices of each table."""
    r = table(spark, sf, "kb_chunk_revision", "id", "content").where("content LIKE '%|%'").groupBy("id").agg(F.max("content").alias("content"))
    n = F.size(F.filter(F.split("content", "\n"), lambda x: x.startswith("|")))
    return r.select("id", n.alias("rows")).where("rows > 0").select("id", "rows", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / 25).cast("int"))).alias("slice")).withColumn("in_slice", F.least(F.lit(25), F.col("rows") - F.col("slice") * 25))


CATALOGUE = {
    "json_lines_source": (json_lines_source, "SELECT DISTINCT id, section_id, length(section_title) AS characters, coalesce(len(section_path), 0) AS elements, section_level FROM (SELECT DISTINCT id, section_id, section_title, section_path, section_level FROM kb_section)"),
    "delimited_source": (delimited_source, "SELECT id, length(anchor_name) AS name, length(evidence_quote) AS quote FROM (SELECT DISTINCT id, anchor_name, evidence_quote FROM kb_anchor_registry)"),
    "text_source": (text_source, None),
    "spreadsheet_source": (spreadsheet_source, "SELECT 'targets' AS sheet, row_number() OVER (ORDER BY source) AS row_no, source, round(target_share, 6) AS target_share, max_repeats FROM mix_targets"),
    "html_table_source": (html_table_source, None),
    "graph_import_source": (
        graph_import_source,
        """WITH s AS (SELECT section_id, min(section_type) AS t FROM kb_section GROUP BY section_id) SELECT coalesce(t, 'none') AS kind, count(*) AS n FROM s GROUP BY 1
        UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT section_id, parent_section_id FROM kb_section WHERE parent_section_id IN (SELECT section_id FROM s)) UNION ALL SELECT 'reports', count(*) FROM (SELECT DISTINCT id, section_title, node_summary FROM kb_section_summary) WHERE node_summary IS NOT NULL""",
    ),
    "dispatch": (dispatch, "SELECT CASE source WHEN 'scan_desk' THEN 'unsupported' WHEN 'qa_export' THEN 'table' WHEN 'branch_memo' THEN 'package' WHEN 'web_capture' THEN 'html' WHEN 'partner_feed' THEN 'json' ELSE 'markdown' END AS kind, count(*) AS n FROM documents GROUP BY 1"),
    "bulk_index_sink": (bulk_index_sink, "SELECT kb_id, count(*) FILTER (WHERE kb_id <> 7 OR id % 2 = 0) AS n, CASE WHEN kb_id = 7 THEN 2 ELSE 1 END AS written FROM kb_chunk WHERE kb_id IS NOT NULL GROUP BY kb_id"),
    "stage_artefacts": (stage_artefacts, " UNION ALL ".join(f"SELECT '{s}' AS stage, kb_id, count(*) AS n, max(id) AS last FROM (SELECT DISTINCT id, kb_id FROM {t}) GROUP BY kb_id" for s, t in (("chunks", "kb_chunk"), ("sections", "kb_section"), ("summaries", "kb_section_summary")))),
    "graph_merge_identity": (graph_merge_identity, "SELECT kb_id, CASE WHEN anchor_type IN ('role', 'department', 'system') THEN -1 ELSE file_node_id END AS owner, anchor_type, normalized_name, max(id) AS id FROM kb_anchor_registry WHERE normalized_name IS NOT NULL GROUP BY ALL"),
    "graph_sync": (
        graph_sync,
        "SELECT CASE WHEN coalesce(del_flag, false) THEN 'deleted' WHEN id % 2 = 0 THEN 'replaced' ELSE 'kept' END AS what, count(*) AS n FROM kb_chunk WHERE section_id IS NOT NULL GROUP BY 1",
    ),
    "schema_rejects": (schema_rejects, None),
    "chunk_list": (
        chunk_list,
        "SELECT k.id, seq_no, coalesce(own, page_start) AS page, coalesce(origin, 'base') AS origin FROM kb_chunk k LEFT JOIN (SELECT id, max(page_start) AS own, max(revision_source) AS origin FROM kb_chunk_revision GROUP BY id) r ON r.id = k.latest_revision_id WHERE kb_id = 7 AND audit_status = 'approved' AND enabled AND chunk_type NOT IN ('image', 'figure') ORDER BY seq_no NULLS FIRST, k.id LIMIT 50",
    ),
    "image_evidence": (image_evidence, "SELECT CASE WHEN chunk_id IS NULL THEN 'none' WHEN chunk_id IN (SELECT id FROM kb_chunk) THEN 'bound' ELSE 'orphan' END AS state, count(*) AS n, min(id) AS first FROM (SELECT DISTINCT id, chunk_id FROM kb_section_summary_evidence WHERE evidence_role = 'figure') GROUP BY 1"),
    "rule_merge": (
        rule_merge,
        """WITH u AS (SELECT source_chunk_id AS chunk_id, CASE anchor_type WHEN 'process' THEN 'procedure' WHEN 'plan' THEN 'scope' ELSE anchor_type END AS code, 1 AS rank, id FROM kb_anchor_registry WHERE source_chunk_id IS NOT NULL
            UNION ALL SELECT k.id, s.code, 2, k.id FROM kb_chunk k JOIN (SELECT section_id, min(section_type) AS code FROM kb_section WHERE section_type IS NOT NULL GROUP BY section_id) s USING (section_id))
        SELECT DISTINCT chunk_id, code, CASE rank WHEN 1 THEN 'model' ELSE 'rule' END AS "by", id FROM (SELECT DISTINCT * FROM u) QUALIFY row_number() OVER (PARTITION BY chunk_id, code ORDER BY rank, id) = 1""",
    ),
    "qa_prebuilt": (
        qa_prebuilt,
        """WITH r AS (SELECT DISTINCT ON (id) id, chunk_id, title FROM kb_chunk_revision WHERE length(trim(title, ' ')) > 0), e AS (SELECT chunk_id, max(CASE alignment_status WHEN 'exact' THEN 3 WHEN 'lesser' THEN 2 ELSE 1 END) AS q FROM kb_section_summary_evidence WHERE chunk_id IS NOT NULL AND alignment_status IS NOT NULL GROUP BY chunk_id),
        j AS (SELECT lower(regexp_replace(title, '[ \\t\\r\\n]+', '', 'g')) AS question, r.id, q, count(*) OVER (PARTITION BY lower(regexp_replace(title, '[ \\t\\r\\n]+', '', 'g'))) AS asked FROM r JOIN e USING (chunk_id))
        SELECT question, id, asked, CASE q WHEN 3 THEN 0.95 WHEN 2 THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence, q * 5 AS priority FROM j QUALIFY row_number() OVER (PARTITION BY question ORDER BY id) = 1""",
    ),
    "sequence_gaps": (
        sequence_gaps,
        "WITH s AS (SELECT section_id, seq_no - lag(seq_no) OVER (PARTITION BY file_node_id, parse_generation ORDER BY seq_no NULLS FIRST, id) AS s FROM kb_chunk) SELECT CASE WHEN s IS NULL THEN 'first' WHEN s = 1 THEN 'next' WHEN s = 0 THEN 'same' ELSE 'gap' END AS step, section_id IS NULL AS loose, count(*) AS n FROM s GROUP BY ALL",
    ),
    "content_slices": (
        content_slices,
        "WITH r AS (SELECT id, len(list_filter(string_split(max(content), chr(10)), lambda x: starts_with(x, '|'))) AS rows FROM kb_chunk_revision WHERE content LIKE '%|%' GROUP BY id) SELECT id, rows, slice, least(25, rows - slice * 25) AS in_slice FROM (SELECT id, rows, unnest(range((rows - 1) // 25 + 1)) AS slice FROM r WHERE rows > 0)",
    ),
}
