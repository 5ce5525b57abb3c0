"""Queries: what goes into the search index and what comes back from it. Documents of the index, texts to embed, scopes, listings, quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veinstone.functions import text as T
from veinstone.sources.tables import table

_W = T.words_sql


def _rev(spark, sf, *columns):
    """Revisions, each once."""
    return table(spark, sf, "kb_chunk_revision", "id", *columns).distinct()


def index_chunks(spark, sf):
    """Chunk documents: path joined by " > ", tokens counted, a preview of 500 characters, flags."""
    c = table(spark, sf, "kb_chunk", "id", "kb_id", "file_node_id", "section_id", "enabled", "audit_status", "del_flag", "latest_revision_id", "index_generation")
    r = table(spark, sf, "kb_chunk_revision", "id", "content", "title_path").where("content IS NOT NULL").groupBy(F.col("id").alias("latest_revision_id")).agg(F.max(F.struct("content", F.array_join("title_path", " > ").alias("path"))).alias("x"))
    flags = (F.col("enabled") & (F.col("audit_status") == "approved") & ~F.coalesce("del_flag", F.lit(False))).alias("searchable")
    return c.join(r, "latest_revision_id").select("id", "kb_id", "file_node_id", "index_generation", F.col("x.path").alias("title_path"), F.size(T.words(F.col("x.content"))).alias("tokens"), F.substring("x.content", 1, 500).alias("preview"), flags)


def index_sections(spark, sf):
    """Section summary documents: path, tokens of title and summary, the first covered chunk as the primary one, how many are covered."""
    s = table(spark, sf, "kb_section_summary", "id", "kb_id", "section_id", "section_title", "node_summary", "covered_chunk_ids", "confidence").dropDuplicates(["id"])
    p = table(spark, sf, "kb_section", "section_id", "section_path").where("section_path IS NOT NULL").groupBy("section_id").agg(F.max(F.array_join("section_path", " > ")).alias("path"))
    text = F.concat_ws(" ", "section_title", "node_summary")
    return s.join(p, "section_id", "left").select("id", "kb_id", "section_id", "path", F.size(T.words(text)).alias("tokens"), F.try_element_at("covered_chunk_ids", F.lit(1)).alias("primary_chunk_id"), F.coalesce(F.size(F.when(F.col("covered_chunk_ids").isNotNull(), F.col("covered_chunk_ids"))), F.lit(0)).alias("covered"))


def index_anchors(spark, sf):
    """Anchor documents: name and aliases as tokens, the label, whether it is in force."""
    a = table(spark, sf, "kb_anchor_registry", "id", "kb_id", "anchor_type", "anchor_name", "aliases", "status").distinct()
    names = F.concat_ws(" ", "anchor_name", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))
    return a.select("id", "kb_id", "anchor_type", T.label(F.col("anchor_name")).alias("label"), F.size(F.array_distinct(T.words(names))).alias("tokens"), (F.col("status") == "active").alias("active"))


def embedding_texts(spark, sf):
    """Texts to embed: of chunks title and content, of summaries path and summary, of anchors type, name and aliases; as lengths and hashes."""
    r = _rev(spark, sf, "title", "content").select(F.lit("chunk").alias("kind"), "id", F.concat_ws("\n", "title", "content").alias("t"))
    s = table(spark, sf, "kb_section_summary", "id", "section_title", "node_summary").distinct().select(F.lit("section").alias("kind"), "id", F.concat_ws("\n", "section_title", "node_summary").alias("t"))
    a = table(spark, sf, "kb_anchor_registry", "id", "anchor_type", "anchor_name", "aliases").distinct()
    a = a.select(F.lit("anchor").alias("kind"), "id", F.concat_ws(" ", "anchor_type", "anchor_name", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " ")).alias("t"))
    return r.unionByName(s).unionByName(a).select("kind", "id", F.length("t").alias("characters"), F.substring(F.sha1("t"), 1, 12).alias("hash"))


def candidate_rows(spark, sf):
    """Hits of all indexes in one form: identity is the chunk, else the summary, else the anchor; text is the first that is there."""
    s = table(spark, sf, "kb_section_summary", "id", "node_summary", "section_title", "covered_chunk_ids").dropDuplicates(["id"])
    a = table(spark, sf, "kb_anchor_registry", "id", "anchor_name", "evidence_quote", "source_chunk_id").distinct()
    both = s.select(F.lit("section").alias("route"), "id", F.try_element_at("covered_chunk_ids", F.lit(1)).alias("chunk_id"), F.coalesce(F.nullif(F.trim("node_summary"), F.lit("")), "section_title").alias("text")).unionByName(
        a.select(F.lit("anchor").alias("route"), "id", F.col("source_chunk_id").alias("chunk_id"), F.coalesce(F.nullif(F.trim("evidence_quote"), F.lit("")), "anchor_name").alias("text"))
    )
    key = F.when(F.col("chunk_id").isNotNull(), F.concat(F.lit("chunk:"), "chunk_id")).otherwise(F.concat("route", F.lit(":"), "id"))
    return both.select("route", "id", key.alias("identity"), F.length("text").alias("characters"))


def flattened_context(spark, sf):
    """Hits with the context of their group: title and path of the section that a chunk stands in, copied to each of its rows."""
    e = table(spark, sf, "kb_section_summary_evidence", "id", "kb_id", "chunk_id").distinct().where("chunk_id IS NOT NULL")
    c = table(spark, sf, "kb_chunk", "id", "kb_id", "section_id").select(F.col("id").alias("chunk_id"), "kb_id", "section_id")
    s = table(spark, sf, "kb_section", "section_id", "section_title").groupBy("section_id").agg(F.min("section_title").alias("section_title"))
    return e.join(c, ["kb_id", "chunk_id"], "left").join(s, "section_id", "left").select("id", "chunk_id", "section_id", "section_title")


def snapshot_restriction(spark, sf):
    """Rows of six tables that are tied to the chunks of one base: by chunk, by a covered chunk, or by their section."""
    ids = table(spark, sf, "kb_chunk", "id", "kb_id", "section_id").where("kb_id = 7")
    chunk, section = ids.select(F.col("id").alias("chunk_id")), ids.select("section_id").where("section_id IS NOT NULL").distinct()
    r = _rev(spark, sf, "chunk_id").join(chunk, "chunk_id", "left_semi").select(F.lit("revision").alias("source"), "id")
    e = table(spark, sf, "kb_section_summary_evidence", "id", "chunk_id").distinct().join(chunk, "chunk_id", "left_semi").select(F.lit("evidence").alias("source"), "id")
    a = table(spark, sf, "kb_anchor_registry", "id", F.col("source_chunk_id").alias("chunk_id")).distinct().join(chunk, "chunk_id", "left_semi").select(F.lit("anchor").alias("source"), "id")
    v = table(spark, sf, "knowledge_chunks_v1", "chunk_id").distinct().join(chunk, "chunk_id", "left_semi").select(F.lit("vector").alias("source"), F.col("chunk_id").alias("id"))
    s = table(spark, sf, "kb_section", "id", "section_id").distinct().join(section, "section_id", "left_semi").select(F.lit("section").alias("source"), "id")
    m = table(spark, sf, "kb_section_summary", "id", "covered_chunk_ids").select("id", F.explode("covered_chunk_ids").alias("chunk_id")).join(chunk, "chunk_id", "left_semi").select(F.lit("summary").alias("source"), "id").distinct()
    out = r
    for x in (e, a, v, s, m):
        out = out.unionByName(x)
    return out.groupBy("source").agg(F.count("*").alias("rows"), F.min("id").alias("first"), F.max("id").alias("last"))


def main_chunks(spark, sf):
    """Chunks of each file without those of appendices; a file that has nothing else keeps all."""
    c = table(spark, sf, "kb_chunk", "id", "file_node_id", "section_id")
    s = table(spark, sf, "kb_section", "section_id", "section_type").groupBy("section_id").agg(F.min("section_type").alias("section_type"))
    j = c.join(s, "section_id", "left").select("id", "file_node_id", (F.coalesce("section_type", F.lit("")) != "appendix").alias("main"))
    has = j.groupBy("file_node_id").agg(F.max("main").alias("has"))
    return j.join(has, "file_node_id").where("main OR NOT has").select("id", "file_node_id")


def qa_list(spark, sf):
    """Pairs of title and content whose question or answer holds a keyword, newest first by id."""
    r = _rev(spark, sf, "title", "content").where(F.lower("title").contains("bond") | F.lower("content").contains("bond"))
    return r.select("id", F.lower("title").contains("bond").alias("in_question"), F.lower("content").contains("bond").alias("in_answer"))


def file_type_filter(spark, sf):
    """Documents by the kind of file that their source stands for: scans, exports, notes, other."""
    d = table(spark, sf, "documents", "doc_id", "source")
    s = F.lower(F.coalesce("source", F.lit("")))
    return d.groupBy(F.when(s.contains("scan"), "pdf").when(s.contains("export") | s.contains("feed"), "excel").when(s.contains("memo") | s.contains("notes"), "word").otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


def scope_files(spark, sf):
    """Files that hold an active plan anchor whose name, or an alias of it, names one of the asked products; if none does, the files of the asked base."""
    asked = ["担保", "bond", "bürgschaft"]
    a = table(spark, sf, "kb_anchor_registry", "file_node_id", "kb_id", "anchor_type", "anchor_name", "aliases", "status").where("anchor_type = 'plan' AND status = 'active'")
    names = F.transform(F.concat(F.array("anchor_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.lower(x))
    strict = a.where(F.exists(names, lambda x: F.coalesce(x.contains(asked[0]) | x.contains(asked[1]) | x.contains(asked[2]), F.lit(False)))).select("file_node_id").distinct()
    fallback = table(spark, sf, "kb_chunk", "file_node_id", "kb_id").where("kb_id = 7").select("file_node_id").distinct()
    some = F.broadcast(strict.limit(1).agg((F.count("*") > 0).alias("some")))  # one row
    return strict.withColumn("match", F.lit("strict")).unionByName(fallback.crossJoin(some).where("NOT some").select("file_node_id", F.lit("fallback").alias("match")))


def chunk_quality(spark, sf):
    """Quality of the chunks of each base: counts, empty and short and long texts, average length, keys of the first empty ones."""
    c = table(spark, sf, "kb_chunk", "id", "kb_id", "section_id", "latest_revision_id")
    r = table(spark, sf, "kb_chunk_revision", "id", "content").groupBy(F.col("id").alias("latest_revision_id")).agg(F.max("content").alias("content"))
    j = c.join(r, "latest_revision_id", "left").withColumn("n", F.coalesce(F.length("content"), F.lit(0)))
    # Ten keys a base: a list of fixed length, cut on both sides of the shuffle.
    short = j.where("n < 80").withColumn("p", F.row_number().over(Window.partitionBy("kb_id").orderBy("id"))).where("p <= 10").groupBy("kb_id").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("short_ids"))
    agg = j.groupBy("kb_id").agg(F.count("*").alias("chunks"), F.count_if(F.expr("n = 0")).alias("empty"), F.count_if(F.expr("n < 80")).alias("short"), F.count_if(F.expr("n > 2000")).alias("long"), F.count_if(F.expr("section_id IS NULL")).alias("loose"), F.round(F.avg("n"), 4).alias("average"))
    return agg.join(short, "kb_id", "left")


def node_order(spark, sf):
    """Nodes of one base by kind (file, section, shared anchor, other) and name: the first 400."""
    f = table(spark, sf, "kb_chunk", "kb_id", "file_node_id").where("kb_id = 7").select(F.lit(0).alias("rank"), F.col("file_node_id").cast("string").alias("name")).distinct()
    s = table(spark, sf, "kb_section", "kb_id", "section_id").where("kb_id = 7").select(F.lit(1).alias("rank"), F.col("section_id").alias("name")).distinct()
    a = table(spark, sf, "kb_anchor_registry", "kb_id", "anchor_id", "anchor_type").where("kb_id = 7").select(F.when(F.col("anchor_type").isin("role", "department", "system"), 2).otherwise(3).alias("rank"), F.col("anchor_id").alias("name")).distinct()
    return f.unionByName(s).unionByName(a).orderBy("rank", "name").limit(400)


def sibling_order(spark, sf):
    """Place of each section among its siblings, by first page of its chunks and id."""
    s = table(spark, sf, "kb_section", "section_id", "parent_section_id").groupBy("section_id").agg(F.min(F.nullif(F.trim("parent_section_id"), F.lit(""))).alias("parent"))
    p = table(spark, sf, "kb_chunk", "section_id", "page_start").groupBy("section_id").agg(F.min("page_start").alias("page"))
    order = Window.partitionBy("parent").orderBy(F.coalesce("page", F.lit(1 << 30)), "section_id")
    return s.where("parent IS NOT NULL").join(p, "section_id", "left").select("section_id", "parent", F.row_number().over(order).alias("place"))


def section_tree(spark, sf):
    """Sections built from their chunks: sequence and page range, how many, the first title, total length."""
    c = table(spark, sf, "kb_chunk", "id", "kb_id", "file_node_id", "section_id", "seq_no", "page_start", "page_end", "latest_revision_id").where("section_id IS NOT NULL")
    r = table(spark, sf, "kb_chunk_revision", "id", "title", "content").groupBy(F.col("id").alias("latest_revision_id")).agg(F.max("title").alias("title"), F.max(F.length("content")).alias("n"))
    j = c.join(r, "latest_revision_id", "left")
    return j.groupBy("file_node_id", "section_id").agg(
        F.count("*").alias("chunks"), F.min("seq_no").alias("seq_start"), F.max("seq_no").alias("seq_end"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"),
        F.min_by("title", F.when(F.col("title").isNotNull(), F.struct("seq_no", "id"))).alias("title"), F.sum(F.coalesce("n", F.lit(0))).alias("characters"),
    )


def table_rows(spark, sf):
    """Tables within texts and their rows, one to many: table number, row number and cells of each row."""
    r = table(spark, sf, "kb_chunk_revision", "id", "content").where("content LIKE '%|%'").distinct()
    t = r.select("id", F.posexplode(F.filter(F.split("content", "\n\n"), lambda x: F.ltrim(x).startswith("|"))).alias("table_no", "t"))
    rows = t.select("id", "table_no", F.posexplode(F.filter(F.split("t", "\n"), lambda x: F.trim(x).startswith("|"))).alias("row_no", "row"))
    return rows.select("id", "table_no", "row_no", (F.size(F.split("row", r"\|")) - 2).alias("cells"))


_RC = "(SELECT id, max(content) AS content FROM kb_chunk_revision GROUP BY id)"

CATALOGUE = {
    "index_chunks": (
        index_chunks,
        f"""WITH r AS (SELECT id, max({{'content': content, 'path': coalesce(array_to_string(list_filter(title_path, lambda x: x IS NOT NULL), ' > '), NULL)}}) AS x FROM kb_chunk_revision WHERE content IS NOT NULL GROUP BY id)
        SELECT c.id, kb_id, file_node_id, index_generation, x.path AS title_path, len({_W('x.content')}) AS tokens, left(x.content, 500) AS preview, enabled AND audit_status = 'approved' AND NOT coalesce(del_flag, false) AS searchable FROM kb_chunk c JOIN r ON r.id = c.latest_revision_id""",
    ),
    "index_sections": (
        index_sections,
        f"""WITH s AS (SELECT DISTINCT ON (id) * FROM kb_section_summary), p AS (SELECT section_id, max(array_to_string(list_filter(section_path, lambda x: x IS NOT NULL), ' > ')) AS path FROM kb_section WHERE section_path IS NOT NULL GROUP BY section_id)
        SELECT id, kb_id, section_id, path, len({_W("concat_ws(' ', section_title, node_summary)")}) AS tokens, covered_chunk_ids[1] AS primary_chunk_id, coalesce(len(covered_chunk_ids), 0) AS covered FROM s LEFT JOIN p USING (section_id)""",
    ),
    "index_anchors": (
        index_anchors,
        f"""WITH a AS (SELECT DISTINCT id, kb_id, anchor_type, anchor_name, aliases, status FROM kb_anchor_registry)
        SELECT id, kb_id, anchor_type, regexp_replace(lower(anchor_name), '[^0-9a-z一-鿿]', '', 'g') AS label, len(list_distinct({_W("concat_ws(' ', anchor_name, coalesce(array_to_string(aliases, ' '), ''))")})) AS tokens, status = 'active' AS active FROM a""",
    ),
    "embedding_texts": (
        embedding_texts,
        """WITH t AS (SELECT 'chunk' AS kind, id, concat_ws(chr(10), title, content) AS t FROM (SELECT DISTINCT id, title, content FROM kb_chunk_revision)
            UNION ALL SELECT 'section', id, concat_ws(chr(10), section_title, node_summary) FROM (SELECT DISTINCT id, section_title, node_summary FROM kb_section_summary)
            UNION ALL SELECT 'anchor', id, concat_ws(' ', anchor_type, anchor_name, coalesce(array_to_string(aliases, ' '), '')) FROM (SELECT DISTINCT id, anchor_type, anchor_name, aliases FROM kb_anchor_registry))
        SELECT kind, id, length(t) AS characters, left(sha1(t), 12) AS hash FROM t""",
    ),
    "candidate_rows": (
        candidate_rows,
        """WITH b AS (SELECT 'section' AS route, id, covered_chunk_ids[1] AS chunk_id, coalesce(nullif(trim(node_summary, ' '), ''), section_title) AS text FROM (SELECT DISTINCT ON (id) * FROM kb_section_summary)
            UNION ALL SELECT 'anchor', id, source_chunk_id, coalesce(nullif(trim(evidence_quote, ' '), ''), anchor_name) FROM (SELECT DISTINCT id, anchor_name, evidence_quote, source_chunk_id FROM kb_anchor_registry))
        SELECT route, id, CASE WHEN chunk_id IS NOT NULL THEN 'chunk:' || chunk_id ELSE route || ':' || id END AS identity, length(text) AS characters FROM b""",
    ),
    "flattened_context": (
        flattened_context,
        """SELECT e.id, e.chunk_id, c.section_id, s.section_title FROM (SELECT DISTINCT id, kb_id, chunk_id FROM kb_section_summary_evidence WHERE chunk_id IS NOT NULL) e LEFT JOIN kb_chunk c ON c.id = e.chunk_id AND c.kb_id = e.kb_id
        LEFT JOIN (SELECT section_id, min(section_title) AS section_title FROM kb_section GROUP BY section_id) s ON s.section_id = c.section_id""",
    ),
    "snapshot_restriction": (
        snapshot_restriction,
        """WITH k AS (SELECT id, section_id FROM kb_chunk WHERE kb_id = 7), x AS (
            SELECT DISTINCT 'revision' AS source, id FROM kb_chunk_revision WHERE chunk_id IN (SELECT id FROM k) UNION ALL SELECT DISTINCT 'evidence', id FROM kb_section_summary_evidence WHERE chunk_id IN (SELECT id FROM k)
            UNION ALL SELECT DISTINCT 'anchor', id FROM kb_anchor_registry WHERE source_chunk_id IN (SELECT id FROM k) UNION ALL SELECT DISTINCT 'vector', chunk_id FROM knowledge_chunks_v1 WHERE chunk_id IN (SELECT id FROM k)
            UNION ALL SELECT DISTINCT 'section', id FROM kb_section WHERE section_id IN (SELECT section_id FROM k) UNION ALL SELECT DISTINCT 'summary', id FROM (SELECT id, unnest(covered_chunk_ids) AS c FROM kb_section_summary) WHERE c IN (SELECT id FROM k))
        SELECT source, count(*) AS rows, min(id) AS first, max(id) AS last FROM x GROUP BY source""",
    ),
    "main_chunks": (
        main_chunks,
        """WITH j AS (SELECT k.id, file_node_id, coalesce(t, '') <> 'appendix' AS main FROM kb_chunk k LEFT JOIN (SELECT section_id, min(section_type) AS t FROM kb_section GROUP BY section_id) USING (section_id))
        SELECT id, file_node_id FROM (SELECT *, bool_or(main) OVER (PARTITION BY file_node_id) AS has FROM j) WHERE main OR NOT has""",
    ),
    "qa_list": (qa_list, "SELECT id, lower(title) LIKE '%bond%' AS in_question, lower(content) LIKE '%bond%' AS in_answer FROM (SELECT DISTINCT id, title, content FROM kb_chunk_revision) WHERE lower(title) LIKE '%bond%' OR lower(content) LIKE '%bond%'"),
    "file_type_filter": (file_type_filter, "SELECT CASE WHEN source LIKE '%scan%' THEN 'pdf' WHEN source LIKE '%export%' OR source LIKE '%feed%' THEN 'excel' WHEN source LIKE '%memo%' OR source LIKE '%notes%' THEN 'word' ELSE 'other' END AS kind, count(*) AS n FROM documents GROUP BY 1"),
    "scope_files": (
        scope_files,
        """WITH s AS (SELECT DISTINCT file_node_id FROM kb_anchor_registry WHERE anchor_type = 'plan' AND status = 'active' AND regexp_matches(lower(anchor_name || ' ' || coalesce(array_to_string(aliases, ' '), '')), '担保|bond|bürgschaft'))
        SELECT file_node_id, 'strict' AS match FROM s UNION ALL SELECT DISTINCT file_node_id, 'fallback' FROM kb_chunk WHERE kb_id = 7 AND NOT EXISTS (SELECT 1 FROM s)""",
    ),
    "chunk_quality": (
        chunk_quality,
        f"""WITH j AS (SELECT k.id, kb_id, section_id, coalesce(length(content), 0) AS n FROM kb_chunk k LEFT JOIN {_RC} r ON r.id = k.latest_revision_id),
        s AS (SELECT kb_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS short_ids FROM (SELECT * FROM j WHERE n < 80 QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY id) <= 10) GROUP BY kb_id)
        SELECT kb_id, count(*) AS chunks, count_if(n = 0) AS empty, count_if(n < 80) AS short, count_if(n > 2000) AS long, count_if(section_id IS NULL) AS loose, round(avg(n), 4) AS average, any_value(short_ids) AS short_ids FROM j LEFT JOIN s USING (kb_id) GROUP BY kb_id""",
    ),
    "node_order": (
        node_order,
        """SELECT DISTINCT 0 AS rank, file_node_id::VARCHAR AS name FROM kb_chunk WHERE kb_id = 7 UNION ALL SELECT DISTINCT 1, section_id FROM kb_section WHERE kb_id = 7
        UNION ALL SELECT DISTINCT CASE WHEN anchor_type IN ('role', 'department', 'system') THEN 2 ELSE 3 END, anchor_id FROM kb_anchor_registry WHERE kb_id = 7 ORDER BY 1, 2 LIMIT 400""",
    ),
    "sibling_order": (
        sibling_order,
        """SELECT section_id, parent, row_number() OVER (PARTITION BY parent ORDER BY coalesce(page, 1073741824), section_id) AS place FROM (SELECT section_id, min(nullif(trim(parent_section_id, ' '), '')) AS parent FROM kb_section GROUP BY section_id)
        LEFT JOIN (SELECT section_id, min(page_start) AS page FROM kb_chunk GROUP BY section_id) USING (section_id) WHERE parent IS NOT NULL""",
    ),
    "section_tree": (
        section_tree,
        """WITH r AS (SELECT id, max(title) AS title, max(length(content)) AS n FROM kb_chunk_revision GROUP BY id)
        SELECT file_node_id, section_id, count(*) AS chunks, min(seq_no) AS seq_start, max(seq_no) AS seq_end, min(page_start) AS page_start, max(page_end) AS page_end, arg_min(title, {'s': seq_no, 'i': k.id}) FILTER (WHERE title IS NOT NULL) AS title, sum(coalesce(n, 0))::BIGINT AS characters
        FROM kb_chunk k LEFT JOIN r ON r.id = k.latest_revision_id WHERE section_id IS NOT NULL GROUP BY file_node_id, section_id""",
    ),
    "table_rows": (
        table_rows,
        """WITH r AS (SELECT DISTINCT id, content FROM kb_chunk_revision WHERE content LIKE '%|%'), t AS (SELECT id, unnest(list_filter(string_split(content, chr(10) || chr(10)), lambda x: starts_with(ltrim(x, ' '), '|'))) AS t, generate_subscripts(list_filter(string_split(content, chr(10) || chr(10)), lambda x: starts_with(ltrim(x, ' '), '|')), 1) - 1 AS table_no FROM r),
        w AS (SELECT id, table_no, list_filter(string_split(t, chr(10)), lambda x: starts_with(trim(x, ' '), '|')) AS l FROM t), u AS (SELECT id, table_no, unnest(l) AS row, generate_subscripts(l, 1) - 1 AS row_no FROM w)
        SELECT id, table_no, row_no, len(string_split(row, '|')) - 2 AS cells FROM u""",
    ),
}
