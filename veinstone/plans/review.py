"""Queries: review, state and history of chunks, files and questions, messages with their citations, hits with file and base, reports on parsing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veinstone.sources.tables import table


def _newest(spark, sf):
    """Newest revision of each chunk by number, then time and id."""
    r = table(spark, sf, "kb_chunk_revision", "id", "chunk_id", "revision_no", "create_time", "content", "revision_source").distinct()
    return r.groupBy("chunk_id").agg(F.max(F.struct("revision_no", "create_time", "id", "content", "revision_source")).alias("x")).select("chunk_id", "x.*")


def chunk_review(spark, sf):
    """Review of manual edits: approved with a new revision where the text differs from the one before, approved as it is where it doesn't; the number the new revision gets."""
    r = table(spark, sf, "kb_chunk_revision", "id", "chunk_id", "revision_no", "content", "revision_source").distinct()
    order = Window.partitionBy("chunk_id").orderBy("revision_no", "id")
    j = r.withColumn("before", F.lag("content").over(order)).withColumn("most", F.max("revision_no").over(Window.partitionBy("chunk_id"))).where("revision_source = 'manual_edit'")
    changed = ~F.col("content").eqNullSafe(F.col("before"))
    return j.select("id", "chunk_id", F.when(changed, "revise").otherwise("keep").alias("action"), F.when(changed, F.col("most") + 1).alias("next_revision"))


def file_review(spark, sf):
    """Rejection of a file: what the cascade does to each base's chunks of the file 880001 (disabled, pointer cleared) and leaves of the others."""
    c = table(spark, sf, "kb_chunk", "id", "kb_id", "file_node_id", "enabled", "published_revision_id")
    hit = F.coalesce(F.col("file_node_id") == 880001, F.lit(False))
    after = c.select("kb_id", hit.alias("hit"), F.when(hit, False).otherwise(F.col("enabled")).alias("enabled"), F.when(~hit, F.col("published_revision_id")).alias("published"))
    return after.groupBy("kb_id").agg(F.count_if("hit").alias("rejected"), F.count_if("enabled").alias("enabled"), F.count("published").alias("published"))


def index_deletion(spark, sf):
    """State of the index after deletion of a file: its rows become deleted, other rows keep their state; counted by generation and state."""
    v = table(spark, sf, "knowledge_chunks_v1", "chunk_id", "file_node_id", "index_generation", "enabled", "deleted").dropDuplicates(["chunk_id"])
    state = F.when((F.col("file_node_id") == 880001) | F.coalesce("deleted", F.lit(False)), "deleted").when(F.coalesce("enabled", F.lit(False)), "active").otherwise("inactive")
    return v.groupBy("index_generation", state.alias("state")).agg(F.count("*").alias("n"))


def qa_save(spark, sf):
    """Question-answer pairs (title and content) as they are appended: blank ones left out, numbered after what is there, in order of id."""
    r = table(spark, sf, "kb_chunk_revision", "id", "kb_id", "title", "content").dropDuplicates(["id"])
    p = r.where("length(trim(title)) > 0 AND length(trim(content)) > 0")
    return p.select("id", "kb_id", (F.row_number().over(Window.partitionBy("kb_id").orderBy("id")) + 1000).alias("qa_no"))


def qa_snapshot(spark, sf):
    """Pairs in force: of approved chunks that aren't deleted, of the files in scope (those divisible by 3) or of none."""
    c = table(spark, sf, "kb_chunk", "id", "file_node_id", "audit_status", "del_flag").where("audit_status = 'approved' AND NOT coalesce(del_flag, false) AND (file_node_id IS NULL OR file_node_id % 3 = 0)")
    return _newest(spark, sf).join(c.select(F.col("id").alias("chunk_id"), "file_node_id"), "chunk_id").select("chunk_id", "id", "file_node_id")


def file_existence(spark, sf):
    """Documents that are there already: one of the same text came before, or else one of the same file."""
    d = table(spark, sf, "documents", "doc_id", "text", "file_node_id")
    h = d.where("length(text) > 0").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("by_text"))
    f = d.where("file_node_id IS NOT NULL").groupBy("file_node_id").agg(F.min("doc_id").alias("by_file"))
    j = d.select("doc_id", "file_node_id", F.when(F.length("text") > 0, F.sha2("text", 256)).alias("h")).join(h, "h", "left").join(f, "file_node_id", "left")
    hit = F.when(F.col("by_text") < F.col("doc_id"), "text").when(F.col("by_file") < F.col("doc_id"), "file")
    return j.select("doc_id", hit.alias("by"), F.when(hit == "text", F.col("by_text")).when(hit == "file", F.col("by_file")).alias("existing")).where("by IS NOT NULL")


def message_citations(spark, sf):
    """Messages (summaries) with their citations (evidence) in order of place: how many, the first five roles, the first chunk."""
    m = table(spark, sf, "kb_section_summary", "id").distinct()
    e = table(spark, sf, "kb_section_summary_evidence", "id", "summary_id", "chunk_id", "evidence_role", "char_start").distinct()
    place = F.row_number().over(Window.partitionBy("summary_id").orderBy(F.col("char_start").asc_nulls_last(), "id"))
    # Five are shown, so a list never grows beyond that; all are counted.
    few = e.withColumn("p", place).where("p <= 5").groupBy("summary_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("p", "evidence_role")))["evidence_role"], ",").alias("roles"), F.min_by("chunk_id", "p").alias("first_chunk"))
    n = e.groupBy("summary_id").agg(F.count("*").alias("citations"))
    return m.join(few.withColumnRenamed("summary_id", "id"), "id", "left").join(n.withColumnRenamed("summary_id", "id"), "id", "left").select("id", F.coalesce("citations", F.lit(0)).alias("citations"), "roles", "first_chunk")


def hits_with_file(spark, sf):
    """Hits with file and base, of bases the asker may read (even ids stand for public, 7 is granted): best hit of each file by confidence."""
    a = table(spark, sf, "kb_anchor_registry", "id", "source_chunk_id", "confidence").where("source_chunk_id IS NOT NULL AND confidence IS NOT NULL").distinct()
    c = table(spark, sf, "kb_chunk", "id", "kb_id", "file_node_id").where("kb_id % 2 = 0 OR kb_id = 7").select(F.col("id").alias("source_chunk_id"), "kb_id", "file_node_id")
    best = a.join(c, "source_chunk_id").groupBy("kb_id", "file_node_id").agg(F.max(F.struct("confidence", (-F.col("id")).alias("i"))).alias("b"), F.count("*").alias("hits"))
    return best.select("kb_id", "file_node_id", (-F.col("b.i")).alias("id"), F.col("b.confidence").cast("double").alias("confidence"), "hits")


def status_poll(spark, sf):
    """One poll of active tasks: users whose newest event is neither a purchase nor an error, the 50 smallest ids."""
    e = table(spark, sf, "events", "user_id", "ts", "event_id", "event_type")
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return last.where("state NOT IN ('purchase', 'error')").orderBy("user_id").limit(50)


def cache_identity(spark, sf):
    """Identity of each document's parse: hash of its text, profile, parser, version and options in the order of their names."""
    d = table(spark, sf, "documents", "doc_id", "text", "lang", "source").where("length(text) > 0")
    options = F.to_json(F.struct(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")))
    return d.select("doc_id", F.sha2(F.concat_ws("|", F.sha1("text"), F.coalesce("lang", F.lit("default")), F.lit("text"), F.lit("1"), options), 256).alias("identity"))


def cache_lookup(spark, sf):
    """Documents whose exact five-part key (hash, profile, parser, version, options) an earlier document has."""
    i = cache_identity(spark, sf)
    first = i.groupBy("identity").agg(F.min("doc_id").alias("cached"))
    return i.join(first, "identity").where("doc_id <> cached").select("doc_id", "cached")


def layer_report(spark, sf):
    """Report on the stages of parsing: rows, distinct keys and rows that warn, of each stage's table."""
    stages = [
        ("chunks", "kb_chunk", "id", "section_id IS NULL"), ("revisions", "kb_chunk_revision", "id", "title IS NULL"), ("sections", "kb_section", "id", "section_path IS NULL"),
        ("summaries", "kb_section_summary", "id", "node_summary IS NULL"), ("evidence", "kb_section_summary_evidence", "id", "chunk_id IS NULL"), ("anchors", "kb_anchor_registry", "id", "source_chunk_id IS NULL"),
    ]
    out = None
    for name, t, key, warns in stages:
        p = table(spark, sf, t).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(F.expr(warns)).alias("warnings")).select(F.lit(name).alias("stage"), "rows", "keys", "warnings")
        out = p if out is None else out.unionByName(p)
    return out


def retrieval_settings(spark, sf):
    """Weights of the routes for each base: defaults, over them the stored ones of its profile, over them the asked ones; those above 0 made to sum to 1, all alike if none is."""
    default = {"lexical": 0.3, "vector": 0.3, "graph": 0.2, "sections": 0.2}
    stored = {"zh": {"lexical": 0.5}, "de": {"graph": 0.0}, "und": dict.fromkeys(default, 0.0)}
    b = table(spark, sf, "documents", "kb_id", "lang").where("kb_id IS NOT NULL").groupBy("kb_id").agg(F.min("lang").alias("profile"))
    weights = []
    for route, w in default.items():
        c = F.lit(w)
        for profile, own in stored.items():
            if route in own:
                c = F.when(F.col("profile") == profile, own[route]).otherwise(c)
        weights.append(c.alias(route))
    r = b.select("kb_id", *weights)
    total = sum((F.col(x) for x in default), F.lit(0.0))
    return r.withColumn("total", total).select("kb_id", *[F.round(F.when(F.col("total") > 0, F.col(x) / F.col("total")).otherwise(1 / len(default)), 6).alias(x) for x in default])


_N = "n AS (SELECT chunk_id, id, content, revision_source FROM (SELECT DISTINCT id, chunk_id, revision_no, create_time, content, revision_source FROM kb_chunk_revision) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY revision_no DESC, create_time DESC, id DESC) = 1)"

CATALOGUE = {
    "chunk_review": (
        chunk_review,
        """WITH r AS (SELECT DISTINCT id, chunk_id, revision_no, content, revision_source FROM kb_chunk_revision), j AS (SELECT *, lag(content) OVER (PARTITION BY chunk_id ORDER BY revision_no, id) AS before, max(revision_no) OVER (PARTITION BY chunk_id) AS most FROM r)
        SELECT id, chunk_id, CASE WHEN content IS DISTINCT FROM before THEN 'revise' ELSE 'keep' END AS action, CASE WHEN content IS DISTINCT FROM before THEN most + 1 END AS next_revision FROM j WHERE revision_source = 'manual_edit'""",
    ),
    "file_review": (
        file_review,
        "SELECT kb_id, count_if(coalesce(file_node_id = 880001, false)) AS rejected, count_if(enabled AND NOT coalesce(file_node_id = 880001, false)) AS enabled, count(CASE WHEN NOT coalesce(file_node_id = 880001, false) THEN published_revision_id END) AS published FROM kb_chunk GROUP BY kb_id",
    ),
    "index_deletion": (
        index_deletion,
        "SELECT index_generation, CASE WHEN file_node_id = 880001 OR coalesce(deleted, false) THEN 'deleted' WHEN coalesce(enabled, false) THEN 'active' ELSE 'inactive' END AS state, count(*) AS n FROM (SELECT DISTINCT ON (chunk_id) * FROM knowledge_chunks_v1) GROUP BY ALL",
    ),
    "qa_save": (qa_save, "SELECT id, kb_id, row_number() OVER (PARTITION BY kb_id ORDER BY id) + 1000 AS qa_no FROM (SELECT DISTINCT ON (id) * FROM kb_chunk_revision) WHERE length(trim(title, ' ')) > 0 AND length(trim(content, ' ')) > 0"),
    "qa_snapshot": (qa_snapshot, f"WITH {_N} SELECT chunk_id, n.id, file_node_id FROM n JOIN kb_chunk k ON k.id = chunk_id WHERE audit_status = 'approved' AND NOT coalesce(del_flag, false) AND (file_node_id IS NULL OR file_node_id % 3 = 0)"),
    "file_existence": (
        file_existence,
        """WITH h AS (SELECT text, min(doc_id) AS t FROM documents WHERE length(text) > 0 GROUP BY text), f AS (SELECT file_node_id, min(doc_id) AS g FROM documents WHERE file_node_id IS NOT NULL GROUP BY file_node_id),
        j AS (SELECT d.doc_id, CASE WHEN t < d.doc_id THEN 'text' WHEN g < d.doc_id THEN 'file' END AS by_, t, g FROM documents d LEFT JOIN h USING (text) LEFT JOIN f USING (file_node_id)) SELECT doc_id, by_ AS "by", CASE by_ WHEN 'text' THEN t ELSE g END AS existing FROM j WHERE by_ IS NOT NULL""",
    ),
    "message_citations": (
        message_citations,
        """WITH e AS (SELECT DISTINCT id, summary_id, chunk_id, evidence_role, char_start FROM kb_section_summary_evidence), p AS (SELECT *, row_number() OVER (PARTITION BY summary_id ORDER BY char_start NULLS LAST, id) AS p FROM e),
        f AS (SELECT summary_id, string_agg(evidence_role, ',' ORDER BY p) AS roles, arg_min_null(chunk_id, p) AS first_chunk FROM p WHERE p <= 5 GROUP BY summary_id), n AS (SELECT summary_id, count(*) AS citations FROM e GROUP BY summary_id)
        SELECT m.id, coalesce(citations, 0) AS citations, roles, first_chunk FROM (SELECT DISTINCT id FROM kb_section_summary) m LEFT JOIN f ON f.summary_id = m.id LEFT JOIN n ON n.summary_id = m.id""",
    ),
    "hits_with_file": (
        hits_with_file,
        """WITH j AS (SELECT k.kb_id, k.file_node_id, a.id, a.confidence, count(*) OVER (PARTITION BY k.kb_id, k.file_node_id) AS hits FROM (SELECT DISTINCT id, source_chunk_id, confidence FROM kb_anchor_registry WHERE confidence IS NOT NULL) a JOIN kb_chunk k ON k.id = a.source_chunk_id WHERE k.kb_id % 2 = 0 OR k.kb_id = 7)
        SELECT kb_id, file_node_id, id, confidence::DOUBLE AS confidence, hits FROM j QUALIFY row_number() OVER (PARTITION BY kb_id, file_node_id ORDER BY confidence DESC, id) = 1""",
    ),
    "status_poll": (status_poll, "SELECT user_id, state FROM (SELECT user_id, event_type AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE state NOT IN ('purchase', 'error') ORDER BY user_id LIMIT 50"),
    "cache_identity": (
        cache_identity,
        """SELECT doc_id, sha256(concat_ws('|', sha1(text), coalesce(lang, 'default'), 'text', '1', '{"lang":"' || coalesce(lang, '') || '","source":"' || coalesce(source, '') || '"}')) AS identity FROM documents WHERE length(text) > 0""",
    ),
    "cache_lookup": (cache_lookup, "SELECT doc_id, c AS cached FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, coalesce(lang, 'default'), coalesce(lang, ''), coalesce(source, '')) AS c FROM documents WHERE length(text) > 0) WHERE doc_id <> c"),
    "layer_report": (
        layer_report,
        " UNION ALL ".join(
            f"SELECT '{n}' AS stage, count(*) AS rows, count(DISTINCT id) AS keys, count_if({w}) AS warnings FROM {t}"
            for n, t, w in (("chunks", "kb_chunk", "section_id IS NULL"), ("revisions", "kb_chunk_revision", "title IS NULL"), ("sections", "kb_section", "section_path IS NULL"), ("summaries", "kb_section_summary", "node_summary IS NULL"), ("evidence", "kb_section_summary_evidence", "chunk_id IS NULL"), ("anchors", "kb_anchor_registry", "source_chunk_id IS NULL"))
        ),
    ),
    "retrieval_settings": (
        retrieval_settings,
        """WITH b AS (SELECT kb_id, min(lang) AS p FROM documents WHERE kb_id IS NOT NULL GROUP BY kb_id), w AS (SELECT kb_id, CASE p WHEN 'zh' THEN 0.5 WHEN 'und' THEN 0.0 ELSE 0.3 END::DOUBLE AS l, CASE p WHEN 'und' THEN 0.0 ELSE 0.3 END::DOUBLE AS v, CASE WHEN p IN ('de', 'und') THEN 0.0 ELSE 0.2 END::DOUBLE AS g, CASE p WHEN 'und' THEN 0.0 ELSE 0.2 END::DOUBLE AS s FROM b), t AS (SELECT *, l + v + g + s AS t FROM w)
        SELECT kb_id, round(CASE WHEN t > 0 THEN l / t ELSE 0.25 END, 6) AS lexical, round(CASE WHEN t > 0 THEN v / t ELSE 0.25 END, 6) AS vector, round(CASE WHEN t > 0 THEN g / t ELSE 0.25 END, 6) AS graph, round(CASE WHEN t > 0 THEN s / t ELSE 0.25 END, 6) AS sections FROM t""",
    ),
}
