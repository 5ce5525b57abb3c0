"""Queries: chunks, revisions, files and bases as relational rows. Where a table is delivered with repeated rows they are made distinct first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinstone.sources.tables import table

_REV = "rev AS (SELECT DISTINCT id, chunk_id, kb_id, file_node_id, revision_no, revision_source, title, content, create_time FROM kb_chunk_revision)"


def _chunk(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "kb_chunk", *columns)


def _revision(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return table(spark, sf, "kb_chunk_revision", *columns).distinct()


def latest(df: DataFrame, by: list[str], order: list[str], *values: str) -> DataFrame:
    """One row a group: the values of the row that is last by ``order``. No sort: max_by is combined before the shuffle."""
    return df.groupBy(*by).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("_last")).select(*by, *[F.col(f"_last.{v}").alias(v) for v in values])


def active_chunks(spark, sf):
    """Enabled, approved, not deleted."""
    return _chunk(spark, sf, "id", "kb_id", "file_node_id", "enabled", "audit_status", "del_flag").where("enabled AND audit_status = 'approved' AND NOT del_flag").select("id", "kb_id", "file_node_id")


def structural_filter(spark, sf):
    """Anchors of one base in one state."""
    return table(spark, sf, "kb_anchor_registry", "id", "kb_id", "status", "anchor_type").where("kb_id = 7 AND status = 'active'").distinct().select("id", "anchor_type")


def chunk_type_filter(spark, sf):
    """Chunks of the wanted types."""
    return _chunk(spark, sf, "id", "chunk_type").where(F.col("chunk_type").isin("small_chunk", "section_chunk"))


def qa_scope(spark, sf):
    """Approved chunks that aren't deleted, of chosen files or of none."""
    return _chunk(spark, sf, "id", "file_node_id", "audit_status", "del_flag").where("(file_node_id IN (880001) OR file_node_id IS NULL) AND audit_status = 'approved' AND NOT coalesce(del_flag, false)").select("id")


def active_scope(spark, sf):
    """Chunks in scope: where files are named (of base 7: file 880001) just those; elsewhere of files that have a generation in the index, in just that one."""
    index = table(spark, sf, "knowledge_chunks_v1", "file_node_id", "parse_generation", "deleted").where("NOT deleted AND parse_generation IS NOT NULL").select("file_node_id", "parse_generation").distinct()
    c = _chunk(spark, sf, "id", "kb_id", "file_node_id", "parse_generation")
    named = F.coalesce(F.col("kb_id") == 7, F.lit(False))
    return c.where(named & (F.col("file_node_id") == 880001)).select("id").unionByName(c.where(~named).join(index, ["file_node_id", "parse_generation"], "left_semi").select("id"))


def permission_filter(spark, sf):
    """Chunks of public bases (here: even ids), or of bases that the user has a rule for (here: with a summary of high confidence)."""
    rules = table(spark, sf, "kb_section_summary", "kb_id", "confidence").where("confidence = 'high'").select("kb_id").distinct()
    c = _chunk(spark, sf, "id", "kb_id")
    return c.where("kb_id % 2 = 0").unionByName(c.where("kb_id % 2 <> 0").join(rules, "kb_id", "left_semi")).select("id")


def keyword_predicates(spark, sf):
    """Sections by keyword, type and the existence of a summary."""
    s = table(spark, sf, "kb_section", "id", "section_id", "section_title", "section_type").distinct()
    has = table(spark, sf, "kb_section_summary", "section_id").distinct()
    return s.where(F.col("section_title").contains("费率") & F.col("section_type").isNotNull()).join(has, "section_id", "left_semi").select("id")


def chunk_stats(spark, sf):
    """Chunks and available ones by base."""
    return _chunk(spark, sf, "kb_id", "enabled", "del_flag").groupBy("kb_id").agg(F.count("*").alias("total"), F.count_if(F.col("enabled") & ~F.col("del_flag")).alias("available"), F.count_if("del_flag").alias("deleted"))


def chunk_type_stats(spark, sf):
    """Number and page range by chunk type and type of section."""
    types = table(spark, sf, "kb_section", "section_id", "section_type").groupBy("section_id").agg(F.min("section_type").alias("section_type"))
    return _chunk(spark, sf, "chunk_type", "page_start", "page_end", "section_id").join(types, "section_id", "left").groupBy("chunk_type", "section_type").agg(F.count("*").alias("n"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"))


def audit_counts(spark, sf):
    """Audit states by file."""
    a = F.col("audit_status")
    return _chunk(spark, sf, "file_node_id", "audit_status").groupBy("file_node_id").agg(F.count_if(a == "approved").alias("approved"), F.count_if(a == "rejected").alias("rejected"), F.count_if(a == "pending").alias("pending"))


def audit_state_derived(spark, sf):
    """One state a file, from the counts of its chunks."""
    state = F.when(F.col("pending") > 0, "pending").when((F.col("approved") > 0) & (F.col("rejected") > 0), "partially_approved").when(F.col("approved") > 0, "approved").when(F.col("rejected") > 0, "rejected").otherwise("none")
    return audit_counts(spark, sf).select("file_node_id", state.alias("state"))


def max_revision(spark, sf):
    """Highest revision number of each chunk."""
    return table(spark, sf, "kb_chunk_revision", "chunk_id", "revision_no").groupBy("chunk_id").agg(F.max("revision_no").alias("revision_no"))


def latest_revision(spark, sf):
    """Newest revision of each chunk by number and id."""
    return latest(_revision(spark, sf, "id", "chunk_id", "revision_no", "revision_source"), ["chunk_id"], ["revision_no", "id"], "id", "revision_source")


def latest_task(spark, sf):
    """Last event of each user, by id."""
    return latest(table(spark, sf, "events", "event_id", "user_id", "event_type"), ["user_id"], ["event_id"], "event_id", "event_type")


def published_revision(spark, sf):
    """Chunks with their published revision, else the latest."""
    c = _chunk(spark, sf, "id", "published_revision_id", "latest_revision_id").select(F.col("id").alias("chunk_id"), F.coalesce("published_revision_id", "latest_revision_id").alias("id"))
    return c.join(_revision(spark, sf, "id", "title", "revision_no"), "id").select("chunk_id", F.col("id").alias("revision_id"), "title", "revision_no")


def revision_overlay(spark, sf):
    """Chunks with page and source of the latest revision laid over their own."""
    c = _chunk(spark, sf, "id", "latest_revision_id", "page_start").select(F.col("id").alias("chunk_id"), F.col("latest_revision_id").alias("id"), F.col("page_start").alias("base_page"))
    return c.join(_revision(spark, sf, "id", "page_start", "revision_source"), "id", "left").select("chunk_id", F.coalesce("page_start", "base_page").alias("page"), F.coalesce("revision_source", F.lit("base")).alias("origin"))


def chunk_section_summary(spark, sf):
    """Chunks with the summaries of their section: a join on four keys."""
    keys = ["kb_id", "file_node_id", "parse_generation", "section_id"]
    c = _chunk(spark, sf, "id", *keys)
    s = table(spark, sf, "kb_section_summary", "id", "summary_type", *keys).withColumnRenamed("id", "summary_id")
    return c.join(s, keys).select("id", "summary_id", "summary_type")


def evidence_chain(spark, sf):
    """Evidence with its summary, chunk and revision: a chain of left joins."""
    e = table(spark, sf, "kb_section_summary_evidence", "id", "summary_id", "chunk_id").distinct()
    s = table(spark, sf, "kb_section_summary", "id", "confidence").select(F.col("id").alias("summary_id"), "confidence")
    c = _chunk(spark, sf, "id", "latest_revision_id").select(F.col("id").alias("chunk_id"), "latest_revision_id")
    r = _revision(spark, sf, "id", "revision_no").select(F.col("id").alias("latest_revision_id"), "revision_no")
    return e.join(s, "summary_id", "left").join(c, "chunk_id", "left").join(r, "latest_revision_id", "left").select("id", "confidence", "latest_revision_id", "revision_no")


def base_listing(spark, sf):
    """Bases with counts of files, files with pending chunks, and anchors: correlated counts as pre-aggregates."""
    c = _chunk(spark, sf, "kb_id", "file_node_id", "audit_status")
    files = c.groupBy("kb_id").agg(F.count_distinct("file_node_id").alias("files"))
    pending = c.where("audit_status = 'pending'").groupBy("kb_id").agg(F.count_distinct("file_node_id").alias("pending_files"))
    anchors = table(spark, sf, "kb_anchor_registry", "id", "kb_id").distinct().groupBy("kb_id").agg(F.count("*").alias("anchors"))
    return files.join(pending, "kb_id", "left").join(anchors, "kb_id", "left").fillna(0, ["pending_files", "anchors"])


def role_of_base(spark, sf):
    """Owner, member or neither: existence tests as one aggregate of flags (here: by confidence labels)."""
    flags = table(spark, sf, "kb_section_summary", "kb_id", "confidence").groupBy("kb_id").agg(F.coalesce(F.bool_or(F.col("confidence") == "high"), F.lit(False)).alias("o"), F.coalesce(F.bool_or(F.col("confidence") == "low"), F.lit(False)).alias("m"))
    bases = _chunk(spark, sf, "kb_id").distinct()
    return bases.join(flags, "kb_id", "left").select("kb_id", F.when(F.col("o"), "owner").when(F.col("m"), "member").alias("role"))


def case_ordering(spark, sf):
    """Section types in a given order, then by id: the first 300."""
    rank = F.when(F.col("section_type") == "scope", 1).when(F.col("section_type") == "claim", 2).when(F.col("section_type") == "appendix", 3).otherwise(5)
    s = table(spark, sf, "kb_section", "id", "section_type").distinct().select("id", rank.alias("rank"))
    return s.orderBy("rank", "id").limit(300)


def page_of_chunks(spark, sf):
    """Third page of 50 chunks of the largest file, by sequence and id."""
    return _chunk(spark, sf, "id", "file_node_id", "seq_no").where("file_node_id = 880001").orderBy("seq_no", "id").offset(100).limit(50).select("id", "seq_no")


def recent_documents(spark, sf):
    """The 12 newest documents."""
    return table(spark, sf, "documents", "doc_id", "create_time").orderBy(F.desc_nulls_last("create_time"), "doc_id").limit(12).select("doc_id")


def section_order(spark, sf):
    """Place of each section in its file, by start, level and id."""
    order = Window.partitionBy("file_node_id").orderBy(F.asc_nulls_first("seq_start"), F.asc_nulls_first("section_level"), "id")
    return table(spark, sf, "kb_section", "id", "file_node_id", "seq_start", "section_level").distinct().withColumn("place", F.row_number().over(order)).select("id", "place")


def best_evidence_per_file(spark, sf):
    """Longest quote of each file, ties by id: the best hit with its snippet, without a sort."""
    e = table(spark, sf, "kb_section_summary_evidence", "id", "file_node_id", "evidence_quote").where("evidence_quote IS NOT NULL").withColumn("n", F.length("evidence_quote"))
    best = e.groupBy("file_node_id").agg(F.max(F.struct("n", (-F.col("id")).alias("i"), "evidence_quote")).alias("b"))
    return best.select("file_node_id", F.col("b.n").alias("score"), F.substring("b.evidence_quote", 1, 60).alias("snippet"))


def ordered_distinct(spark, sf):
    """Aliases of each anchor without repetition, first places kept."""
    a = table(spark, sf, "kb_anchor_registry", "id", "aliases").distinct().where("size(aliases) > 0")
    return a.select("id", F.array_join(F.array_distinct("aliases"), "|").alias("aliases"))


def upsert(spark, sf):
    """Deliveries of anchors by identity: the newest by time and id replaces older ones."""
    a = table(spark, sf, "kb_anchor_registry", "id", "anchor_id", "status", "create_time").distinct()
    return latest(a.withColumn("t", F.coalesce("create_time", F.lit("1970-01-01").cast(a.schema["create_time"].dataType))), ["anchor_id"], ["t", "id"], "id", "status")


def delete_by_file(spark, sf):
    """Index rows without those of deleted chunks."""
    gone = _chunk(spark, sf, "id", "del_flag").where("del_flag").select(F.col("id").alias("chunk_id"))
    return table(spark, sf, "knowledge_chunks_v1", "chunk_id").distinct().join(gone, "chunk_id", "left_anti")


def pointer_switch(spark, sf):
    """Pointers after a switch: the greatest generation is current, the one before is kept."""
    g = table(spark, sf, "kb_chunk", "file_node_id", "index_generation").distinct().where("index_generation IS NOT NULL")
    order = Window.partitionBy("file_node_id").orderBy(F.desc("index_generation"))
    ranked = g.withColumn("n", F.row_number().over(order)).where("n <= 2")
    return ranked.groupBy("file_node_id").agg(F.max(F.when(F.col("n") == 1, F.col("index_generation"))).alias("current"), F.max(F.when(F.col("n") == 2, F.col("index_generation"))).alias("previous"))


def parse_cache_lookup(spark, sf):
    """Documents whose content another one of the same language and source has had parsed before: an exact key of three parts (``cache_lookup`` has the one of five)."""
    d = table(spark, sf, "documents", "doc_id", "text", "lang", "source").where("text IS NOT NULL")
    key = d.select("doc_id", F.sha1("text").alias("hash"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    first = key.groupBy("hash", "lang", "source").agg(F.min("doc_id").alias("cached"))
    return key.join(first, ["hash", "lang", "source"]).where("doc_id <> cached").select("doc_id", "cached")


def retry_merge(spark, sf):
    """Sections of a first pass, and of a second one only those that are new."""
    s = table(spark, sf, "kb_section", "section_id", "section_type", "section_level").distinct()
    one, two = s.where("section_type = 'scope'").select("section_id").distinct(), s.where("section_level >= 3").select("section_id").distinct()
    return one.select("section_id", F.lit(1).alias("pass")).unionByName(two.join(one, "section_id", "left_anti").select("section_id", F.lit(2).alias("pass")))


def scope_intersection(spark, sf):
    """Files that are both in the chunk table and in the index, and those only in one."""
    a, b = _chunk(spark, sf, "file_node_id").distinct(), table(spark, sf, "kb_section_summary", "file_node_id").distinct()
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).withColumn("side", F.lit("left"))).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def disjointness(spark, sf):
    """Files whose approved and rejected sections overlap."""
    c = _chunk(spark, sf, "file_node_id", "section_id", "audit_status").where("audit_status IN ('approved', 'rejected') AND section_id IS NOT NULL")
    both = c.groupBy("file_node_id", "section_id").agg(F.count_distinct("audit_status").alias("n")).where("n = 2")
    return both.groupBy("file_node_id").agg(F.count("*").alias("shared"))


def content_hash_dedupe(spark, sf):
    """Section chunks whose content hash no small chunk of the file has."""
    c = _chunk(spark, sf, "id", "file_node_id", "chunk_type", "content_hash")
    small = c.where("chunk_type = 'small_chunk'").select("file_node_id", "content_hash").distinct()
    return c.where("chunk_type = 'section_chunk'").join(small, ["file_node_id", "content_hash"], "left_anti").select("id")


def field_history(spark, sf):
    """Changes of a chunk's title from revision to revision: old and new value."""
    r = _revision(spark, sf, "id", "chunk_id", "revision_no", "title")
    w = Window.partitionBy("chunk_id").orderBy("revision_no", "id")
    h = r.withColumn("old", F.lag("title").over(w)).withColumn("n", F.row_number().over(w))
    return h.where("n > 1 AND NOT (old <=> title)").select("id", "old", F.col("title").alias("new"))


def index_status(spark, sf):
    """Files with the state of their index."""
    files = _chunk(spark, sf, "file_node_id").distinct()
    k = table(spark, sf, "knowledge_chunks_v1", "chunk_id", "file_node_id", "deleted").distinct().groupBy("file_node_id").agg(F.count("*").alias("rows"), F.count_if("deleted").alias("gone"))
    return files.join(k, "file_node_id", "left").select("file_node_id", F.when(F.col("rows").isNull(), "absent").when(F.col("gone") == F.col("rows"), "deleted").otherwise("active").alias("state"))


def profile_vote(spark, sf):
    """Language of each base's documents if it has a strict majority."""
    n = table(spark, sf, "documents", "kb_id", "lang").groupBy("kb_id", "lang").agg(F.count("*").alias("n"))
    best = n.groupBy("kb_id").agg(F.max(F.struct("n", "lang")).alias("b"), F.sum("n").alias("all"))
    return best.select("kb_id", F.when(F.col("b.n") * 2 > F.col("all"), F.coalesce("b.lang", F.lit("none"))).otherwise("default").alias("profile"))


CATALOGUE = {
    "active_chunks": (active_chunks, "SELECT id, kb_id, file_node_id FROM kb_chunk WHERE enabled AND audit_status = 'approved' AND NOT del_flag"),
    "structural_filter": (structural_filter, "SELECT DISTINCT id, anchor_type FROM kb_anchor_registry WHERE kb_id = 7 AND status = 'active'"),
    "chunk_type_filter": (chunk_type_filter, "SELECT id, chunk_type FROM kb_chunk WHERE chunk_type IN ('small_chunk', 'section_chunk')"),
    "qa_scope": (qa_scope, "SELECT id FROM kb_chunk WHERE (file_node_id IN (880001) OR file_node_id IS NULL) AND audit_status = 'approved' AND NOT coalesce(del_flag, false)"),
    "active_scope": (active_scope, "SELECT id FROM kb_chunk c WHERE CASE WHEN coalesce(kb_id = 7, false) THEN file_node_id = 880001 ELSE EXISTS (SELECT 1 FROM knowledge_chunks_v1 k WHERE NOT k.deleted AND k.file_node_id = c.file_node_id AND k.parse_generation = c.parse_generation) END"),
    "permission_filter": (permission_filter, "SELECT id FROM kb_chunk WHERE kb_id % 2 = 0 OR kb_id IN (SELECT kb_id FROM kb_section_summary WHERE confidence = 'high')"),
    "keyword_predicates": (keyword_predicates, "SELECT DISTINCT id FROM kb_section s WHERE section_title LIKE '%费率%' AND section_type IS NOT NULL AND EXISTS (SELECT 1 FROM kb_section_summary m WHERE m.section_id = s.section_id)"),
    "chunk_stats": (chunk_stats, "SELECT kb_id, count(*) AS total, count_if(enabled AND NOT del_flag) AS available, count_if(del_flag) AS deleted FROM kb_chunk GROUP BY kb_id"),
    "chunk_type_stats": (chunk_type_stats, "SELECT chunk_type, section_type, count(*) AS n, min(page_start) AS first_page, max(page_end) AS last_page FROM kb_chunk LEFT JOIN (SELECT section_id, min(section_type) AS section_type FROM kb_section GROUP BY section_id) USING (section_id) GROUP BY ALL"),
    "audit_counts": (audit_counts, "SELECT file_node_id, count_if(audit_status = 'approved') AS approved, count_if(audit_status = 'rejected') AS rejected, count_if(audit_status = 'pending') AS pending FROM kb_chunk GROUP BY file_node_id"),
    "audit_state_derived": (
        audit_state_derived,
        "SELECT file_node_id, CASE WHEN p > 0 THEN 'pending' WHEN a > 0 AND r > 0 THEN 'partially_approved' WHEN a > 0 THEN 'approved' WHEN r > 0 THEN 'rejected' ELSE 'none' END AS state FROM (SELECT file_node_id, count_if(audit_status = 'approved') AS a, count_if(audit_status = 'rejected') AS r, count_if(audit_status = 'pending') AS p FROM kb_chunk GROUP BY file_node_id)",
    ),
    "max_revision": (max_revision, "SELECT chunk_id, max(revision_no) AS revision_no FROM kb_chunk_revision GROUP BY chunk_id"),
    "latest_revision": (latest_revision, f"WITH {_REV} SELECT chunk_id, id, revision_source FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY revision_no DESC, id DESC) AS n FROM rev) WHERE n = 1"),
    "latest_task": (latest_task, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1"),
    "published_revision": (published_revision, f"WITH {_REV} SELECT c.id AS chunk_id, r.id AS revision_id, title, revision_no FROM kb_chunk c JOIN rev r ON r.id = coalesce(published_revision_id, latest_revision_id)"),
    "revision_overlay": (revision_overlay, "SELECT c.id AS chunk_id, coalesce(r.page_start, c.page_start) AS page, coalesce(r.revision_source, 'base') AS origin FROM kb_chunk c LEFT JOIN (SELECT DISTINCT id, page_start, revision_source FROM kb_chunk_revision) r ON r.id = c.latest_revision_id"),
    "chunk_section_summary": (chunk_section_summary, "SELECT c.id, s.id AS summary_id, summary_type FROM kb_chunk c JOIN kb_section_summary s USING (kb_id, file_node_id, parse_generation, section_id)"),
    "evidence_chain": (
        evidence_chain,
        "SELECT e.id, s.confidence, c.latest_revision_id, r.revision_no FROM (SELECT DISTINCT id, summary_id, chunk_id FROM kb_section_summary_evidence) e LEFT JOIN kb_section_summary s ON s.id = e.summary_id LEFT JOIN kb_chunk c ON c.id = e.chunk_id LEFT JOIN (SELECT DISTINCT id, revision_no FROM kb_chunk_revision) r ON r.id = c.latest_revision_id",
    ),
    "base_listing": (
        base_listing,
        "SELECT kb_id, count(DISTINCT file_node_id) AS files, (SELECT count(DISTINCT file_node_id) FROM kb_chunk p WHERE p.kb_id = c.kb_id AND audit_status = 'pending') AS pending_files, (SELECT count(DISTINCT id) FROM kb_anchor_registry a WHERE a.kb_id = c.kb_id) AS anchors FROM kb_chunk c GROUP BY kb_id",
    ),
    "role_of_base": (
        role_of_base,
        "SELECT kb_id, CASE WHEN EXISTS (SELECT 1 FROM kb_section_summary s WHERE s.kb_id = b.kb_id AND confidence = 'high') THEN 'owner' WHEN EXISTS (SELECT 1 FROM kb_section_summary s WHERE s.kb_id = b.kb_id AND confidence = 'low') THEN 'member' END AS role FROM (SELECT DISTINCT kb_id FROM kb_chunk) b",
    ),
    "case_ordering": (case_ordering, "SELECT id, CASE section_type WHEN 'scope' THEN 1 WHEN 'claim' THEN 2 WHEN 'appendix' THEN 3 ELSE 5 END AS rank FROM (SELECT DISTINCT id, section_type FROM kb_section) ORDER BY rank, id LIMIT 300"),
    "page_of_chunks": (page_of_chunks, "SELECT id, seq_no FROM kb_chunk WHERE file_node_id = 880001 ORDER BY seq_no, id LIMIT 50 OFFSET 100"),
    "recent_documents": (recent_documents, "SELECT doc_id FROM documents ORDER BY create_time DESC NULLS LAST, doc_id LIMIT 12"),
    "section_order": (section_order, "SELECT id, row_number() OVER (PARTITION BY file_node_id ORDER BY seq_start NULLS FIRST, section_level NULLS FIRST, id) AS place FROM (SELECT DISTINCT id, file_node_id, seq_start, section_level FROM kb_section)"),
    "best_evidence_per_file": (best_evidence_per_file, "SELECT file_node_id, length(evidence_quote) AS score, left(evidence_quote, 60) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY file_node_id ORDER BY length(evidence_quote) DESC, id) AS n FROM kb_section_summary_evidence WHERE evidence_quote IS NOT NULL) WHERE n = 1"),
    "ordered_distinct": (
        ordered_distinct,
        "WITH x AS (SELECT DISTINCT id, aliases FROM kb_anchor_registry WHERE len(aliases) > 0), y AS (SELECT id, a, min(i) AS i FROM (SELECT id, unnest(aliases) AS a, generate_subscripts(aliases, 1) AS i FROM x) GROUP BY id, a) SELECT id, string_agg(a, '|' ORDER BY i) AS aliases FROM y GROUP BY id",
    ),
    "upsert": (upsert, "SELECT anchor_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY create_time DESC NULLS LAST, id DESC) AS n FROM (SELECT DISTINCT id, anchor_id, status, create_time FROM kb_anchor_registry)) WHERE n = 1"),
    "delete_by_file": (delete_by_file, "SELECT DISTINCT chunk_id FROM knowledge_chunks_v1 WHERE chunk_id NOT IN (SELECT id FROM kb_chunk WHERE del_flag)"),
    "pointer_switch": (
        pointer_switch,
        'SELECT file_node_id, max(CASE WHEN n = 1 THEN index_generation END) AS "current", max(CASE WHEN n = 2 THEN index_generation END) AS previous FROM (SELECT *, row_number() OVER (PARTITION BY file_node_id ORDER BY index_generation DESC) AS n FROM (SELECT DISTINCT file_node_id, index_generation FROM kb_chunk WHERE index_generation IS NOT NULL)) GROUP BY file_node_id',
    ),
    "parse_cache_lookup": (
        parse_cache_lookup,
        "WITH k AS (SELECT doc_id, text, coalesce(lang, '') AS l, coalesce(source, '') AS s FROM documents WHERE text IS NOT NULL) SELECT k.doc_id, f.cached FROM k JOIN (SELECT text, l, s, min(doc_id) AS cached FROM k GROUP BY ALL) f USING (text, l, s) WHERE k.doc_id <> f.cached",
    ),
    "retry_merge": (
        retry_merge,
        "WITH a AS (SELECT DISTINCT section_id FROM kb_section WHERE section_type = 'scope') SELECT section_id, 1 AS pass FROM a UNION ALL SELECT DISTINCT section_id, 2 FROM kb_section WHERE section_level >= 3 AND section_id NOT IN (SELECT section_id FROM a)",
    ),
    "scope_intersection": (
        scope_intersection,
        "WITH a AS (SELECT DISTINCT file_node_id FROM kb_chunk), b AS (SELECT DISTINCT file_node_id FROM kb_section_summary) SELECT file_node_id, CASE WHEN a.f AND b.f THEN 'both' WHEN a.f THEN 'left' ELSE 'right' END AS side FROM (SELECT *, true AS f FROM a) a FULL JOIN (SELECT *, true AS f FROM b) b USING (file_node_id)",
    ),
    "disjointness": (disjointness, "SELECT file_node_id, count(*) AS shared FROM (SELECT file_node_id, section_id FROM kb_chunk WHERE audit_status IN ('approved', 'rejected') AND section_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT audit_status) = 2) GROUP BY file_node_id"),
    "content_hash_dedupe": (content_hash_dedupe, "SELECT id FROM kb_chunk c WHERE chunk_type = 'section_chunk' AND NOT EXISTS (SELECT 1 FROM kb_chunk s WHERE s.chunk_type = 'small_chunk' AND s.file_node_id = c.file_node_id AND s.content_hash = c.content_hash)"),
    "field_history": (
        field_history,
        "WITH r AS (SELECT DISTINCT id, chunk_id, revision_no, title FROM kb_chunk_revision), h AS (SELECT *, lag(title) OVER w AS old, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY chunk_id ORDER BY revision_no, id)) SELECT id, old, title AS new FROM h WHERE n > 1 AND old IS DISTINCT FROM title",
    ),
    "index_status": (
        index_status,
        "SELECT f.file_node_id, CASE WHEN r IS NULL THEN 'absent' WHEN g = r THEN 'deleted' ELSE 'active' END AS state FROM (SELECT DISTINCT file_node_id FROM kb_chunk) f LEFT JOIN (SELECT file_node_id, count(*) AS r, count_if(deleted) AS g FROM (SELECT DISTINCT chunk_id, file_node_id, deleted FROM knowledge_chunks_v1) GROUP BY file_node_id) k USING (file_node_id)",
    ),
    "profile_vote": (
        profile_vote,
        "WITH n AS (SELECT kb_id, lang, count(*) AS n FROM documents GROUP BY ALL), b AS (SELECT kb_id, max(n) AS m, sum(n) AS a FROM n GROUP BY kb_id) SELECT b.kb_id, CASE WHEN 2 * m > a THEN (SELECT coalesce(max(lang), 'none') FROM n WHERE n.kb_id = b.kb_id AND n.n = b.m) ELSE 'default' END AS profile FROM b",
    ),
}
