"""Queries: lines, headings, sections, chunk relations and ranges of characters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veinstone.operators import chunking as C
from veinstone.sources.tables import table


def _docs(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text")


def _sections(spark, sf, *columns):
    return table(spark, sf, "kb_section", *columns).distinct()


def split_pieces(spark, sf):
    """Greedy pieces of documents of at most 500 characters with an overlap of 50."""
    rows = lambda t: [(i, a, b) for i, (a, b) in enumerate(C.split_content(t, 500, 50))]
    return C.per_text(_docs(spark, sf), "doc_id", "text", "piece int, begin int, end int", rows)


def line_offsets(spark, sf):
    """Lines of documents with offsets."""
    return C.lines(_docs(spark, sf), "doc_id", "text").select("doc_id", "line_no", "offset", F.length("line").alias("size"))


def headings(spark, sf):
    """Headings of documents with level."""
    return C.headings(_docs(spark, sf), "doc_id", "text").select("doc_id", "line_no", "level")


def heading_sessions(spark, sf):
    """Sections of documents: lines and characters under each heading."""
    s = C.heading_sessions(_docs(spark, sf), "doc_id", "text")
    return s.groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"))


def section_bounds(spark, sf):
    """End and parent of each heading."""
    return C.section_bounds(C.headings(_docs(spark, sf), "doc_id", "text"), "doc_id")


def paragraph_blocks(spark, sf):
    """Blocks of documents parted by empty lines, labelled heading, table or text."""
    b = _docs(spark, sf).where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("block", "t")).where("length(t) > 0")
    return b.select("doc_id", "block", F.when(F.col("t").rlike("^#{1,6} "), "heading").when(F.col("t").contains("\t"), "table").otherwise("text").alias("label"))


def multigranularity(spark, sf):
    """Chunks of three grains: small ones packed in order into section chunks of up to 4,200 characters, those into parent chunks of up to 6,500 from two on; a chunk longer than that stands alone. Of each section how many of both and the longest."""
    c = table(spark, sf, "kb_chunk", "id", "section_id", "seq_no", "latest_revision_id").where("section_id IS NOT NULL")
    r = table(spark, sf, "kb_chunk_revision", "id", "content").select(F.col("id").alias("latest_revision_id"), "content").dropDuplicates(["latest_revision_id"])
    j = c.join(r, "latest_revision_id").groupBy("section_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("seq_no", "id", F.length("content").alias("l"))))["l"].alias("sizes"))

    def packed(sizes, limit):
        begin = F.array().cast("array<int>")
        full = lambda s, x: (F.size(s) == 0) | (F.try_element_at(s, F.lit(-1)) + 1 + x > limit)
        return F.aggregate(sizes, begin, lambda s, x: F.when(full(s, x), F.concat(s, F.array(x))).otherwise(F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.element_at(s, -1) + 1 + x))))

    s = j.withColumn("sections", packed(F.col("sizes"), 4200))
    p = s.withColumn("parents", F.when(F.size("sections") >= 2, packed(F.col("sections"), 6500)).otherwise(F.array().cast("array<int>")))
    return p.select("section_id", "n", F.size("sections").alias("section_chunks"), F.size("parents").alias("parent_chunks"), F.array_max("sections").alias("longest_section"), F.array_max("parents").alias("longest_parent"))


def adjacent_relations(spark, sf):
    """Each chunk and the next one of its file and generation."""
    order = Window.partitionBy("file_node_id", "parse_generation").orderBy("seq_no", "id")
    c = table(spark, sf, "kb_chunk", "id", "file_node_id", "parse_generation", "seq_no")
    return c.withColumn("next", F.lead("id").over(order)).where("next IS NOT NULL").select("id", "next", F.lit(1.0).alias("weight"))


def section_context(spark, sf):
    """Chunks of a section and the section's own chunk."""
    c = table(spark, sf, "kb_chunk", "id", "section_id", "chunk_type").where("section_id IS NOT NULL")
    small, own = c.where("chunk_type = 'small_chunk'").select("section_id", "id"), c.where("chunk_type = 'section_chunk'").select("section_id", F.col("id").alias("context"))
    return small.join(own, "section_id").select("id", "context", F.lit(0.92).alias("weight"))


def related_chunks(spark, sf):
    """For every chunk its neighbours in both directions, the five heaviest."""
    a = adjacent_relations(spark, sf)
    both = a.unionByName(a.select(F.col("next").alias("id"), F.col("id").alias("next"), "weight")).unionByName(section_context(spark, sf).select("id", F.col("context").alias("next"), "weight")).distinct()
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "next")
    return both.withColumn("place", F.row_number().over(order)).where("place <= 5")


def span_section_overlap(spark, sf):
    """Evidence spans that overlap in a chunk: pairs of overlapping character ranges, each once."""
    e = table(spark, sf, "kb_section_summary_evidence", "id", "chunk_id", "char_start", "char_end").distinct().where("chunk_id IS NOT NULL AND char_start < char_end")
    a = e.select("chunk_id", F.col("id").alias("a"), F.col("char_start").alias("a0"), F.col("char_end").alias("a1"))
    b = e.select("chunk_id", F.col("id").alias("b"), F.col("char_start").alias("b0"), F.col("char_end").alias("b1"))
    return C.overlap_join(a, b, ["chunk_id"], ("a0", "a1"), ("b0", "b1"), 500).where("a < b").groupBy("chunk_id").agg(F.count("*").alias("overlaps"))


def char_coverage(spark, sf):
    """Characters of each chunk that evidence covers, and the largest gap."""
    e = table(spark, sf, "kb_section_summary_evidence", "id", "chunk_id", "char_start", "char_end").distinct().where("chunk_id IS NOT NULL")
    return C.coverage(e, ["chunk_id"], "char_start", "char_end")


def section_rollup(spark, sf):
    """Sequence and page range and number of chunks of each section."""
    c = table(spark, sf, "kb_chunk", "id", "section_id", "seq_no", "page_start", "page_end").where("section_id IS NOT NULL")
    return c.groupBy("section_id").agg(F.count("*").alias("chunks"), F.min("seq_no").alias("first"), F.max("seq_no").alias("last"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))


def profile_coverage(spark, sf):
    """Required section types that a file lacks."""
    required = F.broadcast(spark.createDataFrame([("scope",), ("claim",), ("appendix",)], "section_type string"))
    s = _sections(spark, sf, "file_node_id", "section_type")
    return s.select("file_node_id").distinct().crossJoin(required).join(s, ["file_node_id", "section_type"], "left_anti")


def summary_quality(spark, sf):
    """Share of summaries with evidence, and concentration on one chunk, by file."""
    s = table(spark, sf, "kb_section_summary", "id", "file_node_id")
    e = table(spark, sf, "kb_section_summary_evidence", "id", "summary_id", "chunk_id").distinct().groupBy("summary_id").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("c"))
    j = s.join(e.withColumnRenamed("summary_id", "id"), "id", "left")
    return j.groupBy("file_node_id").agg(F.round(F.avg(F.col("n").isNotNull().cast("double")), 6).alias("evidence_coverage"), F.round(F.avg(F.col("c") / F.col("n")), 6).alias("spread"))


def covered_chunks(spark, sf):
    """Chunks that sections say they cover and that exist."""
    s = _sections(spark, sf, "id", "covered_chunk_ids").select("id", F.explode(F.array_distinct("covered_chunk_ids")).alias("chunk_id"))
    c = table(spark, sf, "kb_chunk", "id").select(F.col("id").alias("chunk_id"))
    return s.join(c, "chunk_id").groupBy("id").agg(F.count("*").alias("found"))


def neighbour_window(spark, sf):
    """Ids of up to three text chunks before and after each chunk of its file."""
    order = Window.partitionBy("file_node_id").orderBy("seq_no", "id")
    c = table(spark, sf, "kb_chunk", "id", "file_node_id", "seq_no", "chunk_type").where("chunk_type <> 'visual_chunk'")
    return c.select("id", F.array_join(F.collect_list("id").over(order.rowsBetween(-3, -1)), ",").alias("before"), F.array_join(F.collect_list("id").over(order.rowsBetween(1, 3)), ",").alias("after"))


def charmap_rebuild(spark, sf):
    """Gaps between the evidence spans of a chunk in order, as they would be filled when the text is put together."""
    e = table(spark, sf, "kb_section_summary_evidence", "id", "chunk_id", "char_start", "char_end").distinct().where("chunk_id IS NOT NULL AND char_start IS NOT NULL AND char_end > char_start")
    order = Window.partitionBy("chunk_id").orderBy("char_start", "char_end", "id")
    g = e.withColumn("gap", F.greatest(F.lit(0), F.col("char_start") - F.coalesce(F.lag("char_end").over(order), F.lit(0))))
    return g.groupBy("chunk_id").agg(F.sum("gap").alias("filled"), F.count("*").alias("spans"))


def sequence_checks(spark, sf):
    """Breaks of the chunk numbering of files: duplicates and holes."""
    order = Window.partitionBy("file_node_id", "parse_generation").orderBy("seq_no", "id")
    c = table(spark, sf, "kb_chunk", "id", "file_node_id", "parse_generation", "seq_no").withColumn("step", F.col("seq_no") - F.lag("seq_no").over(order))
    return c.where("step IS NOT NULL AND step <> 1").select("id", F.when(F.col("step") == 0, "duplicate").otherwise("hole").alias("problem"))


def section_type_rules(spark, sf):
    """Section types by the title: ordered rules, the first that matches."""
    t = F.col("section_title")
    kind = F.when(t.rlike("费率|[Ff]ees?|Entgelt|Satz"), "fee").when(t.rlike("资料|[Cc]hecklist|Unterlagen"), "documents").when(t.rlike("还款|[Rr]epayment|Rückzahlung"), "repayment").when(t.rlike("档案|[Rr]ecord|Akten"), "records").otherwise("other")
    return _sections(spark, sf, "id", "section_title").select("id", kind.alias("kind"))


def protected_blocks(spark, sf):
    """Runs of table lines in documents: first and last line of each."""
    l = C.lines(_docs(spark, sf), "doc_id", "text").withColumn("p", F.col("line").contains("\t") | F.col("line").startswith("|"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    new = (F.col("p") & ~F.coalesce(F.lag("p").over(order), F.lit(False))).cast("int")
    run = l.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where("p").groupBy("doc_id", "run").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))


def table_slices(spark, sf):
    """Table lines in slices of 25 rows."""
    l = C.lines(_docs(spark, sf), "doc_id", "text").where(F.contains(F.col("line"), F.lit("\t")))
    n = l.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    return n.groupBy("doc_id", F.floor((F.col("n") - 1) / 25).cast("int").alias("slice")).agg(F.count("*").alias("rows"))


_L = "l AS (SELECT doc_id, (unnest(range(len(x))))::INT AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))"
_H = rf"{_L}, h AS (SELECT doc_id, line_no, line, CASE WHEN regexp_matches(line, '^#+ ') THEN length(regexp_extract(line, '^(#+) ', 1)) WHEN regexp_matches(line, '[0-9]') THEN length(regexp_replace(regexp_extract(line, '([0-9]{{1,2}}(\.[0-9]{{1,2}})*)', 1), '[0-9]', '', 'g')) + 1 ELSE 1 END::INT AS level FROM l WHERE regexp_matches(line, '{C.HEADING}'))"
_ADJ = "a AS (SELECT id, lead(id) OVER (PARTITION BY file_node_id, parse_generation ORDER BY seq_no, id) AS next FROM kb_chunk), adj AS (SELECT id, next, 1.0::DOUBLE AS weight FROM a WHERE next IS NOT NULL)"
_CTX = "ctx AS (SELECT s.id, o.id AS context, 0.92::DOUBLE AS weight FROM kb_chunk s JOIN kb_chunk o USING (section_id) WHERE s.chunk_type = 'small_chunk' AND o.chunk_type = 'section_chunk')"
_E = "e AS (SELECT DISTINCT id, chunk_id, char_start, char_end FROM kb_section_summary_evidence WHERE chunk_id IS NOT NULL)"

CATALOGUE = {
    "split_pieces": (split_pieces, None),
    "line_offsets": (line_offsets, f"WITH {_L} SELECT doc_id, line_no, (coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS \"offset\", length(line) AS size FROM l"),
    "headings": (headings, f"WITH {_H} SELECT doc_id, line_no, level FROM h"),
    "heading_sessions": (heading_sessions, f"WITH {_L}, s AS (SELECT doc_id, line, sum(regexp_matches(line, '{C.HEADING}')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM l) SELECT doc_id, section, count(*) AS lines, sum(length(line)) AS characters FROM s GROUP BY ALL"),
    "section_bounds": (
        section_bounds,
        f"WITH {_H} SELECT doc_id, line_no, level, (SELECT min(b.line_no) FROM h b WHERE b.doc_id = a.doc_id AND b.line_no > a.line_no AND b.level <= a.level) AS end_line, (SELECT max(b.line_no) FROM h b WHERE b.doc_id = a.doc_id AND b.line_no < a.line_no AND b.level < a.level) AS parent_line FROM h a",
    ),
    "paragraph_blocks": (
        paragraph_blocks,
        "WITH b AS (SELECT doc_id, unnest(range(len(x)))::INT AS block, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS x FROM documents WHERE text IS NOT NULL)) SELECT doc_id, block, CASE WHEN regexp_matches(t, '^#{1,6} ') THEN 'heading' WHEN contains(t, chr(9)) THEN 'table' ELSE 'text' END AS label FROM b WHERE length(t) > 0",
    ),
    "multigranularity": (multigranularity, None),
    "adjacent_relations": (adjacent_relations, f"WITH {_ADJ} SELECT * FROM adj"),
    "section_context": (section_context, f"WITH {_CTX} SELECT * FROM ctx"),
    "related_chunks": (related_chunks, f"WITH {_ADJ}, {_CTX}, b AS (SELECT id, next, weight FROM adj UNION SELECT next, id, weight FROM adj UNION SELECT id, context, weight FROM ctx) SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, next) AS place FROM b QUALIFY place <= 5"),
    "span_section_overlap": (span_section_overlap, f"WITH {_E} SELECT a.chunk_id, count(*) AS overlaps FROM e a JOIN e b ON a.chunk_id = b.chunk_id AND a.id < b.id AND a.char_start < b.char_end AND b.char_start < a.char_end WHERE a.char_start < a.char_end AND b.char_start < b.char_end GROUP BY a.chunk_id"),
    "char_coverage": (
        char_coverage,
        f"WITH {_E}, r AS (SELECT *, max(char_end) OVER (PARTITION BY chunk_id ORDER BY char_start, char_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM e WHERE char_end > char_start) SELECT chunk_id, sum(greatest(0, char_end - greatest(char_start, coalesce(b, char_start)))) AS covered, max(greatest(0, char_start - coalesce(b, char_start))) AS largest_gap FROM r GROUP BY chunk_id",
    ),
    "section_rollup": (section_rollup, 'SELECT section_id, count(*) AS chunks, min(seq_no) AS "first", max(seq_no) AS "last", min(page_start) AS page_start, max(page_end) AS page_end FROM kb_chunk WHERE section_id IS NOT NULL GROUP BY section_id'),
    "profile_coverage": (profile_coverage, "SELECT f.file_node_id, t.section_type FROM (SELECT DISTINCT file_node_id FROM kb_section) f, (VALUES ('scope'), ('claim'), ('appendix')) t(section_type) WHERE NOT EXISTS (SELECT 1 FROM kb_section s WHERE s.file_node_id = f.file_node_id AND s.section_type = t.section_type)"),
    "summary_quality": (
        summary_quality,
        "SELECT file_node_id, round(avg((n IS NOT NULL)::INT), 6) AS evidence_coverage, round(avg(c / n), 6) AS spread FROM kb_section_summary s LEFT JOIN (SELECT summary_id, count(*) AS n, count(DISTINCT chunk_id) AS c FROM (SELECT DISTINCT id, summary_id, chunk_id FROM kb_section_summary_evidence) GROUP BY summary_id) e ON e.summary_id = s.id GROUP BY file_node_id",
    ),
    "covered_chunks": (covered_chunks, "WITH s AS (SELECT DISTINCT id, unnest(list_distinct(covered_chunk_ids)) AS chunk_id FROM kb_section) SELECT s.id, count(*) AS found FROM s JOIN kb_chunk c ON c.id = s.chunk_id GROUP BY s.id"),
    "neighbour_window": (
        neighbour_window,
        "SELECT id, coalesce(array_to_string(list(id) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ','), '') AS before, coalesce(array_to_string(list(id) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), ','), '') AS after FROM kb_chunk WHERE chunk_type <> 'visual_chunk' WINDOW w AS (PARTITION BY file_node_id ORDER BY seq_no, id)",
    ),
    "charmap_rebuild": (
        charmap_rebuild,
        f"WITH {_E}, g AS (SELECT chunk_id, greatest(0, char_start - coalesce(lag(char_end) OVER (PARTITION BY chunk_id ORDER BY char_start, char_end, id), 0)) AS gap FROM e WHERE char_start IS NOT NULL AND char_end > char_start) SELECT chunk_id, sum(gap) AS filled, count(*) AS spans FROM g GROUP BY chunk_id",
    ),
    "sequence_checks": (sequence_checks, "WITH s AS (SELECT id, seq_no - lag(seq_no) OVER (PARTITION BY file_node_id, parse_generation ORDER BY seq_no, id) AS step FROM kb_chunk) SELECT id, CASE step WHEN 0 THEN 'duplicate' ELSE 'hole' END AS problem FROM s WHERE step IS NOT NULL AND step <> 1"),
    "section_type_rules": (
        section_type_rules,
        "SELECT DISTINCT id, CASE WHEN regexp_matches(section_title, '费率|[Ff]ees?|Entgelt|Satz') THEN 'fee' WHEN regexp_matches(section_title, '资料|[Cc]hecklist|Unterlagen') THEN 'documents' WHEN regexp_matches(section_title, '还款|[Rr]epayment|Rückzahlung') THEN 'repayment' WHEN regexp_matches(section_title, '档案|[Rr]ecord|Akten') THEN 'records' ELSE 'other' END AS kind FROM kb_section",
    ),
    "protected_blocks": (
        protected_blocks,
        f"WITH {_L}, p AS (SELECT *, contains(line, chr(9)) OR starts_with(line, '|') AS p FROM l), n AS (SELECT *, (p AND NOT coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY line_no), false))::INT AS new FROM p), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM n) SELECT doc_id, run, min(line_no) AS \"first\", max(line_no) AS \"last\" FROM r WHERE p GROUP BY doc_id, run",
    ),
    "table_slices": (table_slices, f"WITH {_L}, n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM l WHERE contains(line, chr(9))) SELECT doc_id, ((n - 1) // 25)::INT AS slice, count(*) AS rows FROM n GROUP BY ALL"),
}
