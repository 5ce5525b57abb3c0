"""Queries: chunking by profile (clauses, settings, SQL objects), budgets for batches of text, and layouts delivered as JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veinstone.operators import chunking as C
from veinstone.sources.tables import table

#: Lines that begin a clause: a numbered article, or a numbering of two parts or more.
CLAUSE = "^(第[0-9一二三四五六七八九十百.]+[章节条]|[0-9]{1,2}([.][0-9]{1,2})+[ \\t])"
#: Characters that a batch may hold, and what each text in it costs besides its own.
BUDGET, EACH = 20_000, 200

_BLOCK = "array<struct<label:string,text:string>>"
_LAYOUT = f"pages array<struct<page_no:int,blocks:{_BLOCK}>>"


def clause_chunks(spark, sf):
    """Clauses of each content: from one line that begins a clause to the next, with the clause's number; what stands before the first has none."""
    t = table(spark, sf, "kb_chunk_revision", "id", "content").where("length(content) > 0").groupBy("id").agg(F.max("content").alias("content"))
    l = C.lines(t, "id", "content").withColumn("new", F.col("line").rlike(CLAUSE).cast("int"))
    n = l.withColumn("clause_no", F.sum("new").over(Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    head = F.max(F.when(F.col("new") == 1, F.regexp_extract("line", "([0-9]{1,2}(?:[.][0-9]{1,2})+)", 1)))
    return n.groupBy("id", "clause_no").agg(head.alias("number"), F.count("*").alias("lines"), F.min("offset").alias("begin"), F.max(F.col("offset") + F.length("line")).alias("end"))


def setting_lines(spark, sf):
    """Settings within documents: lines of a name, a colon or an equals sign, and a value; by name, how many and the longest value."""
    d = table(spark, sf, "documents", "doc_id", "text").where("length(text) > 0").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    p = "^([A-Za-z_][A-Za-z0-9_.-]{0,40})[ ]?[:=][ ]?([^ ].*)$"
    s = d.select("doc_id", F.regexp_extract("line", p, 1).alias("name"), F.regexp_extract("line", p, 2).alias("value")).where("name <> ''")
    return s.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"), F.max(F.length("value")).alias("longest"))


def budget_batches(spark, sf):
    """Chunks of each section batched in order, so that a batch with 200 characters for each text keeps 20,000: batches and the fullest of each section. A text over the budget is a batch of its own."""
    c = table(spark, sf, "kb_chunk", "id", "section_id", "seq_no", "latest_revision_id").where("section_id IS NOT NULL")
    r = table(spark, sf, "kb_chunk_revision", "id", "content").groupBy(F.col("id").alias("latest_revision_id")).agg(F.max(F.length("content")).alias("n"))
    j = c.join(r, "latest_revision_id", "left").groupBy("section_id").agg(F.sort_array(F.collect_list(F.struct("seq_no", "id", (F.coalesce("n", F.lit(0)) + EACH).alias("n"))))["n"].alias("sizes"))
    begin = F.struct(F.lit(0).alias("batches"), F.lit(0).alias("total"), F.lit(0).alias("most"))

    def step(s, x):
        new = (s["batches"] == 0) | (s["total"] + x > BUDGET)
        total = F.when(new, x).otherwise(s["total"] + x)
        return F.struct(F.when(new, s["batches"] + 1).otherwise(s["batches"]).alias("batches"), total.alias("total"), F.greatest(s["most"], total).alias("most"))

    return j.select("section_id", F.size("sizes").alias("texts"), F.aggregate("sizes", begin, step).alias("s")).select("section_id", "texts", F.col("s.batches").alias("batches"), F.col("s.most").alias("fullest"))


def sql_objects(spark, sf):
    """Objects described in marked blocks (name, kind, a fence of SQL), written from the sections and parsed again: what each holds, and why it can't be published."""
    s = table(spark, sf, "kb_section", "section_id", "section_title", "section_type").groupBy("section_id").agg(F.min("section_title").alias("title"), F.min("section_type").alias("type"))
    text = F.concat(
        F.lit("### object\nname: "), F.coalesce(F.regexp_replace("title", "[\\r\\n:]+", " "), F.lit("")), F.lit("\nkind: "), F.coalesce("type", F.lit("")),
        F.when(F.col("type") == "appendix", F.lit("\n")).otherwise(F.concat(F.lit("\n```sql\nSELECT * FROM "), "section_id", F.lit(" WHERE kb_id = 7\n```\n"))),
    )
    block = s.select("section_id", text.alias("t"))
    pairs = F.str_to_map(F.regexp_replace(F.regexp_extract("t", "(?s)^### object\\n(.*?)(?:\\n```|\\n$)", 1), "\\n+$", ""), F.lit("\n"), F.lit(": "))
    sql = F.regexp_extract("t", "(?s)```sql\\n(.*?)\\n```", 1)
    p = block.select("section_id", pairs.alias("m"), sql.alias("sql")).select("section_id", F.trim(F.coalesce(F.col("m")["name"], F.lit(""))).alias("name"), F.coalesce(F.col("m")["kind"], F.lit("")).alias("kind"), F.regexp_extract("sql", "(?i)from ([a-z0-9_]+)", 1).alias("source"))
    errors = F.array_compact(F.array(F.when(F.col("name") == "", "no name"), F.when(F.col("kind") == "", "no kind"), F.when(F.col("source") == "", "no sql")))
    return p.select("section_id", F.length("name").alias("name"), "kind", "source", F.array_join(errors, ",").alias("errors"))


def layout_blocks(spark, sf):
    """Documents as layouts in JSON (pages of blocks, as a reader of scans delivers them), taken apart: page, place, label and length of each block. What doesn't parse gives none."""
    d = table(spark, sf, "documents", "doc_id", "text").where("length(text) > 0")
    label = lambda x: F.when(F.ltrim(x).startswith("|"), "table").when(F.length(x) < 30, "title").otherwise("text")
    blocks = lambda p: F.transform(F.split(p, "\n\n"), lambda x: F.struct(label(x).alias("label"), x.alias("text")))
    page = F.transform(F.split("text", "\f"), lambda p, i: F.struct((i + 1).alias("page_no"), blocks(p).alias("blocks")))
    raw = d.select("doc_id", F.to_json(F.struct(page.alias("pages"))).alias("j"))
    pages = raw.select("doc_id", F.explode(F.from_json("j", _LAYOUT)["pages"]).alias("p"))
    return pages.select("doc_id", F.col("p.page_no").alias("page_no"), F.posexplode("p.blocks").alias("place", "b")).select("doc_id", "page_no", "place", "b.label", F.length("b.text").alias("characters"))


CATALOGUE = {
    "clause_chunks": (
        clause_chunks,
        f"""WITH t AS (SELECT id, max(content) AS c FROM kb_chunk_revision WHERE length(content) > 0 GROUP BY id), l AS (SELECT id, unnest(string_split(c, chr(10))) AS line, unnest(range(len(string_split(c, chr(10))))) AS no FROM t),
        o AS (SELECT *, regexp_matches(line, '{CLAUSE}') AS new, sum(length(line) + 1) OVER (PARTITION BY id ORDER BY no) - length(line) - 1 AS off FROM l), n AS (SELECT *, sum(new::INT) OVER (PARTITION BY id ORDER BY no) AS clause_no FROM o)
        SELECT id, clause_no::BIGINT AS clause_no, max(CASE WHEN new THEN regexp_extract(line, '([0-9]{{1,2}}(?:[.][0-9]{{1,2}})+)', 1) END) AS number, count(*) AS lines, min(off)::BIGINT AS begin, max(off + length(line))::BIGINT AS "end" FROM n GROUP BY id, clause_no""",
    ),
    "setting_lines": (
        setting_lines,
        """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE length(text) > 0), s AS (SELECT doc_id, regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_.-]{0,40})[ ]?[:=][ ]?([^ ].*)$', 1) AS name, regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_.-]{0,40})[ ]?[:=][ ]?([^ ].*)$', 2) AS value FROM l)
        SELECT name, count(*) AS n, count(DISTINCT doc_id) AS documents, max(length(value)) AS longest FROM s WHERE name <> '' GROUP BY name""",
    ),
    "budget_batches": (budget_batches, None),
    "sql_objects": (
        sql_objects,
        """WITH s AS (SELECT section_id, trim(regexp_replace(coalesce(min(section_title), ''), '[\\r\\n:]+', ' ', 'g'), ' ') AS name, coalesce(min(section_type), '') AS kind FROM kb_section GROUP BY section_id)
        SELECT section_id, length(name) AS name, kind, CASE WHEN kind = 'appendix' THEN '' ELSE section_id END AS source, concat_ws(',', CASE WHEN name = '' THEN 'no name' END, CASE WHEN kind = '' THEN 'no kind' END, CASE WHEN kind = 'appendix' THEN 'no sql' END) AS errors FROM s""",
    ),
    "layout_blocks": (
        layout_blocks,
        """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS p, unnest(range(len(string_split(text, chr(12))))) + 1 AS page_no FROM documents WHERE length(text) > 0), b AS (SELECT doc_id, page_no, unnest(string_split(p, chr(10) || chr(10))) AS b, unnest(range(len(string_split(p, chr(10) || chr(10))))) AS place FROM p)
        SELECT doc_id, page_no, place, CASE WHEN starts_with(ltrim(b, ' '), '|') THEN 'table' WHEN length(b) < 30 THEN 'title' ELSE 'text' END AS label, length(b) AS characters FROM b""",
    ),
}
