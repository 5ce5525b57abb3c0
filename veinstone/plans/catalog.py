"""Queries: headings and catalogues of documents, protected blocks, packing, tables, and what is read from spans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veinstone.operators import catalogue as K
from veinstone.operators import chunking as C
from veinstone.operators import similarity as S
from veinstone.sources.tables import table


def _texts(spark, sf):
    """Each revision's content once."""
    return table(spark, sf, "kb_chunk_revision", "id", "content").where("length(content) > 0").groupBy("id").agg(F.max("content").alias("content"))


def line_boxes(spark, sf):
    """Boxes of the lines of each block: the block's height by its lines, the last one taking what remains."""
    t = table(spark, sf, "documents", "doc_id", "text").where("length(text) > 0").select("doc_id", F.split("text", "\n").alias("l"))
    height = F.lit(1000)
    each = F.floor(height / F.size("l")).cast("int")
    l = t.select("doc_id", F.posexplode("l").alias("line_no", "line"), each.alias("each"), F.size("l").alias("n"))
    return l.select("doc_id", "line_no", (F.col("line_no") * F.col("each")).alias("top"), F.when(F.col("line_no") == F.col("n") - 1, 1000).otherwise((F.col("line_no") + 1) * F.col("each")).alias("bottom"))


def catalogue_merge(spark, sf):
    """Items of overlapping catalogues (sections delivered in any order) merged: of equal place and title the first by id."""
    s = table(spark, sf, "kb_section", "id", "file_node_id", "seq_start", "section_title").dropDuplicates(["id"])
    return s.groupBy("file_node_id", F.coalesce("seq_start", F.lit(-1)).alias("place"), K.key(F.col("section_title")).alias("title")).agg(F.min("id").alias("id"), F.count("*").alias("items"))


def catalogue_validation(spark, sf):
    """Items of the catalogue by what is wrong with them: type not allowed, no title, first chunk unknown, place taken by another of the same title."""
    s = table(spark, sf, "kb_section", "id", "file_node_id", "section_type", "section_title", "seq_start", "covered_chunk_ids").dropDuplicates(["id"])
    c = table(spark, sf, "kb_chunk", "id").select(F.col("id").alias("first"), F.lit(True).alias("known"))
    w = Window.partitionBy("file_node_id", "seq_start", "section_title")
    j = s.withColumn("first", F.try_element_at("covered_chunk_ids", F.lit(1))).withColumn("n", F.row_number().over(w.orderBy("id"))).join(c, "first", "left")
    allowed = F.col("section_type").isin("claim", "procedure", "definition", "appendix", "scope", "fee", "other", "collateral")
    state = F.when(~F.coalesce(allowed, F.lit(False)), "type").when(F.coalesce(F.trim("section_title"), F.lit("")) == "", "title").when(F.col("known").isNull(), "chunk").when(F.col("n") > 1, "twice").otherwise("valid")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def heading_match(spark, sf):
    """Headings of revisions held against the titles of the catalogue: equal keys, the one holding the other, or a ratio of 0.82 from six characters on; the best title of each heading.

    Equal keys meet by a join. A key that holds another has the other's rarest pair of characters. Of the n - 1 pairs of either of two
    keys of a ratio of 0.82, together s long, 0.23 s - 1 >= 0.38 n - 1 stay together, so one that both have is among the rarest n - (0.38 n - 1) of each:
    no such pair of keys is missed. Pairs of keys that lack too many of each other's pairs, by two words of 64 bits, go no further.
    """
    h = table(spark, sf, "kb_chunk_revision", "title").where("title IS NOT NULL").select(K.key(F.col("title")).alias("x")).distinct().where("length(x) >= 4")
    t = table(spark, sf, "kb_section", "section_title").where("section_title IS NOT NULL").select(K.key(F.col("section_title")).alias("x")).distinct().where("length(x) >= 4")
    equal = h.join(t, "x", "left_semi").select(F.col("x").alias("h"), F.col("x").alias("t"), F.lit(1.0).alias("ratio"))
    cuts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("x") - 1), lambda i: F.substring("x", i, F.lit(2))))
    places = F.transform("_g", lambda g: F.pmod(F.xxhash64(g), F.lit(128)).cast("int"))
    word = lambda i: F.expr(f"aggregate(filter(_b, b -> b div 64 = {i}), 0L, (m, b) -> m | shiftleft(1L, b % 64))")
    two = lambda df: df.withColumn("_g", cuts).withColumn("_b", places).select("x", F.length("x").alias("n"), word(0).alias("m0"), word(1).alias("m1"), F.explode("_g").alias("g"))
    # The optimizer doesn't know that explode makes more rows: left to itself it broadcasts them.
    hg, tg = two(h.join(t, "x", "left_anti")), two(t)
    often = hg.unionByName(tg).groupBy("g").agg(F.count("*").alias("f"))
    w = Window.partitionBy("x").orderBy("f", "g")
    placed = lambda df: df.hint("merge").join(often, "g").withColumn("p", F.row_number().over(w))
    hp, tp = placed(hg), placed(tg)
    few = (F.col("n") >= 6) & (F.col("p") <= F.col("n") - F.ceil((38 * F.col("n") - 100) / 100))
    as_ = lambda df, e: df.select("g", *[F.col(c).alias(f"{e}{c}") for c in ("x", "n", "m0", "m1")])
    meet = lambda a, b, such: as_(a, "h").hint("merge").join(as_(b, "t"), "g").where(such).select(F.col("hx").alias("h"), F.col("tx").alias("t"), lacks("h", "t").alias("lacks"))
    lacks = lambda a, b: sum(F.bit_count(F.col(f"{a}{m}").bitwiseAND(F.bitwise_not(f"{b}{m}"))) for m in ("m0", "m1"))
    s = F.col("hn") + F.col("tn")
    alike = (59 * F.least("hn", "tn") >= 41 * F.greatest("hn", "tn")) & (100 * lacks("h", "t") <= 100 * F.col("hn") - 23 * s) & (100 * lacks("t", "h") <= 100 * F.col("tn") - 23 * s)
    pairs = meet(hp.where(few), tp.where(few), alike).unionByName(meet(hp.where("p = 1"), tg, F.col("tx").contains(F.col("hx")))).unionByName(meet(hg, tp.where("p = 1"), F.col("hx").contains(F.col("tx")))).distinct()
    near = S.near_best(pairs, "h", "t", "lacks", 0.82)
    best = near.groupBy("h").agg(F.max(F.struct("ratio", "t")).alias("b"))
    return equal.unionByName(best.select("h", F.col("b.t").alias("t"), F.col("b.ratio").alias("ratio")))


def title_places(spark, sf):
    """Where each revision's own title stands in its content: as it is, without white space, or by the line most like it."""
    r = table(spark, sf, "kb_chunk_revision", "id", "title", "content").where("title IS NOT NULL").dropDuplicates(["id"])
    return K.locate_frame(r, "id", "title", "content")


def protected_overlaps(spark, sf):
    """Protected blocks (tables) of contents and the pieces of 400 characters that they overlap: the piece with the largest part of each block, and whether it is cut."""
    t = _texts(spark, sf)
    l = C.lines(t, "id", "content").where(F.trim("line").startswith("|"))
    island = F.col("line_no") - F.row_number().over(Window.partitionBy("id").orderBy("line_no"))
    b = l.withColumn("g", island).groupBy("id", "g").agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.length("line")).alias("end")).where("end > begin")
    pieces = b.withColumn("piece", F.explode(F.sequence(F.floor(F.col("begin") / 400), F.floor((F.col("end") - 1) / 400))))
    part = F.least(F.col("end"), (F.col("piece") + 1) * 400) - F.greatest(F.col("begin"), F.col("piece") * 400)
    best = pieces.withColumn("part", part).groupBy("id", "begin", "end").agg(F.max(F.struct("part", (-F.col("piece")).alias("p"))).alias("b"), F.count("*").alias("pieces"))
    return best.select("id", "begin", "end", (-F.col("b.p")).alias("piece"), (F.col("pieces") > 1).alias("is_cut"))


def contents_lists(spark, sf):
    """Documents that begin with a list of contents, and where it ends."""
    return C.per_text(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", "list boolean, ends int", lambda t: [K.contents_list(t)])


def structure_report(spark, sf):
    """Catalogues of files: sections that overlap the one before of their level, children beyond their parent's range, leaves without text of their own."""
    s = table(spark, sf, "kb_section", "section_id", "parent_section_id", "file_node_id", "section_level", "seq_start", "seq_end", "covered_chunk_ids").groupBy("section_id").agg(
        F.min("parent_section_id").alias("parent"), F.min("file_node_id").alias("file"), F.min("section_level").alias("level"), F.min("seq_start").alias("a"), F.max("seq_end").alias("b"), F.max(F.size(F.coalesce("covered_chunk_ids", F.array().cast("array<long>")))).alias("n")
    )
    # The order within a file and level is a range by begin: cut at multiples of 1,000 with the last of each piece carried over.
    before = F.max("b").over(Window.partitionBy("file", "level").orderBy("a", "section_id").rowsBetween(Window.unboundedPreceding, -1))
    o = s.withColumn("overlaps", F.coalesce(before > F.col("a"), F.lit(False)))
    p = s.select(F.col("section_id").alias("parent"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    kids = s.where("parent IS NOT NULL").select(F.col("parent").alias("section_id")).distinct().withColumn("kids", F.lit(True))
    j = o.join(p, "parent", "left").join(kids, "section_id", "left")
    return j.groupBy("file").agg(
        F.count("*").alias("sections"), F.count_if("overlaps").alias("overlaps"), F.count_if(F.coalesce((F.col("a") < F.col("pa")) | (F.col("b") > F.col("pb")), F.lit(False))).alias("beyond_parent"),
        F.count_if(F.col("kids").isNull() & (F.col("n") == 0)).alias("empty_leaves"), F.min("a").alias("first"), F.max("b").alias("last"),
    )


def paragraph_packs(spark, sf):
    """Paragraphs of each content packed in order up to 600 characters: number of packs and the longest."""
    sizes = F.transform(F.filter(F.split("content", "\n\n"), lambda x: F.length(F.trim(x)) > 0), lambda x: F.length(x))
    begin = F.struct(F.lit(0).alias("n"), F.lit(601).alias("total"), F.lit(0).alias("most"))

    def step(s, x):
        new = (s["total"] + x > 600) | (s["total"] == 0)
        total = F.when(new, x).otherwise(s["total"] + x)
        return F.struct(F.when(new, s["n"] + 1).otherwise(s["n"]).alias("n"), total.alias("total"), F.greatest(s["most"], total).alias("most"))

    return _texts(spark, sf).select("id", F.aggregate(sizes, begin, step).alias("s")).select("id", F.col("s.n").alias("packs"), F.when(F.col("s.n") > 0, F.col("s.most")).alias("longest"))


def chunker_choice(spark, sf):
    """Which chunker each content takes: by syntax if it gives two chunks or more and more than headings do, else by headings."""
    t = _texts(spark, sf)
    marks = F.size(F.filter(F.split("content", "\n"), lambda x: x.rlike("^#{1,6} ")))
    plain = F.size(F.filter(F.split("content", "\n"), lambda x: x.rlike(C.HEADING)))
    blocks = F.size(F.filter(F.split("content", "\n\n"), lambda x: F.ltrim(x).startswith("|")))
    return t.select("id", marks.alias("m"), plain.alias("h"), blocks.alias("b")).select("id", F.when((F.col("m") + F.col("b") >= 2) & (F.col("m") + F.col("b") > F.col("h")), "syntax").when(F.col("h") >= 1, "headings").otherwise("plain").alias("chunker"))


def syntax_chunks(spark, sf):
    """Chunks of documents by their markup, with path, level and range."""
    return C.per_text(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", "path string, level int, begin int, end int", K.syntax_chunks)


def representative_texts(spark, sf):
    """Representative text of each document: beginning, lines with key terms, end; as length and hash."""
    import hashlib

    terms = ["担保", "抵押", "guarantee", "collateral", "bürgschaft"]

    def make(t):
        r = K.representative(t, terms)
        return [(len(r), hashlib.sha1(r.encode()).hexdigest()[:12])]

    return C.per_text(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", "characters int, hash string", make)


def line_windows(spark, sf):
    """Windows of consecutive blocks of each document, up to 800 characters, the last block repeated."""

    def make(t):
        sizes = [len(x) for x in t.split("\n\n")]
        return [(n, a, b, sum(sizes[a:b])) for n, (a, b) in enumerate(C.windows(sizes, 800, 1))]

    return C.per_text(table(spark, sf, "documents", "doc_id", "text").where("length(text) > 0"), "doc_id", "text", "window int, first int, end int, characters int", make)


def merged_small_parts(spark, sf):
    """Paragraphs of each document with small ones (under 50 characters) merged forward, a last one backward: number of parts, shortest and longest."""

    def make(t):
        sizes = [len(x) for x in t.split("\n\n") if x.strip()]
        groups: dict[int, int] = {}
        for g, s in zip(C.merge_small(sizes, 50), sizes):
            groups[g] = groups.get(g, 0) + s
        return [(len(groups), min(groups.values(), default=0), max(groups.values(), default=0))]

    return C.per_text(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", "parts int, shortest int, longest int", make)


def best_chunk_for_field(spark, sf):
    """The chunk that bears out each anchor best among those of its section: its own source first; else 8 for a name in the text, 4 for an alias in the title, 2.5 for one in the first 300 characters; none at 0."""
    a = table(spark, sf, "kb_anchor_registry", "id", "anchor_name", "aliases", "source_chunk_id").dropDuplicates(["id"])
    c = table(spark, sf, "kb_chunk", "id", "section_id", "latest_revision_id")
    r = table(spark, sf, "kb_chunk_revision", "id", "title", "content").groupBy(F.col("id").alias("latest_revision_id")).agg(F.max("title").alias("title"), F.max("content").alias("content"))
    own = a.join(c.select(F.col("id").alias("source_chunk_id"), "section_id"), "source_chunk_id")
    text = c.where("section_id IS NOT NULL").join(r, "latest_revision_id").select("section_id", F.col("id").alias("chunk_id"), "title", "content")
    alias = F.coalesce(F.try_element_at("aliases", F.lit(1)), F.col("anchor_name"))
    score = F.when(F.col("chunk_id") == F.col("source_chunk_id"), 100.0).otherwise(
        F.when(F.col("content").contains(F.col("anchor_name")), 8.0).otherwise(0.0) + F.when(F.col("title").contains(alias), 4.0).otherwise(0.0) + F.when(F.substring("content", 1, 300).contains(alias), 2.5).otherwise(0.0)
    )
    best = own.join(text, "section_id").withColumn("s", score).where("s > 0").groupBy("id").agg(F.max(F.struct("s", (-F.col("chunk_id")).alias("c"))).alias("b"))
    return best.select("id", (-F.col("b.c")).alias("chunk_id"), F.col("b.s").alias("score"))


CATALOGUE = {
    "line_boxes": (
        line_boxes,
        """WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE length(text) > 0), u AS (SELECT doc_id, unnest(range(len(l))) AS line_no, 1000 // len(l) AS each, len(l) AS n FROM t)
        SELECT doc_id, line_no, line_no * each AS top, CASE WHEN line_no = n - 1 THEN 1000 ELSE (line_no + 1) * each END AS bottom FROM u""",
    ),
    "catalogue_merge": (
        catalogue_merge,
        "SELECT file_node_id, coalesce(seq_start, -1) AS place, lower(regexp_replace(section_title, '[ \\t\\r\\n　]+', '', 'g')) AS title, min(id) AS id, count(*) AS items FROM (SELECT DISTINCT ON (id) * FROM kb_section) GROUP BY ALL",
    ),
    "catalogue_validation": (
        catalogue_validation,
        """WITH s AS (SELECT *, row_number() OVER (PARTITION BY file_node_id, seq_start, section_title ORDER BY id) AS n FROM (SELECT DISTINCT ON (id) * FROM kb_section))
        SELECT CASE WHEN section_type IS NULL OR section_type NOT IN ('claim', 'procedure', 'definition', 'appendix', 'scope', 'fee', 'other', 'collateral') THEN 'type' WHEN coalesce(trim(section_title, ' '), '') = '' THEN 'title' WHEN NOT coalesce(covered_chunk_ids[1] IN (SELECT id FROM kb_chunk), false) THEN 'chunk' WHEN n > 1 THEN 'twice' ELSE 'valid' END AS state, count(*) AS n FROM s GROUP BY 1""",
    ),
    "heading_match": (heading_match, None),
    "title_places": (title_places, None),
    "protected_overlaps": (
        protected_overlaps,
        """WITH t AS (SELECT id, max(content) AS c FROM kb_chunk_revision WHERE length(content) > 0 GROUP BY id), l AS (SELECT id, unnest(string_split(c, chr(10))) AS line, unnest(range(len(string_split(c, chr(10))))) AS no FROM t),
        o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY id ORDER BY no) - length(line) - 1 AS off FROM l), p AS (SELECT *, no - row_number() OVER (PARTITION BY id ORDER BY no) AS g FROM o WHERE starts_with(trim(line, ' '), '|')),
        b AS (SELECT id, g, min(off)::BIGINT AS a, max(off + length(line))::BIGINT AS z FROM p GROUP BY id, g), x AS (SELECT id, a, z, unnest(range(a // 400, (z - 1) // 400 + 1)) AS piece FROM b WHERE z > a)
        SELECT id, a AS begin, z AS "end", arg_max(piece, {'n': least(z, (piece + 1) * 400) - greatest(a, piece * 400), 'p': -piece}) AS piece, count(*) > 1 AS is_cut FROM x GROUP BY id, a, z""",
    ),
    "contents_lists": (contents_lists, None),
    "structure_report": (
        structure_report,
        """WITH s AS (SELECT section_id, min(parent_section_id) AS parent, min(file_node_id) AS file, min(section_level) AS level, min(seq_start) AS a, max(seq_end) AS b, max(coalesce(len(covered_chunk_ids), 0)) AS n FROM kb_section GROUP BY section_id),
        o AS (SELECT *, coalesce(max(b) OVER (PARTITION BY file, level ORDER BY a NULLS FIRST, section_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > a, false) AS x FROM s)
        SELECT o.file, count(*) AS sections, count_if(x) AS overlaps, count_if(coalesce(o.a < p.a OR o.b > p.b, false)) AS beyond_parent, count_if(o.section_id NOT IN (SELECT parent FROM s WHERE parent IS NOT NULL) AND o.n = 0) AS empty_leaves, min(o.a) AS first, max(o.b) AS last FROM o LEFT JOIN s p ON p.section_id = o.parent GROUP BY o.file""",
    ),
    "paragraph_packs": (paragraph_packs, None),
    "chunker_choice": (
        chunker_choice,
        f"""WITH t AS (SELECT id, max(content) AS c FROM kb_chunk_revision WHERE length(content) > 0 GROUP BY id), m AS (SELECT id, len(list_filter(string_split(c, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}} '))) AS m, len(list_filter(string_split(c, chr(10)), lambda x: regexp_matches(x, '{C.HEADING}'))) AS h, len(list_filter(string_split(c, chr(10) || chr(10)), lambda x: starts_with(ltrim(x, ' '), '|'))) AS b FROM t)
        SELECT id, CASE WHEN m + b >= 2 AND m + b > h THEN 'syntax' WHEN h >= 1 THEN 'headings' ELSE 'plain' END AS chunker FROM m""",
    ),
    "syntax_chunks": (syntax_chunks, None),
    "representative_texts": (representative_texts, None),
    "line_windows": (line_windows, None),
    "merged_small_parts": (merged_small_parts, None),
    "best_chunk_for_field": (
        best_chunk_for_field,
        """WITH a AS (SELECT DISTINCT ON (id) id, anchor_name, coalesce(aliases[1], anchor_name) AS al, source_chunk_id FROM kb_anchor_registry), r AS (SELECT id, max(title) AS title, max(content) AS content FROM kb_chunk_revision GROUP BY id),
        j AS (SELECT a.id, k.id AS chunk_id, CASE WHEN k.id = a.source_chunk_id THEN 100.0 ELSE CASE WHEN contains(content, anchor_name) THEN 8.0 ELSE 0 END + CASE WHEN contains(title, al) THEN 4.0 ELSE 0 END + CASE WHEN contains(left(content, 300), al) THEN 2.5 ELSE 0 END END AS s
            FROM a JOIN kb_chunk o ON o.id = a.source_chunk_id JOIN kb_chunk k ON k.section_id = o.section_id JOIN r ON r.id = k.latest_revision_id)
        SELECT id, chunk_id, s::DOUBLE AS score FROM j WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, chunk_id) = 1""",
    ),
}
