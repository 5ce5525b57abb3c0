"""Queries: what a question asks for, by rules: entities, scope, comparison, features of routes, intents. Questions here are the titles of sections and the first lines of documents.

Dictionaries are parameters of the callers; those here fit the test tables.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from veinstone.functions import text as T
from veinstone.sources.tables import table

PLACES = "([一-鿿]{2}(?:区|县|乡|镇|市|港))"
TRADES = "([一-鿿]{2,4}(?:行业|类借款人|类贷款))"
OFFICES = "([一-鿿]{2,6}(?:部|厅|室|机构|委员会|小组))"
STOP = ["该机构", "各分支机构"]
ALIASES = {"guarantee": ["担保", "bürgschaft", "bond"], "collateral": ["抵押", "sicherheit"], "claim": ["代偿", "ausfall"]}
INTENTS = (("recent_files", "最近|recent|zuletzt"), ("file_search", "文件|file|datei"), ("comparison", "比较|区别|compare|vergleich"), ("casual", "你好|hello|hallo"))
#: Alias of a relation -> relation and the kinds of nodes that it may end at, by profile.
GRAPH_INTENTS = (("签字", "signs", "role", "zh"), ("审批", "approves", "department", "zh"), ("zuständig", "responsible", "department", "de"), ("review", "approves", "department", "en"), ("checklist", "requires", "rule_document", "en"))


def _lines(spark, sf):
    return table(spark, sf, "documents", "doc_id", "text", "lang").where("length(text) > 0").select("doc_id", T.first_line(F.col("text")).alias("q"), "lang")


def entities(spark, sf):
    """Places, trades and offices that each quote names, each once, stop words left out."""
    e = table(spark, sf, "kb_section_summary_evidence", "id", "evidence_quote").distinct().where("evidence_quote IS NOT NULL")
    out = None
    for kind, pattern in (("place", PLACES), ("trade", TRADES), ("office", OFFICES)):
        p = e.select("id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("evidence_quote", F.lit(pattern), 1))).alias("name"))
        out = p if out is None else out.unionByName(p)
    return out.where(~F.col("name").isin(STOP))


def scope_anchors(spark, sf):
    """What each first line asks about: offices and known products in it, without interrogatives, eight at most in order of their names."""
    known = ["担保", "抵押", "保函", "bond", "collateral", "bürgschaft"]
    names = F.array_distinct(F.concat(F.regexp_extract_all("q", F.lit(OFFICES), 1), F.filter(F.array(*[F.lit(k) for k in known]), lambda k: F.lower("q").contains(k))))
    kept = F.slice(F.array_sort(F.filter(names, lambda n: ~n.rlike("什么|哪|怎么|which|what"))), 1, 8)
    return _lines(spark, sf).select("doc_id", kept.alias("a")).where("size(a) > 0").select("doc_id", F.array_join("a", ",").alias("anchors"), F.size("a").alias("n"))


def alias_expansion(spark, sf):
    """Products of anchors with all their other names: the map is read in both directions."""
    pairs = [(a, b) for k, v in ALIASES.items() for a in (k, *v) for b in (k, *v) if a != b]
    m = F.broadcast(spark.createDataFrame(pairs, "word string, alias string"))  # a dictionary of fixed size
    a = table(spark, sf, "kb_anchor_registry", "anchor_name").where("anchor_name IS NOT NULL").select(F.lower("anchor_name").alias("name")).distinct()
    return a.crossJoin(m).where(F.contains(F.col("name"), F.col("word"))).select("name", "alias").distinct()


def comparison_anchors(spark, sf):
    """Quotes that compare two things or more: the parts on both sides of the first joining word, and a mark of comparison."""
    e = table(spark, sf, "kb_section_summary_evidence", "id", "evidence_quote").distinct()
    p = F.regexp_extract("evidence_quote", "([一-鿿A-Za-z]{2,8})(?:和|与| and | und )([一-鿿A-Za-z]{2,8})", 1)
    q = F.regexp_extract("evidence_quote", "([一-鿿A-Za-z]{2,8})(?:和|与| and | und )([一-鿿A-Za-z]{2,8})", 2)
    return e.select("id", p.alias("first"), q.alias("second"), F.col("evidence_quote").rlike("比例|分别|双方|between|both|zwischen|beide").alias("marked")).where("first <> '' AND marked").select("id", "first", "second")


def route_features(spark, sf):
    """Features of each first line that routes are chosen by: length class, whether it asks, names a code, compares, names a field; and the mode that follows."""
    q = F.col("q")
    asks, code = q.rlike("[?？]|什么|如何|多少|which|what|wie|was "), q.rlike("[A-Z]{2}-[0-9]{4}")
    compares = q.rlike("比较|区别|compare|vergleich")
    mode = F.when(compares, "comparison").when(code, "exact").when(asks & (F.length(q) <= 80), "question").when(F.length(q) <= 12, "keyword").otherwise("semantic")
    return _lines(spark, sf).groupBy(mode.alias("mode"), asks.alias("asks"), code.alias("code"), (F.length(q) <= 80).alias("short")).agg(F.count("*").alias("n"))


def graph_intents(spark, sf):
    """Relations that each first line asks for in the graph: aliases that its profile (language) allows."""
    d = F.broadcast(spark.createDataFrame([*GRAPH_INTENTS], "alias string, relation string, node string, profile string"))  # a dictionary of fixed size
    return _lines(spark, sf).crossJoin(d).where(F.contains(F.lower("q"), F.col("alias")) & (F.coalesce("lang", F.col("profile")) == F.col("profile"))).select("doc_id", "relation", "node").distinct()


def plan_steps(spark, sf):
    """The plan of each mode: routes on, context relations, most chunks. Comparisons take more, exact questions fewer."""
    f = route_features(spark, sf).groupBy("mode").agg(F.sum("n").alias("questions"))
    most = F.when(F.col("mode") == "comparison", 12).when(F.col("mode") == "exact", 4).otherwise(8)
    routes = F.when(F.col("mode") == "exact", "lexical,structured").when(F.col("mode") == "keyword", "lexical,sections").otherwise("lexical,vector,sections,graph")
    return f.select("mode", "questions", routes.alias("routes"), most.alias("most_chunks"), F.when(F.col("mode").isin("comparison", "semantic"), "parent").otherwise("section").alias("context"))


def rewrite_guard(spark, sf):
    """Which first lines need no rewriting by a model: with a code up to 120 characters, asking up to 80, others up to 50."""
    q = F.col("q")
    limit = F.when(q.rlike("[A-Z]{2}-[0-9]{4}"), 120).when(q.rlike("[?？]|什么|如何|多少|which|what"), 80).otherwise(50)
    return _lines(spark, sf).groupBy((F.length(q) <= limit).alias("skip")).agg(F.count("*").alias("n"))


def rule_relations(spark, sf):
    """Relations by rule: from the first plan of each section to each of its other anchors, unless their chunk ties them already; confidence up to 0.86."""
    a = table(spark, sf, "kb_anchor_registry", "id", "anchor_type", "source_chunk_id", "confidence").where("source_chunk_id IS NOT NULL").dropDuplicates(["id"])
    c = table(spark, sf, "kb_chunk", "id", "section_id").where("section_id IS NOT NULL").select(F.col("id").alias("source_chunk_id"), "section_id")
    j = a.join(c, "source_chunk_id")
    first = j.where("anchor_type = 'plan'").groupBy("section_id").agg(F.min(F.struct("id", "source_chunk_id")).alias("p"))
    pairs = j.join(first, "section_id").where("id <> p.id AND source_chunk_id <> p.source_chunk_id")
    return pairs.select(F.col("p.id").alias("from_id"), F.col("id").alias("to_id"), F.round(F.least(F.lit(0.86), F.coalesce(F.col("confidence").cast("double"), F.lit(0.5))), 4).alias("confidence"))


def chat_intents(spark, sf):
    """Intent of each first line: lists of phrases in order, else a question."""
    kind: Column = F.lit("question")
    for name, pattern in reversed(INTENTS):
        kind = F.when(F.lower("q").rlike(pattern), name).otherwise(kind)
    return _lines(spark, sf).groupBy(kind.alias("intent")).agg(F.count("*").alias("n"))


def understanding_merge(spark, sf):
    """What a model said over what rules found: a null falls back, an empty list stays. Here the aliases of anchors over the words of their names."""
    a = table(spark, sf, "kb_anchor_registry", "id", "anchor_name", "aliases").dropDuplicates(["id"])
    return a.select("id", F.size(F.coalesce("aliases", T.words(F.col("anchor_name")))).alias("terms"), F.col("aliases").isNull().alias("by_rule"))


def contract_numbers(spark, sf):
    """Rates, terms and limits of each quote: the least and greatest rate, the longest term in days, the highest amount in whole units."""
    e = table(spark, sf, "kb_section_summary_evidence", "id", "evidence_quote").distinct().where("evidence_quote IS NOT NULL")
    rates = F.transform(F.regexp_extract_all("evidence_quote", F.lit(r"([0-9]{1,3}(?:\.[0-9]{1,4})?)(?:%| percent)"), 1), lambda x: x.cast("double"))
    days = F.transform(F.regexp_extract_all("evidence_quote", F.lit("([0-9]{1,4}) ?(?:日|天|days|Tagen)"), 1), lambda x: x.cast("int"))
    years = F.transform(F.regexp_extract_all("evidence_quote", F.lit("([0-9]{1,2}) ?(?:年|years|Jahre)"), 1), lambda x: x.cast("int") * 360)
    money = F.concat(
        F.transform(F.regexp_extract_all("evidence_quote", F.lit("([0-9]{1,9})万元"), 1), lambda x: x.cast("long") * 10_000), F.transform(F.regexp_extract_all("evidence_quote", F.lit("([0-9]{1,9})亿元"), 1), lambda x: x.cast("long") * 100_000_000)
    )
    s = e.select("id", F.array_min(rates).alias("least_rate"), F.array_max(rates).alias("most_rate"), F.array_max(F.concat(days, years)).alias("days"), F.array_max(money).alias("amount"))
    return s.where("least_rate IS NOT NULL OR days IS NOT NULL OR amount IS NOT NULL")


def byte_sizes(spark, sf):
    """Sizes of documents in units: bytes, KB, MB."""
    n = F.octet_length("text")
    text = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.round(n / 1024, 1).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.round(n / (1 << 20), 1).cast("string"), F.lit(" MB")))
    return table(spark, sf, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", text.alias("size"))


_Q = "q AS (SELECT doc_id, regexp_extract(text, '^([^\\n]*)', 1) AS q, lang FROM documents WHERE length(text) > 0)"
_E = "e AS (SELECT DISTINCT id, evidence_quote FROM kb_section_summary_evidence)"
_MODE = "CASE WHEN regexp_matches(q, '比较|区别|compare|vergleich') THEN 'comparison' WHEN regexp_matches(q, '[A-Z]{2}-[0-9]{4}') THEN 'exact' WHEN regexp_matches(q, '[?？]|什么|如何|多少|which|what|wie|was ') AND length(q) <= 80 THEN 'question' WHEN length(q) <= 12 THEN 'keyword' ELSE 'semantic' END"
_VAL = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + ")"

CATALOGUE = {
    "entities": (entities, f"WITH {_E}, x AS (" + " UNION ALL ".join(f"SELECT DISTINCT id, '{k}' AS kind, unnest(regexp_extract_all(evidence_quote, '{p}', 1)) AS name FROM e" for k, p in (("place", PLACES), ("trade", TRADES), ("office", OFFICES))) + ") SELECT * FROM x WHERE name NOT IN ('该机构', '各分支机构')"),
    "scope_anchors": (
        scope_anchors,
        f"""WITH {_Q}, x AS (SELECT DISTINCT doc_id, unnest(list_concat(regexp_extract_all(q, '{OFFICES}', 1), list_filter(['担保', '抵押', '保函', 'bond', 'collateral', 'bürgschaft'], lambda k: contains(lower(q), k)))) AS n FROM q),
        y AS (SELECT doc_id, n FROM x WHERE NOT regexp_matches(n, '什么|哪|怎么|which|what') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) <= 8) SELECT doc_id, string_agg(n, ',' ORDER BY n) AS anchors, count(*) AS n FROM y GROUP BY doc_id""",
    ),
    "alias_expansion": (alias_expansion, f"SELECT DISTINCT lower(anchor_name) AS name, alias FROM kb_anchor_registry, {_VAL([(a, b) for k, v in ALIASES.items() for a in (k, *v) for b in (k, *v) if a != b])} m(word, alias) WHERE contains(lower(anchor_name), word)"),
    "comparison_anchors": (
        comparison_anchors,
        f"WITH {_E}, x AS (SELECT id, regexp_extract(evidence_quote, '([一-鿿A-Za-z]{{2,8}})(?:和|与| and | und )([一-鿿A-Za-z]{{2,8}})', 1) AS first, regexp_extract(evidence_quote, '([一-鿿A-Za-z]{{2,8}})(?:和|与| and | und )([一-鿿A-Za-z]{{2,8}})', 2) AS second, evidence_quote FROM e) SELECT id, first, second FROM x WHERE first <> '' AND regexp_matches(evidence_quote, '比例|分别|双方|between|both|zwischen|beide')",
    ),
    "route_features": (route_features, f"WITH {_Q} SELECT {_MODE} AS mode, regexp_matches(q, '[?？]|什么|如何|多少|which|what|wie|was ') AS asks, regexp_matches(q, '[A-Z]{{2}}-[0-9]{{4}}') AS code, length(q) <= 80 AS short, count(*) AS n FROM q GROUP BY ALL"),
    "graph_intents": (graph_intents, f"WITH {_Q} SELECT DISTINCT doc_id, relation, node FROM q, {_VAL(GRAPH_INTENTS)} d(alias, relation, node, profile) WHERE contains(lower(q), alias) AND coalesce(lang, profile) = profile"),
    "plan_steps": (
        plan_steps,
        f"WITH {_Q}, m AS (SELECT {_MODE} AS mode, count(*) AS questions FROM q GROUP BY 1) SELECT mode, questions, CASE mode WHEN 'exact' THEN 'lexical,structured' WHEN 'keyword' THEN 'lexical,sections' ELSE 'lexical,vector,sections,graph' END AS routes, CASE mode WHEN 'comparison' THEN 12 WHEN 'exact' THEN 4 ELSE 8 END AS most_chunks, CASE WHEN mode IN ('comparison', 'semantic') THEN 'parent' ELSE 'section' END AS context FROM m",
    ),
    "rewrite_guard": (rewrite_guard, f"WITH {_Q} SELECT length(q) <= CASE WHEN regexp_matches(q, '[A-Z]{{2}}-[0-9]{{4}}') THEN 120 WHEN regexp_matches(q, '[?？]|什么|如何|多少|which|what') THEN 80 ELSE 50 END AS skip, count(*) AS n FROM q GROUP BY 1"),
    "rule_relations": (
        rule_relations,
        """WITH j AS (SELECT a.id, anchor_type, source_chunk_id, confidence, section_id FROM (SELECT DISTINCT ON (id) * FROM kb_anchor_registry) a JOIN kb_chunk k ON k.id = source_chunk_id WHERE section_id IS NOT NULL),
        p AS (SELECT section_id, id, source_chunk_id FROM j WHERE anchor_type = 'plan' QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY id) = 1)
        SELECT p.id AS from_id, j.id AS to_id, round(least(0.86, coalesce(confidence::DOUBLE, 0.5)), 4) AS confidence FROM j JOIN p USING (section_id) WHERE j.id <> p.id AND j.source_chunk_id <> p.source_chunk_id""",
    ),
    "chat_intents": (chat_intents, f"WITH {_Q} SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{p}') THEN '{n}'" for n, p in INTENTS) + " ELSE 'question' END AS intent, count(*) AS n FROM q GROUP BY 1"),
    "understanding_merge": (understanding_merge, f"SELECT id, len(coalesce(aliases, {T.words_sql('anchor_name')})) AS terms, aliases IS NULL AS by_rule FROM (SELECT DISTINCT ON (id) * FROM kb_anchor_registry)"),
    "contract_numbers": (
        contract_numbers,
        rf"""WITH {_E}, x AS (SELECT id, list_transform(regexp_extract_all(evidence_quote, '([0-9]{{1,3}}(?:\.[0-9]{{1,4}})?)(?:%| percent)', 1), lambda x: x::DOUBLE) AS r, list_concat(list_transform(regexp_extract_all(evidence_quote, '([0-9]{{1,4}}) ?(?:日|天|days|Tagen)', 1), lambda x: x::INT), list_transform(regexp_extract_all(evidence_quote, '([0-9]{{1,2}}) ?(?:年|years|Jahre)', 1), lambda x: x::INT * 360)) AS d,
            list_concat(list_transform(regexp_extract_all(evidence_quote, '([0-9]{{1,9}})万元', 1), lambda x: x::BIGINT * 10000), list_transform(regexp_extract_all(evidence_quote, '([0-9]{{1,9}})亿元', 1), lambda x: x::BIGINT * 100000000)) AS m FROM e WHERE evidence_quote IS NOT NULL)
        SELECT id, list_min(r) AS least_rate, list_max(r) AS most_rate, list_max(d) AS days, list_max(m) AS amount FROM x WHERE len(r) > 0 OR len(d) > 0 OR len(m) > 0""",
    ),
    "byte_sizes": (
        byte_sizes,
        "WITH n AS (SELECT doc_id, strlen(text) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN round(n / 1024, 1) || ' KB' ELSE round(n / 1048576, 1) || ' MB' END AS size FROM n",
    ),
}
