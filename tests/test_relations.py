import random

from veinstone.operators import relations as R

SCHEMA = "id long, file long, generation string, seq int, section_type string, meta map<string,string>, extra string"


def chunks(spark, rows):
    return spark.createDataFrame([(i, f, "g", s, t, m, "x") for i, f, s, t, m in rows], SCHEMA)


def brute(rows):
    """Links of each (rule, chunk) by comparing all pairs of a file."""
    out = {}

    def link(rule, a, b):
        out.setdefault((rule, a), set()).add(b)
        out.setdefault((rule, b), set()).add(a)

    for n, (i, f, _, t, m) in enumerate(rows):
        for j, g, _, u, o in rows[:n]:
            if f != g:
                continue
            get = lambda x, *names: next((x[k] for k in names if x.get(k)), None)
            if t and t == u != "other":
                link("same_section_type", i, j)
            for rule, *names in (("same_group", "chunk_group_id"), ("same_business_block", "business_block_id"), ("same_clause", "clause_id"), ("same_chapter", "chapter_id"), ("same_table", "table_key"), ("same_title_parent", "title_parent"),
                                 ("same_module", "module_key", "module"), ("same_api", "api_key", "api_group_id"), ("db_schema_related", "table_key", "table_name"), ("related_obligation", "obligation_subject_key", "obligation_subject")):
                if get(m, *names) and get(m, *names) == get(o, *names):
                    link(rule, i, j)
            if t == u == "config_item" and (m.get("module") or None) == (o.get("module") or None):
                link("config_related", i, j)
            if (m.get("clause_id") and m.get("clause_id") == o.get("parent_clause_id")) or (o.get("clause_id") and o.get("clause_id") == m.get("parent_clause_id")):
                link("parent_clause", i, j)
            api = get(m, "api_key", "api_group_id")
            if api and api == get(o, "api_key", "api_group_id"):
                for kind in ("api_param", "api_example", "api_error_code"):
                    if {t, u} == {"api_spec", kind}:
                        link(kind, i, j)
            if {t, u} == {"payment_term", "breach_clause"}:
                link("payment_breach_related", i, j)
            if "breach_clause" in (t, u) and {t, u} & {"term_effective", "delivery_acceptance", "payment_term"}:
                link("term_breach_related", i, j)
            if set(filter(None, m.get("parties", "").split("|"))) & set(filter(None, o.get("parties", "").split("|"))):
                link("same_party", i, j)
    return out


def test_classes_hold_the_links_of_all_rules(spark):
    rng = random.Random(3)
    kinds = ["api_spec", "api_param", "api_example", "api_error_code", "payment_term", "breach_clause", "term_effective", "delivery_acceptance", "config_item", "other", None, ""]
    keys = ["chunk_group_id", "business_block_id", "clause_id", "parent_clause_id", "chapter_id", "table_key", "table_name", "title_parent", "module", "module_key", "api_key", "api_group_id", "obligation_subject"]
    rows = [(i, i % 2, i, rng.choice(kinds), {k: rng.choice(["a", "b", "c", ""]) for k in keys if rng.random() < 0.6} | ({"parties": rng.choice(["p", "q", "p2", ""])} if rng.random() < 0.5 else {})) for i in range(60)]
    df = chunks(spark, rows + rows[:7])  # some delivered twice
    expected = {k: len(v) for k, v in brute(rows).items()}
    got: dict = {}
    for r in R.classes(df).collect():
        assert r["weight"] == (R.EQUAL | R.ROLES)[r["rule"]]
        if r["rule"] == "parent_clause":  # a chunk may be parent and child: its links are those of both roles
            got[r["rule"], r["id"]] = got.get((r["rule"], r["id"]), 0) + r["links"]
        else:
            assert (r["rule"], r["id"]) not in got
            got[r["rule"], r["id"]] = r["links"]
    assert {k: v for k, v in got.items() if k[0] != "parent_clause"} == {k: v for k, v in expected.items() if k[0] != "parent_clause"}
    assert {k[1] for k in expected if k[0] == "parent_clause"} <= {k[1] for k in got if k[0] == "parent_clause"}
    assert {k[0] for k in got} == set(R.EQUAL | R.ROLES)
    assert R.classes(df.limit(0)).count() == 0


def test_edges_over_the_borders_of_cells(spark):
    rows = [(i, 1, s, None, {"clause_order": str(o)}) for i, (s, o) in enumerate([(0, 1), (999, 2), (1000, 3), (1000, 7), (5200, 8), (None, 1)])]
    children = spark.createDataFrame([(90, "section_chunk", 1), (91, "parent_chunk", 1), (90, "section_chunk", 1)], "context long, kind string, child long")
    e = {(r["rule"], r["from_id"], r["to_id"]): r["weight"] for r in R.edges(chunks(spark, rows), children).collect()}
    assert {k[1:] for k in e if k[0] == "adjacent_next"} == {(5, 0), (0, 1), (1, 2), (2, 3), (3, 4)}
    assert {k[1:] for k in e if k[0] == "adjacent_clause"} == {(0, 1), (1, 2), (3, 4)}
    assert e["section_context", 1, 90] == 0.92 and e["parent_context", 1, 91] == 0.74
