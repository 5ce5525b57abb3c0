"""Greedy packing within expressions against plain loops, and packages of spreadsheets."""

import io
import zipfile

from pyspark.sql import functions as F

from veinstone.operators import catalogue as K
from veinstone.plans import catalog, profiles, structure
from veinstone.sources import files
from veinstone.sources.tables import table


def _sections(spark, sf):
    rows = table(spark, sf, "kb_chunk", "id", "section_id", "seq_no", "latest_revision_id").where("section_id IS NOT NULL").collect()
    texts = {}
    for r in table(spark, sf, "kb_chunk_revision", "id", "content").distinct().collect():
        texts[r["id"]] = max(texts.get(r["id"], ""), r["content"] or "")
    out = {}
    for r in sorted(rows, key=lambda r: (r["section_id"], r["seq_no"] is not None, r["seq_no"] or 0, r["id"])):
        out.setdefault(r["section_id"], []).append(r["latest_revision_id"])
    return out, texts


def _packed(sizes, limit):
    out = []
    for s in sizes:
        if out and out[-1] + 1 + s <= limit:
            out[-1] += 1 + s
        else:
            out.append(s)
    return out


def test_three_grains_against_loops(spark, sf):
    sections, texts = _sections(spark, sf)
    got = {r["section_id"]: r for r in structure.multigranularity(spark, sf).collect()}
    assert len(got) > 10
    for s, ids in sections.items():
        sizes = [len(texts[i]) for i in ids if i in texts]
        if not sizes:
            continue
        own = _packed(sizes, 4200)
        parents = _packed(own, 6500) if len(own) >= 2 else []
        r = got[s]
        assert (r["n"], r["section_chunks"], r["parent_chunks"], r["longest_section"], r["longest_parent"]) == (len(sizes), len(own), len(parents), max(own), max(parents, default=None))


def test_budget_batches_against_loops(spark, sf):
    sections, texts = _sections(spark, sf)
    got = {r["section_id"]: r for r in profiles.budget_batches(spark, sf).collect()}
    for s, ids in sections.items():
        batches = []
        for i in ids:
            n = len(texts.get(i, "")) + 200
            if batches and batches[-1] + n <= 20_000:
                batches[-1] += n
            else:
                batches.append(n)
        assert (got[s]["texts"], got[s]["batches"], got[s]["fullest"]) == (len(ids), len(batches), max(batches))


def test_paragraph_packs_against_the_function(spark, sf):
    texts = {r["id"]: r["content"] for r in catalog._texts(spark, sf).collect()}
    for r in catalog.paragraph_packs(spark, sf).collect():
        sizes = [len(p) for p in texts[r["id"]].split("\n\n") if p.strip(" ")]
        groups = {}
        for g, s in zip(K.pack(sizes, 600), sizes):
            groups[g] = groups.get(g, 0) + s
        assert (r["packs"], r["longest"]) == (len(groups), max(groups.values(), default=None))


def test_spreadsheets(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(files.sheet_package({"one": [["a", "1 < 2"], ["", "中文"]], "two": [["x"]]}))
    shared = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(files.sheet_package({"s": [["0", "1"]]}))) as z, zipfile.ZipFile(shared, "w") as out:
        for n in z.namelist():
            if "sheet1" not in n:
                out.writestr(n, z.read(n))
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        out.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>first</t></si><si><t>se</t><t>cond</t></si></sst>')
        out.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="3"><c r="B3" t="s"><v>1</v></c><c r="D3"><v>2.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(shared.getvalue())
    (tmp_path / "c.xlsx").write_bytes(b"broken")
    got = {(r["path"][-6], r["sheet"], r["row_no"]): r["cells"] for r in files.sheets(files.files(spark, str(tmp_path))).collect()}
    assert got == {("a", "one", 1): ["a", "1 < 2"], ("a", "one", 2): ["", "中文"], ("a", "two", 1): ["x"], ("b", "s", 3): ["", "second", "", "2.5"], ("c", "error", 0): ["BadZipFile"]}


def test_json_lines_with_broken_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\nbroken\n{"t": "y"}\n')
    r = files.json_lines(spark, str(tmp_path / "a.jsonl"), "id long, t string")
    assert sorted((x["id"] or 0, x["t"] or "") for x in r.collect()) == [(0, ""), (0, "y"), (1, "x")]
    assert r.where(F.col("id").isNull()).count() == 2
