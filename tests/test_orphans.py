import datetime as dt

from veinstone.operators.orphans import Ledger, parents, references

T = [dt.datetime(2024, 1, d) for d in range(1, 29)]
CHUNK = "id long, del_flag boolean, create_time timestamp_ntz, key string"
EVIDENCE = "id long, chunk_id long, create_time timestamp_ntz, state string, target string"


def refs(spark, rows):
    return references(spark.createDataFrame([(*r, "x", "y") for r in rows], EVIDENCE), "evidence", "chunk_id", "chunk")


def chunks(spark, rows):
    return parents(spark.createDataFrame([(*r, "k") for r in rows], CHUNK), "chunk", deleted="del_flag")


def kinds(ledger):
    return {(r["id"]): r["kind"] for r in ledger.orphans().collect()}


def test_states(spark):
    c = chunks(spark, [(1, False, T[0]), (2, True, T[0]), (3, False, T[9]), (4, None, None), (1, False, T[0])])
    r = refs(spark, [(10, 1, T[5]), (11, 2, T[5]), (12, 3, T[5]), (13, 99, T[5]), (14, None, T[5]), (15, 3, None), (16, 4, T[0]), (13, 99, T[5])])
    assert kinds(Ledger.start(c, r)) == {11: "deleted", 12: "late", 13: "missing"}


def test_steps_give_what_one_load_gives(spark):
    c = [(i, i % 7 == 0, T[i % 20]) for i in range(1, 60)]
    r = [(i, i % 80 if i % 5 else 13, T[(i * 3) % 25] if i % 11 else None) for i in range(400)]  # a fifth names one key
    whole = kinds(Ledger.start(chunks(spark, c), refs(spark, r)))
    alive = [(i, False, t) for i, _, t in c]
    ledger = Ledger.start(chunks(spark, alive[:20]), refs(spark, r[:150]))
    assert ledger.latest().where("state = 'missing'").count() > 50
    ledger = ledger.step(chunks(spark, alive[20:]), refs(spark, r[100:]))  # parents resolve what waits; some references come again
    ledger = ledger.step(chunks(spark, [x for x in c if x[1]]), refs(spark, []))  # deletions reopen
    assert kinds(ledger) == whole


def test_snapshot_and_empty(spark):
    ledger = Ledger.start(chunks(spark, []), refs(spark, [(1, 5, T[0]), (2, 5, None)]))
    assert {(r["period"], r["kind"]): r["orphans"] for r in ledger.counts().collect()} == {("2024-01", "missing"): 1, (None, "missing"): 1}
    assert kinds(Ledger.start(chunks(spark, []), refs(spark, []))) == {}


def test_repointed_and_repeated_references(spark):
    """A reference delivered again with another key is judged by that key, and its old key no longer moves it."""
    ledger = Ledger.start(chunks(spark, [(1, False, T[0]), (2, False, T[0])]), refs(spark, [(10, 1, T[5]), (11, 77, T[5]), (12, 2, T[5])]))
    assert kinds(ledger) == {11: "missing"}
    ledger = ledger.step(chunks(spark, []), refs(spark, [(10, 99, T[5]), (11, 1, T[5]), (12, None, T[5])]))
    assert kinds(ledger) == {10: "missing"}
    ledger = ledger.step(chunks(spark, [(1, True, T[0]), (77, True, T[0]), (2, True, T[0])]), refs(spark, []))
    assert kinds(ledger) == {10: "missing", 11: "deleted"}
    # Two rows of one reference in one delivery: the later one counts, whatever the order.
    for rows in ([(5, 1, T[1]), (5, 42, T[2])], [(5, 42, T[2]), (5, 1, T[1])]):
        assert kinds(Ledger.start(chunks(spark, [(1, False, T[0])]), refs(spark, rows))) == {5: "missing"}


def test_a_step_writes_what_changed_and_snapshots_are_kept(spark):
    c = [(i, False, T[0]) for i in range(500)]
    ledger = Ledger.start(chunks(spark, c), refs(spark, [(i, i, T[5]) for i in range(500)]), snapshot=True)
    ledger = ledger.step(chunks(spark, [(7, True, T[0])]), refs(spark, []), snapshot=True)
    written = ledger._read("refs", "source_table string, ref_field string, id long, target string, key long, time timestamp_ntz, state tinyint, delivered int, step int, bucket int")
    assert {r["step"]: r["count"] for r in written.groupBy("step").count().collect()} == {1: 500, 2: 1}
    assert [(r["step"], r["kind"], r["orphans"]) for r in ledger.history().orderBy("step").collect()] == [(2, "deleted", 1)]


def test_heavy_keys_are_spread_and_give_the_plain_join(spark, monkeypatch):
    from pyspark.sql import functions as F

    from veinstone import session

    left = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id")).alias("key"))
    right = spark.range(10_000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    plain = session.salted_left_join(left, right, "key", "id")
    monkeypatch.setattr(session, "SMALL", 0)
    heavy, salts = session.heavy_keys(left, "key")
    assert len(heavy) == 1 and salts > 50
    spread = session.salted_left_join(left, right, "key", "id")
    assert spread.count() == 20_000 and not spread.exceptAll(plain).limit(1).count()
