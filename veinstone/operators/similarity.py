"""Near-duplicate labels, sequence similarity, quote alignment and exact vector search."""

from __future__ import annotations

import difflib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinstone.functions import text as T

SEEDS, BANDS = 32, 8


def minhash(shingles: Column, seeds: int = SEEDS) -> Column:
    """Minimum of a seeded hash over the shingles, for each seed. The shingles are gone through once, not once a seed."""
    all_ = F.sequence(F.lit(0), F.lit(seeds - 1))
    most = F.array_repeat(F.lit((1 << 63) - 1), seeds)
    return F.aggregate(shingles, most, lambda least, x: F.zip_with(least, F.transform(all_, lambda s: F.xxhash64(s, x)), lambda p, q: F.least(p, q)))


def bands(signature: Column, n: int = BANDS, rows: int = SEEDS // BANDS) -> Column:
    """One key a band. Written out, not as a lambda, in which the signature would be computed anew for each band."""
    return F.array(*[F.xxhash64(F.lit(b), F.slice(signature, b * rows + 1, rows)) for b in range(n)])


def ratio(a: str, b: str) -> float:
    """Ratio of matching blocks of two strings."""
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def ratio_from(least: float):
    """The ratio where it may reach ``least`` by its upper bounds, which cost little; else 0."""

    def measure(a: str, b: str) -> float:
        m = difflib.SequenceMatcher(None, a, b, autojunk=False)
        return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0

    return measure


def overlap(a: str, b: str) -> float:
    """Longest common substring by the shorter length; containment is 1."""
    if not a or not b:
        return 0.0
    if a in b or b in a:
        return 1.0
    return difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size / min(len(a), len(b))


def window_size(n: Column | int) -> Column | int:
    """The least length of a common substring of an overlap of 0.72, of the shorter label's length."""
    size = (72 * n + 99) / 100
    return F.floor(size) if isinstance(n, Column) else int(size)


#: Counters of parts that reach the driver.
COUNTERS = 1 << 16


def part_counts(parts: DataFrame, part: str) -> np.ndarray:
    """How often parts occur, by their checksum: ``COUNTERS`` numbers. Parts that share a counter are taken for more frequent, no more."""
    found = parts.groupBy(F.pmod(F.crc32(F.col(part).cast("binary")), F.lit(COUNTERS)).alias("i")).agg(F.count("*").alias("f")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[found["i"].to_numpy()] = found["f"].to_numpy()
    return counts


def windows(df: DataFrame, by: list[str], label: str, counts: np.ndarray) -> DataFrame:
    """(by, window, part): the windows of each label and of each window its rarest part of three characters, by ``counts``. Labels have three characters or more."""
    shared = df.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            row, window, part = [], [], []
            for r, text in enumerate(b.column(len(by)).to_pylist()):
                w = window_size(len(text))
                parts = [text[i : i + 3] for i in range(len(text) - 2)]
                ranks = [(often[zlib.crc32(p.encode()) % COUNTERS], p) for p in parts]
                least = -1
                for i in range(len(text) - w + 1):
                    if least < i:
                        least = min(range(i, i + w - 2), key=ranks.__getitem__)
                    elif ranks[i + w - 3] < ranks[least]:
                        least = i + w - 3
                    row.append(r)
                    window.append(text[i : i + w])
                    part.append(parts[least])
            at = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(by))), pa.array(window, pa.string()), pa.array(part, pa.string())], [*by, "window", "part"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    return df.select(*by, label).mapInArrow(run, f"{kinds}, window string, part string")


def _pairwise(measure, a: Column, b: Column) -> Column:
    """A measure of two strings, batch by batch; null if either is null."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([measure(p, q) if p is not None and q is not None else None for p, q in zip(x, y)], dtype=float)

    return F.pandas_udf(run, "double")(a, b)


def near_best(pairs: DataFrame, a: str, b: str, order: str, least: float, shortest: int = 6) -> DataFrame:
    """(a, b, ratio): pairs that reach ``least``, 0.9 where the one holds the other, without those that are known to be worse than another of the same ``a``.

    The pairs of one ``a`` come together, by ``order``; a ratio is computed only where its upper bounds reach the best so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = None, least
        for batch in batches:
            found = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x != own:
                    own, best = x, least
                if x in y or y in x:
                    r = 0.9
                elif min(len(x), len(y)) < shortest:
                    continue
                else:
                    m, floor = difflib.SequenceMatcher(None, x, y, autojunk=False), max(least, best - 1e-6)  # ratios are rounded
                    r = m.ratio() if m.real_quick_ratio() >= floor and m.quick_ratio() >= floor else 0.0
                r = round(r, 6)
                if r >= least:
                    best = max(best, r)
                    found.append((x, y, r))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], [a, b, "ratio"])

    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(tasks, a).sortWithinPartitions(a, order).select(a, b).mapInArrow(run, f"{a} string, {b} string, ratio double")


def ratios(a: Column, b: Column) -> Column:
    return _pairwise(ratio, a, b)


def overlaps(a: Column, b: Column) -> Column:
    return _pairwise(overlap, a, b)


def label_groups(df: DataFrame, key: str, name: str, by: list[str]) -> DataFrame:
    """(class, representative text, members): names of one scope that are equal as labels. Members are counted, not listed."""
    labelled = df.select(key, *by, T.label(F.col(name)).alias("label")).where("label <> ''")
    return labelled.groupBy(*by, "label").agg(F.min(key).alias("class_id"), F.count("*").alias("members"))


def near_labels(df: DataFrame, by: list[str], label: str = "label", threshold: float = 0.88, longer: int = 6) -> DataFrame:
    """(by, a, b, similarity), a < b: distinct labels of one scope that share a band, or of which one holds the other, and that reach the threshold.

    Classes of equal labels come in as one row each. Similarity is 0.9 for containment of four characters or more, else
    the greater of Jaccard and block ratio. Pairs that share a band of the signature are compared, each once; pairs of containment
    with a length difference of up to ``longer`` are found exactly, as equal to what is left of the longer one without its ends.
    """
    rows = df.select(*by, F.col(label).alias("l")).distinct().where((F.length("l") >= 2) & (T.entropy(F.col("l")) >= 1.2))
    # Only labels and bands are shuffled; shingles come from the label where they are needed.
    keyed = rows.withColumn("sig", minhash(T.shingles(F.col("l")))).withColumn("band", F.explode(bands(F.col("sig")))).drop("sig")
    a = keyed.select(*by, "band", F.col("l").alias("a"))
    b = keyed.select(*by, "band", F.col("l").alias("b"))
    pairs = a.join(b, [*by, "band"]).where("a < b").dropDuplicates([*by, "a", "b"]).withColumn("sa", T.shingles(F.col("a"))).withColumn("sb", T.shingles(F.col("b")))
    contained = (F.least(F.length("a"), F.length("b")) >= 4) & (F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a")))
    sim = F.when(contained, F.lit(0.9)).otherwise(F.greatest(T.jaccard(F.col("sa"), F.col("sb")), _pairwise(ratio_from(threshold - 1e-6), F.col("a"), F.col("b"))))
    near = pairs.select(*by, "a", "b", F.round(sim, 6).alias("similarity"))
    # The parts of a label that are shorter by 1 to ``longer`` characters and have at least four.
    cuts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for d in range(1, longer + 1) for i in range(d + 1)])
    parts = F.array_distinct(F.transform(F.filter(cuts, lambda x: F.length("l") - x["d"] >= 4), lambda x: F.substring(F.col("l"), x["i"] + 1, F.length("l") - x["d"])))
    held = rows.select(*by, F.col("l").alias("whole"), F.explode(parts).alias("l")).join(rows.select(*by, "l"), [*by, "l"])
    inner = held.select(*by, F.least("l", "whole").alias("a"), F.greatest("l", "whole").alias("b"), F.lit(0.9).alias("similarity"))
    return near.unionByName(inner).where(F.col("similarity") >= threshold).dropDuplicates([*by, "a", "b"])


def align(quote: str, text: str) -> tuple[str, int, int]:
    """(state, begin, end) of a quote in a text: exact, without white space, by a common subsequence (up to 1.5 million pairs of characters), by matching blocks, or failed."""
    if not quote or not text:
        return "failed", -1, -1
    if (at := text.find(quote)) >= 0:
        return "exact", at, at + len(quote)
    where = [i for i, c in enumerate(text) if not c.isspace()]
    compact, wanted = "".join(text[i] for i in where).lower(), "".join(quote.split()).lower()
    if len(compact) != len(where) or not wanted:  # lower case changed the length
        compact = "".join(text[i] for i in where)
    if wanted and (at := compact.find(wanted)) >= 0:
        return "compact", where[at], where[at + len(wanted) - 1] + 1
    if not wanted:
        return "failed", -1, -1
    if len(compact) * len(wanted) <= 1_500_000 and (places := common_subsequence(compact, wanted)):
        span = places[-1] - places[0] + 1
        if len(places) / len(wanted) >= 0.75 and len(places) / span >= 0.33:
            return "subsequence", where[places[0]], where[places[-1]] + 1
    blocks = [m for m in difflib.SequenceMatcher(None, compact, wanted, autojunk=False).get_matching_blocks() if m.size > 1]
    if not blocks:
        return "failed", -1, -1
    covered, span = sum(m.size for m in blocks), blocks[-1].a + blocks[-1].size - blocks[0].a
    if covered / len(wanted) >= 0.85 and covered / span >= 0.65:
        return "blocks", where[blocks[0].a], where[blocks[-1].a + blocks[-1].size - 1] + 1
    return "failed", -1, -1


def common_subsequence(text: str, wanted: str) -> list[int]:
    """Places in the text of a longest common subsequence. Row by row: a row is the running maximum over the row before."""
    t, w = np.array([ord(c) for c in text], np.uint32), [ord(c) for c in wanted]
    rows = [np.zeros(len(t) + 1, np.int16)]
    for c in w:
        up = rows[-1]
        row = up.copy()
        row[1:] = np.maximum(up[1:], up[:-1] + (t == c))
        rows.append(np.maximum.accumulate(row))
    out, i, j = [], len(w), len(t)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(j)
    return out[::-1]


def align_quotes(pairs: DataFrame, key: str, quote: str, text: str) -> DataFrame:
    """(key, state, begin, end). The exact stage is built in; only what it leaves goes through Python."""
    at = F.expr(f"instr(`{text}`, `{quote}`)")
    found = pairs.withColumn("_at", at)
    exact = found.where(F.col("_at") > 0).select(key, F.lit("exact").alias("state"), (F.col("_at") - 1).cast("int").alias("begin"), (F.col("_at") - 1 + F.length(quote)).cast("int").alias("end"))
    rest = found.where((F.col("_at") == 0) | F.col("_at").isNull()).select(F.col(key).alias("k"), F.col(quote).alias("q"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [align(q, t) for q, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32())], ["k", "state", "begin", "end"])

    kind = rest.schema["k"].dataType.simpleString()
    return exact.unionByName(rest.mapInArrow(run, f"k {kind}, state string, begin int, end int").withColumnRenamed("k", key))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


#: Bytes of query vectors that are broadcast at once.
QUERY_BYTES = 64 << 20


def search_exact(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int | None = None) -> DataFrame:
    """(query, id, score, place): the k best of all vectors for each query, by exact cosine.

    The queries are a stated set. They come in blocks of bounded size (``QUERY_BYTES``, or ``block`` queries), each broadcast as one matrix that
    all vectors pass; a task keeps the k best of each query, so that k rows a query and task are shuffled. Rows without a
    vector, or with one of another length than the queries', are neither.
    """
    spark = vectors.sparkSession
    q = queries.select(F.col(key).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).where("q IS NOT NULL AND size(v) > 0")
    stats = q.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = stats["dim"] or 0
    per = block or max(1, QUERY_BYTES // max(1, 8 * dim))
    blocks = max(1, -(-stats["n"] // per))
    source = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dim)
    found = None
    for b in range(blocks):
        one = q.where(F.size("v") == dim).where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).orderBy("q").toPandas()
        if not len(one):
            continue
        m = np.array(one["v"].to_list(), np.float64)
        shared = spark.sparkContext.broadcast((one["q"].to_numpy(np.int64), m, np.linalg.norm(m, axis=1)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, m, norms = shared.value
            best: list[list[tuple[float, int]]] = [[] for _ in asked]
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(0).to_numpy()
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = np.nan_to_num((m @ v.T) / norms[:, None] / np.linalg.norm(v, axis=1), nan=-2.0).round(6)
                for i, scores in enumerate(s):
                    few = np.flatnonzero(scores >= np.partition(scores, max(0, len(scores) - k - 1))[max(0, len(scores) - k - 1)])
                    own = best[i] + [(-float(scores[j]), int(ids[j])) for j in few if ids[j] != asked[i]]
                    best[i] = sorted(own)[:k]
            flat = [(int(a), i, -s) for a, own in zip(asked, best) for s, i in own]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in flat], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query", "id", "score"])

        part = source.mapInArrow(run, "query long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query long, id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
