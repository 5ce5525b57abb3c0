"""Most similar vectors for every vector: a hash-prefix forest.

Each tree gives every vector a long hash string, one bit per hyperplane. Sorted, the strings of a tree are a sorted
array, in which the vectors that share a prefix with a given one are a range. Every vector descends in all trees to its
longest-prefix matches and ascends from there, in all trees at once: level by level the prefix gets shorter by a bit,
the same in each tree, until the ranges of all trees together hold as many candidates as are wanted (``leaf`` a tree on
average). So a tree in which a vector lies in a crowd gives it many candidates and one in which it lies alone gives few.
The sizes of ranges that the ascent needs are read from sorted arrays of a bounded sample; the ranges themselves come from the whole arrays. A tree's
array is cut at prefixes into parts that tasks hold one after another (prefixes found on the same sample), and candidates are scored there
by matrix products; what the trees find is joined and ranked by the exact cosine.

A string that is too common to be cut by its bits (a crowd of near copies) gets further bits from hyperplanes around the crowd's
own centre, as often as needed, so a crowd is searched as a forest of its own.

How many trees are needed follows from the theory of the hash: two vectors of cosine c share a bit with probability
p = 1 - acos(c)/pi, so with n vectors and ranges of size m they meet in a tree with probability p ** log2(n/m), see
``trees_needed``. The work for a vector is trees x leaf, and trees grow like n ** 0.22 at a cosine of 0.9. A tree moves half a
byte a dimension or one (``bits``); exact values are only fetched for the pairs that are left.

Copies: vectors equal in all their values form one class, of which a single member goes through the forest; members
come back at the end (the ones of smallest id first, as ties go), so a vector repeated in a third of all rows costs no more than one.

What may be lost: neighbours that meet in no tree (``recall``), and of more than ``keep`` candidates that the quantised form can't tell
from the k-th (``MARGIN``) those behind. Both are in the measured recall.

Defined results: rows with a null id, and vectors that are null, empty, of another length, all zero or not finite,
have no neighbours and are nobody's neighbour; a row delivered twice counts once; ties go by smaller id; fewer than
``k`` others give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinstone.session import cut, salted_left_join

BITS = 60
#: About so many vectors make the sample on which centre and cells are fitted; every row is indexed all the same.
SAMPLE = 20_000
#: Cosine that the quantised form of so many bits may lose; pairs this far below the wanted least similarity are still verified exactly.
SLACK = {8: 0.006, 4: 0.065}
#: By how much the quantised form of so many bits may put two candidates in the wrong order: all within it of the k-th are verified exactly.
MARGIN = {8: 0.004, 4: 0.065}
#: Vectors of a part of a sorted array that a task holds, as a multiple of ``leaf``.
PART = 8


def trees_needed(n: int, leaf: int, cosine: float, recall: float) -> int:
    """Trees after which two vectors of that cosine have met with probability ``recall``."""
    p = (1 - math.acos(min(1.0, cosine)) / math.pi) ** max(0.0, math.log2(max(1, n) / leaf) + 0.5)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p))) if p < 1 else 1


def usable(batch: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of usable vectors of a list array, and those vectors as float32 rows."""
    lists = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
    offsets = lists.offsets.to_numpy()
    valid = np.asarray(lists.is_valid()) if lists.null_count else np.ones(len(lists), bool)
    rows = np.flatnonzero(valid & (np.diff(offsets) == dim))
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)  # nulls become NaN
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    x = values[offsets[rows][:, None] + np.arange(dim)]
    good = np.isfinite(x).all(axis=1) & x.any(axis=1)
    return rows[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def quantise(x: np.ndarray, bits: int = 8) -> np.ndarray:
    """Vectors as rows of bytes, one number a byte or two, each vector scaled to its own largest value."""
    top = 127 if bits == 8 else 7
    q = np.rint(x * (top / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)
    if bits == 8:
        return q
    if q.shape[1] % 2:
        q = np.pad(q, ((0, 0), (0, 1)))
    u = (q + 8).astype(np.uint8)
    return u[:, ::2] << 4 | u[:, 1::2]


def dequantise(data: bytes, n: int, dim: int, bits: int = 8) -> np.ndarray:
    """Unit vectors of what ``quantise`` made."""
    if bits == 8:
        x = np.frombuffer(data, np.int8).reshape(n, dim).astype(np.float32)
    else:
        u = np.frombuffer(data, np.uint8).reshape(n, -1)
        x = np.empty((n, 2 * u.shape[1]), np.float32)
        x[:, ::2], x[:, 1::2] = u >> 4, u & 15
        x = x[:, :dim] - 8
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Tree:
    """Hyperplanes, and what a sample says of the sorted array: sizes of ranges, first strings of the parts, crowds."""

    def __init__(self, planes: np.ndarray, sample: np.ndarray, per: int, parts: list[int], rng: np.random.Generator, depth: int = 0):
        self.planes = planes / np.linalg.norm(planes, axis=1, keepdims=True)
        self.offset = self.planes @ (sample.mean(axis=0) if len(sample) else np.zeros(planes.shape[1], np.float32))
        h = self.strings(sample)
        self.sample = np.sort(h)
        self.starts, crowds = self._parts(per)
        self.first = parts[0]
        parts[0] += len(self.starts)
        self.crowds: dict[int, Tree] = {}
        for c in crowds:
            own = sample[h == c]
            if depth < 4 and (own != own[0]).any():
                self.crowds[c] = Tree(rng.standard_normal(planes.shape).astype(np.float32), own, per, parts, rng, depth + 1)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """The hash string of each vector; order of numbers is order of strings."""
        bits = np.zeros((len(x), 64), np.uint8)
        if len(x):
            bits[:, 64 - BITS :] = (x @ self.planes.T) > self.offset
        return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.int64)

    def _parts(self, per: int) -> tuple[np.ndarray, list[int]]:
        """First strings of the prefixes below which at most ``per`` sampled vectors lie, and the strings that more than so many share."""
        h = self.sample
        starts, crowds, todo = [], [], [(0, len(h), 0, 0)]
        while todo:
            a, b, bit, low = todo.pop()
            if b - a <= per or bit >= BITS:
                starts.append(low)
                if b - a > per:
                    crowds.append(low)
                continue
            half = low + (1 << (BITS - 1 - bit))
            m = a + int(np.searchsorted(h[a:b], half))
            todo += [(a, m, bit + 1, low), (m, b, bit + 1, half)]
        return np.array(sorted(starts), np.int64), crowds

    def size(self, h: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Sampled vectors that share the first ``level`` bits with each string."""
        low, high = ranges_of(h, level)
        return np.searchsorted(self.sample, high, "right") - np.searchsorted(self.sample, low, "left")

    def place(self, x: np.ndarray, h: np.ndarray, level: np.ndarray, share: float, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, string, level) of each vector; those of a crowd by the crowd's own tree, in which they ascend anew."""
        part = self.first + np.searchsorted(self.starts, h, "right") - 1
        for c, tree in self.crowds.items():
            own = np.flatnonzero(h == c)
            if len(own):
                x2 = x[own]
                h2 = tree.strings(x2)
                part[own], h[own], level[own] = tree.place(x2, h2, ascend([tree], [h2], share, leaf), share, leaf)
        return part, h, level


def ranges_of(h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest string that share the first ``level`` bits."""
    mask = (np.int64(1) << (BITS - level).astype(np.int64)) - 1
    return h & ~mask, h | mask


def ascend(trees: list[Tree], h: list[np.ndarray], share: float, leaf: int) -> np.ndarray:
    """The level at which each vector's ascent ends: the longest prefix under which all trees together hold leaf candidates a tree.

    share: the part of all vectors that is in the sample. Below what the sample can tell (two sampled vectors a tree)
    each further bit is taken to halve a range.
    """
    wanted = len(trees) * leaf * share
    told = max(wanted, 2.0 * len(trees))
    low, high = np.zeros(len(h[0]), np.int64), np.full(len(h[0]), BITS, np.int64)
    while (low < high).any():
        middle = (low + high + 1) // 2
        enough = sum(t.size(s, middle) for t, s in zip(trees, h)) >= told
        low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
    return np.minimum(BITS, low + int(math.log2(told / wanted)))


class Forest:
    """All trees, fitted on a sample of unit vectors. share: the part of all vectors that the sample is."""

    def __init__(self, sample: np.ndarray, n: int, trees: int, leaf: int, seed: int, adapt: float = 0.0):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        turn = np.eye(dim, dtype=np.float32)
        if adapt and len(sample) > dim:
            # Normals drawn along the directions in which the sample varies: near vectors part later, others sooner.
            w, v = np.linalg.eigh(np.cov((sample - sample.mean(axis=0)).T))
            turn = (v * np.maximum(w, 1e-12) ** adapt).T.astype(np.float32)
        self.share, self.leaf, parts = len(sample) / max(1, n), leaf, [0]
        per = max(1, round(self.share * PART * leaf))
        self.trees = [Tree(rng.standard_normal((BITS, dim)).astype(np.float32) @ turn, sample, per, parts, rng) for _ in range(trees)]
        self.parts = parts[0]

    def place(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(part, string, level) of unit vectors in each tree."""
        h = [t.strings(x) for t in self.trees]
        level = ascend(self.trees, h, self.share, self.leaf)
        for t, s in zip(self.trees, h):
            yield t.place(x, s, level.copy(), self.share, self.leaf)


def matches(h: np.ndarray, level: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
    """(rows, a, b): rows of a sorted array and the range [a, b) of the vectors that share their prefix, rows of one range together."""
    low, high = ranges_of(h, level)
    a, b = np.searchsorted(h, low, "left"), np.searchsorted(h, high, "right")
    key = a * (len(h) + 1) + b
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    return [(rows, int(a[rows[0]]), int(b[rows[0]])) for rows in np.split(order, cuts) if len(rows)]


def best_of(
    ids: np.ndarray, x: np.ndarray, rows: np.ndarray, a: int, b: int, k: int, keep: int, margin: float, least: float
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, candidate, cosine) of some rows and the candidates [a, b): of each row the k best that reach ``least`` and what comes within the margin of them, ``keep`` at most."""
    n = b - a
    if n < 2:
        return
    step = max(1, (4 << 20) // n)
    for i in range(0, len(rows), step):
        r = rows[i : i + step]
        s = x[r] @ x[a:b].T
        s[np.arange(len(r)), r - a] = -2
        rest = np.arange(len(r))
        if least > -1:
            f, t = np.divmod(np.flatnonzero(s >= least), n)
            many = np.bincount(f, minlength=len(r)) > k
            light = ~many[f]
            if light.any():
                yield ids[r[f[light]]], ids[t[light] + a], s[f[light], t[light]]
            rest = np.flatnonzero(many)
        if len(rest):
            most = min(keep, n - 1)
            own = s[rest]
            best = np.argpartition(own, n - most, axis=1)[:, n - most :]
            near = np.take_along_axis(own, best, axis=1)
            kth = np.partition(near, max(0, most - k), axis=1)[:, max(0, most - k)]
            f, t = np.nonzero(near >= np.maximum(kth - margin, max(least, -1.5))[:, None])
            yield ids[r[rest[f]]], ids[best[f, t] + a], near[f, t]


def nearest(
    df: DataFrame, key: str, vector: str, dim: int, k: int = 10, least: float | None = None, recall: float = 0.99,
    leaf: int = 512, trees: int | None = None, adapt: float = 0.0, bits: int | None = None, keep: int | None = None, seed: int = 7,
) -> DataFrame:
    """(id, other, cosine, place): the k most similar others of each usable vector, place 1 being the most similar.

    least: only neighbours of at least that cosine are wanted; the number of trees is then chosen for pairs at that
    cosine. Otherwise ``trees`` and ``leaf`` say how far the search goes, and ``adapt`` how much hyperplanes follow the
    directions in which the vectors vary (0: not at all).
    """
    spark = df.sparkSession
    raw = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id IS NOT NULL AND size(v) = %d" % dim)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows, x = usable(b.column(1), dim)
            h = [xxhash.xxh3_128_digest(v.tobytes()) for v in x + np.float32(0)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(h, pa.binary()), pa.array([v.tobytes() for v in quantise(unit(x))] if len(x) else [], pa.binary())], ["id", "class", "q"])

    # One row a class: its smallest id and the int8 vector. The members stay a distributed table of two columns.
    marked = cut(raw.mapInArrow(classes, "id long, class binary, q binary"), "vectors")
    heads = cut(marked.groupBy("class").agg(F.min("id").alias("id"), F.first("q").alias("q"), F.max("id").alias("most")), "heads")
    n = heads.count()
    if trees is None:
        trees = trees_needed(n, leaf, least if least is not None else 0.9, recall)
    # About SAMPLE vectors, chosen by a hash of their values: the same at every run, and none is favoured.
    share = min(1 << 30, math.ceil((1 << 30) * SAMPLE / max(1, n)))
    sampled = heads.where(F.pmod(F.xxhash64("class"), F.lit(1 << 30)) < share).orderBy("class").select("q").toPandas()["q"] if n else []
    forest = Forest(dequantise(b"".join(sampled), len(sampled), dim) if len(sampled) else np.zeros((0, dim), np.float32), n, trees, leaf, seed, adapt)
    shared = spark.sparkContext.broadcast(forest)  # trees x (BITS x dim floats and SAMPLE strings): fixed by parameters
    bits = bits or (8 if least is None else 4)
    keep = keep or 8 * k
    floor = -1.0 if least is None else least - SLACK[bits]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            data = b"".join(b.column(1).to_pylist())
            x = dequantise(data, b.num_rows, dim)
            q = b.column(1) if bits == 8 else pa.array([v.tobytes() for v in quantise(x, bits)], pa.binary())
            for part, h, level in f.place(x):
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(h), pa.array(level.astype(np.int8)), b.column(0), q], ["part", "h", "level", "id", "q"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, kept = None, [], 0

        def work() -> Iterator[pa.RecordBatch]:
            nonlocal held, kept
            whole = pa.Table.from_batches(held).combine_chunks()
            held, kept = [], 0
            h, ids = whole.column(1).to_numpy(), whole.column(3).to_numpy()
            x = dequantise(b"".join(whole.column(4).to_pylist()), len(ids), dim, bits)
            out: list[list[np.ndarray]] = [[], [], []]
            size = 0
            for rows, a, b in matches(h, whole.column(2).to_numpy()):
                for found in best_of(ids, x, rows, a, b, k, keep, MARGIN[bits], floor):
                    for o, c in zip(out, found):
                        o.append(c)
                    size += len(found[0])
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["id", "other", "near"])
                    out, size = [[], [], []], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["id", "other", "near"])

        for b in batches:
            p = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                # What is held stays bounded even if a crowd can't be told apart in its quantised form; its order differs from tree to tree.
                if kept and (p[a] != part or kept > 8 * PART * leaf):
                    yield from work()
                part = p[a]
                held.append(b.slice(a, z - a))
                kept += z - a
        if kept:
            yield from work()

    tasks = max(8, min(4096, math.ceil(n * trees / (4 * PART * leaf))))
    strings = heads.select("id", "q").mapInArrow(emit, "part long, h long, level tinyint, id long, q binary")
    met = strings.repartition(tasks, "part").sortWithinPartitions("part", "h", F.xxhash64("id", "part")).mapInArrow(search, "id long, other long, near float")
    # What the trees found is joined and cut to the nearest of each vector. With a least cosine there are few pairs, most
    # of them found several times, and they are combined before the shuffle; else all goes by id in one shuffle.
    joined = (met if least is not None else met.repartition("id")).groupBy("id", "other").agg(F.max("near").alias("near"))
    nearest_first = Window.partitionBy("id").orderBy(F.desc("near"), "other")
    first = joined.withColumn("n", F.row_number().over(nearest_first)).where(F.col("n") <= keep)
    kth = F.min(F.when(F.col("n") <= k, F.col("near"))).over(Window.partitionBy("id"))
    pairs = cut(first.withColumn("kth", kth).where(F.col("near") >= F.col("kth") - MARGIN[bits]).select("id", "other"), "pairs")
    scored = _exact(raw, pairs, dim)
    if least is not None:
        scored = scored.where(F.col("cosine") >= least)
    return _with_members(scored, marked, heads, k)


def _exact(raw: DataFrame, pairs: DataFrame, dim: int) -> DataFrame:
    """pairs with the exact cosine. Each unordered pair is computed once, so that it is the same both ways."""
    once = cut(pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "once")
    # Written first, so that Spark knows its size: where few vectors are wanted the others aren't shuffled.
    wanted = cut(once.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    vectors = cut(raw.join(wanted, "id", "left_semi").dropDuplicates(["id"]), "exact")

    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        a, b = np.stack(x.to_list()).astype(np.float64), np.stack(y.to_list()).astype(np.float64)
        dot = (a * b).sum(axis=1)
        return pd.Series(dot / np.sqrt((a * a).sum(axis=1)) / np.sqrt((b * b).sum(axis=1)))

    kernel = F.pandas_udf(cosine, "double")
    # A vector may be near to any share of the others.
    half = salted_left_join(once, vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), "a", "b")
    both = salted_left_join(half, vectors.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b", "a").where("va IS NOT NULL AND vb IS NOT NULL")
    done = both.select("a", "b", F.round(kernel("va", "vb"), 9).alias("cosine"))
    return done.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("p"), "cosine").select("p.*", "cosine")


def _with_members(scored: DataFrame, marked: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """From neighbours of class heads to the k nearest of every member.

    What a member gets is decided once a class, in a list of at most k + 1 others, of which each member leaves out itself. Lists are
    one row a class, so however many members a class has, or vectors that it is near to, the joins are spread.
    """
    copies = heads.where("most > id").select("class", F.col("id").alias("head"))
    members = salted_left_join(marked.select("class", "id").distinct(), copies, "class", "id").where("head IS NOT NULL").select("head", F.col("id").alias("member"))
    # Of each class at most the k + 1 smallest ids, which are all that can count.
    order = Window.partitionBy("head").orderBy("member")
    first = members.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("head").agg(F.sort_array(F.collect_list("member")).alias("few"))
    by_class = salted_left_join(scored, first.select(F.col("head").alias("other"), "few"), "other", "id").select("id", "cosine", F.explode(F.coalesce("few", F.array("other"))).alias("other"))
    own = first.select(F.col("head").alias("id"), F.lit(1.0).alias("cosine"), F.explode("few").alias("other"))
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    ranked = by_class.unionByName(own).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "other", "cosine"))).alias("near"))
    spread = salted_left_join(members, lists.select(F.col("id").alias("head"), "near"), "head", "member").select(F.col("member").alias("id"), "near")
    single = lists.join(copies.select(F.col("head").alias("id")), "id", "left_anti")
    mine = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)
    return single.unionByName(spread).select("id", F.posexplode(mine).alias("at", "x")).select("id", "x.other", "x.cosine", (F.col("at") + 1).alias("place"))


def close_pairs(neighbours: DataFrame, least: float, a: str, b: str) -> DataFrame:
    """Unordered pairs, a < b, where one is among the nearest of the other and the cosine is at least ``least``."""
    return neighbours.where(F.col("cosine") >= least).select(F.least("id", "other").alias(a), F.greatest("id", "other").alias(b)).distinct()
