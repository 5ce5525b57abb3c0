"""Visually identical text with different characters: one form for all texts that read the same on the page.

A text is brought into compatibility form, ignorable characters are deleted, kinds of space become one. What is left are
look-alike letters. Each token of letters spans a lattice: at every position stand the letters of all scripts that look
like the one found. The way through the lattice is searched by Viterbi under character bigram scores of each script,
with a charge on changing the script within a token. Scores are counted over the whole corpus. As the lattice depends on
what a token looks like and on nothing else, tokens that look alike come out equal, and tokens that don't stay apart.

Defined results: a null text has a null form and is in no pair; an empty text stays empty; texts are read whole; a row
delivered twice counts once; case, digits, punctuation marks, accents, words and line breaks are never changed
(a carriage return before a line feed is no line break of its own); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.session import cut

# Letters of other scripts that look like Latin letters.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԚԜаеорсухѕіјһԁԛԝӏ", "ABESIJKMHOPCTYXYQWaeopcyxsijhdqwl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿονραιυχκϳ", "ABEZHIKMNOPTYXJovpaiuxkj"))
ARMENIAN = dict(zip("ՕՏՍօսհցզո", "OSUouhgqn"))
LATIN = dict(zip("ɑɡ", "ag"))
# CJK radicals and the ideographs they look like, where the compatibility form doesn't join them.
RADICALS = dict(
    zip(
        "⺁⺅⺈⺉⺊⺎⺒⺓⺔⺖⺘⺙⺛⺜⺝⺞⺠⺡⺢⺣⺤⺦⺧⺨⺩⺫⺬⺭⺰⺱⺲⺶⺹⺻⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻇⻈⻉⻋⻌⻏⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲",
        "厂亻刀刂卜兀巳幺彑忄扌攵旡日月歺民氵氺灬爫丬牛犭王目示礻纟罓罒羊耂聿月臼艹艹艹虎衤覀西见角角讠贝车辶阝钅長镸长门阜阝雨青韦页风飞食飠饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀",
    )
)
RADICALS["⻳"] = "龟"
# Ideographs of the same look under several code points.
IDEOGRAPHS = dict(zip("戶戸靑黃內吿淸說兌銳悅稅脫", "户户青黄内告清説兑鋭悦税脱"))

SCRIPTS = ("latin", "greek", "cyrillic", "armenian")
#: Members of one class of look-alikes that a task takes on.
SPREAD = 1000
#: Log charge for a change of script within a token.
CHANGE = 12.0
#: Code points below this one are counted by script; all letters of the look-alike scripts lie there.
_ALPHABETS = 0x590

_IGNORABLE = re.compile(
    r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]+"
)
_OTHER_SPACE = re.compile(r"[\t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_CJK = str.maketrans(RADICALS | IDEOGRAPHS)
_CJK_FOUND = re.compile("[" + "".join(RADICALS | IDEOGRAPHS) + "]")
_FOREIGN = {**CYRILLIC, **GREEK, **ARMENIAN, **LATIN}
#: Letters of the look-alike scripts and combining marks; Greek, Cyrillic, Armenian and phonetic letters among them.
_LETTER = r"A-Za-z\u00c0-\u024f\u0250-\u02af\u0370-\u058f\u1e00-\u1fff\u0300-\u036f"
_MIXED = re.compile(rf"[{_LETTER}]*[\u0250-\u02af\u0370-\u058f\u1f00-\u1fff][{_LETTER}]*")
_TOKEN = re.compile(f"[{_LETTER}]+")


def script_of(c: str) -> str | None:
    o = ord(c)
    if o < 0x2B0 and c.isalpha():
        return "latin"
    if 0x370 <= o < 0x400:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x530 <= o < 0x590:
        return "armenian"
    return None


def look(c: str) -> str:
    """What the letter looks like: a Latin letter, or itself."""
    return _FOREIGN.get(c, c)


def _members() -> dict[str, dict[str, str]]:
    """look -> script -> letter."""
    out: dict[str, dict[str, str]] = {}
    for script, letters in (("greek", GREEK), ("cyrillic", CYRILLIC), ("armenian", ARMENIAN)):
        for c, x in letters.items():
            out.setdefault(x, {"latin": x}).setdefault(script, c)
    return out


MEMBERS = _members()


class Model:
    """Bigram scores of the scripts. counts: (first letter, second letter) -> times, both of one script."""

    def __init__(self, counts: Mapping[tuple[str, str], int]):
        self.pairs: dict[str, dict[tuple[str, str], int]] = {s: {} for s in SCRIPTS}
        self.singles: dict[str, dict[str, int]] = {s: {} for s in SCRIPTS}
        for (a, b), n in counts.items():
            s = script_of(a)
            if s and s == script_of(b):
                self.pairs[s][a, b] = self.pairs[s].get((a, b), 0) + n
                self.singles[s][a] = self.singles[s].get(a, 0) + n
        self.sums = {s: sum(x.values()) for s, x in self.singles.items()}
        total = sum(self.sums.values()) + 1
        #: Log share of each script in all letters; it counts at every letter, so that a script without data never gains by it.
        self.share = {s: math.log((n + (1 if s == "latin" else 0.1)) / total) for s, n in self.sums.items()}
        self.cache: dict[str, str] = {}

    def single(self, c: str, script: str) -> float:
        return (self.singles[script].get(c, 0) + 0.5) / (self.sums[script] + 50)

    def first(self, c: str, script: str) -> float:
        return self.share[script] + math.log(self.single(c, script))

    def next(self, a: str, b: str, script: str) -> float:
        n = self.singles[script].get(a, 0)
        back = 10 + 0.1 * n  # weight of the single letter where the pair is rare
        return self.share[script] + math.log((self.pairs[script].get((a, b), 0) + back * self.single(b, script)) / (n + back))

    def latin_wins(self) -> bool:
        """Whether Latin is the better way at each letter and pair, so that plain Latin tokens come out as they are."""
        for script in SCRIPTS[1:]:
            both = [(x, by[script]) for x, by in MEMBERS.items() if script in by]
            for x, c in both:
                if self.first(c, script) >= self.first(x, "latin") or any(self.next(c, d, script) >= self.next(x, y, "latin") for y, d in both):
                    return False
        return True

    def resolve(self, token: str) -> str:
        """The token of letters and marks, in the letters of the best way through its lattice."""
        if (done := self.cache.get(token)) is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            done = self.cache[token] = self._viterbi(unicodedata.normalize("NFD", token))
        return done

    def _viterbi(self, token: str) -> str:
        marks, looks = [], []
        for c in token:
            if unicodedata.combining(c) and looks:
                marks[-1] += c
            else:
                looks.append(look(c))
                marks.append("")
        best: dict[str, tuple[float, str]] = {}
        last: dict[str, str] = {}
        for i, x in enumerate(looks):
            here = MEMBERS.get(x) or {script_of(x) or "latin": x}
            step = {}
            for script, c in here.items():
                if i == 0:
                    step[script] = (self.first(c, script), c)
                    continue
                ways = []
                for before, (score, path) in best.items():
                    if before == script:
                        ways.append((score + self.next(last[before], c, script), path))
                    else:
                        ways.append((score - CHANGE + self.first(c, script), path))
                score, path = max(ways, key=lambda w: w[0])
                step[script] = (score, path + c)
            best, last = step, {s: p[-1] for s, (_, p) in step.items()}
        path = max(best.values(), key=lambda w: w[0])[1] if best else ""
        return unicodedata.normalize("NFC", "".join(c + m for c, m in zip(path, marks)))


def canonical(text: str, model: Model, plain: bool) -> str:
    """The one form of all texts that read like this one. plain: Latin tokens need no search (``latin_wins``)."""
    if not text.isascii():
        text = _IGNORABLE.sub("", text)
        text = unicodedata.normalize("NFKC", text)
        text = _IGNORABLE.sub("", text)
        if _CJK_FOUND.search(text):
            text = text.translate(_CJK)
        text = (_MIXED if plain else _TOKEN).sub(lambda m: model.resolve(m.group()), text)
    elif not plain:
        text = _TOKEN.sub(lambda m: model.resolve(m.group()), text)
    return _OTHER_SPACE.sub(" ", text).replace("\r\n", "\n")


def train(texts: DataFrame) -> Model:
    """The model from all texts of a one-column frame. What comes to the driver is bounded by the alphabets, not by the texts."""
    script = np.zeros(_ALPHABETS + 1, np.uint8)
    for o in range(_ALPHABETS):
        script[o] = SCRIPTS.index(script_of(chr(o))) + 1 if script_of(chr(o)) else 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            whole = "\n".join(t for t in b.column(0).to_pylist() if t)
            points = np.minimum(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), _ALPHABETS)
            s = script[points]
            at = np.flatnonzero((s[1:] == s[:-1]) & (s[1:] > 0))
            seen = np.bincount(points[at].astype(np.int64) * _ALPHABETS + points[at + 1], minlength=_ALPHABETS**2)
            total = seen if not len(total) else total + seen
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["pair", "n"])

    source = texts.select(F.col(texts.columns[0]).alias("t")).where("t IS NOT NULL")
    rows = source.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return Model({(chr(r["pair"] // _ALPHABETS), chr(r["pair"] % _ALPHABETS)): r["n"] for r in rows})


def _map_text(df: DataFrame, text: str, model: Model, out: str, make) -> DataFrame:
    """df without its text, and with the columns of ``out`` that ``make`` gives for the text."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the alphabets
    plain = model.latin_wins()
    rest = [c for c in df.columns if c != text]
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(f"`{text}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            arrays, names = make(b.column(b.num_columns - 1).to_pylist(), own, plain)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], [*b.schema.names[:-1], *names])

    fields = [f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(rest))]
    done = source.mapInArrow(run, ", ".join([*fields, out]))
    made = [c for c in done.columns if not re.fullmatch(r"c\d+", c)]
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *made)


def one_form(df: DataFrame, text: str, model: Model | None = None) -> DataFrame:
    """df with the text replaced by ``form``, its one form."""
    model = model or train(df.select(text))

    def make(texts, own, plain):
        return [pa.array([None if t is None else canonical(t, own, plain) for t in texts], pa.string())], ["form"]

    return _map_text(df, text, model, "form string", make)


def equal_looking(df: DataFrame, key: str, text: str, within: list[str | Column], model: Model | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows of the same ``within`` whose texts read the same and differ in their characters.

    What is shuffled per row are two hashes of 128 bits, not the text. Only groups with two different texts of one
    form go into the join; a large one is spread by the row.
    """
    model = model or train(df.select(text))
    rows = df.select(F.col(key).alias("id"), *[(F.col(c) if isinstance(c, str) else c).alias(f"g{i}") for i, c in enumerate(within)], F.col(text).alias("t")).where("t IS NOT NULL")

    def make(texts, own, plain):
        import xxhash

        form = [xxhash.xxh3_128_digest(canonical(t, own, plain).encode("utf-8", "surrogatepass")) for t in texts]
        raw = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
        return [pa.array(form, pa.binary()), pa.array(raw, pa.binary())], ["form", "raw"]

    hashed = _map_text(rows, "t", model, "form binary, raw binary", make)
    by = [f"g{i}" for i in range(len(within))] + ["form"]
    hashed = cut(hashed.dropna(subset=by[:-1]).distinct() if within else hashed.distinct(), "forms")
    # A class of many members is spread over as many tasks as it has thousands: its pairs are the result, but no single task makes them all.
    several = hashed.groupBy(*by).agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.ceil(F.count("*") / SPREAD).cast("int").alias("salts")).where("low <> high").drop("low", "high")
    kept = hashed.join(several, by)
    a = kept.select(*by, F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias("id_a"), F.col("raw").alias("raw_a"))
    b = kept.select(*by, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("id_b"), F.col("raw").alias("raw_b"))
    return a.join(b, [*by, "salt"]).where("id_a < id_b AND raw_a <> raw_b").select("id_a", "id_b").distinct()
