import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veinstone.llm import tokens as T

public = pytest.importorskip("public_tokenizers")
own = T.encoder(T.default_ranks_path())
plain = T.Encoder(T.default_ranks_path(), compiled=False)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("'' slltrevmdSx12 .,!\n\t\r 　é中文😀<|>"), max_size=30))
def test_same_as_the_library(reference, t):
    assert own.encode([t])[0].tolist() == reference([t])[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_batches_decode_and_plain_merging(texts):
    flat, offsets = own.encode(texts)
    assert flat.tolist() == plain.encode(texts)[0].tolist()
    for i, t in enumerate(texts):
        assert own.decode(flat[offsets[i] : offsets[i + 1]].tolist()) == t


def test_contractions_and_special_strings(reference):
    texts = ["it's", "'s", " 's", "''s", "x'll've're'd", "!'s", "\n's", "'re'", "'r", "<|endoftext|> a", "a  \n\n  b   ", "don'tt"]
    flat, o = own.encode(texts)
    assert [flat[o[i] : o[i + 1]].tolist() for i in range(len(texts))] == reference(texts)


def test_offsets_cover_the_bytes():
    t = "Größe 中 it's  ok"
    spans = own.encode_with_offsets(t)
    assert spans[0][1] == 0 and spans[-1][2] == len(t.encode()) and all(a[2] == b[1] for a, b in zip(spans, spans[1:]))


def test_frame(spark, reference, monkeypatch):
    long = "word " * 50_000 + "中" * 10_000
    rows = [(1, "Hello world", 5), (2, None, 5), (3, "", 5), (1, "Hello world", 5), (4, long, 5)]
    df = spark.createDataFrame(rows, "k long, t string, ids int")
    got = [(r["k"], r["ids"]) for r in T.encode_corpus(df, "k", "t").collect()]
    assert sorted(got)[:4] == [(1, reference(["Hello world"])[0])] * 2 + [(2, []), (3, [])]
    assert dict(got)[4] == reference([long])[0]
    counts = T.count_tokens(df, "t", "n").select("k", "ids", "n").distinct().collect()
    assert {r["k"]: r["n"] for r in counts} == {k: len(i) for k, i in got}
    assert T.encode_corpus(df.where("k < 0"), "k", "t").count() == 0
    assert T.count_tokens(df.select("t"), "t", "n").agg(F.sum("n")).first()[0] == sum(len(i) for _, i in got)


def test_merging_of_a_long_slice_takes_little_time():
    import time

    piece = ("abcdefgh" * 12_500).encode()
    began = time.time()
    ids = T.merge(piece, plain.ranks)
    assert time.time() - began < 10 and b"".join(k for i in ids for k in [plain.decode([i]).encode()]) == piece


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_merging_joins_the_lowest_rank_first(piece):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((plain.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    assert T.merge(piece, plain.ranks) == [plain.ranks[p] for p in parts]


def test_ends_lead_back_to_the_text(spark):
    texts = {1: "It's 3 naïve 中文 texts.", 2: "", 3: None, 4: "a"}
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, ends int")
    for r in T.encode_with_ends(df, "doc_id", "text").collect():
        data, begin = (texts[r["doc_id"]] or "").encode(), 0
        for i, end in zip(r["ids"], r["ends"]):
            assert own.encode_slice(data[begin:end]) is not None and plain._merge(data[begin:end]) == [i]
            begin = end
        assert begin == len(data) and len(r["ids"]) == len(r["ends"])
