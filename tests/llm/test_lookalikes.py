import pytest

from veinstone.llm import lookalikes as L

COUNTS = {("K", "N"): 50, ("a", "b"): 100, ("e", "r"): 100, ("o", "f"): 60, ("П", "р"): 10, ("р", "и"): 10, ("и", "в"): 9, ("в", "е"): 9, ("е", "т"): 9, ("η", "μ"): 3}
COUNTS |= {(a, b): 40 for a in "abcdefghijklmnopqrstuvwxyz" for b in "aeiou"}
MODEL = L.Model(COUNTS)


def form(t):
    return L.canonical(t, MODEL, MODEL.latin_wins())


@pytest.mark.parametrize(
    "odd,plain",
    [("ΚΝ-5335", "KN-5335"), ("offеn", "offen"), ("Ｂid　bond", "Bid bond"), ("Señaro", "Señaro"), ("a​b­c", "abc"), ("ﬁle", "file"), ("⼾⻋", "户车"), ("１２", "12"), ("a b c\td", "a b c d"), ("ré", "ré"), ("рé", "pé"), ("x\r\ny", "x\ny"), ("﻿KN", "KN")],
)
def test_same_look_same_form(odd, plain):
    assert form(odd) == form(plain) == plain


@pytest.mark.parametrize("a,b", [("KN", "Kn"), ("KN-5", "KN-6"), ("a.b", "a,b"), ("é", "e"), ("a\nb", "a b"), ("O", "0"), ("a b", "ab"), ("bid", "bids"), ("l", "1")])
def test_other_changes_stay(a, b):
    assert form(a) != form(b)


def test_foreign_words_keep_their_script():
    assert form("Привет") == "Привет"


def test_form_is_a_function_of_the_look():
    import random

    rng = random.Random(1)
    swap = {}
    for d in (L.CYRILLIC, L.GREEK, L.ARMENIAN):
        for c, x in d.items():
            swap.setdefault(x, []).append(c)
    for _ in range(300):
        t = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ -5") for _ in range(12))
        odd = "".join(rng.choice(swap[c]) if c in swap and rng.random() < 0.5 else c for c in t)
        assert form(odd) == form(t)


def test_pairs(spark):
    rows = [
        (1, "f", "g", "Bid bond KN-1"), (2, "f", "g", "Bіd bond ΚN-1"), (3, "f", "h", "Bid bond KN-1"), (4, "f", "g", "Bid bond KN-1"), (2, "f", "g", "Bіd bond ΚN-1"),
        (5, "f", "g", None), (6, "f", "g", ""), (7, None, "g", "Bid bond KN-1"), (8, "f", "g", "x" * 100_000), (9, "f", "g", "х" * 100_000),
    ]
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], "id long, file string, gen string, t string, form int, raw string")
    got = sorted(tuple(r) for r in L.equal_looking(df, "id", "t", ["file", "gen"]).collect())
    assert got == [(1, 2), (2, 4), (8, 9)]
    assert L.equal_looking(df.where("id < 0"), "id", "t", ["file"]).count() == 0
    forms = {r["id"]: r["form"] for r in L.one_form(df.drop("form"), "t").collect()}
    assert forms[2] == "Bid bond KN-1" and forms[5] is None and forms[6] == ""


def test_a_large_class_is_spread_and_gives_all_its_pairs(spark, monkeypatch):
    monkeypatch.setattr(L, "SPREAD", 10)
    rows = [(i, 1, "Bond" if i % 2 else "Bоnd", "x") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, g int, t string, salt string")
    got = {tuple(r) for r in L.equal_looking(df, "id", "t", ["g"]).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if (i - j) % 2}
