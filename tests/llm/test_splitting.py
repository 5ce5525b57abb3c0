from hypothesis import given, settings
from hypothesis import strategies as st

from veinstone.llm import splitting as S


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab 。.\n中,"), max_size=900), st.integers(30, 120), st.integers(0, 20))
def test_pieces_keep_the_limit_share_the_overlap_and_lose_nothing(t, limit, overlap):
    p = S.split_text(t, limit, overlap)
    whole = t[p[0][0] : p[0][1]]
    for (_, b, _), (a, c, _) in zip(p, p[1:]):
        assert b - a == overlap and c > b
        whole += t[b:c]
    assert whole == t and all(b - a <= limit for a, b, _ in p)
    assert len(p) == 1 or len(t) > limit


def test_strongest_boundary_near_the_target_wins():
    t = "x" * 900 + ". " + "y" * 90 + "\n\n" + "z" * 950
    assert [s for *_, s in S.split_text(t, 1100, 100)][1:] == ["paragraph"]
    t = "One sentence. " * 180
    assert all(s == "sentence" for *_, s in S.split_text(t, 2000, 100)[1:])
    assert [s for *_, s in S.split_text("q" * 2500, 2000, 100)] == ["start", "hard"]


def test_number_of_pieces_is_least():
    assert len(S.split_text("a" * 2001, 2000, 100)) == 2
    assert len(S.split_text("a" * 2000, 2000, 100)) == 1
    assert len(S.split_text("a" * 3900, 2000, 100)) == 2 and len(S.split_text("a" * 3901, 2000, 100)) == 3


def test_paths_share_an_element():
    e = [f"element {i:02d} " + "x" * 30 for i in range(20)]
    p = S.split_path(e, 300, 100)
    assert all(len(x) <= 300 for x in p)
    parts = [x.split(S.JOINER) for x in p]
    assert all(a[-1] == b[0] for a, b in zip(parts, parts[1:]))
    assert [y for i, x in enumerate(parts) for y in x[bool(i) :]] == e


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab。 ", max_size=700)), max_size=12))
def test_any_path_keeps_the_limit(e):
    assert all(len(x) <= 300 for x in S.split_path(e, 300, 100))


def test_frames(spark):
    df = spark.createDataFrame([(1, "a" * 2500, ["p" * 200, None, "q" * 200]), (1, "a" * 2500, ["p" * 200, None, "q" * 200]), (2, "short", None), (3, None, []), (4, "中" * 2000, [None])], "id long, content string, path array<string>")
    assert sorted((r["id"], r["piece_no"], len(r["piece"])) for r in S.split_texts(df, "id", "content").collect()) == [(1, 1, 1300), (1, 2, 1300)]
    assert sorted((r["id"], r["piece_no"]) for r in S.split_paths(df, "id", "path").collect()) == [(1, 1), (1, 2)]
    assert S.split_texts(df.where("id < 0"), "id", "content").count() == 0


def test_pieces_are_added_until_each_cut_has_a_boundary():
    """Boundaries only at every 1,150 characters: the least number of pieces can't use them, one more than two can."""
    part = "x" * 1149 + "\n"
    text = part * 9
    pieces = S.split_text(text, 2000, 100)
    assert all(b - a <= 2000 for a, b, _ in pieces) and {s for _, _, s in pieces[1:]} == {"line"}
    assert len(pieces) == 9


def test_no_boundary_at_all_takes_little_time():
    import time

    began = time.time()
    pieces = S.split_text("x" * 2_000_000, 2000, 100)
    assert len(pieces) == 1053 and time.time() - began < 20
