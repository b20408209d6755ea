import random
import unicodedata

import pyarrow as pa
import pytest

from boxfold.llm.unify import class_members, has_no_width, look_alikes, same_looking_classes, same_looking_pairs, text_slices, unify_array, unify_text

LOOK = {ord(a): b for a, b in look_alikes().items()}
GONE = {o: None for o in range(0x110000) if has_no_width(chr(o))}
SPACES = {o: " " for o in range(0x110000) if unicodedata.category(chr(o)) == "Zs"}
SCHEMA = "doc_id bigint, text string"


def plain(s):
    """The decomposed form by string calls, one text at a time."""
    x = unicodedata.normalize("NFKD", s.translate(GONE).translate(SPACES)).translate(GONE).translate(SPACES)
    return unicodedata.normalize("NFD", x).translate(LOOK)


def texts(seed, n=4000):
    rng = random.Random(seed)
    pool = [chr(o) for a, b in ((32, 0x250), (0x300, 0x600), (0x900, 0x980), (0x1100, 0x1200), (0x1E00, 0x2100), (0x3040, 0x3100), (0xAC00, 0xAC40), (0xF900, 0xFB10), (0xFF00, 0xFFF0), (0x1D400, 0x1D410)) for o in range(a, b)]
    out = ["".join(rng.choice(pool) for _ in range(rng.randrange(25))) for _ in range(n)]
    return out + ["".join(rng.choice("aeиį̣̈́​") for _ in range(8)) for _ in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_equal_just_where_the_plain_forms_are(seed):
    source = texts(seed)
    made = unify_array(pa.array(source)).to_pylist()
    for s, x in zip(source, made):
        assert plain(x) == plain(s)
    assert len({*made}) == len({plain(s) for s in source})
    assert unify_array(pa.array(made)).to_pylist() == made  # nothing is left to do
    assert all(len(x) <= len(unicodedata.normalize("NFC", plain(s))) for s, x in zip(source, made))


@pytest.mark.parametrize("a,b", [("ｆｕｌｌ　１", "full 1"), ("café", "café"), ("a​b﻿", "ab"), ("x y", "x y"), ("раураl", "paypal"), ("ﬁn", "fin"), ("ﾊﾞ", "バ"), ("각", "각"), ("Ω", "Ω"), ("ΑΒ", "AB"), ("ΓΠΦ", "ГПФ"), ("Ѓ", "Γ́")])
def test_same(a, b):
    x, y = unify_array(pa.array([a, b])).to_pylist()
    assert x == y


@pytest.mark.parametrize("a,b", [("A", "a"), ("é", "e"), ("1", "2"), ("a  b", "a b"), ("a\nb", "a b"), ("ab", "a b"), ("l", "I"), ("ς", "σ"), ("ё", "e")])
def test_different(a, b):
    x, y = unify_array(pa.array([a, b])).to_pylist()
    assert x != y


def test_slices_cover_everything():
    column = pa.array(["ab", None, "", "x" * 50, "é\U0001d400"])
    parts = list(text_slices(column, most=3))
    assert sum(len(starts) - 1 for _, _, starts in parts) == 5
    assert "".join(chr(c) for _, points, _ in parts for c in points) == "ab" + "x" * 50 + "é\U0001d400"
    assert unify_array(column.slice(2)).to_pylist() == ["", "x" * 50, "éA"]


def test_frame_with_nulls_clashes_and_long_texts(spark):
    long = "ｆ​" * 400_000
    df = spark.createDataFrame([(1, None, "a"), (2, "", None), (None, long, "b"), (4, "​", "c")], "doc_id bigint, text string, _text string")
    rows = {r["doc_id"]: r for r in unify_text(df).collect()}
    assert rows[1]["text"] is None and rows[2]["text"] == "" and rows[4]["text"] == "" and rows[None]["text"] == "f" * 400_000 and rows[4]["_text"] == "c"
    both = unify_text(df, into="one").collect()
    assert {r["one"] is None for r in both if r["doc_id"] == 1} == {True} and len(both) == 4
    assert unify_text(df.limit(0)).count() == 0


def test_pairs_against_brute_force(spark):
    base = ["cafe one", "café one", "café one", "ｃafé one", "cafe  one", "", None, "​", "x", "х", "x", "x​"]
    rows = list(enumerate(base + base[:2]))
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(i, j) for i, a in rows for j, b in rows if i < j and a and b and a != b and plain(a) == plain(b)}
    assert {tuple(r) for r in same_looking_pairs(df).collect()} == want
    told = {r["record"]: (r["class"], r["n_links"]) for r in class_members(df).collect()}
    assert told == {i: (min(j for j, b in rows if b and plain(b) == plain(a)), sum(i in p for p in want)) for i, a in rows if a}
    assert class_members(df.limit(0)).count() == 0
    assert same_looking_pairs(df.limit(0)).count() == 0


def test_copies_cost_no_pairs(spark):
    df = spark.createDataFrame([(i, "same text" if i else "same text") for i in range(2000)], SCHEMA)
    assert same_looking_pairs(df).count() == 1999
    assert {(r["class"], r["n_links"]) for r in class_members(df).collect()} == {(0, 1), (0, 1999)}
    assert same_looking_classes(df).select("look").distinct().count() == 1
