import random
import re
import unicodedata

import numpy as np
import pytest

from boxfold.llm import leak
from boxfold.llm.unify import has_no_width, letter_classes

CLASSES = letter_classes()
WORDS = ["ala", "Bob", "Ćma", "деLо", "ночь", "été", "42", "straße", "Wien", "x1"]


def words(s):
    """By string calls."""
    x = unicodedata.normalize("NFKD", "".join(c for c in s if not has_no_width(c)))
    x = "".join(CLASSES.get(c, c) for c in unicodedata.normalize("NFKD", x.casefold()) if not has_no_width(c))
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFC", x))


def brute(docs, items, least):
    out = set()
    for d, text in docs:
        w = " ".join(words(text or ""))
        for i, passage in items:
            p = words(passage or "")
            n = min(least, len(p))
            if n and any(f" {' '.join(p[k:k + n])} " in f" {w} " for k in range(len(p) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_index_against_search(seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(1, 6, rng.integers(0, 40)) for _ in range(12)]
    texts += [texts[0], texts[1]]
    symbols = np.concatenate([x for t in texts for x in (t, [0])]).astype(np.int32)
    index = leak.FMIndex(symbols)
    phrases = np.zeros((200, 4), np.int64)
    length = rng.integers(1, 5, 200)
    for k, n in enumerate(length):
        phrases[k, :n] = rng.integers(1, 7, n)
    which, lo, hi = index.search(phrases.ravel(), np.arange(200) * 4, length)
    found = dict(zip(which.tolist(), zip(lo.tolist(), hi.tolist())))
    for k, n in enumerate(length):
        want = [p for p in range(len(symbols) - n + 1) if (symbols[p : p + n] == phrases[k, :n]).all()]
        got = sorted(index.locate(np.arange(*found[k])).tolist()) if k in found else []
        assert got == want


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(9)
    symbols = np.append(rng.integers(1, 3, 300), 0).astype(np.int32)
    order = leak.suffix_array(symbols)
    suffixes = [symbols[i:].tolist() for i in order]
    assert suffixes == sorted(suffixes)


def disguise(rng, s):
    s = s.upper() if rng.random() < 0.3 else s
    s = s.replace("a", "а") if rng.random() < 0.5 else s
    s = s.replace(" ", rng.choice([" - ", ",\n", " ", ". "]))
    return unicodedata.normalize("NFD", s) if rng.random() < 0.5 else "​".join(s)


@pytest.mark.parametrize("seed", [0, 1])
def test_leaks_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, say(rng.choice([2, 4, 6, 9]))) for i in range(12)] + [(90, None), (91, ""), (92, "..."), (3, say(5))]
    docs = []
    for d in range(120):
        i, p = rng.choice(items[:12])
        w = p.split()
        k = rng.randrange(len(w))
        docs.append((d, f"{say(rng.randrange(20))} {disguise(rng, ' '.join(w[k:k + rng.randrange(1, 8)]))} {say(3)}"))
    docs += [(200, None), (201, ""), (202, "!!"), (203, say(3000)), (5, docs[5][1])]
    monkeypatch.setattr(leak, "SHARD_WORDS", 150)
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string")
    tests = spark.createDataFrame(items, "item_id bigint, passage string")
    rows = leak.leaks(corpus, tests, least_words=4).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == brute(docs, items, 4)
    texts = dict(docs)
    for r in rows:
        for s in r["spans"]:
            piece = words(texts[r["doc_id"]][s["start"] : s["stop"]])
            assert piece and any(" ".join(piece[:2]) in " ".join(words(p or "")) for i, p in items if i == r["item_id"])
    key = lambda r: (r["doc_id"], r["item_id"], r["n_phrases"], tuple(map(tuple, r["spans"])))
    assert len({(r["doc_id"], r["item_id"]) for r in rows}) == len(rows)
    monkeypatch.setattr(leak, "BLOCK_BYTES", 100)
    monkeypatch.setattr(leak, "SEARCH_PHRASES", 3)
    assert sorted(map(key, leak.leaks(corpus, tests, least_words=4).collect())) == sorted(map(key, rows))


def test_an_item_of_two_passages_in_a_repeated_document_is_one_row(spark):
    df = spark.createDataFrame([(1, "x a b c d e f y")] * 2, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "a b c"), (7, "d e f")], "item_id bigint, passage string")
    (r,) = leak.leaks(df.repartition(2), items, least_words=3).collect()
    assert r["n_phrases"] == 2 and [tuple(s) for s in r["spans"]] == [(2, 13)]


def test_spans_merge_and_point_into_the_stored_text(spark):
    passage = "one two three four five six"
    text = "ﬁrst  ONE​ two, three four five\nsix end"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    (r,) = leak.leaks(df, spark.createDataFrame([(7, passage)], "item_id bigint, passage string"), least_words=3).collect()
    (s,) = r["spans"]
    assert text[s["start"] : s["stop"]] == "ONE​ two, three four five\nsix" and r["n_phrases"] == 4


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, passage string")
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, passage string")
    assert leak.leaks(docs, items).count() == leak.leaks(docs, some).count() == 0
