"""Evaluation passages that leaked into a training corpus.

Every shard of the corpus gets an FM-index over its words: the suffix array (prefix doubling, only tied suffixes
are sorted again), its Burrows-Wheeler transform as a wavelet matrix, and sampled suffix positions.  All phrases
are searched backward at once by vectorised ranks, occurrences are located by walking to the next sampled
position, and hits of one item in one document merge into spans to remove.  Texts are not shuffled, only leaking
(document, item) rows leave a shard.

Words are runs of letters and digits after width, accents' spelling, invisible characters, look-alike letters
and letter case are set aside.  A phrase is any ``least_words`` consecutive words of a passage, or the whole
passage if it is shorter.  Words that no passage has share one symbol, which no phrase holds.

Defined results: a null document id stays one; null or empty texts and passages give no rows; a passage without words gives none; repeated
document rows come once; all passages of an item count as one item; texts of any length are indexed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxfold.llm.unify import SLICE, TOP, text_slices, unify_points

#: Words of a shard's index, about; a longer text has an index of its own.
SHARD_WORDS = 1_000_000
#: Every so many positions keep their place in the text.
SAMPLE = 8
#: Bytes of passages that every task holds, in one index search; a larger set of items is searched in further passes over the corpus.
BLOCK_BYTES = 32_000_000
#: Phrases searched at once, to bound what a search holds.
SEARCH_PHRASES = 500_000

_word_char: np.ndarray | None = None


def word_chars() -> np.ndarray:
    """Letters, digits, and marks that did not compose with their letter."""
    global _word_char
    if _word_char is None:
        table = np.zeros(TOP, bool)
        for lo, hi in ((0, 0x33480), (0xE0000, 0xE01F0)):
            table[lo:hi] = [chr(o).isalnum() for o in range(lo, hi)]
        table[0x300:0x370] = True
        _word_char = table
    return _word_char


def word_spans(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word; no word crosses from one text into the next."""
    inside = np.zeros(len(points) + 1, bool)
    inside[:-1] = word_chars()[points]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = ~inside
    last[1:] &= inside[:-1]
    last[0] = False
    cuts = starts[(starts > 0) & (starts < len(points))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    if len(cuts):
        begin, end = np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts]))
    return begin, end


def word_hashes(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word: its code points, each mixed with its place in the word, summed."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = end - begin
    at = np.cumsum(length) - length
    index = np.repeat(begin - at, length) + np.arange(int(length.sum()))
    place = (index - np.repeat(begin, length)).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = points[index].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        return np.add.reduceat(x, at)


class Phrases:
    """Phrases of the items: ``words`` of all passages as symbols (from 2, in order of ``vocabulary``), and of each phrase its start there, length and item."""

    def __init__(self, items: list[tuple[int, str]], least_words: int) -> None:
        column = pa.array([p for _, p in items], pa.string())
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, points, starts in text_slices(column):
            out, new, _ = unify_points(points, starts, fold_case=True)
            begin, end = word_spans(out, new)
            hashes.append(word_hashes(out, begin, end))
            counts.append(np.diff(np.searchsorted(begin, new)))
        every, count = np.concatenate(hashes), np.concatenate(counts).astype(np.int64)
        self.vocabulary, place = np.unique(every, return_inverse=True)
        self.words = (place.ravel() + 2).astype(np.int32)
        n = np.where(count > 0, np.maximum(1, count - least_words + 1), 0)
        ends, first = np.cumsum(n), np.cumsum(count) - count
        self.start = np.repeat(first - (ends - n), n) + np.arange(int(n.sum()))
        self.length = np.repeat(np.minimum(count, least_words), n)
        self.item = np.repeat(np.array([i for i, _ in items], np.int64), n)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order; a separator (0) is ordered by its position and ends every comparison."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    bits = int(rank.max()).bit_length()
    pack = max(1, min(62 // bits, 8))
    key = rank.copy()
    padded = np.concatenate([rank, np.zeros(pack, np.int64)])
    for k in range(1, pack):
        key <<= bits
        key |= padded[k : k + n]
    order = np.argsort(key)
    sorted_key = key[order]
    fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    place = np.flatnonzero(tied)
    step = pack
    while len(place):
        index = order[place]
        key = rank[index] * (n + 1) + rank[np.minimum(index + step, n - 1)]
        turn = np.argsort(key)
        index, key = index[turn], key[turn]
        order[place] = index
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[index] = place[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))]
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        place = place[tied]
        step *= 2
    return order


class WaveletMatrix:
    """Ranks of any symbol in a sequence, one bit at a time from the highest."""

    def __init__(self, symbols: np.ndarray) -> None:
        n, top = len(symbols), int(symbols.max(initial=1)).bit_length()
        self.ones, self.zeros = [], []
        for b in range(top - 1, -1, -1):
            bit = (symbols >> b) & 1
            count = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(n - int(count[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.top = top

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """How often ``symbol`` occurs before each place."""
        base = np.zeros(len(symbol), np.int64)
        at = [p.astype(np.int64) for p in places]
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((symbol >> (self.top - 1 - k)) & 1).astype(bool)
            move = lambda x: np.where(one, zeros + ones[x], x - ones[x])  # noqa: B023, E731
            base, at = move(base), [move(x) for x in at]
        return [x - base for x in at]


class FMIndex:
    def __init__(self, symbols: np.ndarray) -> None:
        """``symbols`` ends with a separator (0)."""
        order = suffix_array(symbols)
        self.last = symbols[order - 1]  # of suffix 0 the symbol before is the last separator
        counts = np.bincount(symbols)
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.wavelet = WaveletMatrix(self.last)
        first = np.zeros(len(symbols), bool)  # a walk never steps over a separator
        first[np.flatnonzero(symbols == 0)[:-1] + 1] = True
        first[0] = True
        kept = first[order] | (order % SAMPLE == 0)
        self.kept = kept
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.place = order[kept]

    def search(self, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (runs of ``words``) that occur, with their interval of suffixes."""
        live = np.arange(len(start))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.last), np.int64)
        done = []
        for k in range(int(length.max(initial=0))):
            symbol = words[start[live] + length[live] - 1 - k].astype(np.int64)
            known = symbol < len(self.before) - 1
            live, lo, hi, symbol = live[known], lo[known], hi[known], symbol[known]
            if not len(live):
                break
            a, b = self.wavelet.rank(symbol, lo, hi)
            lo, hi = self.before[symbol] + a, self.before[symbol] + b
            some = hi > lo
            live, lo, hi = live[some], lo[some], hi[some]
            end = length[live] == k + 1
            done.append((live[end], lo[end], hi[end]))
            live, lo, hi = live[~end], lo[~end], hi[~end]
        if not done:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows, by walking back to a sampled one."""
        out, walking, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(walking):
            at = self.kept[rows]
            out[walking[at]] = self.place[self.kept_before[rows[at]]] + steps
            walking, rows = walking[~at], rows[~at]
            symbol = self.last[rows]
            rows = self.before[symbol] + self.wavelet.rank(symbol, rows)[0]
            steps += 1
        return out


class Shard:
    """Words of whole texts, gathered until an index is worth while."""

    def __init__(self, phrases: Phrases) -> None:
        self.phrases = phrases
        self.clear()

    def clear(self) -> None:
        self.symbols, self.begin, self.end, self.docs, self.words = [], [], [], [], 0

    def add(self, doc: pa.Array, points: np.ndarray, starts: np.ndarray) -> None:
        out, new, source = unify_points(points, starts, fold_case=True, want_source=True)
        begin, end = word_spans(out, new)
        hashes = word_hashes(out, begin, end)
        vocabulary = self.phrases.vocabulary
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        symbols = np.where(vocabulary[at] == hashes, at + 2, 1).astype(np.int32)
        cut = np.searchsorted(begin, new[1:])  # a separator after the words of each text
        self.symbols.append(np.insert(symbols, cut, 0))
        text = np.searchsorted(cut, np.arange(len(begin)), "right")
        self.begin.append(np.insert((source[begin] - starts[text]).astype(np.int64), cut, 0))
        after = np.minimum(np.append(source, len(points))[end], starts[text + 1])  # past marks that composed with the last letter
        self.end.append(np.insert((after - starts[text]).astype(np.int64), cut, 0))
        self.docs.append(doc)
        self.words += len(begin) + len(doc)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Per hit: text number, item, first and last word (as positions in the shard); and the shard's documents."""
        symbols = np.concatenate(self.symbols)
        index, p, found = FMIndex(symbols), self.phrases, []
        for k in range(0, len(p.start), SEARCH_PHRASES):
            some = slice(k, k + SEARCH_PHRASES)
            which, lo, hi = index.search(p.words, p.start[some], p.length[some])
            count = hi - lo
            ends = np.cumsum(count)
            rows = np.repeat(lo - (ends - count), count) + np.arange(int(count.sum()))
            found.append((index.locate(rows), np.repeat(which + k, count)))
        place, which = (np.concatenate(x) for x in zip(*found))
        size = p.length[which]
        # exact: every word of the phrase stands there
        for k in range(int(size.max(initial=0))):
            inside = size > k
            if not (symbols[place[inside] + k] == p.words[p.start[which[inside]] + k]).all():
                raise AssertionError("index and text disagree")
        text = np.searchsorted(np.flatnonzero(symbols == 0), place)
        hit = np.unique(np.column_stack([text, p.item[which], place, place + size - 1]), axis=0)
        return *hit.T, pa.concat_arrays(self.docs)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.words:
            return
        text, item, first, last, docs = self.hits()
        begin, end = np.concatenate(self.begin), np.concatenate(self.end)
        self.clear()
        if not len(text):
            return
        pair = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])])
        # spans of one pair that meet or overlap become one
        group = np.cumsum(pair) - 1
        reach = last + group * (len(begin) + 1)
        reach = np.maximum.accumulate(reach) - group * (len(begin) + 1)
        start = pair.copy()
        start[1:] |= first[1:] > reach[:-1] + 1
        at = np.flatnonzero(start)
        stop = np.append(at[1:], len(text)) - 1
        spans = pa.StructArray.from_arrays([pa.array(begin[first[at]]), pa.array(end[reach[stop]])], ["start", "stop"])
        heads = np.flatnonzero(pair)
        bounds = np.searchsorted(at, np.append(heads, len(text))).astype(np.int32)
        n_hits = np.diff(np.append(heads, len(text)))
        yield pa.RecordBatch.from_arrays([docs.take(pa.array(text[heads])), pa.array(item[heads], pa.int64()), pa.array(n_hits, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), spans)], names=["doc_id", "item_id", "n_phrases", "spans"])


LEAK_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("n_phrases", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
])


def leaks(corpus: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", least_words: int = 12) -> DataFrame:
    """(doc_id, item_id, n_phrases, spans): documents that hold a phrase of an item, and the code points of the stored text to remove.

    Items are held by every task, ``BLOCK_BYTES`` of passages at most; a larger set is divided by item, one pass over the corpus each."""
    stated = items.select(F.col(item).cast("long").alias("i"), F.col(passage).alias("p")).filter(F.col("i").isNotNull() & (F.length("p") > 0)).distinct()
    blocks = -(-max(1, stated.agg(F.sum(F.octet_length("p"))).first()[0] or 0) // BLOCK_BYTES)
    rows = corpus.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    out = None
    for b in range(blocks):
        part = stated if blocks == 1 else stated.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        found = _search(rows, Phrases(sorted(map(tuple, part.collect())), least_words))
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def _search(rows: DataFrame, phrases: Phrases) -> DataFrame:
    if not len(phrases.start):
        return rows.sparkSession.createDataFrame([], LEAK_SCHEMA)
    shared = rows.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(shared.value)
        for batch in batches:
            for row, points, starts in text_slices(batch.column(1), SLICE):
                shard.add(batch.column(0).slice(row, len(starts) - 1), points, starts)
                if shard.words >= SHARD_WORDS:
                    yield from shard.rows()
        yield from shard.rows()

    return rows.mapInArrow(run, LEAK_SCHEMA)
