"""One form for text that looks the same.

Arrow text becomes one array of code points per slice.  A lookup table gives each code point's expansion
(compatibility decomposition, without characters of no width, every space a plain one, look-alike letters
replaced), offsets place the expansions, marks are put into canonical order by one sort, and composed by rounds
of table look-ups over all starters at once.  No string is touched by itself.

Set aside: width and presentation forms, separate or combined accents, characters without width, the kind of
space, and look-alike letters of the same case in the Latin, Cyrillic and Greek scripts.  Kept: case, accents,
digits, lines, the number of spaces.

Defined results: null stays null, empty stays empty, a text of nothing but invisible characters becomes empty;
texts of any length are processed whole; other columns pass through.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxfold.lineage import cut

#: Letters that look alike in the same case, each followed by the letter that stands for it.
CYRILLIC_LOOK_ALIKES = "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ҮY ԚQ ԜW ӀI аa еe оo рp сc уy хx ѕs іi јj ԁd һh ԛq ԝw үy ӏl ѴV ѵv ԌG"
GREEK_LOOK_ALIKES = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv αa ιi ρp υu κк ϲc ϳj ϹC ͿJ ΓГ ΠП ΦФ ϜF"

#: Code points of a slice at most, unless a single text is longer; keeps the temporaries of a slice near 50 MB.
SLICE = 1_000_000
TOP = sys.maxunicode + 1
#: A text is of the head if more than 1 / HEAD of all records hold it, so there are fewer than HEAD of them.
HEAD = 1024
HANGUL_L, HANGUL_V, HANGUL_T, HANGUL_S = 0x1100, 0x1161, 0x11A7, 0xAC00


def look_alikes() -> dict[str, str]:
    return {p[0]: p[1] for p in f"{CYRILLIC_LOOK_ALIKES} {GREEK_LOOK_ALIKES}".split()}


def has_no_width(c: str) -> bool:
    o = ord(c)
    return unicodedata.category(c) == "Cf" or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF


def letter_classes() -> dict[str, str]:
    """Each letter's representative when case and look-alikes are both set aside (closed over both relations)."""
    parent: dict[str, str] = {}

    def find(c: str) -> str:
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for o in range(0x250):
        _link(chr(o), parent, find)
    for o in range(0x370, 0x590):
        _link(chr(o), parent, find)
    for a, b in look_alikes().items():
        parent[find(a)] = find(b)
    members: dict[str, list[str]] = {}
    for c in list(parent):
        members.setdefault(find(c), []).append(c)
    rank = lambda c: (not c.islower(), ord(c))
    return {c: best for group in members.values() if len(group) > 1 for best in [min(group, key=rank)] for c in group}


def _link(c: str, parent: dict[str, str], find) -> None:
    if unicodedata.decomposition(c):
        return
    for other in (c.lower(), c.upper()):
        if len(other) == 1 and other != c and not unicodedata.decomposition(other):
            parent[find(c)] = find(other)


def expand(c: str, fold_case: bool, letters: dict[str, str]) -> str:
    """What one character becomes, decomposed (Hangul syllables stay whole)."""
    if has_no_width(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    text = unicodedata.normalize("NFKD", c) if not 0xAC00 <= ord(c) < 0xD7A4 else c
    if fold_case:
        text = unicodedata.normalize("NFKD", text.casefold()) if text.casefold() != text else text
    return "".join(letters.get(x, x) for x in text if not has_no_width(x))


def _characters() -> Iterator[str]:
    """Characters that may change; those left out never do."""
    for o in [*range(0x33480), *range(0xE0000, 0xE01F0)]:
        if not (0xD800 <= o < 0xE000 or 0x4E00 <= o < 0xA000 or 0xAC00 <= o < 0xD7A4 or 0x20000 <= o < 0x2F800):
            yield chr(o)


def expansions(fold_case: bool = False) -> dict[str, str]:
    """Every character that changes, with what it becomes."""
    letters = letter_classes() if fold_case else look_alikes()
    made = ((c, expand(c, fold_case, letters)) for c in _characters() if c != "\0")
    return {c: x for c, x in made if x != c}


class Tables:
    """expansion of code point c: data[start[c]:start[c] + length[c]]; mark classes; sorted pairs that compose."""

    def __init__(self, fold_case: bool) -> None:
        letters = letter_classes() if fold_case else look_alikes()
        self.length = np.ones(TOP, np.int32)
        self.start = np.zeros(TOP, np.int32)
        self.mark = np.zeros(TOP, np.uint8)
        data: list[int] = []
        same = np.arange(TOP, dtype=np.uint32)
        pairs: dict[int, int] = {}
        for c in _characters():
            o = ord(c)
            self.mark[o] = unicodedata.combining(c)
            out = expand(c, fold_case, letters)
            if out != c:
                self.length[o], self.start[o] = len(out), len(data)
                data.extend(map(ord, out))
            parts = unicodedata.decomposition(c).split()
            if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", c) == c:
                pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = o
        # code points that stay as they are share one region, after the expansions
        self.data = np.concatenate([np.array(data, np.uint32), same])
        plain = (self.length == 1) & (self.start == 0)
        if data:
            first = next(o for o in range(TOP) if self.length[o] != 1 or self.start[o] or expand(chr(o), fold_case, letters) != chr(o))
            plain[first] = False
        self.start[plain] = np.flatnonzero(plain) + len(data)
        for pair, o in list(pairs.items()):  # a composed letter of one script may stand for another letter
            a, b = pair >> 21, pair & 0x1FFFFF
            pairs.setdefault(ord(letters.get(chr(a), chr(a))) << 21 | b, o)
        self.pair = np.array(sorted(pairs), np.int64)
        self.whole = np.array([pairs[p] for p in sorted(pairs)], np.uint32)
        seconds = {p & 0x1FFFFF for p in pairs}
        self.second = np.zeros(TOP, bool)
        self.second[[s for s in seconds if not self.mark[s]]] = True


@lru_cache(maxsize=2)
def tables(fold_case: bool = False) -> Tables:
    return Tables(fold_case)


def unify_points(points: np.ndarray, starts: np.ndarray, fold_case: bool = False, want_source: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Code points of texts laid end to end, text k from starts[k] to starts[k + 1], into their one form.

    Also returns the new starts and, if wanted, the index of the source code point of each output code point."""
    t = tables(fold_case)
    length = t.length[points]
    ends = np.cumsum(length, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    begin = ends - length
    new_starts = np.concatenate([begin, [total]])[starts]
    if total == len(points) and (length == 1).all():
        out, source = t.data[t.start[points]], np.arange(total) if want_source else None
    else:
        index = np.repeat(t.start[points] - begin, length) + np.arange(total)
        out = t.data[index]
        source = np.repeat(np.arange(len(points)), length) if want_source else None
    mark = t.mark[out]
    if mark.any() or (len(out) and bool(t.second[out].any())) or bool(((out >= HANGUL_L) & (out < 0x1200)).any()):
        out, source, new_starts = _compose(t, out, mark, source, new_starts)
    return out, new_starts, source


def _lookup(t: Tables, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = a.astype(np.int64) << 21 | b.astype(np.int64)
    at = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
    return t.pair[at] == key, t.whole[at]


def _compose(t: Tables, out: np.ndarray, mark: np.ndarray, source: np.ndarray | None, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    fresh = np.zeros(len(out) + 1, bool)  # a text's first character begins a run even if it is a mark
    fresh[starts] = True
    where = np.flatnonzero(mark > 0)
    gone = np.zeros(len(out), bool)
    if len(where):
        new_run = np.ones(len(where), bool)
        new_run[1:] = (np.diff(where) > 1) | fresh[where[1:]]
        run = np.cumsum(new_run) - 1
        order = np.lexsort((mark[where], run))  # stable: marks of a class keep their order
        moved = where[order]
        out[where], mark[where] = out[moved], mark[moved]
        if source is not None:
            source[where] = source[moved]
        first = np.flatnonzero(new_run)
        head, size = where[first], np.diff(np.append(first, len(where)))
        base = head - 1
        ok = (head > 0) & ~fresh[head]
        base, head, size = base[ok], head[ok], size[ok]
        blocked = np.zeros(len(base), np.int16)
        for k in range(int(size.max(initial=0))):
            live = size > k
            base, head, size, blocked = base[live], head[live], size[live], blocked[live]
            at = head + k
            found, whole = _lookup(t, out[base], out[at])
            found &= blocked < mark[at]
            out[base[found]] = whole[found]
            gone[at[found]] = True
            blocked = np.where(found, blocked, mark[at].astype(np.int16))
    if gone.any():
        out, source, starts, fresh = _squeeze(gone, out, source, starts)
    for _ in range(2):  # letters that join with the next letter: Hangul, then a few Indic vowels
        if len(out) < 2:
            break
        a, b = out[:-1].astype(np.int64), out[1:].astype(np.int64)
        vowel = (a >= HANGUL_L) & (a < HANGUL_L + 19) & (b >= HANGUL_V) & (b < HANGUL_V + 21)
        tail = (a >= HANGUL_S) & (a < 0xD7A4) & ((a - HANGUL_S) % 28 == 0) & (b > HANGUL_T) & (b < HANGUL_T + 28)
        found, whole = np.zeros(len(a), bool), np.zeros(len(a), np.uint32)
        some = np.flatnonzero(t.second[b])
        if len(some):
            found[some], whole[some] = _lookup(t, a[some], b[some])
        join = (vowel | tail | found) & ~fresh[1 : len(out)]
        join[1:] &= ~join[:-1]
        at = np.flatnonzero(join)
        if not len(at):
            break
        made = np.where(vowel[at], HANGUL_S + ((a[at] - HANGUL_L) * 21 + b[at] - HANGUL_V) * 28, np.where(tail[at], a[at] + b[at] - HANGUL_T, whole[at]))
        out[at] = made
        gone = np.zeros(len(out), bool)
        gone[at + 1] = True
        out, source, starts, fresh = _squeeze(gone, out, source, starts)
    return out, source, starts


def _squeeze(gone, out, source, starts):
    kept = ~gone
    before = np.concatenate([[0], np.cumsum(kept)])
    starts = before[starts]
    fresh = np.zeros(int(before[-1]) + 1, bool)
    fresh[starts] = True
    return out[kept], None if source is None else source[kept], starts, fresh


def text_slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, starts) of consecutive rows, about ``most`` code points each; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    view = memoryview(data) if data is not None else memoryview(b"")
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(at, at[row] + most, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        raw = view[at[row] : at[stop]]
        array = np.frombuffer(raw, np.uint8)
        points = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32)
        leads = np.concatenate([[0], np.cumsum((array & 0xC0) != 0x80)])
        yield row, points, leads[at[row : stop + 1] - at[row]]
        row = stop


def to_arrow(points: np.ndarray, starts: np.ndarray) -> pa.Array:
    raw = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(width)])[starts]
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw)).cast(pa.string())


def unify_array(column: pa.Array, fold_case: bool = False) -> pa.Array:
    parts = []
    for _, points, starts in text_slices(column):
        out, new, _ = unify_points(points, starts, fold_case)
        parts.append(to_arrow(out, new))
    made = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    return pc.if_else(pc.is_null(column), pa.scalar(None, pa.string()), made) if column.null_count else made


def unify_text(df: DataFrame, text: str = "text", into: str | None = None) -> DataFrame:
    """``df`` with ``text`` in its one form, or with the form in the further column ``into``."""
    names = [c for c in df.columns if c != (into or text)]
    source = "_text"
    while source in names:
        source = "_" + source
    base = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(source))
    schema = T.StructType([*base.schema.fields[:-1], T.StructField(into or text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], unify_array(batch.columns[-1])], names=schema.names)

    return base.mapInArrow(run, schema)


def same_looking_classes(df: DataFrame, record: str = "doc_id", text: str = "text") -> DataFrame:
    """(record, look, exact): digests of the one form and of the text as stored, of non-empty texts.

    Only digests leave the scan; texts are never shuffled."""
    rows = df.filter(F.length(text) > 0).select(F.col(record).alias("record"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("exact"), F.col(text).alias("text"))
    return unify_text(rows).select("record", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("look"), "exact")


def _texts(rows: DataFrame) -> DataFrame:
    """(look, exact, n, least): every different text once, with how many records hold it and the smallest of them."""
    return rows.groupBy("look", "exact").agg(F.count(F.lit(1)).alias("n"), F.min("record").alias("least"))


def class_members(df: DataFrame, record: str = "doc_id", text: str = "text") -> DataFrame:
    """(record, class, n_links): one row per record with non-empty text; its class is the smallest record that looks the same,
    its links are the records of the class whose text is stored differently.

    Texts that many records hold - at most ``HEAD`` of them can exist - are broadcast, the others are joined by shuffle."""
    rows = cut(same_looking_classes(df, record, text))
    texts = cut(_texts(rows))
    whole = texts.groupBy("look").agg(F.sum("n").alias("all"), F.min("least").alias("class"))
    told = texts.join(whole, "look").select("look", "exact", "n", "class", (F.col("all") - F.col("n")).alias("n_links"))
    bound = (texts.agg(F.sum("n")).first()[0] or 0) / HEAD
    head = told.filter(F.col("n") > bound).drop("n")
    tail = told.filter(F.col("n") <= bound).drop("n")
    hot = rows.join(F.broadcast(head), ["look", "exact"], "left")
    out = ["record", "class", "n_links"]
    return hot.filter("n_links IS NOT NULL").select(*out).unionByName(hot.filter("n_links IS NULL").select("record", "look", "exact").join(tail, ["look", "exact"]).select(*out))


def same_looking_pairs(df: DataFrame, record: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b) with a < b: records whose texts differ as stored but have the same form.

    Pairs are formed between different texts, then expanded to their records: exact copies are never paired with
    each other, so the work is in proportion to the result."""
    rows = cut(same_looking_classes(df, record, text))  # three uses below, one pass over the texts
    texts = _texts(rows).select("look", "exact")
    several = texts.groupBy("look").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("look")
    texts = cut(texts.join(several, "look"))
    rows = rows.join(texts, ["look", "exact"])
    links = texts.join(texts.select("look", F.col("exact").alias("exact_b")), "look").filter("exact < exact_b")
    sides = links.join(rows.select("look", "exact", F.col("record").alias("x")), ["look", "exact"])
    both = sides.join(rows.select("look", F.col("exact").alias("exact_b"), F.col("record").alias("y")), ["look", "exact_b"])
    return both.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
