"""Filling containers of fixed capacity with texts of varying length.

Hierarchical packing in several context sizes.  The windows of tier t are a capacity's 2^t-th part; a text is routed
to the shortest window that takes it whole.  Tiers are packed from the long windows to the short: a text first fills
the gap of a longer window, the fullest that still has room, and only then is packed with those of its own tier.  The
filled windows of the shorter tiers are then laid into containers, by what they hold, again the fullest fit first, and
the gaps that are left take the loose texts, which are too short for a window of their own.
Containers are dealt to steps so that the tokens of a step are even.  Only (id, size) pairs leave the scan, once,
spread evenly over shards by a hash of id and place; a shard packs about ``PACK_ROWS`` texts at a time, so memory is
bounded however many rows it has.  Equal sizes are placed together, as arrays.

A text larger than a container is cut into full containers and a rest, other texts never.

Defined results: a null id stays one; null texts have no size and are in no container; an empty text has size 1 (its end); repeated
rows are packed each; capacities under 1 are refused; an empty table gives no containers; container, window and step numbers are unique over all shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxfold.lineage import cut

#: Texts that are packed together; a shard with more packs them in turns.
PACK_ROWS = 50_000
#: Context sizes of a capacity: whole, half, quarter and so on.  Texts under the half of the shortest stay loose (tier ``TIERS``).
TIERS = 4

PIECES = "spec_id int, capacity int, container bigint, step bigint, tier int, window bigint, doc_id bigint, piece int, n_pieces int, start bigint, length int"


def byt5_size(text: Column) -> Column:
    """Tokens under the public byte tokenizer: one per byte in UTF-8, and one for the end."""
    return F.octet_length(F.encode(text, "UTF-8")) + 1


class Bins:
    """Bins in stacks by the room they have; a bit set of these rooms finds the least one that is enough."""

    def __init__(self) -> None:
        self.count = 0
        self.rooms = 0
        self.stacks: dict[int, list[np.ndarray]] = {}

    def _push(self, room: int, bins: np.ndarray) -> None:
        if room and len(bins):
            self.stacks.setdefault(room, []).append(bins)
            self.rooms |= 1 << room

    def _pop(self, room: int, most: int) -> np.ndarray:
        stack = self.stacks[room]
        top = stack.pop()
        if len(top) > most:
            stack.append(top[most:])
            top = top[:most]
        if not stack:
            self.rooms ^= 1 << room
        return top

    def fill(self, size: int, n: int) -> np.ndarray:
        """Bins for up to n items of one size, the fullest first; fewer than n if the rest fits nowhere."""
        out = []
        while n:
            fit = self.rooms >> size
            if not fit:
                break
            room = size + (fit & -fit).bit_length() - 1
            bins = self._pop(room, n)
            out.append(bins)
            n -= len(bins)
            self._push(room - size, bins)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def open(self, size: int, n: int, width: int) -> np.ndarray:
        """New bins of a width for n items of one size, as many in each as fit."""
        each = width // size
        whole, rest = divmod(n, each)
        bins = np.arange(self.count, self.count + whole + (rest > 0))
        self.count += len(bins)
        self._push(width - each * size, bins[:whole])
        self._push(width - rest * size, bins[whole:])
        return np.concatenate([np.repeat(bins[:whole], each), np.repeat(bins[whole:], rest)])


def by_size(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Sizes in descending order, with the items that have them."""
    order = np.argsort(-sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(sizes[part[0]]), part


def pack_windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each size, and the tier of each window."""
    window, tiers = np.full(len(sizes), -1), []
    by_tier = [Bins() for _ in range(TIERS + 1)]
    names: list[list[np.ndarray]] = [[] for _ in by_tier]  # window of each bin of a tier
    placed: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in by_tier]
    for size, items in by_size(sizes):
        tier = min(TIERS, (capacity // size).bit_length() - 1)
        for t in range(tier + 1):  # gaps of longer windows go first
            own = by_tier[t].fill(size, len(items))
            placed[t].append((items[: len(own)], own))
            items = items[len(own) :]
        if len(items):
            before = by_tier[tier].count
            placed[tier].append((items, by_tier[tier].open(size, len(items), capacity >> tier if tier < TIERS else size)))
            made = by_tier[tier].count - before
            names[tier].append(np.arange(len(tiers), len(tiers) + made))
            tiers += [tier] * made
    for name, parts in zip(names, placed):
        if name:
            number = np.concatenate(name)
            for items, bins in parts:
                window[items] = number[bins]
    return window, np.array(tiers, np.int64)


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Container of each size, its window, and the tier of each window.

    A window of the first tier is a container; the others are laid into containers by what they hold."""
    if not len(sizes):
        none = np.zeros(0, np.int64)
        return none, none, none
    window, tier = pack_windows(sizes, capacity)
    held = np.bincount(window, sizes, len(tier)).astype(np.int64)
    home, boxes = np.empty(len(tier), np.int64), Bins()
    for size, items in by_size(held):
        own = boxes.fill(size, len(items))
        made = boxes.open(size, len(items) - len(own), capacity) if len(own) < len(items) else own[:0]
        home[items] = np.concatenate([own, made])
    return home[window], window, tier


def deal_steps(used: np.ndarray, per_step: int) -> np.ndarray:
    """A step for each container: fullest first to the step with the fewest tokens that has a place."""
    n = -(-len(used) // per_step)
    out = np.empty(len(used), np.int64)
    heap = [(0, s, 0) for s in range(n)]
    for k in np.argsort(-used, kind="stable").tolist():
        tokens, s, held = heapq.heappop(heap)
        out[k] = s
        if held + 1 < per_step:
            heapq.heappush(heap, (tokens + int(used[k]), s, held + 1))
    return out


def cut_pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and length of every piece: full containers, then the rest."""
    n = -(-sizes // capacity)
    row = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, piece, np.minimum(capacity, sizes[row] - piece * capacity)


def pack_documents(sizes: DataFrame, specs: list[tuple[int, int]], per_step: int = 8, shard_rows: int | None = None) -> DataFrame:
    """Every piece of every text in ``sizes`` (doc_id, size) with its container, for each (spec_id, capacity)."""
    if any(c < 1 for _, c in specs):
        raise ValueError("a capacity must be at least 1")
    sizes = cut(sizes.select(F.col("doc_id").cast("bigint"), F.col("size").cast("bigint"), F.monotonically_increasing_id().alias("m")))  # the one scan of the texts
    shards = max(1, round(sizes.count() / (shard_rows or PACK_ROWS)))
    spread = sizes.repartition(shards, F.xxhash64("doc_id", "m")).select("doc_id", "size", F.spark_partition_id().alias("shard"))

    def turn(docs: list[pa.Array], size: np.ndarray, shard: int, done: dict[int, list[int]]) -> Iterator[pa.RecordBatch]:
        docs = pa.concat_arrays(docs)
        order = np.lexsort((size, docs.fill_null(-(1 << 63)).to_numpy()))
        docs, size = docs.take(pa.array(order)), size[order]
        for spec, capacity in specs:
            row, piece, length = cut_pieces(size, capacity)
            home, window, tier = pack_sizes(length, capacity)
            used = np.bincount(home, length).astype(np.int64)
            step = deal_steps(used, per_step)
            n, before = len(row), done.setdefault(spec, [0, 0, 0])
            numbers = [(shard << 40) + b + x for b, x in zip(before, (home, step[home], window))]
            done[spec] = [b + k for b, k in zip(before, (len(used), int(step.max()) + 1, len(tier)))]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in (
                (np.full(n, spec), pa.int32()), (np.full(n, capacity), pa.int32()), (numbers[0], pa.int64()), (numbers[1], pa.int64()), (tier[window], pa.int32()), (numbers[2], pa.int64()), (docs.take(pa.array(row)), pa.int64()),
                (piece, pa.int32()), (-(-size[row] // capacity), pa.int32()), (piece * capacity, pa.int64()), (length, pa.int32()))],
                names=["spec_id", "capacity", "container", "step", "tier", "window", "doc_id", "piece", "n_pieces", "start", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, size, shard, held, done = [], [], 0, 0, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(2)[0].as_py()
            docs.append(batch.column(0))
            size.append(batch.column(1).to_numpy(zero_copy_only=False))
            held += batch.num_rows
            if held >= 2 * PACK_ROWS:
                yield from turn(docs, np.concatenate(size), shard, done)
                docs, size, held = [], [], 0
        if held:
            yield from turn(docs, np.concatenate(size), shard, done)

    return spread.mapInArrow(run, PIECES)


def stated_specs(specs: DataFrame, most: int = 1_000) -> list[tuple[int, int]]:
    """(spec_id, capacity) of a stated set; more than ``most`` are refused."""
    rows = specs.select("spec_id", "capacity").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} capacities to pack for")
    return sorted((r["spec_id"], r["capacity"]) for r in rows)


def packing_report(pieces: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, share of the space used, texts cut."""
    boxes = pieces.groupBy("spec_id", "capacity", "container").agg(F.sum("length").alias("used"), F.count(F.when(F.expr("piece = 0 AND n_pieces > 1"), 1)).alias("cut"))
    out = boxes.groupBy("spec_id", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.sum("cut").alias("texts_cut"))
    return out.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity")))
