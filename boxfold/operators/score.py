"""Scoring samples against a model's boxes.

The boxes are the stated set, the samples are all rows: every task holds blocks of boxes, of checked size,
and walks its samples in Arrow batches, by neighbourhoods that look at the boxes near them first (exact; memberships per
class compare with all boxes, tile by tile).  Nothing is joined and nothing is shuffled; the evidence of a model's blocks is combined where the samples are, up to ``PASS_BLOCKS`` blocks in
one pass over them, and a still larger model takes further passes.

``samples``: sid, xl, xu (ARRAY<DOUBLE>, NULL or NaN missing), for mixed models cat: values (``eiol``), bit sets (``onehot``) or codes (``freqcat``).
``boxes``: box_id, v, w, c, optionally n_samples, centroid; for mixed models hist, bits, or e and f.
Samples without arrays and boxes without corners or the categories their kind needs are left out; a missing value is one of its own
(``eiol``), has no bit (``onehot``), or is at distance 0 from every value (``freqcat``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxfold.functions.distance import MISSING_HIGH, MISSING_LOW
from boxfold.kernels import scoring
from boxfold.kernels.geometry import EMPTY
from boxfold.kernels.scoring import MIXED, Model, chosen, tile_distance, tile_membership  # noqa: F401  re-exported

#: Doubles of boxes in one block at most (32 MB), blocks of one pass, and cells of a tile.
BLOCK_CELLS, PASS_BLOCKS, TILE = 4_000_000, 8, 1_000_000
MOST_BLOCKS = 64

EVIDENCE = "sid bigint, top double, c_low bigint, c_high bigint, first_id bigint, first_c bigint, near double, near_n double, near_id bigint, near_c bigint"
CLASSES = "sid bigint, c int, membership double, box_id bigint"
NEEDS = {"eiol": ["hist"], "onehot": ["bits"], "freqcat": ["e", "f"]}


def _usable(boxes: DataFrame, d: int, kind: str) -> DataFrame:
    whole = boxes.filter((F.size("v") == d) & (F.size("w") == d)) if d else boxes
    for c in NEEDS.get(kind, []):
        whole = whole.filter(F.col(c).isNotNull())
    return whole


def load_block(boxes: DataFrame, d: int, own: bool = False, **how) -> Model:
    """One block from the driver's hand; ``own``: every box is a class of its own, named by its id."""
    kind = how.get("kind", "gfmm")
    names = [c for c in ("n_samples", "centroid") if c in boxes.columns]
    return as_model(_usable(boxes, d, kind).select("box_id", *(["v", "w"] if d else []), "c", *names, *NEEDS.get(kind, [])).orderBy("box_id").toArrow(), d, own, **how)


def as_model(rows: pa.Table, d: int, own: bool = False, **how) -> Model:
    """Boxes in order of box_id as arrays."""
    kind, n, names = how.get("kind", "gfmm"), rows.num_rows, rows.column_names

    def wide(c: str, t: type, empty) -> np.ndarray:
        column = rows[c].combine_chunks()
        flat = column.flatten()
        if t is float and not column.null_count and not flat.null_count and len(flat) == n * d:
            return flat.to_numpy().astype(float).reshape(n, d)
        return np.array([[empty if x is None else x for x in row] for row in column.to_pylist()], t).reshape(n, -1 if n else d)

    v, w = (wide(c, float, np.nan) if d else np.zeros((n, 0)) for c in ("v", "w"))
    count = np.nan_to_num(np.array(rows["n_samples"].to_pylist(), float), nan=1.0) if "n_samples" in names else np.ones(n)
    centre = (v + w) / 2
    if "centroid" in names:
        told = rows["centroid"].combine_chunks()
        if not told.null_count and not told.flatten().null_count and n and (told.value_lengths().to_numpy() == d).all():
            centre = wide("centroid", float, np.nan)
        else:
            for k, m in enumerate(told.to_pylist()):
                if m is not None and len(m) == d:
                    centre[k] = m
    if kind == "onehot":
        how["bits"] = wide("bits", np.int64, 0)
    elif kind == "freqcat":
        how["slots"] = wide("e", np.int64, EMPTY), wide("f", np.int64, EMPTY)
    elif kind == "eiol":
        how["hist"] = [[dict(h) for h in row] for row in rows["hist"].to_pylist()]
    ids = rows["box_id"].to_numpy().astype(np.int64)
    return Model(ids, v, w, ids if own else rows["c"].fill_null(-1).to_numpy().astype(np.int64), count, centre, **how)


def n_blocks(boxes: DataFrame, d: int, kind: str = "gfmm") -> int:
    """Blocks of bounded size that the model takes."""
    cats = {"onehot": F.size("bits"), "freqcat": F.size("e") * 2, "eiol": F.aggregate("hist", F.lit(0), lambda a, h: a + 2 * F.size(h))}.get(kind, F.lit(0))
    cells = _usable(boxes, d, kind).agg(F.sum(F.lit(2 * d + 2) + cats)).first()[0] or 0
    k = max(1, -(-cells // BLOCK_CELLS))
    if k > MOST_BLOCKS:
        raise ValueError(f"a model of {cells} numbers can't be held by a task; coarsen it first")
    return k


def blocks_of(boxes: DataFrame, d: int, **how) -> Iterator[Model]:
    """The model in blocks, one after the other."""
    k = n_blocks(boxes, d, how.get("kind", "gfmm"))
    for b in range(k):
        yield load_block(boxes if k == 1 else boxes.filter(F.pmod(F.xxhash64("box_id"), F.lit(k)) == b), d, **how)


def one_block(boxes: DataFrame, d: int, **how) -> Model:
    if n_blocks(boxes, d, how.get("kind", "gfmm")) > 1:
        raise ValueError("this needs a model of one block; coarsen it first")
    return load_block(boxes, d, **how)


def _passes(boxes: DataFrame, d: int, **how) -> Iterator[list]:
    """Broadcast blocks, at most ``PASS_BLOCKS`` of them together."""
    together, some = [], False
    for m in blocks_of(boxes, d, **how):
        if len(m.ids):
            some = True
            together.append(boxes.sparkSession.sparkContext.broadcast(m))
        if len(together) == PASS_BLOCKS:
            yield together
            together = []
    if not some:
        raise ValueError("a model without boxes predicts nothing")
    if together:
        yield together


#: Rows of a task that are asked together, about.
GATHERED = 200_000


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together: of more rows a neighbourhood is smaller, and meets fewer boxes."""
    some: list[pa.RecordBatch] = []
    for batch in batches:
        some.append(batch)
        if sum(x.num_rows for x in some) >= GATHERED:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some = []
    if sum(x.num_rows for x in some):
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def _bounds(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    take = lambda k: batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d) if d else np.zeros((batch.num_rows, 0))
    xl, xu = take(1), take(2)
    return np.where(np.isnan(xl), MISSING_LOW, xl), np.where(np.isnan(xu), MISSING_HIGH, xu)


def _categories(batch: pa.RecordBatch) -> np.ndarray | None:
    if batch.num_columns < 4:
        return None
    flat = batch.column(3).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _tiles(batch: pa.RecordBatch, d: int, n_boxes: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray | None]]:
    xl, xu = _bounds(batch, d)
    cat = _categories(batch)
    step = max(1, TILE // max(1, n_boxes))
    for k in range(0, len(xl), step):
        yield batch.column(0).slice(k, step), xl[k : k + step], xu[k : k + step], None if cat is None else cat[k : k + step]


def _ready(samples: DataFrame, d: int, kind: str = "gfmm") -> DataFrame:
    fill = lambda c: F.transform(c, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan"))))
    rows = samples.filter((F.size("xl") == d) & (F.size("xu") == d))
    numbers = [F.col("sid").cast("bigint"), fill("xl"), fill("xu")]
    if kind not in MIXED:
        return rows.select(*numbers)
    cast, missing = ("string", str(EMPTY)) if kind == "eiol" else ("bigint", 0 if kind == "onehot" else EMPTY)
    return rows.filter(F.col("cat").isNotNull()).select(*numbers, F.transform("cat", lambda x: F.coalesce(x.cast(cast), F.lit(missing).cast(cast))))


def evidence(samples: DataFrame, boxes: DataFrame, d: int, kind: str = "gfmm", rule: str = "manhattan", gamma=1.0, own: bool = False, **how) -> DataFrame:
    """Per sample: greatest membership, classes of the boxes that have it, the first and the nearest of them."""
    names = ["sid", "top", "c_low", "c_high", "first_id", "first_c", "near", "near_n", "near_id", "near_c"]
    passes = list(_passes(boxes, d, kind=kind, rule=rule, gamma=gamma, own=own, **how))  # handles of broadcasts
    several = len(passes) > 1
    ready = _ready(samples, d, kind)

    def asks(shared: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in gathered(batches):
                (xl, xu), cat, found = _bounds(batch, d), _categories(batch), None
                for s in shared:
                    e = scoring.evidence_of(s.value, xl, xu, cat, several or len(shared) > 1)
                    found = e if found is None else scoring.combine(found, e)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in found]], names=names)

        return run

    runs = [ready.mapInArrow(asks(shared), EVIDENCE) for shared in passes]
    if not several:
        return runs[0]
    both = runs[0]
    for p in runs[1:]:
        both = both.unionByName(p)
    best = both.groupBy("sid").agg(F.collect_list(F.struct(*[c for c in both.columns if c != "sid"])).alias("e"))  # one entry per pass
    best = best.withColumn("e", F.filter("e", lambda x: x["top"] == F.array_max(F.transform("e", lambda y: y["top"]))))
    first = F.array_min(F.transform("e", lambda x: F.struct(x["first_id"], x["first_c"])))
    near = F.array_min(F.transform("e", lambda x: F.struct(x["near"], x["near_n"], x["near_id"], x["near_c"])))
    return best.select("sid", F.col("e")[0]["top"].alias("top"), F.array_min(F.transform("e", lambda x: x["c_low"])).alias("c_low"), F.array_max(F.transform("e", lambda x: x["c_high"])).alias("c_high"),
                       first["first_id"].alias("first_id"), first["first_c"].alias("first_c"), near["near"].alias("near"), near["near_n"].alias("near_n"), near["near_id"].alias("near_id"), near["near_c"].alias("near_c"))


def predict(samples: DataFrame, boxes: DataFrame, d: int, kind: str = "gfmm", rule: str = "manhattan", gamma=1.0, **how) -> DataFrame:
    """(sid, y_pred, box_id, membership): class of the box of greatest membership, between classes by the rule
    (``manhattan``, ``corners``, ``centroid``, or ``probability``: by the weight of samples)."""
    if rule == "probability":
        return _by_probability(samples, boxes, d, kind, gamma, **how)
    e = evidence(samples, boxes, d, kind, rule, gamma, **how)
    torn = F.col("c_low") != F.col("c_high")
    return e.select("sid", F.when(torn, F.col("near_c")).otherwise(F.col("first_c")).cast("int").alias("y_pred"), F.when(torn, F.col("near_id")).otherwise(F.col("first_id")).alias("box_id"), F.col("top").alias("membership"))


def attribute(samples: DataFrame, boxes: DataFrame, d: int, kind: str = "gfmm", rule: str = "manhattan", gamma=1.0, **how) -> DataFrame:
    """(sid, box_id, c): the one box each sample counts for, nearest of those of greatest membership (or by the weight of samples)."""
    if rule == "probability":
        found = _by_probability(samples, boxes, d, kind, gamma, **how)
    else:
        e = evidence(samples, boxes, d, kind, rule, gamma, own=True, **how)
        found = e.select("sid", F.when(F.col("c_low") != F.col("c_high"), F.col("near_id")).otherwise(F.col("first_id")).alias("box_id"))
    return found.select("sid", "box_id").join(boxes.select("box_id", "c"), "box_id").select("sid", "box_id", "c")


def _by_probability(samples: DataFrame, boxes: DataFrame, d: int, kind: str, gamma, **how) -> DataFrame:
    shared = samples.sparkSession.sparkContext.broadcast(one_block(boxes, d, kind=kind, gamma=gamma, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            (xl, xu), cat = _bounds(batch, d), _categories(batch)
            y, box, top = np.empty(len(xl), np.int64), np.empty(len(xl), np.int64), np.empty(len(xl))
            for rows, some, b in scoring.tops(m, xl, xu, cat):
                at = scoring.most_likely(some, b)
                y[rows], box[rows], top[rows] = some.c[at], some.ids[at], b[np.arange(len(b)), at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y, pa.int32()), pa.array(box), pa.array(top)], names=["sid", "y_pred", "box_id", "membership"])

    return _ready(samples, d, kind).mapInArrow(run, "sid bigint, y_pred int, box_id bigint, membership double")


def predict_probability(samples: DataFrame, boxes: DataFrame, d: int, gamma=1.0, **how) -> DataFrame:
    """(sid, y_pred): between classes the one with the greater weight of samples."""
    return predict(samples, boxes, d, rule="probability", gamma=gamma, **how).select("sid", "y_pred")


def class_memberships(samples: DataFrame, boxes: DataFrame, d: int, kind: str = "gfmm", gamma=1.0, **how) -> DataFrame:
    """(sid, c, membership, box_id): per sample and class the greatest membership and the first box that has it."""
    parts = []
    for shared in _passes(boxes, d, kind=kind, gamma=gamma, **how):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            most = max(len(s.value.ids) for s in shared)
            for batch in batches:
                for sid, xl, xu, cat in _tiles(batch, d, most):
                    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                    for s in shared:
                        m = s.value
                        b = tile_membership(m, xl, xu, cat)
                        for c in np.unique(m.c).tolist():
                            own = np.flatnonzero(m.c == c)
                            at = b[:, own].argmax(axis=1)
                            value, box = b[np.arange(len(b)), own[at]], m.ids[own[at]]
                            if c in best:
                                old, kept = best[c]
                                ahead = (value > old) | ((value == old) & (box < kept))
                                value, box = np.where(ahead, value, old), np.where(ahead, box, kept)
                            best[c] = value, box
                    for c, (value, box) in best.items():
                        yield pa.RecordBatch.from_arrays([sid, pa.array(np.full(len(value), c), pa.int32()), pa.array(value), pa.array(box)], names=["sid", "c", "membership", "box_id"])

        parts.append(_ready(samples, d, kind).mapInArrow(run, CLASSES))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both if len(parts) == 1 else both.groupBy("sid", "c").agg(F.max("membership").alias("membership"), F.max_by("box_id", F.struct("membership", -F.col("box_id"))).alias("box_id"))


def class_probabilities(memberships: DataFrame) -> DataFrame:
    """(sid, c, proba): memberships in proportion to their sum; all 0 where the sum is 0."""
    sums = memberships.groupBy("sid").agg(F.sum("membership").alias("_s"))
    return memberships.join(sums, "sid").select("sid", "c", F.when(F.col("_s") == 0, F.col("membership")).otherwise(F.col("membership") / F.col("_s")).alias("proba"))


def explain(samples: DataFrame, boxes: DataFrame, d: int, kind: str = "gfmm", rule: str = "manhattan", gamma=1.0, **how) -> DataFrame:
    """(sid, y_pred, c, membership, v, w and the categories of the box): the prediction, and per class the box that speaks for it."""
    sides = boxes.select("box_id", "v", "w", *NEEDS.get(kind, []))
    told = class_memberships(samples, boxes, d, kind, gamma, **how).join(sides, "box_id")
    return told.join(predict(samples, boxes, d, kind, rule, gamma, **how).select("sid", "y_pred"), "sid").select("sid", "y_pred", "c", "membership", "v", "w", *NEEDS.get(kind, []))


def accuracy(predicted: DataFrame, y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    return predicted.agg(F.avg((F.col(y) == F.col(y_pred)).cast("double")).alias("accuracy"))
