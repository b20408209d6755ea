"""Ensembles: members fitted side by side, combined by votes, mean memberships or a model over their boxes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxfold.kernels import scoring
from boxfold.lineage import cut
from boxfold.operators import fit as fitting
from boxfold.operators import prepare, score

#: Members of an ensemble at most.
MOST_MEMBERS = 10_000

#: Rows of one part of a member, about; a member of no more rows is one fold, as it is without parts.
PART_ROWS = 20_000
#: Numbers of boxes kept for one part of a member.
PART_IDS = 1 << 20


def max_features(kind: str | int | float | None, d: int) -> int:
    """How many of d features a member gets."""
    if kind is None:
        return d
    if kind in ("auto", "sqrt"):
        return max(1, int(math.sqrt(d)))
    if kind == "log2":
        return max(1, int(math.log2(d)))
    if isinstance(kind, float):
        return max(1, int(kind * d))
    return max(1, min(d, int(kind)))


def draw_features(members: DataFrame, d: int, kind: str | int | float | None = "sqrt", balanced: bool = False, seed: int = 0) -> DataFrame:
    """``members`` with a random ascending list ``features``; balanced: a random size up to the limit."""
    k = max_features(kind, d)
    order = F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.struct(F.xxhash64("member_id", j, F.lit(seed)).alias("key"), j.alias("j")))), lambda s: s["j"])
    size = F.pmod(F.xxhash64("member_id", F.lit(seed + 1)), F.lit(k)) + 1 if balanced else F.lit(k)
    return members.withColumn("features", F.array_sort(F.slice(order, F.lit(1), size.cast("int"))))


def project(samples: DataFrame, features: DataFrame) -> DataFrame:
    """Samples of a member (member_id) with only its features; members are few and broadcast, their number is checked."""
    if features.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 members")
    pick = lambda c: F.transform("features", lambda j: F.get(c, j))
    return samples.join(F.broadcast(features.select("member_id", "features")), "member_id").withColumns({"xl": pick("xl"), "xu": pick("xu")}).drop("features")


def draw(samples: DataFrame, members: DataFrame, max_samples: float = 0.5, bootstrap: bool = False, class_balanced: bool = False, seed: int = 0) -> DataFrame:
    """The rows each member is fitted on, with ``member_id``."""
    copies = prepare.per_member(samples, members)
    if class_balanced:
        return prepare.draw_balanced(copies, "sid", "y", max_samples, seed=seed)
    return prepare.draw_rate(copies, "sid", max_samples, bootstrap, seed=seed)


def _sizes(drawn: DataFrame) -> tuple[int, int, int]:
    """How many members there are, the rows of the largest, and those of the largest class of a member."""
    classes = drawn.groupBy("member_id", "y").count()
    n, most, of_class = classes.groupBy("member_id").agg(F.sum("count").alias("n"), F.max("count").alias("c")).agg(F.count(F.lit(1)), F.max("n"), F.max("c")).first()
    return n, most or 0, of_class or 0


def _k(most: int, part_rows: int) -> int:
    return max(1, -(-most // part_rows))


def in_parts(drawn: DataFrame, part_rows: int, seed: int = 0, sizes: tuple[int, int, int] | None = None) -> DataFrame:
    """``partition_id``: every member's rows (counted, if not told) dealt class by class, at random, to parts of about ``part_rows``; no row is left out."""
    _, most, of_class = sizes or _sizes(drawn)
    k = _k(most, part_rows)
    if k == 1:
        return drawn.withColumn("partition_id", F.lit(0))
    if k >= PART_IDS >> 8 or 4 * part_rows > PART_IDS:
        raise ValueError(f"{k} parts of {part_rows} rows can't be numbered")
    return prepare._ranked(drawn, ["member_id", "y"], "sid", seed + 1, most=of_class).withColumn("partition_id", F.pmod("_rank", F.lit(k)).cast("int")).drop("_rank", "_size")


def fit_members(drawn: DataFrame, learner: str, part_rows: int | None = None, seed: int = 0, **params) -> DataFrame:
    """Boxes of every member (``drawn`` has member_id): of one fold, or the union over its parts of about ``part_rows``."""
    if part_rows is None:
        return fitting.fit(drawn, learner, ["member_id"], **params)
    sizes = _sizes(drawn)
    boxes = fitting.fit(in_parts(drawn, part_rows, seed, sizes), learner, ["member_id", "partition_id"], groups=sizes[0] * _k(sizes[1], part_rows), **params)
    return boxes.withColumn("box_id", F.col("partition_id").cast("bigint") * PART_IDS + F.col("box_id")).drop("partition_id")


def bag(samples: DataFrame, members: DataFrame, learner: str, max_samples: float = 0.5, bootstrap: bool = False, class_balanced: bool = False, seed: int = 0, part_rows: int | None = None, **params) -> DataFrame:
    """Boxes of every member; ``part_rows``: learnt in parts of about so many rows."""
    return fit_members(draw(samples, members, max_samples, bootstrap, class_balanced, seed), learner, part_rows, seed, **params)


def random_boxes(samples: DataFrame, members: DataFrame, learner: str, max_samples: float = 0.5, class_balanced: bool = False, seed: int = 0, part_rows: int | None = None, **params) -> DataFrame:
    """Boxes of every member over its own features (``members`` has ``features``) and a stratified share of rows."""
    copies = prepare.per_member(samples, members)
    rows = prepare.draw_balanced(copies, "sid", "y", max_samples, seed=seed) if class_balanced else prepare.draw_stratified(copies, "sid", "y", max_samples, seed=seed)
    return fit_members(project(rows, members), learner, part_rows, seed, **params)


def member_predictions(samples: DataFrame, boxes: DataFrame, d: int, features: DataFrame | None = None, kind: str = "gfmm", rule: str = "manhattan", gamma=1.0, attribute: bool = False) -> DataFrame:
    """(member_id, sid, y_pred) of every member, over its own features if given; ``attribute``: (member_id, sid, box_id), the box a sample counts for.

    All members that fit in one block of boxes are asked in one pass over the samples; nothing is shuffled."""
    out, kind_of = None, boxes.schema["member_id"].dataType.simpleString()
    for models in _passes(boxes, d, features, kind, rule, gamma):
        one = _ask(samples, models, d, kind_of, attribute)
        out = one if out is None else out.unionByName(one)
    return out


#: Rows of one task of a vote, about.
VOTE_ROWS = 40_000


def vote(samples: DataFrame, boxes: DataFrame, d: int, features: DataFrame | None = None, kind: str = "gfmm", rule: str = "manhattan", gamma=1.0) -> DataFrame:
    """(sid, y_pred): ``majority`` of ``member_predictions``, counted where the samples are.

    Samples are brought together by place: equal ones are asked once, and a task meets few of the boxes."""
    tasks = max(1, -(-samples.count() // VOTE_ROWS))
    near, counts = cut(samples.select("sid", "xl", "xu").repartitionByRange(max(tasks, samples.sparkSession.sparkContext.defaultParallelism), "xl", "xu")), None
    for models in _passes(boxes, d, features, kind, rule, gamma):
        one = _count(near, models, d)
        counts = one if counts is None else counts.unionByName(one)
    return counts.groupBy("sid", "y_pred").agg(F.sum("n").alias("n")).groupBy("sid").agg(F.max_by("y_pred", F.struct("n", -F.col("y_pred"))).alias("y_pred"))


def _passes(boxes: DataFrame, d: int, features: DataFrame | None, kind: str, rule: str, gamma) -> Iterator[list]:
    """(member, its features, its model) of all members, of a block's size together."""
    lists = {r["member_id"]: list(r["features"]) for r in features.select("member_id", "features").collect()} if features is not None else {}
    counts = boxes.groupBy("member_id").agg(F.count(F.lit(1)).alias("n")).orderBy("member_id").limit(MOST_MEMBERS + 1).collect()
    if len(counts) > MOST_MEMBERS:
        raise ValueError(f"more than {MOST_MEMBERS} members")
    passes: list[list] = [[]]
    cells = 0
    for r in counts:
        size = 2 * len(lists.get(r["member_id"], range(d))) * r["n"]
        if size > score.BLOCK_CELLS:
            raise ValueError(f"member {r['member_id']} has {r['n']} boxes, more than a block; coarsen it first")
        if cells + size > score.BLOCK_CELLS and passes[-1]:
            passes.append([])
            cells = 0
        passes[-1].append(r["member_id"])
        cells += size
    names = ["member_id", "box_id", "v", "w", "c", *[c for c in ("n_samples", "centroid") if c in boxes.columns and rule in ("centroid", "probability")]]
    for group in passes:
        rows = boxes.filter(F.col("member_id").isin(group)).select(*names).orderBy("member_id", "box_id").toArrow()  # of one block's size
        member = rows["member_id"].to_numpy()
        models = []
        for m in group:
            own = lists.get(m, list(range(d)))
            part = rows.slice(int(np.searchsorted(member, m, "left")), int((member == m).sum()))
            models.append((m, own, score.as_model(part, len(own), kind=kind, rule=rule, gamma=gamma)))
        yield models


def _ask(samples: DataFrame, members: list, d: int, member_type: str, attribute: bool) -> DataFrame:
    shared = samples.sparkSession.sparkContext.broadcast(members)
    name = "box_id" if attribute else "y_pred"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in score.gathered(batches):
            sid, (xl, xu) = batch.column(0), score._bounds(batch, d)
            for member, own, model in shared.value:
                if len(model.ids) and len(sid):
                    told = scoring.speakers(model, xl[:, own], xu[:, own]) if attribute else scoring.winners(model, xl[:, own], xu[:, own])
                    yield pa.RecordBatch.from_pydict({"member_id": np.full(len(sid), member), "sid": sid, name: told}, schema=kinds)

    kinds = pa.schema([("member_id", pa.int64() if member_type == "bigint" else pa.int32()), ("sid", pa.int64()), (name, pa.int64() if attribute else pa.int32())])
    return score._ready(samples, d).mapInArrow(run, f"member_id {member_type}, sid bigint, {name} {'bigint' if attribute else 'int'}")


def _count(samples: DataFrame, members: list, d: int) -> DataFrame:
    """(sid, y_pred, n): how many of the members tell a class."""
    shared = samples.sparkSession.sparkContext.broadcast(members)
    kinds = pa.schema([("sid", pa.int64()), ("y_pred", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in score.gathered(batches):
            sid, (xl, xu) = batch.column(0).to_numpy(), score._bounds(batch, d)
            told = [_once(model, xl[:, own], xu[:, own]) for _, own, model in shared.value if len(model.ids) and len(sid)]
            if told:
                votes = np.column_stack(told)
                for c in np.unique(votes):
                    n = (votes == c).sum(axis=1)
                    rows = np.flatnonzero(n)
                    yield pa.RecordBatch.from_pydict({"sid": sid[rows], "y_pred": np.full(len(rows), c), "n": n[rows]}, schema=kinds)

    return score._ready(samples, d).mapInArrow(run, "sid bigint, y_pred int, n bigint")


def _once(model: scoring.Model, xl: np.ndarray, xu: np.ndarray) -> np.ndarray:
    """Predictions, of equal samples worked out once."""
    both = np.ascontiguousarray(np.hstack([xl, xu]) + 0.0)  # one zero
    _, first, which = np.unique(both.view(f"V{both.itemsize * both.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return scoring.winners(model, xl[first], xu[first])[which]


def majority(votes: DataFrame) -> DataFrame:
    """(sid, y_pred): the class with most votes, of equal ones the lowest."""
    counts = votes.groupBy("sid", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("sid").agg(F.max_by("y_pred", F.struct("n", -F.col("y_pred"))).alias("y_pred"))


def mean_memberships(samples: DataFrame, boxes: DataFrame, d: int, **how) -> DataFrame:
    """(sid, c, membership): mean over the members, a member without the class counting as 0."""
    ids = prepare.stated(boxes, "member_id")
    parts = [score.class_memberships(samples, boxes.filter(F.col("member_id") == m), d, **how) for m in ids]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("sid", "c").agg((F.sum("membership") / F.lit(float(len(ids)))).alias("membership"))


def merge_members(boxes: DataFrame, learner: str = "agglomerative2", most_boxes: int = 20_000, **params) -> DataFrame:
    """One model over all members' boxes, learnt from them as weighted interval samples."""
    order = F.col("member_id").cast("bigint") * (1 << 32) + F.col("box_id")
    return fitting.fit(fitting.as_samples(boxes.withColumn("box_id", order)).drop("member_id"), learner, most_rows=most_boxes, **params)


def n_boxes(boxes: DataFrame, by: Sequence[str] = ("member_id",)) -> DataFrame:
    return boxes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_boxes"))
