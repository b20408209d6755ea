"""Parameter search by cross-validation: every (candidate, fold) is one group, all are fitted side by side."""

from __future__ import annotations

import itertools
import random
import struct
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxfold.kernels import jvm
from boxfold.kernels import learners as kl
from boxfold.kernels.geometry import MISSING_HIGH, MISSING_LOW
from boxfold.lineage import cut
from boxfold.operators import ensemble
from boxfold.operators import fit as fitting
from boxfold.operators import prepare


def grid(space: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def sample_grid(space: Mapping[str, Sequence], n: int, seed: int = 0) -> list[dict]:
    """n different candidates of the grid (all, if there are fewer)."""
    every = grid(space)
    return random.Random(seed).sample(every, min(n, len(every)))


def cross_validate(samples: DataFrame, learner: str, candidates: Sequence[dict], k: int = 5, seed: int = 0, by: Sequence[str] = (), most_rows: int = fitting.MOST_ROWS) -> DataFrame:
    """(candidate, [by,] accuracy, folds): mean accuracy over the folds; candidates are numbered from 0.

    A group holds the samples once per (candidate, fold), ``most_rows`` at most; larger data is tuned in parts ``by``."""
    def one(params: dict, train: pd.DataFrame, test: pd.DataFrame) -> np.ndarray:
        boxes = kl.make(learner, **params).fit(fitting.to_samples(train, learner))
        return kl.predict(boxes, fitting.to_samples(test, learner).marked(), params.get("gamma", 1.0), learner, **_scoring(learner, params))

    return _validate(samples, candidates, k, seed, by, most_rows, one)


def _scoring(learner: str, params: Mapping) -> dict:
    """What scoring a mixed model takes besides its boxes."""
    return {c: params[c] for c in {"eiol": ("alpha",), "freqcat": ("distance",)}.get(kl.kind_of(learner), ()) if c in params}


def _validate(samples: DataFrame, candidates: Sequence[dict], k: int, seed: int, by: Sequence[str], most_rows: int, predict) -> DataFrame:
    folded = prepare.stratified_folds(samples, "sid", "y", k, seed)
    spread = folded.withColumn("candidate", F.explode(F.array(*[F.lit(i) for i in range(len(candidates))]))).withColumn("held", F.explode(F.array(*[F.lit(i) for i in range(k)])))
    keys = [*by, "candidate", "held"]
    types = dict(spread.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most_rows:
            raise ValueError(f"{len(pdf)} samples in one fold, {most_rows} at most; tune in parts")
        pdf = pdf.sort_values(["seq", "sid"], kind="stable")
        train, test = pdf[pdf["fold"] != key[-1]], pdf[pdf["fold"] == key[-1]]
        right = float((predict(candidates[key[-2]], train, test) == test["y"].to_numpy()).sum()) if len(train) and len(test) else 0.0
        return pd.DataFrame([[*key, right, len(test)]], columns=[*keys, "right", "n"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", right double, n bigint"
    runs = fitting.spread(spread, keys).groupBy(*keys).applyInPandas(run, schema).filter("n > 0")
    return runs.groupBy(*by, "candidate").agg(F.avg(F.col("right") / F.col("n")).alias("accuracy"), F.count(F.lit(1)).alias("folds"))


def best(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The candidate of greatest accuracy, of equal ones the first."""
    return scores.groupBy(*by).agg(F.max_by("candidate", F.struct("accuracy", -F.col("candidate"))).alias("candidate"), F.max("accuracy").alias("accuracy"))


def search_and_fit(samples: DataFrame, learner: str, candidates: Sequence[dict], k: int = 5, seed: int = 0) -> tuple[dict, DataFrame]:
    """The best candidate's parameters, and the boxes it gives on all samples."""
    winner = candidates[best(cross_validate(samples, learner, candidates, k, seed)).first()["candidate"]]
    return winner, fitting.fit(samples, learner, **winner)


def _packed(drawn: DataFrame, by: Sequence[str], k: int, seed: int, most_rows: int, groups: int, in_jvm: bool = False) -> DataFrame:
    """One row per group, ``rows``: its samples in order, each with its ``fold`` of k with even class shares.

    Samples are shuffled once, and read again for every fit without their keys: as Arrow bytes, or, ``plain``, if asked for ``in_jvm`` and
    plain comparisons tell all about the group's points, as ``PointBoxes`` takes them."""
    types = dict(drawn.dtypes)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        if table.num_rows > most_rows:
            raise ValueError(f"{table.num_rows} samples in one group, {most_rows} at most; tune in parts")
        order = [(c, "ascending") for c in ("seq", "sid") if c in table.column_names]
        table = table.take(pc.sort_indices(table, order)).combine_chunks()
        fold = _folds(table["sid"].to_numpy(), table["y"].fill_null(kl.UNLABELLED).to_numpy(), k, seed)
        points = table["xl"].equals(table["xu"])
        table = table.drop_columns([*by, *[c for c, _ in order], *(["xu"] if points else [])]).append_column("fold", pa.array(fold))
        rows = _plain(table) if in_jvm and points else None
        plain = rows is not None
        if not plain:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            rows = sink.getvalue().to_pybytes()
        return pa.table({**{c: pa.array([v.as_py()], v.type) for c, v in zip(by, key)}, "rows": pa.array([rows], pa.binary()), "plain": pa.array([plain])})

    tasks = max(16 * drawn.sparkSession.sparkContext.defaultParallelism, groups // fitting.GROUPS_PER_TASK)  # later passes take as many
    return drawn.repartition(max(1, min(2 * groups, tasks)), *by).groupBy(*by).applyInArrow(pack, ", ".join(f"`{c}` {types[c]}" for c in by) + ", rows binary, plain boolean")


def _plain(table: pa.Table) -> bytes | None:
    """Points (``xl``) with their classes and folds for ``PointBoxes``; None where they are not whole, labelled and comparable, or carry more than that."""
    flat, n = table["xl"].combine_chunks().flatten(), table.num_rows
    d = len(flat) // n if n else 0
    if set(table.column_names) != {"xl", "y", "fold"} or not d or table["y"].null_count or flat.null_count or not pc.all(pc.equal(pc.list_value_length(table["xl"]), d)).as_py():
        return None
    x, y = flat.to_numpy().astype("<f8").reshape(n, d) + 0.0, table["y"].to_numpy()
    if (x == MISSING_LOW).any() or (x == MISSING_HIGH).any() or not kl.make("improved").comparable_to(kl.Samples(x, x, y)):
        return None
    return struct.pack("<ii", n, d) + x.tobytes() + y.astype("<i4").tobytes() + table["fold"].to_numpy().astype("<i4").tobytes()


def _in_jvm(learner: str, candidates: Sequence[dict]) -> bool:
    """Whether ``PointBoxes`` knows the learner and its parameters."""
    return learner == "improved" and all(set(c) == {"theta"} for c in candidates)


def _folds(sid: np.ndarray, y: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A sample's rank in its class, in a random order, modulo k."""
    chance = np.empty(len(sid))
    chance[np.argsort(sid, kind="stable")] = np.random.default_rng(seed).permutation(len(sid))
    order = np.lexsort((chance, y))
    _, first, n = np.unique(y[order], return_index=True, return_counts=True)
    out = np.empty(len(sid), np.int8 if k < 128 else np.int64)
    out[order] = (np.arange(len(sid)) - np.repeat(first, n)) % k
    return out


def _unpacked(rows: bytes, learner: str) -> tuple[kl.Samples, np.ndarray]:
    pdf = pa.ipc.open_stream(rows).read_all().to_pandas()
    if "xu" not in pdf:
        pdf["xu"] = pdf["xl"]
    return fitting.to_samples(pdf, learner), pdf["fold"].to_numpy()


def _accuracies(packed: DataFrame, by: Sequence[str], learner: str, candidates: Sequence[dict], k: int) -> DataFrame:
    """([by,] candidate, accuracy): mean over the folds of each group, all of them learnt where the group is."""
    types = dict(packed.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for row in pdf.itertuples(index=False):
                s, fold = _unpacked(row.rows, learner)
                for c, params in enumerate(candidates):
                    shares = []
                    for held in range(k):
                        test, train = np.flatnonzero(fold == held), np.flatnonzero(fold != held)
                        if len(test):
                            fold_of = kl.make(learner, **params)
                            fold_of.bounds_only = kl.rule_of(learner) not in ("centroid", "probability")
                            told = kl.predict(fold_of.fit(s.take(train)), s.take(test).marked(), params.get("gamma", 1.0), learner, **_scoring(learner, params)) if len(train) else None
                            shares.append(0.0 if told is None else float((told == s.y[test]).mean()))
                    if shares:
                        found.append([*[getattr(row, b) for b in by], c, float(np.mean(shares))])
            yield pd.DataFrame(found, columns=[*by, "candidate", "accuracy"])

    def plain(groups: DataFrame) -> DataFrame:
        thetas = ",".join(repr(float(c["theta"])) for c in candidates)
        return groups.select(*by, F.posexplode(F.call_function("boxfold_accuracies", "rows", F.lit(thetas), F.lit(k))).alias("candidate", "accuracy"))

    return _each(packed, lambda groups: groups.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in by) + ", candidate int, accuracy double"), plain)


def _each(packed: DataFrame, other: Callable[[DataFrame], DataFrame], plain: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What is told of plain groups in the JVM, and of other ones by Python workers, which are asked only if there are any."""
    kinds = {r[0] for r in packed.select("plain").distinct().collect()}
    parts = [f(packed.filter("plain" if kind else "NOT plain")) for kind, f in ((True, plain), (False, other)) if kind in kinds or not (kinds or kind)]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def tuned_members(drawn: DataFrame, learner: str, candidates: Sequence[dict], k: int = 5, seed: int = 0, part_rows: int | None = None, most_rows: int = fitting.MOST_ROWS) -> DataFrame:
    """Boxes of members (``drawn`` has member_id) that each use their own best candidate.

    ``part_rows``: members are validated and learnt in parts of about so many rows; the best candidate has the greatest mean accuracy over a member's parts.
    Folds are of even class shares in every part.  Parts of whole, labelled points are validated and learnt in the JVM if it knows the learner."""
    sizes = ensemble._sizes(drawn)
    parts, by = 1, ["member_id"]
    if part_rows is not None:
        parts, by = ensemble._k(sizes[1], part_rows), ["member_id", "partition_id"]
        drawn = ensemble.in_parts(drawn, part_rows, seed, sizes)
    in_jvm = _in_jvm(learner, candidates)
    if in_jvm:
        jvm.ensure(drawn.sparkSession)
    packed = cut(_packed(drawn, by, k, seed, most_rows, sizes[0] * parts, in_jvm))
    scores = _accuracies(packed, by, learner, candidates, k).groupBy("member_id", "candidate").agg(F.avg("accuracy").alias("accuracy"))
    winners = {r["member_id"]: r["candidate"] for r in best(scores, ["member_id"]).collect()}

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                s, _ = _unpacked(row.rows, learner)
                boxes = fitting.boxes_frame(kl.make(learner, **candidates[winners[row.member_id]]).fit(s), learner)
                if part_rows is not None:
                    boxes["box_id"] += row.partition_id * ensemble.PART_IDS
                boxes.insert(0, "member_id", row.member_id)
                yield boxes

    def plain(groups: DataFrame) -> DataFrame:
        theta = F.element_at(F.create_map(*[F.lit(x) for m, c in winners.items() for x in (m, float(candidates[c]["theta"]))]), F.col("member_id"))
        first = F.col("partition_id").cast("bigint") * ensemble.PART_IDS if part_rows is not None else F.lit(0).cast("bigint")
        told = groups.select("member_id", first.alias("first"), F.posexplode(F.call_function("boxfold_fitted", "rows", theta)).alias("pos", "box"))
        return told.select("member_id", (F.col("first") + F.col("pos") + 1).alias("box_id"), *[F.col(f"box.{c}").alias(c) for c in ("v", "w", "c", "n_samples", "centroid")])

    return _each(packed, lambda groups: groups.mapInPandas(learn, f"member_id {dict(packed.dtypes)['member_id']}, " + fitting.BOX_FIELDS + fitting.CAT_FIELDS.get(learner, "")), plain)


def tuned_random_boxes(samples: DataFrame, members: DataFrame, learner: str, candidates: Sequence[dict], max_samples: float = 0.5, k: int = 5, seed: int = 0, part_rows: int | None = None) -> DataFrame:
    """Tuned members that each have their own features (``members`` has features) and a stratified share of the rows."""
    drawn = prepare.draw_stratified(prepare.per_member(samples, members), "sid", "y", max_samples, seed=seed)
    return tuned_members(ensemble.project(drawn, members), learner, candidates, k, seed, part_rows)


def nested(candidate: Mapping, prefix: str = "base_estimator__") -> tuple[dict, dict]:
    """Parameters of an ensemble, and, from under their prefix, those of its members."""
    return {k: v for k, v in candidate.items() if not k.startswith(prefix)}, {k.removeprefix(prefix): v for k, v in candidate.items() if k.startswith(prefix)}


def cross_validate_ensemble(samples: DataFrame, learner: str, candidates: Sequence[dict], k: int = 5, seed: int = 0, by: Sequence[str] = (), most_rows: int = fitting.MOST_ROWS) -> DataFrame:
    """(candidate, [by,] accuracy, folds) of bagged votes; a candidate has n_estimators, max_samples and, under base_estimator__, its members' parameters."""
    def vote(candidate: dict, train: pd.DataFrame, test: pd.DataFrame) -> np.ndarray:
        own, params = nested(candidate)
        rng = np.random.default_rng(seed)
        s, votes = fitting.to_samples(test, learner).marked(), []
        for _ in range(own.get("n_estimators", 10)):
            rows = np.sort(rng.permutation(len(train))[: max(1, int(own.get("max_samples", 0.5) * len(train)))])
            boxes = kl.make(learner, **params).fit(fitting.to_samples(train.iloc[rows], learner))
            votes.append(kl.predict(boxes, s, params.get("gamma", 1.0), learner, **_scoring(learner, params)))
        classes = np.unique(votes)
        return classes[(np.array(votes)[:, :, None] == classes).sum(axis=0).argmax(axis=1)]

    return _validate(samples, candidates, k, seed, by, most_rows, vote)
