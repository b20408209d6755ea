"""Clusters of records alike, by Gaussian mixtures.

Records first collapse to weighted cells, a fraction of the reach wide (count, sums, products, extents), so a dense
spot costs no more than a sparse one and a hot spot is never gathered in one task.  Space is divided into blocks
with a rim as wide as two reaches; in every block of a label, expectation-maximisation fits Gaussian mixtures with
regularised covariance to the cells, on standardised features reduced by their principal axes.  Components start
from density peaks, each more than a reach from those before; mixtures of all the peaks, of the denser half, quarter
and so on down to one component are fitted, and the one with the least Bayesian information criterion is taken.  All
blocks of a task are fitted side by side, as arrays over (cell, component) pairs.

A component belongs to the block that holds its mean, a cell to the component that most likely made it, and a
cluster is what one component made: nothing joins or splits clusters afterwards.  ``audit`` proves or refutes that they
are what the reach asks for: clusters that fit in the reach and are apart by more than it are the only ones possible.

Defined results: records with a missing feature or label are left out; repeated deliveries are one record; equal
points fall in one cluster; a record alike to no other is a cluster of one; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxfold.lineage import cut

#: Cells to a reach, cells to a block's side, and cells of its rim.
FINE, BLOCK, RIM = 4, 64, 8
#: Principal axes are kept until they explain this share of the variance.
EXPLAINED = 0.9999
MAX_ITERATIONS = 30
#: Cells (with their copies in rims) that one task fits, and that are fitted side by side; a block is never divided.
TASK_CELLS, GROUP_CELLS = 8_000, 4_000


def labelled_points(table: DataFrame, record: str = "sid", features: Sequence[str] = ("c0", "c1"), label: str = "c2") -> DataFrame:
    """(record, label, x0, x1, …): distinct records with all features and a positive label."""
    there = reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(f) for f in features])
    rows = table.filter(there & (F.col(label) > 0) & F.col(record).isNotNull())
    return rows.select(F.col(record).alias("record"), F.col(label).alias("label"), *[F.col(f).cast("double").alias(f"x{j}") for j, f in enumerate(features)]).dropDuplicates(["record"])


def near_pairs(block: np.ndarray, cell: np.ndarray, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), ordered by i, of cells of one block whose means are within the reach; rows are sorted by block and cell."""
    d, stride = cell.shape[1], BLOCK + 2 * RIM + 2 * FINE + 2
    key = block.astype(np.int64)
    for j in range(d):
        key = key * stride + cell[:, j] + RIM + FINE
    left, right = [], []
    for off in itertools.product(range(-FINE, FINE + 1), repeat=d - 1):
        shift = 0
        for o in off:
            shift = shift * stride + o
        lo = np.searchsorted(key, key + shift * stride - FINE, "left")
        n = np.searchsorted(key, key + shift * stride + FINE, "right") - lo
        ends = np.cumsum(n)
        left.append(np.repeat(np.arange(len(key)), n))
        right.append(np.repeat(lo - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0))
    i, j = np.concatenate(left), np.concatenate(right)
    close = (np.abs(x[i] - x[j]) <= reach).all(axis=1)
    i, j = i[close], j[close]
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def density_peaks(i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells in order of the weight around them, each farther than the reach from those before; and that weight of all cells.

    In rounds: a cell that comes before all undecided cells near it is a peak, the cells near a peak are none."""
    n = len(weight)
    around = np.bincount(i, weight[j], n)
    turn = np.empty(n, np.int64)
    turn[np.lexsort((np.arange(n), -around))] = np.arange(n)
    peak, open_ = np.zeros(n, bool), np.ones(n, bool)
    while len(i):
        starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        first = i[starts][np.minimum.reduceat(turn[j], starts) == turn[i[starts]]]
        peak[first] = True
        open_[j[peak[i]]] = False
        both = open_[i] & open_[j]
        i, j = i[both], j[both]
    return peak, around


class Mixtures:
    """Mixtures of several blocks: cells z (in order of block) with weights and inner scatter, components with the block they are of."""

    def __init__(self, block: np.ndarray, z: np.ndarray, weight: np.ndarray, scatter: np.ndarray, ridge: np.ndarray) -> None:
        self.block, self.weight, self.ridge = block, weight, ridge
        self.n_blocks, self.r = int(block[-1]) + 1, z.shape[1]
        self.total = np.bincount(block, weight, self.n_blocks)
        cells = np.bincount(block, minlength=self.n_blocks)
        self.centre = np.column_stack([np.bincount(block, z[:, a], self.n_blocks) / cells for a in range(self.r)])
        self.z = z - self.centre[block]
        self.product = {(a, b): self.z[:, a] * self.z[:, b] + scatter[:, a, b] for a in range(self.r) for b in range(a, self.r)}

    def pairs(self, cells: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every one of the cells with every component of its block (components are in order of block)."""
        lo = np.searchsorted(home, self.block[cells], "left")
        n = np.searchsorted(home, self.block[cells], "right") - lo
        ends = np.cumsum(n)
        return np.repeat(cells, n), np.repeat(lo - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)

    def joint(self, ci: np.ndarray, cj: np.ndarray, share: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
        """Log of share times density, per pair."""
        inverse = np.linalg.inv(np.linalg.cholesky(cov))
        base = share + np.log(np.diagonal(inverse, axis1=1, axis2=2)).sum(-1) - 0.5 * self.r * np.log(2 * np.pi)
        away = [self.z[ci, a] - mean[cj, a] for a in range(self.r)]
        out = base[cj]
        for a in range(self.r):
            side = away[0] * inverse[cj, a, 0]
            for b in range(1, a + 1):
                side += away[b] * inverse[cj, a, b]
            out -= 0.5 * side * side
        return out

    def fit(self, seeds: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expectation-maximisation from the seeds (means, in order of block): log likelihood per block, log shares, means, covariances."""
        k, r = seeds.shape
        mean, cov = seeds - self.centre[home], np.repeat(self.ridge[None] * 4, k, 0)
        share = -np.log(np.bincount(home, minlength=self.n_blocks)[home])
        held = np.zeros(self.n_blocks, bool)
        held[home] = True
        live = held.copy()
        before = np.full(self.n_blocks, -np.inf)
        ci, cj = self.pairs(np.flatnonzero(held[self.block]), home)
        for _ in range(MAX_ITERATIONS):
            joint = self.joint(ci, cj, share, mean, cov)
            starts = np.flatnonzero(np.concatenate([[True], ci[1:] != ci[:-1]]))
            lengths = np.diff(np.append(starts, len(ci)))
            top = np.maximum.reduceat(joint, starts)
            part = np.exp(joint - np.repeat(top, lengths))
            sums = np.add.reduceat(part, starts)
            cells = ci[starts]
            likelihood = np.bincount(self.block[cells], self.weight[cells] * (top + np.log(sums)), self.n_blocks)
            part *= np.repeat(self.weight[cells] / sums, lengths)
            moving = live[home]
            mass = np.bincount(cj, part, k) + 1e-12
            m = np.column_stack([np.bincount(cj, part * self.z[ci, a], k) / mass for a in range(r)])
            c = np.empty((k, r, r))
            for (a, b), p in self.product.items():
                c[:, a, b] = c[:, b, a] = np.bincount(cj, part * p[ci], k) / mass - m[:, a] * m[:, b]
            c[:, range(r), range(r)] = np.maximum(c[:, range(r), range(r)], 0)
            mean[moving], cov[moving] = m[moving], (c + self.ridge)[moving]
            share = np.where(moving, np.log(mass / self.total[home]), share)
            done = live & (likelihood <= before + 1e-6 * np.abs(likelihood))
            before = np.where(live, likelihood, before)
            if done.any():
                live &= ~done
                if not live.any():
                    break
                kept = live[self.block[ci]]
                ci, cj = ci[kept], cj[kept]
        return before, share, mean, cov

    def choose(self, seeds: np.ndarray, home: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per block the mixture of least information criterion among all seeds, the first half by ``turn``, the first quarter and so on.

        Returns block, log share, mean and covariance of the components chosen."""
        best = np.full(self.n_blocks, np.inf)
        chosen: list[tuple[np.ndarray, ...]] = []
        count = np.bincount(home, minlength=self.n_blocks)
        while len(home):
            likelihood, share, mean, cov = self.fit(seeds, home)
            free = count * (1 + self.r + self.r * (self.r + 1) / 2) - 1
            score = np.where(count > 0, free * np.log(np.maximum(self.total, 2)) - 2 * likelihood, np.inf)
            better = score < best
            best = np.where(better, score, best)
            chosen = [tuple(x[~better[c[0]]] for x in c) for c in chosen]
            own = better[home]
            chosen.append((home[own], share[own], mean[own], cov[own]))
            count = count // 2
            kept = turn < count[home]
            seeds, home, turn = seeds[kept], home[kept], turn[kept]
        out = [np.concatenate(x) for x in zip(*chosen)]
        order = np.argsort(out[0], kind="stable")
        return tuple(x[order] for x in out)

    def assign(self, home: np.ndarray, share: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per cell the component that most likely made it, and the log of share times density there."""
        ci, cj = self.pairs(np.arange(len(self.block)), home)
        joint = self.joint(ci, cj, share, mean, cov)
        starts = np.flatnonzero(np.concatenate([[True], ci[1:] != ci[:-1]]))
        top = np.maximum.reduceat(joint, starts)
        best = np.flatnonzero(joint == np.repeat(top, np.diff(np.append(starts, len(ci)))))
        first = best[np.concatenate([[True], ci[best[1:]] != ci[best[:-1]]])]
        return cj[first], top


def fit_cells(block: np.ndarray, corner: np.ndarray, cell: np.ndarray, weight: np.ndarray, x: np.ndarray, inner: np.ndarray, reach: float, mean: np.ndarray, project: np.ndarray, ridge: np.ndarray) -> dict[str, np.ndarray]:
    """Mixtures of all blocks; per cell its component (``p``, numbered in its block), rank, density, and the component's mean, precision and peak.

    ``corner``: the block's coordinates, ``cell``: the cell's coordinates in its block; rows are sorted by block and cell."""
    d, width = x.shape[1], reach / FINE
    mixtures = Mixtures(block, (x - mean) @ project.T, weight, np.einsum("ai,nij,bj->nab", project, inner, project), ridge)
    peak, around = density_peaks(*near_pairs(block, cell, x, reach), weight)
    at = np.flatnonzero(peak)
    at = at[np.lexsort((at, -around[at], block[at]))]
    home = block[at]
    turn = np.arange(len(at)) - np.searchsorted(home, home, "left")
    home, share, mu, cov = mixtures.choose(mixtures.z[at] + mixtures.centre[home], home, turn)
    part, density = mixtures.assign(home, share, mu, cov)
    held = np.maximum(np.bincount(part, weight, len(home)), 1e-300)
    centre = np.column_stack([np.bincount(part, weight * x[:, j], len(home)) / held for j in range(d)])
    there = np.floor(np.floor(centre / width) / BLOCK).astype(np.int64)[part]
    inverse = np.linalg.inv(cov)
    return {
        "p": part - np.searchsorted(home, home, "left")[part],
        "rank": (there == corner).all(axis=1) * 2 + ((cell >= 0) & (cell < BLOCK)).all(axis=1),
        "density": density,
        "centre": centre[part],
        "precision": np.einsum("ai,kab,bj->kij", project, inverse, project).reshape(len(home), -1)[part],
        "peak": (share + 0.5 * np.linalg.slogdet(inverse)[1] - 0.5 * mixtures.r * np.log(2 * np.pi))[part],
    }


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def assign_cells(points: DataFrame, reach: float) -> DataFrame:
    """Every cell with its cluster: label, k0 …, n, extents, first record, part, centre, precision, peak."""
    d = sum(c.startswith("x") for c in points.columns)
    n, width = range(d), reach / FINE
    keys = [f"k{j}" for j in n]
    celled = points.select("record", "label", *[f"x{j}" for j in n], *[F.floor(F.col(f"x{j}") / width).cast("long").alias(f"k{j}") for j in n])
    products = [f"q{i}{j}" for i in n for j in range(i, d)]
    cells = celled.groupBy("label", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("record").alias("first"), *[F.sum(f"x{j}").alias(f"s{j}") for j in n], *[F.min(f"x{j}").alias(f"lo{j}") for j in n],
        *[F.max(f"x{j}").alias(f"hi{j}") for j in n], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in n for j in range(i, d)])
    cells = cut(cells)
    sums = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in n], *[F.sum(q).alias(q) for q in products]).first()
    total = sums["n"] or 1
    mean = np.array([(sums[f"s{j}"] or 0) / total for j in n])
    cov = np.array([[(sums[f"q{min(i, j)}{max(i, j)}"] or 0) / total - mean[i] * mean[j] for j in n] for i in n])
    std = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    values, vectors = np.linalg.eigh(cov / np.outer(std, std) + 1e-9 * np.eye(d))
    order = np.argsort(-values)
    kept = int(np.searchsorted(np.cumsum(values[order]) / values.sum(), EXPLAINED)) + 1
    project = (vectors[:, order[: min(kept, d)]] / std[:, None]).T  # reduced = project @ (x - mean)
    ridge = project @ np.diag(np.full(d, (reach / 8) ** 2)) @ project.T + 1e-18 * np.eye(project.shape[0])

    spread = cells
    for j in n:  # a cell near a border is also in the neighbouring block's rim
        spread = spread.withColumn(f"b{j}", F.explode(F.array_distinct(F.array(*[F.floor((F.col(f"k{j}") + o) / BLOCK).cast("long") for o in (-RIM, 0, RIM)]))))
    block = ["label", *[f"b{j}" for j in n]]
    names = [*block, *keys, "n", *[f"s{j}" for j in n], *products]
    rest = [*[f"{s}{j}" for s in ("lo", "hi") for j in n], "first"]
    # by number of cells: adaptive execution goes by bytes, and would fit all blocks in one task
    sorted_cells = spread.select(*names, *rest).repartition(max(1, sums["cells"] // TASK_CELLS + 1), *block).sortWithinPartitions(*block, *keys)
    types = dict(spread.dtypes)
    out = [*block, *keys, "n", *rest]
    schema = ", ".join(f"{c} {types[c]}" for c in out) + ", p int, rank int, density double, centre array<double>, precision array<double>, peak double"

    def fitted(rows: pa.Table) -> pa.RecordBatch:
        take = lambda names, t: np.column_stack([rows[c].to_numpy() for c in names]).astype(t)
        at, cell, weight = take(block[1:], np.int64), take(keys, np.int64), rows["n"].to_numpy().astype(float)
        x = take([f"s{j}" for j in n], float) / weight[:, None]
        inner = np.empty((len(x), d, d))
        for i in n:
            for j in n:
                inner[:, i, j] = rows[f"q{min(i, j)}{max(i, j)}"].to_numpy() / weight - x[:, i] * x[:, j]
        inner[:, range(d), range(d)] = np.maximum(inner[:, range(d), range(d)], 0)
        number = np.cumsum(_starts(rows, block)) - 1
        made = fit_cells(number, at, cell - at * BLOCK, weight, x, inner, reach, mean, project, ridge)
        lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel()))
        columns = [rows[c].combine_chunks() for c in out] + [pa.array(made["p"], pa.int32()), pa.array(made["rank"], pa.int32()), pa.array(made["density"]), lists(made["centre"]), lists(made["precision"]), pa.array(made["peak"])]
        return pa.RecordBatch.from_arrays(columns, names=[*out, "p", "rank", "density", "centre", "precision", "peak"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                waiting = rows if waiting is None else pa.concat_tables([waiting, rows])
                while waiting.num_rows > GROUP_CELLS:  # whole blocks only: the last one may go on
                    borders = np.flatnonzero(_starts(waiting, block))
                    stop = borders[max(1, np.searchsorted(borders, GROUP_CELLS, "right") - 1)] if len(borders) > 1 else 0
                    if not stop:
                        break
                    yield fitted(waiting.slice(0, stop).combine_chunks())
                    waiting = waiting.slice(stop)
        if waiting is not None and waiting.num_rows:
            yield fitted(waiting.combine_chunks())

    cells = sorted_cells.mapInArrow(run, schema).withColumn("part", F.concat_ws("/", *block, "p"))
    kept_columns = ["n", *rest, "part", "centre", "precision", "peak"]
    best = cells.groupBy("label", *keys).agg(F.max_by(F.struct(*kept_columns), F.struct("rank", "density", "part")).alias("a"))
    return best.select("label", *keys, "a.*")


def _starts(rows: pa.Table, block: Sequence[str]) -> np.ndarray:
    """Where a block begins."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in block:
        v = rows[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def cluster_cells(points: DataFrame, reach: float = 0.0045) -> DataFrame:
    """Cells of ``assign_cells`` with the ``size`` and smallest record (``least``) of their cluster."""
    cells = cut(assign_cells(points, reach))
    clusters = cells.groupBy("label", "part").agg(F.sum("n").alias("size"), F.min("first").alias("least"))
    return cells.join(clusters, ["label", "part"])


def cluster_records(points: DataFrame, reach: float = 0.0045) -> DataFrame:
    """(record, label, x0 …, cluster, size, first, density): ``density`` is the log of the component's share times its density at the record."""
    d = sum(c.startswith("x") for c in points.columns)
    n, width = range(d), reach / FINE
    keys = [f"k{j}" for j in n]
    points = cut(points)  # read for the cells, and again for the members
    cells = cluster_cells(points, reach).select("label", "part", *keys, "centre", "precision", "peak", "size", "least")
    celled = points.withColumns({f"k{j}": F.floor(F.col(f"x{j}") / width).cast("long") for j in n})
    away = reduce(lambda a, b: a + b, [(F.col(f"x{i}") - F.col("centre")[i]) * F.col("precision")[i * d + j] * (F.col(f"x{j}") - F.col("centre")[j]) for i in n for j in n])
    return celled.join(cells, ["label", *keys]).select("record", "label", *[f"x{j}" for j in n], F.col("part").alias("cluster"), "size", F.col("least").alias("first"), (F.col("peak") - away / 2).alias("density"))


def members(clustered: DataFrame) -> DataFrame:
    """(first, record): the members of each cluster of two or more, under its smallest record."""
    return clustered.filter((F.col("size") > 1) & (F.col("record") != F.col("first"))).select("first", "record")


def describe(clustered: DataFrame, typical: int = 3) -> DataFrame:
    """Per cluster: smallest record, label, size, mean of the features, and its members of highest density, of equal ones the smaller record."""
    d = sum(c.startswith("x") for c in clustered.columns)
    means = [F.avg(f"x{j}").alias(f"mean_x{j}") for j in range(d)]
    # the few densest of each task's share, then of those: no cluster is sorted or gathered whole
    share = clustered.withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(64)))
    dense = F.struct((-F.col("density")).alias("sparse"), "record")
    best = share.withColumn("k", F.row_number().over(Window.partitionBy("first", "salt").orderBy(F.desc("density"), "record"))).filter(F.col("k") <= typical)
    best = best.groupBy("first").agg(F.transform(F.slice(F.sort_array(F.collect_list(dense)), 1, typical), lambda s: s["record"]).alias("typical"))
    return clustered.groupBy("first", "label", "size").agg(*means).join(best, "first")


def audit(cells: DataFrame, reach: float = 0.0045) -> DataFrame:
    """One row: ``clusters``, how many are wider than the reach in a feature (``wide``), and how many pairs of one label come within it (``near``).

    With none wide and none near the clusters are exactly the records that belong together.  Extents of clusters meet by an
    equi-join on grid cells as wide as the reach; a wide cluster is compared by its extents, so ``near`` is an upper bound."""
    d = sum(c.startswith("lo") for c in cells.columns)
    n = range(d)
    parts = cells.groupBy("label", "part").agg(*[F.min(f"lo{j}").alias(f"lo{j}") for j in n], *[F.max(f"hi{j}").alias(f"hi{j}") for j in n])
    wide = reduce(lambda a, b: a | b, [F.col(f"hi{j}") - F.col(f"lo{j}") > reach for j in n])
    left, right = parts, parts.select("label", F.col("part").alias("other"), *[F.col(f"{s}{j}").alias(f"o_{s}{j}") for s in ("lo", "hi") for j in n])
    for j in n:
        left = left.withColumn(f"g{j}", F.explode(F.sequence(F.floor((F.col(f"lo{j}") - reach) / reach), F.floor((F.col(f"hi{j}") + reach) / reach))))
        right = right.withColumn(f"g{j}", F.explode(F.sequence(F.floor(F.col(f"o_lo{j}") / reach), F.floor(F.col(f"o_hi{j}") / reach))))
    close = _all([F.greatest(F.col(f"lo{j}") - F.col(f"o_hi{j}"), F.col(f"o_lo{j}") - F.col(f"hi{j}")) <= reach for j in n])
    near = left.join(right, ["label", *[f"g{j}" for j in n]]).filter((F.col("part") < F.col("other")) & close).select("label", "part", "other").distinct()
    counts = parts.agg(F.count(F.lit(1)).alias("clusters"), F.count(F.when(wide, 1)).alias("wide"))
    return counts.join(F.broadcast(near.agg(F.count(F.lit(1)).alias("near"))))  # two single rows
