"""Learners that build boxes from samples in order.

Each learner is a fold over samples: the state is a growing set of boxes, so a fit can be continued, seeded with a
model, weighted, or run as a stream.  A sample looks at the boxes of its class (and unlabelled ones) in order of
membership, of equal ones the later box first.  Boxes live in arrays that double when full; nothing is copied for a
new box.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from boxfold.kernels import geometry as geo
from boxfold.kernels import scoring
from boxfold.kernels.geometry import EMPTY, MISSING_HIGH, MISSING_LOW, UNLABELLED


@dataclass
class Samples:
    """Bounds per feature (equal for points), labels, weights; categorical codes, bit sets or values where a learner takes them."""

    xl: np.ndarray
    xu: np.ndarray
    y: np.ndarray
    n: np.ndarray | None = None
    cat: np.ndarray | None = None
    centroid: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.y)

    def take(self, rows: np.ndarray) -> Samples:
        return Samples(*[None if x is None else x[rows] for x in (self.xl, self.xu, self.y, self.n, self.cat, self.centroid)])

    def marked(self) -> Samples:
        """Missing bounds (NaN) replaced by their marks."""
        return Samples(np.where(np.isnan(self.xl), MISSING_LOW, self.xl), np.where(np.isnan(self.xu), MISSING_HIGH, self.xu), self.y, self.n, self.cat, self.centroid)


class Boxes:
    """Growing columns v, w, c, n, centroid, and categorical columns a and b."""

    def __init__(self, d: int, cats: int = 0, cat_type: type = np.int64) -> None:
        self.size, room = 0, 64
        self._v, self._w, self._m = (np.empty((room, d)) for _ in range(3))
        self._c, self._n = np.empty(room, np.int64), np.empty(room)
        self._a, self._b = np.empty((room, cats), cat_type), np.empty((room, cats), cat_type)

    def __getattr__(self, name: str) -> np.ndarray:
        if name in ("v", "w", "m", "c", "n", "a", "b"):
            return self.__dict__["_" + name][: self.size]
        raise AttributeError(name)

    def extend(self, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> None:
        """Many boxes at once, without categories; weights of 1 and midpoints as centroids."""
        k, self.size = self.size, self.size + len(c)
        while self.size > len(self._c):
            self._double()
        new = slice(k, self.size)
        self._v[new], self._w[new], self._c[new], self._n[new], self._m[new] = v, w, c, 1.0, (v + w) / 2

    def _double(self) -> None:
        for name in ("_v", "_w", "_m", "_c", "_n", "_a", "_b"):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.empty_like(old)]))

    def add(self, v, w, c, n=1.0, m=None, a=None, b=None) -> int:
        k = self.size
        if k == len(self._c):
            self._double()
        self.size += 1
        self._v[k], self._w[k], self._c[k], self._n[k] = v, w, c, n
        self._m[k] = (np.asarray(v) + w) / 2 if m is None else m
        if a is not None:
            self._a[k] = a
        if b is not None:
            self._b[k] = b
        return k


def ranked(b: np.ndarray) -> np.ndarray:
    """Descending, of equal ones the later first."""
    return np.argsort(b, kind="stable")[::-1]


@dataclass
class Learner:
    """What all learners share; ``theta`` bounds a box's edges, ``gamma`` is the slope of membership."""

    theta: float = 0.5
    gamma: float | list[float] = 1.0
    boxes: Boxes | None = field(default=None, repr=False)
    #: Whether only bounds and classes of boxes are asked for; weights and centroids may then be left out.
    bounds_only: bool = field(default=False, init=False, repr=False)
    #: Passes over the samples of the last fit.
    passes: int = field(default=1, init=False, repr=False)

    def begin(self, s: Samples) -> None:
        if self.boxes is None:
            self.boxes = Boxes(s.xl.shape[1])
        self.g = np.asarray(self.gamma, float)
        self.missing = bool((s.xl > s.xu).any())

    def fit(self, s: Samples) -> Boxes:
        s = s.marked()
        self.begin(s)
        for i in range(len(s)):
            self.learn(s, i)
        return self.boxes

    def learn(self, s: Samples, i: int) -> None:
        raise NotImplementedError

    def candidates(self, y: int) -> np.ndarray:
        c = self.boxes.c
        return np.arange(len(c)) if y == UNLABELLED else np.flatnonzero((c == y) | (c == UNLABELLED))

    def corners(self, rows: np.ndarray) -> geo.Box:
        v, w = self.boxes.v[rows], self.boxes.w[rows]
        return (np.minimum(v, w), np.maximum(v, w)) if self.missing else (v, w)

    def grown(self, j: int, s: Samples, i: int) -> geo.Box:
        return np.minimum(self.boxes.v[j], s.xl[i]), np.maximum(self.boxes.w[j], s.xu[i])

    def put(self, j: int, s: Samples, i: int, v: np.ndarray, w: np.ndarray) -> None:
        b = self.boxes
        weight = 1.0 if s.n is None else s.n[i]
        middle = (s.xl[i] + s.xu[i]) / 2 if s.centroid is None else s.centroid[i]
        b._m[j] = (b._m[j] * b._n[j] + middle * weight) / (b._n[j] + weight)
        b._v[j], b._w[j] = v, w
        b._n[j] += weight
        if s.y[i] != UNLABELLED and b.c[j] == UNLABELLED:
            b._c[j] = s.y[i]

    def new(self, s: Samples, i: int) -> int:
        return self.boxes.add(s.xl[i], s.xu[i], s.y[i], 1.0 if s.n is None else s.n[i], None if s.centroid is None else s.centroid[i])

    def rivals(self, j: int) -> np.ndarray:
        """Boxes of another class than box j; for an unlabelled box all others."""
        c = self.boxes.c
        out = (c != c[j]) | (c[j] == UNLABELLED)
        out[j] = False
        return np.flatnonzero(out)

    def part_rivals(self, j: int) -> None:
        b, rivals = self.boxes, self.rivals(j)
        # boxes only shrink when they part, so no other box than these can meet box j later
        for k in rivals[geo.meets(b.v[j], b.w[j], b.v[rivals], b.w[rivals])]:
            if geo.meets(b.v[j], b.w[j], b.v[k : k + 1], b.w[k : k + 1])[0]:
                geo.part_gfmm((b.v[j], b.w[j]), (b.v[k], b.w[k]))

    def fitting(self, rows: np.ndarray, s: Samples, i: int, limit: float) -> np.ndarray:
        """Which of the boxes would keep all edges within the limit with the sample."""
        edges = np.maximum(self.boxes.w[rows], s.xu[i]) - np.minimum(self.boxes.v[rows], s.xl[i])
        return (edges <= limit).all(axis=1)

    def comparable(self, s: Samples) -> bool:
        """Whether plain comparisons of bounds tell all: everything is whole and labelled, and no two values are so near that a membership rounds to 1."""
        whole = not self.missing and bool(geo.well_formed(self.boxes.v, self.boxes.w).all())
        if not whole or not len(s) or not s.xl.shape[1] or (s.y == UNLABELLED).any() or (self.boxes.c == UNLABELLED).any():
            return False
        for f in range(s.xl.shape[1]):
            values = np.unique(np.concatenate([s.xl[:, f], s.xu[:, f], self.boxes.v[:, f], self.boxes.w[:, f]]))
            if not np.isfinite(values).all() or (np.diff(values) * min(1.0, float(self.g.min())) < 1e-15).any():
                return False
        return True

    def comparable_to(self, s: Samples) -> bool:
        """``comparable``, before a fit from no boxes."""
        self.begin(s)
        return self.comparable(s)

    def fit_compared(self, s: Samples, compete: bool = True, weigh: bool = True) -> Boxes:
        """As ``learn`` sample by sample, with the same boxes, weights and centroids: growth into other classes is refused if classes
        ``compete``, and samples in a box count for it if asked to ``weigh`` them.

        A sample inside a box of its class changes no bounds, so such samples are told a chunk at a time and kept up to date as boxes grow;
        boxes of one point are looked up by it.  Weights and centroids follow in the order of the samples."""
        box, d, first = self.boxes, s.xl.shape[1], self.boxes.size
        g = np.broadcast_to(self.g, (d,))
        least, one_slope = 1 - self.g.max() * self.theta, bool((g == g[0]).all())
        room = max(64, 2 * first)
        sides, c = np.empty((2 * d, room)), np.empty(room, np.int64)  # of every feature the upper bound, negated, and the lower one
        sides[0::2, :first], sides[1::2, :first], c[:first] = -box.w.T, box.v.T, box.c
        reach = np.empty((len(s), 2 * d, 1))
        reach[:, 0::2, 0], reach[:, 1::2, 0] = s.xu, -s.xl
        size, holder = first, np.full(len(s), -1, np.int64)
        xl, xu = [np.ascontiguousarray(s.xl[:, f]) for f in range(d)], [np.ascontiguousarray(s.xu[:, f]) for f in range(d)]
        lows, highs, ys = list(zip(*(x.tolist() for x in xl))), list(zip(*(x.tolist() for x in xu))), s.y.tolist()
        points: dict[tuple, int] = {}  # of boxes of one point the last
        wide: dict[int, list[int]] = {}  # boxes of more than a point, by class

        def note(j: int, low: tuple, high: tuple, y: int) -> None:
            if low == high:
                points[low, y] = j
            else:
                wide.setdefault(y, []).append(j)

        labels = np.unique(np.concatenate([s.y, box.c])).tolist()
        for j in range(first):
            note(j, tuple(box.v[j].tolist()), tuple(box.w[j].tolist()), int(c[j]))
        for start in range(0, len(s), 512):
            end = min(len(s), start + 512)
            inside, classes = np.full(end - start, -1, np.int64), s.y[start:end]
            barred = np.zeros(end - start, bool)  # inside a box of another class, which meets all that could grow to the sample
            owns = {y: np.sort(np.array(rows, np.int64)) for y, rows in wide.items()}

            def holds(rows: np.ndarray, some: np.ndarray) -> np.ndarray:
                out = np.ones((len(rows), len(some)), bool)
                for f in range(d):
                    out &= (sides[2 * f + 1, some] <= xl[f][start:end][rows, None]) & (-sides[2 * f, some] >= xu[f][start:end][rows, None])  # noqa: B023
                return out

            for y, own in owns.items():
                rows = np.flatnonzero(classes == y)
                held = holds(rows, own)
                inside[rows] = np.where(held.any(axis=1), own[len(own) - 1 - held[:, ::-1].argmax(axis=1)], -1)
            for y, own in owns.items() if compete else ():
                rows = np.flatnonzero((classes != y) & (inside < 0) & ~barred)
                barred[rows] = holds(rows, own).any(axis=1)
            for i in range(start, end):
                y, low, high = ys[i], lows[i], highs[i]
                j = int(inside[i - start])
                if low == high:
                    j = max(j, points.get((low, y), -1))
                if j >= 0:
                    holder[i] = j if weigh else -1
                    continue
                if compete and (barred[i - start] or (low == high and any(k != y and (low, k) in points for k in labels))):
                    j = -1
                else:
                    j = self._place(sides[:, :size], c, y, reach[i], g, least, one_slope, compete)
                fresh = j < 0
                if fresh:
                    j = size
                    if size == room:
                        room *= 2
                        sides, c = np.concatenate([sides, np.empty_like(sides)], axis=1), np.concatenate([c, np.empty_like(c)])
                    sides[:, j], c[j] = -reach[i, :, 0], y
                    size += 1
                    note(j, low, high, y)
                else:
                    was = sides[:, j].tolist()
                    if all(was[2 * f + 1] == -was[2 * f] for f in range(d)):
                        at = tuple(was[1::2])
                        if points.get((at, y)) == j:
                            del points[at, y]
                        wide.setdefault(y, []).append(j)
                    sides[:, j] = np.minimum(sides[:, j], -reach[i, :, 0])
                holder[i] = j
                if not fresh or low != high:
                    met, same = np.ones(end - i - 1, bool), classes[i + 1 - start :] == y
                    for f, (over, under) in enumerate(sides[:, j].reshape(d, 2).tolist()):
                        met &= (xl[f][i + 1 : end] >= under) & (xu[f][i + 1 : end] <= -over)
                    barred[i + 1 - start :] |= met & ~same
                    met &= same
                    later = inside[i + 1 - start :]
                    later[met] = np.maximum(later[met], j)
        self._weigh(s, holder, first, sides[:, :size], c[:size])
        return self.boxes

    def _place(self, sides: np.ndarray, c: np.ndarray, y: int, reach: np.ndarray, g: np.ndarray, least: float, one_slope: bool, compete: bool) -> int:
        """The box that grows to a sample outside all boxes of its class, or -1."""
        theta = self.theta
        away = (sides + reach).max(axis=0)
        near = (away <= theta + 1e-9).nonzero()[0]
        same = c[near] == y
        rows = near[same]
        if not len(rows):
            return -1
        rivals = near[~same] if compete else near[:0]
        far = away[rivals]
        if len(rivals) and far.min() <= 0:  # holds the sample, hence meets all that could grow to it
            return -1
        own = sides[:, rows]
        grown = np.minimum(own, -reach)
        fits = ((grown[0::2] + grown[1::2]) >= -theta).all(axis=0)
        b = 1.0 - np.minimum(np.maximum(away[rows] * g[0] if one_slope else ((own + reach).reshape(len(g), 2, -1).max(axis=1) * g[:, None]).max(axis=0), 0.0), 1.0)
        left = (fits & (b >= least)).nonzero()[0]
        if not len(left):
            return -1
        if not len(rivals):
            return int(rows[left[ranked(b[left])[0]]])
        facing, others, left = grown[_other_sides(len(g))], sides[:, rivals], left[ranked(b[left])]
        while len(left):  # the best one, mostly; else all that its nearest rival is in the way of drop out with it
            met = (facing[:, left[0], None] + others).max(axis=0) <= 0
            if not met.any():
                return int(rows[left[0]])
            nearest = np.where(met, far, np.inf).argmin()
            left = left[(facing[:, left] + others[:, nearest, None]).max(axis=0) > 0]
        return -1

    def _weigh(self, s: Samples, holder: np.ndarray, first: int, sides: np.ndarray, c: np.ndarray) -> None:
        """The boxes as learnt, their weights and centroids by the samples they hold, one after the other."""
        box, d, size = self.boxes, len(sides) // 2, len(c)
        v, w = sides[1::2].T, -sides[0::2].T
        if self.bounds_only:
            box.v[:], box.w[:] = v[:first], w[:first]
            box.extend(v[first:], w[first:], c[first:])
            return
        n, m = box.n.tolist() + [0.0] * (size - first), box.m.tolist() + [None] * (size - first)
        middle = ((s.xl + s.xu) / 2 if s.centroid is None else s.centroid).tolist()
        weight = [1.0] * len(s) if s.n is None else s.n.tolist()
        for j, x, k in zip(holder.tolist(), middle, weight):
            if j < 0:
                continue
            old = m[j]
            if old is None:
                n[j], m[j] = k, list(x)
            else:
                was = n[j]
                now = was + k
                for f in range(d):
                    old[f] = (old[f] * was + x[f] * k) / now
                n[j] = now
        box.v[:], box.w[:] = v[:first], w[:first]
        box.extend(v[first:], w[first:], c[first:])
        if size:
            box.n[:], box.m[:] = n, m


@lru_cache(maxsize=None)
def _other_sides(d: int) -> np.ndarray:
    """Of every feature the lower side in the upper one's place, and the other way round."""
    return np.arange(2 * d).reshape(d, 2)[:, ::-1].ravel()


class Fmnn(Learner):
    """Only the best box may grow, by the sum of its edges; overlaps with other classes are contracted."""

    def learn(self, s: Samples, i: int) -> None:
        rows = np.flatnonzero(self.boxes.c == s.y[i])
        for j in self.order(rows, geo.fmnn(s.xl[i], self.boxes.v[rows], self.boxes.w[rows], self.g)):
            if j is None:
                return
            v, w = self.grown(j, s, i)
            if self.fits(v, w, s.y[i]):
                self.put(j, s, i, v, w)
                self.contract(j, s.xl[i])
                return
        self.added(self.new(s, i))

    def order(self, rows: np.ndarray, b: np.ndarray) -> Iterator[int | None]:
        """Boxes to try, None where the sample is covered."""
        if len(rows):
            k = int(b.argmax())
            yield None if b[k] == 1 else rows[k]

    def fits(self, v: np.ndarray, w: np.ndarray, y: int) -> bool:
        return (w - v).sum() <= self.theta * len(v)

    def contract(self, j: int, x: np.ndarray) -> None:
        b = self.boxes
        for k in np.flatnonzero((b.c != b.c[j]) & self.apart(b.v[j], b.w[j], b.v, b.w)):
            first, tested = (b.v[j], b.w[j]), (b.v[k], b.w[k])
            found = self.case(first, tested, x)
            if found:
                geo.part_fmnn(first, tested, *found)

    @staticmethod
    def apart(v: np.ndarray, w: np.ndarray, others_v: np.ndarray, others_w: np.ndarray) -> np.ndarray:
        """Boxes that may overlap the box: in no feature wholly on one side of it."""
        low, high = np.sign(v - others_v), np.sign(w - others_w)
        left, right = w - others_v <= 0, others_w - v <= 0
        return ~((low <= 0) & (high <= 0) & (low + high < 0) & left | (low > 0) & (high > 0) & right).any(axis=1)

    def case(self, first: geo.Box, tested: geo.Box, x: np.ndarray) -> tuple[int, int] | None:
        return geo.fmnn_case(first, tested)

    def added(self, j: int) -> None:
        pass


class Efmnn(Fmnn):
    """Every edge is bounded; overlap cases with common edges too."""

    def fits(self, v, w, y):
        return bool((w - v <= self.theta).all())

    def case(self, first, tested, x):
        return geo.efmnn_case(first, tested, x)


@dataclass
class Knefmnn(Efmnn):
    """The first of the k best boxes that may grow."""

    k_neighbors: int = 5

    def order(self, rows, b):
        for k in ranked(b)[: self.k_neighbors]:
            yield None if b[k] == 1 else rows[k]


class Rfmnn(Efmnn):
    """Growth into other classes is refused; a new box splits boxes of other classes around it."""

    def fits(self, v, w, y):
        b = self.boxes
        other = b.c != y
        return super().fits(v, w, y) and not (geo.well_formed(v, w) and geo.meets_free(v, w, b.v[other], b.w[other]).any())

    def contract(self, j, x):
        pass

    def added(self, j):
        b = self.boxes
        v, w = b.v[j].copy(), b.w[j].copy()
        for k in np.flatnonzero((b.c != b.c[j]) & geo.meets_free(v, w, b.v, b.w)):
            dim = geo.least_overlap_dim(v, w, b.v[k], b.w[k])
            if b.v[k, dim] < v[dim] and w[dim] < b.w[k, dim]:
                low, high = b.v[k].copy(), b.w[k].copy()
                b._w[k, dim] = v[dim] - geo.SPLIT_GAP
                low[dim] = w[dim] + geo.SPLIT_GAP
                b.add(low, high, b.c[k], b.n[k])


@dataclass
class OnlineGfmm(Learner):
    """Candidates in order of membership until it drops under the threshold; overlaps are parted afterwards.

    Passes are repeated with a smaller theta until all samples are predicted or ``theta_min`` is passed."""

    theta_min: float = 1.0
    alpha: float = 0.9
    contract: bool = True

    def fit(self, s: Samples) -> Boxes:
        s = s.marked()
        self.begin(s)
        least, self.limit, right, self.passes = min(self.theta_min, self.theta), self.theta, 0.0, 0
        if not self.contract and self.limit * self.alpha < least <= self.limit and self.comparable(s):  # one pass, in which boxes only grow
            self.passes, self.limit = 1, self.limit * self.alpha
            return self.fit_compared(s, compete=False, weigh=False)
        while self.limit >= least and right < 1:
            self.passes += 1
            for i in range(len(s)):
                self.learn(s, i)
            self.limit *= self.alpha
            if self.limit >= least:
                right = float((predict(self.boxes, s, self.g) == s.y).mean()) if len(s) else 1.0
        return self.boxes

    def learn(self, s: Samples, i: int) -> None:
        y, rows = s.y[i], self.candidates(s.y[i])
        if not len(rows):
            self.new(s, i)
            return
        b = geo.gfmm(s.xl[i], s.xu[i], *self.corners(rows), self.g)
        order = ranked(b)
        if b[order[0]] == 1 and y in (self.boxes.c[rows[order[0]]], UNLABELLED):
            return
        order = order[b[order] >= 1 - self.g.max() * self.limit]
        order = order[self.fitting(rows[order], s, i, self.limit)]
        if not len(order):
            self.new(s, i)
            return
        j = rows[order[0]]
        self.put(j, s, i, *self.grown(j, s, i))
        if self.contract:
            self.part_rivals(j)


@dataclass
class ImprovedOnlineGfmm(Learner):
    """A box grows only where it meets no box of another class, so nothing is ever contracted.

    A grown box holds the sample and has edges up to theta, so only boxes within theta of the sample can grow or block."""

    def begin(self, s: Samples) -> None:
        super().begin(s)
        self.whole = not self.missing and bool(geo.well_formed(self.boxes.v, self.boxes.w).all())

    def fit(self, s: Samples) -> Boxes:
        s = s.marked()
        self.begin(s)
        if self.comparable(s):
            return self.fit_compared(s)
        for i in range(len(s)):
            self.learn(s, i)
        return self.boxes

    def near(self, s: Samples, i: int) -> np.ndarray:
        """Boxes within theta of the sample in every feature; all, where bounds are missing."""
        b, rows, reach = self.boxes, None, self.theta + 1e-9
        if self.whole:
            for f in range(s.xl.shape[1]):
                low, high = s.xu[i, f] - reach, s.xl[i, f] + reach
                rows = np.flatnonzero((b.w[:, f] >= low) & (b.v[:, f] <= high)) if rows is None else rows[(b.w[rows, f] >= low) & (b.v[rows, f] <= high)]
        return np.arange(b.size) if rows is None else rows

    def learn(self, s: Samples, i: int) -> None:
        y, box, near = s.y[i], self.boxes, self.near(s, i)
        rows = near if y == UNLABELLED else near[(box.c[near] == y) | (box.c[near] == UNLABELLED)]
        if not len(rows):
            self.new(s, i)
            return
        b = geo.gfmm(s.xl[i], s.xu[i], *self.corners(rows), self.g)
        order = ranked(b)
        if b[order[0]] == 1:
            for j in rows[order[b[order] == 1]]:
                if box.c[j] in (y, UNLABELLED):
                    self.put(j, s, i, box.v[j].copy(), box.w[j].copy())
                    break
            return
        order = order[b[order] >= 1 - self.g.max() * self.theta]
        rows = rows[order[self.fitting(rows[order], s, i, self.theta)]]
        j = self.first_free(rows, near, s, i)
        if j is None:
            self.new(s, i)
        else:
            self.put(j, s, i, *self.grown(j, s, i))

    def first_free(self, rows: np.ndarray, near: np.ndarray, s: Samples, i: int) -> int | None:
        """The first of the rows that may grow to the sample."""
        y, b = s.y[i], self.boxes
        if y == UNLABELLED or not self.whole:
            return next((j for j in rows if not self.blocked(j, y, *self.grown(j, s, i))), None)
        rivals = near[(b.c[near] != y) | (b.c[near] == UNLABELLED)]
        for k in range(0, len(rows), 16):
            part = rows[k : k + 16]
            met = np.ones((len(part), len(rivals)), bool)
            for f in range(s.xl.shape[1]):
                v, w = np.minimum(b.v[part, f], s.xl[i, f]), np.maximum(b.w[part, f], s.xu[i, f])
                met &= 1.0 - np.maximum(v[:, None] - b.w[rivals, f], b.v[rivals, f] - w[:, None]) >= 1.0  # as geo.meets
            free = np.flatnonzero(~met.any(axis=1))
            if len(free):
                return part[free[0]]
        return None

    def blocked(self, j: int, y: int, v: np.ndarray, w: np.ndarray) -> bool:
        b = self.boxes
        other = (b.c != (b.c[j] if y == UNLABELLED else y)) | (b.c == UNLABELLED)
        if y == UNLABELLED and b.c[j] == UNLABELLED:
            other &= (b.v != b.v[j]).any(axis=1)
        return bool(geo.meets(v, w, b.v[other], b.w[other]).any())


@dataclass
class InfOnlineGfmm(Learner):
    """Features of any range: a box may grow while its old edges stay a share ``theta`` of the new ones."""

    min_membership_expansion: float = 0.0

    def candidates(self, y):
        c = self.boxes.c
        return np.flatnonzero((c == y) | (c == UNLABELLED))

    def learn(self, s: Samples, i: int) -> None:
        y, rows, box = s.y[i], self.candidates(s.y[i]), self.boxes
        if not len(rows):
            self.new(s, i)
            return
        b = geo.free_range(s.xl[i], s.xu[i], *self.corners(rows), self.g)
        order = ranked(b)
        if b[order[0]] == 1 and y in (box.c[rows[order[0]]], UNLABELLED):
            return
        for k in order:
            j = rows[k]
            v, w = self.grown(j, s, i)
            share = (box.w[j] - box.v[j]) / (w - v + 1e-5)
            if b[k] >= self.min_membership_expansion and ((share == 0) | (share >= self.theta)).all():
                self.put(j, s, i, v, w)
                rivals = self.rivals(j)
                for r in rivals[geo.meets_free(box.v[j], box.w[j], box.v[rivals], box.w[rivals])]:
                    if geo.meets_free(box.v[j], box.w[j], box.v[r], box.w[r]):
                        geo.part_gfmm((box.v[j], box.w[j]), (box.v[r], box.w[r]), np.inf)
                return
        self.new(s, i)


@dataclass
class Agglomerative(Learner):
    """Samples start as boxes; the most similar pair merges while it fits and meets no other class.

    ``exhaustive``: all pairs are ranked again after each round of equally similar merges; otherwise box after box
    looks for its best partner until a whole pass merges nothing."""

    min_simil: float = 0.5
    simil_measure: str = "mid"
    asimil_type: str = "max"
    exhaustive: bool = True

    def similarity(self, j: int, rows: np.ndarray) -> np.ndarray:
        v, w = self.boxes.v[j], self.boxes.w[j]
        lo, hi = self.corners(rows)
        if self.simil_measure == "short":
            return geo.gfmm(w, v, lo, hi, self.g)
        if self.simil_measure == "long":
            return geo.gfmm(v, w, hi, lo, self.g)
        there, back = geo.gfmm(v, w, lo, hi, self.g), geo.gfmm(lo, hi, v, w, self.g)
        return np.maximum(there, back) if self.asimil_type == "max" else np.minimum(there, back)

    def fit(self, s: Samples) -> Boxes:
        s = s.marked()
        self.begin(s)
        for i in range(len(s)):
            self.new(s, i)
        self.floor = max(self.min_simil, 1 - self.g.max() * self.theta)
        while self.round() if self.exhaustive else self.sweep():
            self.passes += 1
        return self.boxes

    def partners(self, j: int) -> np.ndarray:
        c = self.boxes.c
        out = np.ones(len(c), bool) if c[j] == UNLABELLED else (c == c[j]) | (c == UNLABELLED)
        out[j] = False
        return np.flatnonzero(out)

    def merge(self, i: int, j: int) -> bool:
        """Merge box j into the earlier box i if that is allowed."""
        b = self.boxes
        v, w = np.minimum(b.v[i], b.v[j]), np.maximum(b.w[i], b.w[j])
        if not (w - v <= self.theta).all():
            return False
        c = b.c[j] if b.c[i] == UNLABELLED else b.c[i]
        other = (b.c != c) | (b.c == UNLABELLED)
        other[[i, j]] = False
        if geo.meets(v, w, b.v[other], b.w[other]).any():
            return False
        n = b.n[i] + b.n[j]
        b._m[i] = (b.m[i] * b.n[i] + b.m[j] * b.n[j]) / n
        b._v[i], b._w[i], b._c[i], b._n[i] = v, w, c, n
        for name in ("_v", "_w", "_m", "_c", "_n"):
            column = getattr(b, name)
            column[j : b.size - 1] = column[j + 1 : b.size]
        b.size -= 1
        return True

    def round(self) -> bool:
        b = self.boxes
        pairs = []
        for j in range(b.size):
            rows = self.partners(j)
            rows = rows[rows > j]
            sim = self.similarity(j, rows)
            keep = (sim >= self.floor) & (sim > 0) & ~((b.c[j] == UNLABELLED) & (b.c[rows] == UNLABELLED) & (b.c == UNLABELLED).all())
            pairs += [(float(x), j, int(k)) for x, k in zip(sim[keep], rows[keep])]
        pairs.sort(key=lambda p: p[0])
        pairs.reverse()
        merged = False
        while pairs:
            x, i, j = pairs[0]
            if self.merge(i, j):
                merged = True
                pairs = [(s, p - (p > j), q - (q > j)) for s, p, q in pairs if s >= x and not {p, q} & {i, j}]
            else:
                pairs = pairs[1:]
        return merged

    def sweep(self) -> bool:
        b, k, merged = self.boxes, 0, False
        while k < b.size:
            rows = self.partners(k)
            sim = self.similarity(k, rows)
            order = ranked(sim)
            order = order[sim[order] >= self.floor]
            near = rows[order]
            fits = (np.maximum(b.w[k], b.w[near]) - np.minimum(b.v[k], b.v[near]) <= self.theta).all(axis=1)
            for t in near[fits]:
                i, j = min(k, t), max(k, t)
                if self.merge(i, j):
                    merged = True
                    k -= k != i
                    break
            k += 1
        return merged


def as_model(boxes: Boxes, learner: str = "online", g=1.0, rule: str | None = None, **how) -> scoring.Model:
    """Boxes as a learner leaves them, ready for scoring."""
    kind = kind_of(learner)
    cats = {"onehot": lambda: {"bits": boxes.a}, "eiol": lambda: {"hist": [list(row) for row in boxes.a]}, "freqcat": lambda: {"slots": (boxes.a, boxes.b)}}.get(kind, dict)()
    return scoring.Model(np.arange(boxes.size), boxes.v.copy(), boxes.w.copy(), boxes.c.copy(), boxes.n.copy(), boxes.m.copy(), kind, rule or rule_of(learner), g, **cats, **how)


def predict(boxes: Boxes, s: Samples, g=1.0, learner: str = "online", rule: str | None = None, **how) -> np.ndarray:
    """Class of the box of greatest membership; between classes the nearest, then the earlier box."""
    return scoring.winners(as_model(boxes, learner, g, rule, **how), s.xl, s.xu, s.cat)


def kind_of(learner: str) -> str:
    """The membership a learner's boxes are scored by."""
    return {"fmnn": "fmnn", "efmnn": "fmnn", "knefmnn": "fmnn", "rfmnn": "fmnn", "inf": "free", "eiol": "eiol", "onehot": "onehot", "freqcat": "freqcat"}.get(learner, "gfmm")


def rule_of(learner: str) -> str:
    return "corners" if learner == "rfmnn" else "manhattan"


# Categorical learners --------------------------------------------------------------------------------------------


@dataclass
class ExtendedImprovedGfmm(ImprovedOnlineGfmm):
    """Mixed features: a histogram of values per categorical feature; growth is bounded by the gain of entropy."""

    delta: float = 0.5
    alpha: float = 0.5
    mean_entropy: bool = False

    def begin(self, s: Samples) -> None:
        if self.boxes is None:
            self.boxes = Boxes(s.xl.shape[1], s.cat.shape[1], object)
        super().begin(s)

    fit = Learner.fit

    def membership(self, s: Samples, i: int, rows: np.ndarray) -> np.ndarray:
        fit = np.array([sum(h.get(x, 0) for h, x in zip(hist, s.cat[i])) / sum(hist[0].values()) / len(hist) for hist in self.boxes.a[rows]])
        return fit if not s.xl.shape[1] else self.alpha * geo.gfmm(s.xl[i], s.xu[i], *self.corners(rows), self.g) + (1 - self.alpha) * fit

    def learn(self, s: Samples, i: int) -> None:
        y, rows, box = s.y[i], self.candidates(s.y[i]), self.boxes
        weight = 1 if s.n is None else s.n[i]
        if len(rows):
            b = self.membership(s, i, rows)
            order = ranked(b)
            covered = b[order[0]] == 1
            if not covered:
                order = order[self.fitting(rows[order], s, i, self.theta)]
            for k in order:
                j = rows[k]
                hist = [Counter(h) + Counter({x: weight}) for h, x in zip(box.a[j], s.cat[i])]
                if covered:
                    if b[k] != 1:
                        return
                    if box.c[j] == y:
                        self.put(j, s, i, box.v[j].copy(), box.w[j].copy())
                        box._a[j] = hist
                        return
                    continue
                v, w = self.grown(j, s, i)
                if self.even(hist, box.a[j]) and not self.blocked_mixed(j, y, v, w, hist, box.n[j] + weight):
                    self.put(j, s, i, v, w)
                    box._a[j] = hist
                    return
            if covered:
                return
        box.add(s.xl[i], s.xu[i], y, weight, a=[Counter({x: weight}) for x in s.cat[i]])

    def even(self, after: list[Counter], before: np.ndarray) -> bool:
        growth = np.array([entropy(a) - sum(b.values()) / sum(a.values()) * entropy(b) for a, b in zip(after, before)])
        return bool(growth.mean() <= self.delta if self.mean_entropy else (growth <= self.delta).all())

    def blocked_mixed(self, j, y, v, w, hist, n) -> bool:
        b = self.boxes
        other = (b.c != (b.c[j] if y == UNLABELLED else y)) | (b.c == UNLABELLED)
        if y == UNLABELLED and b.c[j] == UNLABELLED:
            other &= (b.v != b.v[j]).any(axis=1)
        rows = np.flatnonzero(other)
        if b.v.shape[1]:
            rows = rows[geo.meets(v, w, b.v[rows], b.w[rows])]
        same_share = lambda r: all(any(b.a[r, f][x] / b.n[r] == h[x] / n for x in b.a[r, f].keys() & h.keys()) for f, h in enumerate(hist))
        return any(same_share(r) for r in rows)


def entropy(counts: Counter) -> float:
    p = np.array([c for c in counts.values() if c], float) / sum(counts.values())
    return float(-(p * np.log2(p)).sum())


@dataclass
class OneHotGfmm(OnlineGfmm):
    """Mixed features: a set of values (bits) per categorical feature; growth needs enough features in common."""

    min_percent_overlap_cat: float = 0.5

    def begin(self, s: Samples) -> None:
        if self.boxes is None:
            self.boxes = Boxes(s.xl.shape[1], s.cat.shape[1])
        super().begin(s)

    def membership(self, s: Samples, i: int, rows: np.ndarray) -> np.ndarray:
        shared = ((self.boxes.a[rows] & s.cat[i]) != 0).mean(axis=1)
        return shared if not s.xl.shape[1] else (geo.gfmm(s.xl[i], s.xu[i], *self.corners(rows), self.g) + shared) / 2

    def may_join(self, j: int, s: Samples, i: int) -> bool:
        need = max(int(self.min_percent_overlap_cat * s.cat.shape[1]), 1)
        return ((self.boxes.a[j] & s.cat[i]) != 0).sum() >= need

    def join(self, j: int, s: Samples, i: int) -> None:
        self.boxes._a[j] |= s.cat[i]

    def resolve(self, j: int, s: Samples) -> None:
        if s.xl.shape[1]:
            self.part_rivals(j)

    def first_slots(self, s: Samples, i: int) -> dict:
        return {"a": s.cat[i]}

    def fit(self, s: Samples) -> Boxes:
        s = s.marked()
        self.begin(s)
        least, self.limit, right, self.passes = min(self.theta_min, self.theta), self.theta, 0.0, 0
        while self.limit >= least and right < 1:
            self.passes += 1
            for i in range(len(s)):
                self.learn(s, i)
            self.limit *= self.alpha
            if not s.xl.shape[1]:
                break
            if self.limit >= least and len(s):
                every = np.arange(self.boxes.size)
                right = float(np.mean([self.boxes.c[self.winner(s, i, every)] == s.y[i] for i in range(len(s))]))
        return self.boxes

    def winner(self, s: Samples, i: int, rows: np.ndarray) -> int:
        b = self.membership(s, i, rows)
        top = rows[b == b.max()]
        away = np.abs((self.boxes.v[top] + self.boxes.w[top]) / 2 - (s.xl[i] + s.xu[i]) / 2).sum(axis=1)
        return top[int(away.argmin())]

    def learn(self, s: Samples, i: int) -> None:
        y, rows, box = s.y[i], self.candidates(s.y[i]), self.boxes
        if len(rows):
            b = self.membership(s, i, rows)
            order = ranked(b)
            if b[order[0]] == 1 and y in (box.c[rows[order[0]]], UNLABELLED):
                return
            for j in rows[order[self.fitting(rows[order], s, i, self.limit)]]:
                if self.may_join(j, s, i):
                    self.put(j, s, i, *self.grown(j, s, i))
                    self.join(j, s, i)
                    self.resolve(j, s)
                    return
        box.add(s.xl[i], s.xu[i], y, **self.first_slots(s, i))


@dataclass
class FreqCatGfmm(OneHotGfmm):
    """Mixed features: two slots of values per categorical feature, at most ``eta`` apart by the distance table.

    ``distance``: per feature, {(lesser, greater): distance}; an empty slot is at distance 0 from every value."""

    eta: float = 0.5
    distance: list[dict] = field(default_factory=list)

    def gap(self, f: int, a: int, b: int) -> float:
        return self.distance[f].get((min(a, b), max(a, b)), 0.0)

    def membership(self, s, i, rows):
        box = self.boxes
        fit = np.empty((len(rows), s.cat.shape[1]))
        for r, row in enumerate(rows):
            for f, x in enumerate(s.cat[i]):
                low, high = 1 - self.gap(f, x, box.a[row, f]), 1 - self.gap(f, x, box.b[row, f])
                high = 1.0 if low == 1 and box.a[row, f] != EMPTY else high
                low = 1.0 if high == 1 and box.b[row, f] != EMPTY else low
                fit[r, f] = min(low, high)
        least = fit.min(axis=1)
        return least if not s.xl.shape[1] else np.minimum(geo.gfmm(s.xl[i], s.xu[i], *self.corners(rows), self.g), least)

    def may_join(self, j, s, i):
        for f, x in enumerate(s.cat[i]):
            e, g = self.boxes.a[j, f], self.boxes.b[j, f]
            if x in (e, g):
                continue
            if e == EMPTY:
                if g == EMPTY:
                    return True
                continue
            if g == EMPTY:
                if self.gap(f, e, x) > self.eta:
                    return False
                continue
            now, low, high = self.gap(f, e, g), self.gap(f, e, x), self.gap(f, g, x)
            if max(low, high) <= now or min(low, high) > self.eta:
                return False
        return True

    def join(self, j, s, i):
        e, g = self.boxes.a[j], self.boxes.b[j]
        for f, x in enumerate(s.cat[i]):
            if e[f] == EMPTY and g[f] == EMPTY:
                e[f] = x
            elif g[f] == EMPTY or self.gap(f, e[f], g[f]) < self.gap(f, e[f], x) <= self.eta:
                g[f] = x
            else:
                e[f] = x

    def first_slots(self, s, i):
        return {"a": s.cat[i], "b": np.full(s.cat.shape[1], EMPTY)}

    def begin(self, s):
        super().begin(s)
        self.values = [np.unique(s.cat[:, f]) for f in range(s.cat.shape[1])]

    def resolve(self, j, s):
        box, apart = self.boxes, []
        for k in self.rivals(j):
            overlap = slots_overlap(box.a[j], box.b[j], box.a[k], box.b[k])
            change = self.least_change(j, k, apart) if overlap else None
            if change:
                f, low, high = change
                box._a[j, f] = box.a[j, f] if low is None else low
                box._b[j, f] = box.b[j, f] if high is None else high
                apart.append(k)
            elif s.xl.shape[1] and geo.meets(box.v[j], box.w[j], box.v[k : k + 1], box.w[k : k + 1])[0]:
                if overlap:
                    geo.part_gfmm((box.v[j], box.w[j]), (box.v[k], box.w[k]))
                else:
                    apart.append(k)

    def least_change(self, j: int, k: int, apart: list[int]) -> tuple[int, int | None, int | None] | None:
        """(feature, new lower, new upper value) that ends the overlap with box k at the least loss of distance, without a new one."""
        box, best, least = self.boxes, None, 2.0
        for f, values in enumerate(self.values):
            e, g = box.a[j, f], box.b[j, f]
            theirs, now = {box.a[k, f], box.b[k, f]}, self.gap(f, e, g)

            def choose(old: int, pair) -> tuple[int | None, float]:
                pick, loss = None, 2.0
                for x in values:
                    if x == old or x in theirs:
                        continue
                    a, b = pair(x)
                    lost = now - self.gap(f, a, b)
                    if 0 <= lost < loss and not self.overlaps_any(j, f, a, b, apart):
                        pick, loss = x, lost
                return pick, loss

            low = high = None
            loss = 2.0
            if e in theirs:
                low, loss = choose(e, lambda x: (x, g))
                if low is None:
                    continue
            if g != EMPTY and g in theirs:
                high, loss = choose(g, lambda x: (e if low is None else low, x))
                if high is None:
                    continue
            if loss < least:
                best, least = (f, low, high), loss
        return best

    def overlaps_any(self, j: int, f: int, a: int, b: int, apart: list[int]) -> bool:
        e, g = self.boxes.a[j].copy(), self.boxes.b[j].copy()
        e[f], g[f] = a, b
        return any(slots_overlap(e, g, self.boxes.a[k], self.boxes.b[k]) for k in apart)


def slots_overlap(e1, f1, e2, f2) -> bool:
    """Some slot is shared in every feature; two boxes of one value each must share it."""
    for a, b, c, d in zip(e1, f1, e2, f2):
        if not {a, b} & {c, d} or (a != c and b == EMPTY and d == EMPTY):
            return False
    return True


# Granular learning -----------------------------------------------------------------------------------------------


def remove_contained(boxes: Boxes) -> np.ndarray:
    """Rows kept after boxes that lie in another box of their class passed their weight on to it.

    Of several kept holders the one with the farthest centroid takes it; of boxes holding each other the last stays."""
    keep = np.ones(boxes.size, bool)
    for i in range(boxes.size):
        inside = (boxes.c == boxes.c[i]) & (geo.gfmm(boxes.v[i], boxes.w[i], boxes.v, boxes.w) == 1) & keep
        inside[i] = False
        holders = np.flatnonzero(inside)
        if len(holders):
            p = holders[int(np.linalg.norm(boxes.m[holders] - boxes.m[i], axis=1).argmax())]
            n = boxes.n[p] + boxes.n[i]
            boxes._m[p] = (boxes.n[p] * boxes.m[p] + boxes.n[i] * boxes.m[i]) / n
            boxes._n[p] = n
            keep[i] = False
    return np.flatnonzero(keep)


@dataclass
class Coarsen(Learner):
    """Boxes of a finer level as interval samples: growth that would meet another class is refused, new boxes are parted."""

    min_membership_aggregation: float = 0.5

    def begin(self, s: Samples) -> None:
        super().begin(s)
        labelled = not (s.y == UNLABELLED).any() and not (self.boxes.c == UNLABELLED).any()
        self.plain = labelled and not self.missing and bool((self.g >= 0.01).all())

    def learn(self, s: Samples, i: int) -> None:
        if self.plain:
            self.learn_near(s, i)
            return
        y, rows, box = s.y[i], self.candidates(s.y[i]), self.boxes
        if len(rows):
            b = geo.gfmm(s.xl[i], s.xu[i], *self.corners(rows), self.g)
            order = ranked(b)
            if b[order[0]] == 1 and y in (box.c[rows[order[0]]], UNLABELLED):
                return
            for k in order[b[order] >= max(self.min_membership_aggregation, 1 - self.g.max() * self.theta)]:
                j = rows[k]
                v, w = self.grown(j, s, i)
                c = y if box.c[j] == UNLABELLED else box.c[j]
                other = (box.c != c) | (box.c == UNLABELLED)
                other[j] = False
                if (w - v <= self.theta).all() and not geo.meets(v, w, box.v[other], box.w[other]).any():
                    self.put(j, s, i, v, w)
                    return
        j = self.new(s, i)
        if j:
            self.part_rivals(j)

    def learn_near(self, s: Samples, i: int) -> None:
        """The same where all is whole and labelled: only boxes within theta of the sample are looked at, and all candidates at once."""
        y, box, low, high, theta = s.y[i], self.boxes, s.xl[i], s.xu[i], self.theta
        if box.size:
            v, w = box.v, box.w
            near = np.flatnonzero((np.maximum(high - w, v - low) <= max(theta, 0.0) + 1e-9).all(axis=1))
            rows = near[box.c[near] == y]
            j = self.joined(rows, near[box.c[near] != y], low, high) if len(rows) else None
            if j is not None:
                if j >= 0:
                    self.put(j, s, i, *self.grown(j, s, i))
                return
        j = self.new(s, i)
        if j:
            self.part_rivals(j)

    def joined(self, rows: np.ndarray, rivals: np.ndarray, low: np.ndarray, high: np.ndarray) -> int | None:
        """Which of the rows grows to the sample: -1 where one holds it already, None where none may."""
        v, w, theta = self.boxes.v, self.boxes.w, self.theta
        b = geo.gfmm(low, high, v[rows], w[rows], self.g)
        if b.max() == 1:
            return -1
        lo, hi = np.minimum(v[rows], low), np.maximum(w[rows], high)
        left = np.flatnonzero((hi - lo <= theta).all(axis=1) & (b >= max(self.min_membership_aggregation, 1 - self.g.max() * theta)))
        rivals = rivals[geo.well_formed(v[rivals], w[rivals])]
        if not len(left):
            return None
        met = lambda lo, hi, some: (1.0 - np.maximum(lo[..., None, :] - w[some], v[some] - hi[..., None, :]) >= 1.0).all(axis=-1)  # noqa: E731  as geo.meets
        if met(low, high, rivals).any():
            return None
        left = left[ranked(b[left])]
        for k in range(0, len(left), 16):
            part = left[k : k + 16]
            free = np.flatnonzero(~met(lo[part], hi[part], rivals).any(axis=1))
            if len(free):
                return int(rows[part[free[0]]])
        return None


LEARNERS = {
    "fmnn": Fmnn, "efmnn": Efmnn, "knefmnn": Knefmnn, "rfmnn": Rfmnn, "online": OnlineGfmm, "improved": ImprovedOnlineGfmm, "inf": InfOnlineGfmm,
    "agglomerative": Agglomerative, "eiol": ExtendedImprovedGfmm, "onehot": OneHotGfmm, "freqcat": FreqCatGfmm, "coarsen": Coarsen,
}


def make(name: str, **params) -> Learner:
    if name == "agglomerative2":
        return Agglomerative(exhaustive=False, **params)
    return LEARNERS[name](**params)
