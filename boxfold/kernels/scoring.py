"""Memberships and predictions of many samples by one block of boxes, over (samples x boxes) tiles in numpy.

Kinds: ``gfmm``, ``free`` and ``fmnn`` by numbers only; ``onehot`` (bit sets), ``eiol`` (histograms of values) and
``freqcat`` (two slots and a table of distances) by numbers and categories.  A mixed model without numeric features goes
by categories alone; then boxes of equal membership are at equal distance, and the first one speaks.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from boxfold.kernels.geometry import EMPTY, MISSING_HIGH, MISSING_LOW

MIXED = ("onehot", "eiol", "freqcat")
NO_DISTANCE = 2147483647.0


@dataclass
class Model:
    """Boxes of one block as arrays, in order of box_id; categories as the kind needs them.

    ``bits``: (boxes x features); ``slots``: two such arrays of codes; ``hist``: per box a list of {value: count};
    ``distance``: per feature {(lesser, greater): distance}."""

    ids: np.ndarray
    v: np.ndarray
    w: np.ndarray
    c: np.ndarray
    n: np.ndarray
    centroid: np.ndarray
    kind: str = "gfmm"
    rule: str = "manhattan"
    gamma: object = 1.0
    alpha: float = 0.5
    bits: np.ndarray | None = None
    slots: tuple[np.ndarray, np.ndarray] | None = None
    hist: list | None = None
    distance: Sequence[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.lacks = (self.v == MISSING_LOW) | (self.w == MISSING_HIGH)
        self.lo, self.hi = np.minimum(self.v, self.w), np.maximum(self.v, self.w)
        self.middle = (self.v + self.w) / 2
        self.g = np.broadcast_to(np.asarray(self.gamma, float), (self.v.shape[1],))
        if self.kind == "eiol" and self.hist is not None:
            self.shares = self._share_lists(self.hist)
            self.hist = None
        if self.kind == "freqcat" and self.slots is not None:
            self.codes = [np.unique([x for pair in table for x in pair]).astype(np.int64) for table in self.distance]
            self.gaps = [self._gap_table(codes, table) for codes, table in zip(self.codes, self.distance)]

    @staticmethod
    def _share_lists(hist: list) -> list[dict]:
        """Per feature and value the boxes that hold it, and its share of the samples of their first feature's histogram."""
        out: list[dict] = [{} for _ in (hist[0] if hist else [])]
        for k, features in enumerate(hist):
            total = float(sum(features[0].values()))
            for f, counts in enumerate(features):
                for value, count in counts.items():
                    boxes, shares = out[f].setdefault(value, ([], []))
                    boxes.append(k)
                    shares.append(float(count) / total)
        return [{value: (np.array(b), np.array(s)) for value, (b, s) in lists.items()} for lists in out]

    @staticmethod
    def _gap_table(codes: np.ndarray, table: dict) -> np.ndarray:
        """Distances between codes; the last row and column stand for values the table lacks, at distance 0."""
        out = np.zeros((len(codes) + 1, len(codes) + 1))
        for (a, b), gap in table.items():
            i, j = np.searchsorted(codes, [a, b])
            out[i, j] = out[j, i] = gap
        return out

    def code_places(self, f: int, x: np.ndarray) -> np.ndarray:
        codes = self.codes[f]
        at = np.minimum(np.searchsorted(codes, x), max(len(codes) - 1, 0))
        return np.where(codes[at] == x, at, len(codes)) if len(codes) else np.zeros(len(x), np.int64)


    def take(self, rows: np.ndarray) -> Model:
        """Some of the boxes, in their order (no histograms)."""
        out = object.__new__(Model)
        out.__dict__.update(self.__dict__)
        for name in ("ids", "v", "w", "c", "n", "centroid", "lacks", "lo", "hi", "middle"):
            setattr(out, name, getattr(self, name)[rows])
        if self.bits is not None:
            out.bits = self.bits[rows]
        if self.slots is not None:
            out.slots = self.slots[0][rows], self.slots[1][rows]
        return out

    def within(self, rho: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Boxes that may have a membership of 1 - rho at least for samples whose lower bounds are up to ``low`` and upper bounds from ``high`` on."""
        share = {"onehot": 2.0, "fmnn": 2.0 * self.v.shape[1]}.get(self.kind, 1.0) * rho * (1 + 1e-9) + 1e-12
        met = np.ones(len(self.c), bool)
        for j, g in enumerate(self.g):
            if share >= (min(1.0, g) if self.kind == "fmnn" else 1.0):  # a side no longer matters
                continue
            reach = share * g * (self.hi[:, j] - self.lo[:, j] + 1.0) if self.kind == "free" else share / max(g, 1e-300)
            met &= (self.lo[:, j] - reach <= low[j]) & (self.hi[:, j] + reach >= high[j])
        return np.flatnonzero(met)


#: Samples of one neighbourhood, and cells up to which all boxes are compared at once.
NEAR_ROWS, ALL_CELLS = 256, 400_000


def tops(m: Model, xl: np.ndarray, xu: np.ndarray, cat: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, Model, np.ndarray]]:
    """(rows, boxes, memberships): every sample in one of the parts, with boxes among which are all that have its greatest membership.

    Samples are walked by neighbourhoods.  A neighbourhood looks at the boxes near it first; a sample whose best box is nearer than
    any that was passed over is done, the others look farther.  This is exact, and spares most of the (samples x boxes) tile."""
    n, k = len(xl), len(m.c)
    if n * k <= ALL_CELLS or not xl.shape[1] or m.kind == "eiol":
        step = max(1, 1_000_000 // max(1, k))
        for at in range(0, n, step):
            rows = np.arange(at, min(n, at + step))
            yield rows, m, tile_membership(m, xl[rows], xu[rows], None if cat is None else cat[rows])
        return
    xu = xl if m.kind == "fmnn" else xu  # which goes by lower bounds only
    lacks = (xl == MISSING_LOW) | (xu == MISSING_HIGH)
    strip = np.clip(np.floor((xl[:, 0] + xu[:, 0]) / 2 * max(1.0, np.sqrt(n / NEAR_ROWS))), -1e15, 1e15)
    order = np.lexsort((xl[:, min(1, xl.shape[1] - 1)], strip, *lacks.T))
    turns = np.flatnonzero((strip[order[1:]] != strip[order[:-1]]) | (lacks[order[1:]] != lacks[order[:-1]]).any(axis=1)) + 1
    left, few = [], NEAR_ROWS if k < 50_000 else NEAR_ROWS // 4
    for one in np.split(order, turns):  # a box that holds a sample is met by its neighbourhood, and then no other can be better
        about = m.within(HELD, xl[one].max(axis=0), xu[one].min(axis=0))
        some = m.take(about)
        for at in range(0, len(one) if len(about) else 0, few):
            rows = one[at : at + few]
            rows = yield from _sure(some, rows, HELD, xl, xu, cat)
            if len(rows):
                left.append(rows)
        if not len(about):
            left.append(one)
    order = np.concatenate(left) if left else order[:0]
    for at in range(0, len(order), NEAR_ROWS):
        rows, rho = order[at : at + NEAR_ROWS], 0.0025
        while len(rows):
            near = np.arange(k) if rho >= 1 else m.within(rho, xl[rows].max(axis=0), xu[rows].min(axis=0))
            if len(near):
                rows = yield from _sure(m, rows, rho, xl, xu, cat, near)
            rho = rho * 4 if len(near) < k else 1.0


#: So far from a box a sample still counts as held by it, as far as looking for boxes goes.
HELD = 1e-9


def _sure(m: Model, rows: np.ndarray, rho: float, xl: np.ndarray, xu: np.ndarray, cat: np.ndarray | None, near: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, Model, np.ndarray]]:
    """Tells the rows that have a membership of 1 - rho at least by the boxes near them; returns the others."""
    if near is None:
        near = m.within(rho, xl[rows].max(axis=0), xu[rows].min(axis=0))
    if not len(near):
        return rows
    some, left = m.take(near) if len(near) < len(m.c) else m, []
    step = max(1, 200_000 // len(near))  # a tile that fits the cache
    for q in range(0, len(rows), step):
        part = rows[q : q + step]
        b = tile_membership(some, xl[part], xu[part], None if cat is None else cat[part])
        sure = b.max(axis=1) >= 1 - rho if rho < 1 else np.ones(len(part), bool)
        if sure.all():
            yield part, some, b
        elif sure.any():
            yield part[sure], some, b[sure]
        left.append(part[~sure])
    return np.concatenate(left)


def numeric_tile(m: Model, xl: np.ndarray, xu: np.ndarray) -> np.ndarray:
    if m.kind == "fmnn":
        total = np.zeros((len(xl), len(m.c)))
        side = lambda z, g: np.maximum(0.0, 1.0 - np.maximum(0.0, g * np.minimum(1.0, z)))
        for j, g in enumerate(m.g):
            total += side(xl[:, j, None] - m.w[None, :, j], g) + side(m.v[None, :, j] - xl[:, j, None], g)
        return total / (2.0 * len(m.g))
    far = None  # membership falls with the distance, so the farthest side tells the least one
    for j, g in enumerate(m.g):
        for z in (xu[:, j, None] - m.hi[None, :, j], m.lo[None, :, j] - xl[:, j, None]):
            if m.kind == "free":
                z = z / (m.hi[:, j] - m.lo[:, j] + 1.0)[None] * (1.0 / g)
            elif g != 1:
                z *= g
            far = z if far is None else np.maximum(far, z, out=far)
    if far is None:
        return np.ones((len(xl), len(m.c)))
    np.minimum(far, 1.0, out=far)
    np.maximum(far, 0.0, out=far)
    return np.subtract(1.0, far, out=far)


def category_tile(m: Model, cat: np.ndarray) -> np.ndarray:
    """(samples x boxes) memberships by the categories alone."""
    n = cat.shape[1]
    if m.kind == "onehot":
        shared = np.zeros((len(cat), len(m.c)))
        for f in range(n):
            shared += (cat[:, f, None] & m.bits[None, :, f]) != 0
        return shared / float(n)
    if m.kind == "eiol":
        total = np.zeros((len(cat), len(m.c)))
        for f in range(n):
            values, place = np.unique(cat[:, f].astype(str), return_inverse=True)
            table = np.zeros((len(values), len(m.c)))
            for k, value in enumerate(values):
                found = m.shares[f].get(value)
                if found:
                    table[k, found[0]] = found[1]
            total += table[place.ravel()]
        return total / float(n)
    least = np.ones((len(cat), len(m.c)))
    for f in range(n):
        x, e, g = m.code_places(f, cat[:, f]), m.slots[0][:, f], m.slots[1][:, f]
        low, high = 1 - m.gaps[f][x[:, None], m.code_places(f, e)[None]], 1 - m.gaps[f][x[:, None], m.code_places(f, g)[None]]
        high = np.where((low == 1) & (e != EMPTY)[None], 1.0, high)
        low = np.where((high == 1) & (g != EMPTY)[None], 1.0, low)
        np.minimum(least, np.minimum(low, high), out=least)
    return least


def tile_membership(m: Model, xl: np.ndarray, xu: np.ndarray, cat: np.ndarray | None = None) -> np.ndarray:
    """(samples x boxes) memberships."""
    if m.kind not in MIXED:
        return numeric_tile(m, xl, xu)
    by_category = category_tile(m, cat) if cat is not None and cat.shape[1] else None
    if not xl.shape[1]:
        return by_category
    by_number = numeric_tile(m, xl, xu)
    if by_category is None:
        return by_number
    if m.kind == "onehot":
        return (by_number + by_category) / 2.0
    return np.minimum(by_number, by_category) if m.kind == "freqcat" else m.alpha * by_number + (1.0 - m.alpha) * by_category


def tile_distance(m: Model, xl: np.ndarray, xu: np.ndarray) -> np.ndarray:
    """(samples x boxes) distances of the rule that breaks ties between classes."""
    out = np.zeros((len(xl), len(m.c)))
    if not xl.shape[1]:
        return out
    if m.rule == "corners":
        for j in range(xl.shape[1]):
            out += np.abs(xl[:, j, None] - m.v[None, :, j]) + np.abs(xl[:, j, None] - m.w[None, :, j])
        return out / (2.0 * xl.shape[1])
    middle = (xl + xu) / 2.0
    if m.rule == "centroid":
        for j in range(xl.shape[1]):
            out += (m.centroid[None, :, j] - middle[:, j, None]) ** 2
        return np.sqrt(out)
    lacks = (xl == MISSING_LOW) | (xu == MISSING_HIGH)
    seen = np.zeros_like(out, bool)
    for j in range(xl.shape[1]):
        there = ~lacks[:, j, None] & ~m.lacks[None, :, j]
        out += np.where(there, np.abs(middle[:, j, None] - m.middle[None, :, j]), 0.0)
        seen |= there
    return np.where(seen, out, NO_DISTANCE)


@lru_cache(maxsize=None)
def chosen(n: int) -> int:
    """Which of n equal boxes speaks: always the same one for the same n."""
    return random.Random(0).choice(range(n))


def _pick(among: np.ndarray) -> np.ndarray:
    """Of the true entries of each row the chosen one."""
    count = among.sum(axis=1)
    turn = np.array([chosen(int(n)) for n in range(1, int(count.max(initial=1)) + 1)])[np.maximum(count, 1) - 1]
    return (np.cumsum(among, axis=1) == (turn + 1)[:, None]).argmax(axis=1)


def most_likely(m: Model, b: np.ndarray) -> np.ndarray:
    """Place of the box that speaks by the weight of samples: of certain boxes of one sample a chosen one goes first, else
    the class with more samples in the tied boxes (of equal ones the lowest class), and a chosen box of it."""
    top = b.max(axis=1)
    tied = b == top[:, None]
    out = tied.argmax(axis=1)
    several = np.flatnonzero(tied.sum(axis=1) > 1)
    if not len(several):
        return out
    tied, top = tied[several], top[several]
    classes = np.unique(m.c)
    weight = np.column_stack([np.where(tied & (m.c == c)[None], m.n[None], 0.0).sum(axis=1) for c in classes])
    held = np.column_stack([(tied & (m.c == c)[None]).any(axis=1) for c in classes])
    best = classes[np.where(held, weight, -1.0).argmax(axis=1)]
    place = _pick(tied & (m.c[None] == best[:, None]))
    single = tied & (m.n == 1)[None]
    certain = (top == 1) & single.any(axis=1)
    if certain.any():
        place[certain] = _pick(single[certain])
    out[several] = place
    return out


def evidence(m: Model, b: np.ndarray, xl: np.ndarray, xu: np.ndarray, always: bool) -> list[np.ndarray]:
    """Greatest membership, least and greatest class of the boxes that have it, the first of them (id, class), and the nearest
    (distance, less weight, id, class).  Distances are worked out where classes are torn, or always, where another block may tear them."""
    top = b.max(axis=1)
    tied = b == top[:, None]
    low = np.where(tied, m.c[None], np.iinfo(np.int64).max).min(axis=1)
    high = np.where(tied, m.c[None], np.iinfo(np.int64).min).max(axis=1)
    first = tied.argmax(axis=1)
    near, away = first.copy(), np.zeros(len(b))
    torn = np.flatnonzero((low != high) | always)
    if len(torn):
        dist = np.where(tied[torn], tile_distance(m, xl[torn], xu[torn]), np.inf)
        away[torn] = dist.min(axis=1)
        if m.rule == "centroid":  # of equally near boxes the one with more samples
            dist = np.where(dist == away[torn, None], -m.n[None], np.inf)
        near[torn] = dist.argmin(axis=1)
    weight = m.n[near] if m.rule == "centroid" else np.zeros(len(b))
    return [top, low, high, m.ids[first], m.c[first], away, -weight, m.ids[near], m.c[near]]


def combine(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Evidence of two blocks as of one."""
    above, equal = b[0] > a[0], b[0] == a[0]
    first = above | (equal & (b[3] < a[3]))
    near = above | (equal & ((b[5] < a[5]) | (b[5] == a[5]) & ((b[6] < a[6]) | (b[6] == a[6]) & (b[7] < a[7]))))
    pick = lambda k, side: np.where(side, b[k], a[k])
    low = np.where(equal, np.minimum(a[1], b[1]), pick(1, above))
    high = np.where(equal, np.maximum(a[2], b[2]), pick(2, above))
    return [pick(0, above), low, high, pick(3, first), pick(4, first), pick(5, near), pick(6, near), pick(7, near), pick(8, near)]


def speakers(m: Model, xl: np.ndarray, xu: np.ndarray, cat: np.ndarray | None = None) -> np.ndarray:
    """Ids of the boxes that samples count for: the nearest of those of greatest membership, or by the weight of samples."""
    out = np.empty(len(xl), np.int64)
    for rows, some, b in tops(m, xl, xu, cat):
        out[rows] = some.ids[most_likely(some, b)] if m.rule == "probability" else evidence(some, b, xl[rows], xu[rows], True)[7]
    return out


def winners(m: Model, xl: np.ndarray, xu: np.ndarray, cat: np.ndarray | None = None) -> np.ndarray:
    """Predicted classes by one block; rule ``probability`` goes by the weight of samples."""
    out = np.empty(len(xl), np.int64)
    for rows, some, b in tops(m, xl, xu, cat):
        if m.rule == "probability":
            out[rows] = some.c[most_likely(some, b)]
        else:
            _, low, high, _, first, _, _, _, near = evidence(some, b, xl[rows], xu[rows], False)
            out[rows] = np.where(low == high, first, near)
    return out


def evidence_of(m: Model, xl: np.ndarray, xu: np.ndarray, cat: np.ndarray | None, always: bool) -> list[np.ndarray]:
    """``evidence`` of all samples by one block."""
    out: list[np.ndarray] | None = None
    for rows, some, b in tops(m, xl, xu, cat):
        found = evidence(some, b, xl[rows], xu[rows], always)
        if out is None:
            out = [np.empty(len(xl), x.dtype) for x in found]
        for whole, x in zip(out, found):
            whole[rows] = x
    return out
