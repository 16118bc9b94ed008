"""Exact work on every pair of vectors, by matrix products.

Rows are packed into blocks, a few rows of a table each, and every two blocks meet in a task of their own. There patches of both are multiplied
as matrices. Such a product is off by no more than a bound that goes with the norms; it decides alone where it can. What it leaves in doubt
(a product at a threshold, rivals for a place) is summed anew from the first component to the last, so results are those of `dot`.
The number of blocks does not grow with the table until a block is full; so neither does the number of copies of a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import stored

#: Blocks wished for, rows of a block at least and at most, bytes of its vectors at most and of those of a piece, rows of a side of a patch.
BLOCKS, LEAST_ROWS, MOST_ROWS, MOST_BYTES, PIECE_BYTES, STEP = 24, 1024, 32_768, 16 << 20, 1 << 18, 512
#: Pairs that are summed anew at once.
ANEW = 1 << 16
#: Products are compared at 9 places: what is surely equal then, and what may be.
CLOSER, WIDER = 4e-10, 6e-10

_SIDE = "block int, piece int, ids binary, codes binary, names array<string>, widths binary, cells binary"


def packed(kind: type) -> Callable[[pa.Table], pa.Table]:
    """A block's rows by ascending ids in a few rows, small enough for a shuffle's pages."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        label, vector = t.column("label").combine_chunks().dictionary_encode(), t.column("vector").combine_chunks()
        cells = vector.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
        ids, codes = t.column("id").to_numpy(), label.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        widths = np.diff(vector.offsets.to_numpy()).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(widths)])
        size = max(1, PIECE_BYTES // max(1, int(widths.max()) * cells.itemsize))
        starts = range(0, len(ids), size)
        names = label.dictionary.to_pylist()
        own = [np.unique(codes[s : s + size][codes[s : s + size] >= 0]) for s in starts]  # a piece names its own labels alone
        coded = [np.where(c >= 0, np.searchsorted(o, c), -1).astype(np.int32) for o, c in ((o, codes[s : s + size]) for o, s in zip(own, starts))]
        raw = lambda parts: pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())
        return pa.table({
            "block": pa.array([t.column("block")[0].as_py()] * len(starts), pa.int32()), "piece": pa.array(range(len(starts)), pa.int32()), "ids": raw(ids[s : s + size] for s in starts), "codes": raw(coded),
            "names": pa.array([[names[c] for c in o] for o in own], pa.list_(pa.string())), "widths": raw(widths[s : s + size] for s in starts), "cells": raw(cells[ends[s] : ends[min(s + size, len(ids))]] for s in starts),
        })

    return pack


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that are true; much faster than `nonzero` where few are."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


class Side:
    """A block's rows: ids, codes of labels (-1: none) and, by their width, the vectors."""

    def __init__(self, pieces: list[dict], kind: type, names: dict):
        whole = lambda c, of: np.frombuffer(b"".join(p[c] for p in pieces), of)
        self.ids, self.widths, cells = whole("ids", np.int64), whole("widths", np.int32), whole("cells", kind)
        own = [np.array([*(names.setdefault(n, len(names)) for n in p["names"]), -1]) for p in pieces]
        self.codes = np.concatenate([o[np.frombuffer(p["codes"], np.int32)] for o, p in zip(own, pieces)])
        ends = np.cumsum(self.widths)
        self.at, self.of_width = np.zeros(len(self.ids), np.int64), {}
        for width in np.unique(self.widths).tolist():
            mine = np.flatnonzero(self.widths == width)
            self.at[mine] = np.arange(len(mine))
            self.of_width[width] = (mine, cells[(ends[mine] - width)[:, None] + np.arange(width)].astype(np.float64))
        self.norm = max((math.sqrt(float((m**2).sum(axis=1).max(initial=0.0))) for _, m in self.of_width.values()), default=0.0)

    def __len__(self) -> int:
        return len(self.ids)


class Pair:
    """Two blocks, or one twice (`square`)."""

    def __init__(self, t: pa.Table, kind: type):
        pieces = sorted(t.to_pylist(), key=lambda r: (r["block"], r["piece"]))
        first, last = ([p for p in pieces if p["block"] == b] for b in (pieces[0]["block"], pieces[-1]["block"]))
        self.names: dict = {}
        self.x = Side(first, kind, self.names)
        self.square = pieces[0]["block"] == pieces[-1]["block"]
        self.y = self.x if self.square else Side(last, kind, self.names)
        width = max([0, *self.x.of_width, *self.y.of_width])
        #: What a product of matrices and one of `exact` may differ by.
        self.slack = 4 * width * np.finfo(float).eps * self.x.norm * self.y.norm
        # rows of one id are no pair
        low, high = (np.searchsorted(self.y.ids, self.x.ids, side) for side in ("left", "right"))
        n = high - low
        p = np.repeat(np.arange(len(n)), n)
        q = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        some = p < q if self.square else slice(None)
        self.p, self.q = p[some], q[some]

    def exact(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Products from the first component to the last, as dot() sums; 0 for vectors of different lengths."""
        out = np.zeros(len(p))
        for start in range(0, len(p), ANEW):
            a, b = p[start : start + ANEW], q[start : start + ANEW]
            for width, (_, left) in self.x.of_width.items():
                if width in self.y.of_width:
                    at = np.flatnonzero((self.x.widths[a] == width) & (self.y.widths[b] == width))
                    u, v, s = left[self.x.at[a[at]]], self.y.of_width[width][1][self.y.at[b[at]]], np.zeros(len(at))
                    for c in range(width):
                        s += u[:, c] * v[:, c]
                    out[start + at] = s
        return out

    def patches(self, skip: Callable | None = None) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """(rows, columns, products) of all patches, both ascending; what is no pair is NaN."""
        for a in range(0, len(self.x), STEP):
            for b in range(a if self.square else 0, len(self.y), STEP):
                r, c = slice(a, min(a + STEP, len(self.x))), slice(b, min(b + STEP, len(self.y)))
                if skip is not None and skip(r, c):
                    continue
                if len(self.x.of_width) == len(self.y.of_width) == 1 and list(self.x.of_width) == list(self.y.of_width):
                    sim = next(iter(self.x.of_width.values()))[1][r] @ next(iter(self.y.of_width.values()))[1][c].T
                else:
                    sim = np.zeros((r.stop - r.start, c.stop - c.start))
                    for width, (mine, left) in self.x.of_width.items():
                        other, right = self.y.of_width.get(width, (np.zeros(0, np.int64), None))
                        i, j = mine[(mine >= r.start) & (mine < r.stop)], other[(other >= c.start) & (other < c.stop)]
                        if len(i) and len(j):
                            sim[np.ix_(i - r.start, j - c.start)] = left[self.x.at[i]] @ right[self.y.at[j]].T
                if self.square and a == b:
                    sim[np.tril_indices(len(sim))] = np.nan
                if len(self.p):
                    here = (self.p >= r.start) & (self.p < r.stop) & (self.q >= c.start) & (self.q < c.stop)
                    sim[self.p[here] - r.start, self.q[here] - c.start] = np.nan
                yield r, c, sim


def all_pairs(vectors: DataFrame, work: Callable[[Pair], pa.Table], schema: str, key: str = "vec_id", group: str = "label", vector: str = "embedding", block: int | None = None) -> DataFrame:
    """`work` on every two blocks of rows, each with itself too: together they hold each pair of rows once. Rows without a key take no part, a null vector has no components."""
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    kind, name = (np.float32, "float") if single else (np.float64, "double")
    rows = vectors.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(group).cast("string").alias("label"), F.coalesce(F.col(vector).cast(f"array<{name}>"), F.array().cast(f"array<{name}>")).alias("vector")
    )
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    most = max(1, min(MOST_ROWS, MOST_BYTES // max(1, width * np.dtype(kind).itemsize)))
    blocks = max(1, math.ceil(n / (block or min(most, max(LEAST_ROWS, math.ceil(n / BLOCKS))))))
    dealt = rows.withColumn("block", F.expr(f"cast(pmod(xxhash64(id, vector), {blocks}) as int)")).repartition(blocks, "block")
    sides = stored(dealt.groupBy("block").applyInArrow(packed(kind), _SIDE), "blocks")
    # dealt anew, so that no task makes the copies of many pieces
    met = sides.repartition(4 * blocks).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *sides.columns).repartition(blocks * (blocks + 1) // 2, "i", "j")

    def run(t: pa.Table) -> pa.Table:
        whole = t.column("i")[0].as_py() == t.column("j")[0].as_py() or len(set(t.column("block").to_pylist())) == 2  # a block that has no rows meets none
        return work(Pair(t, kind)) if whole else pa.Table.from_batches([], schema=empty)

    empty = to_arrow_schema(T.StructType.fromDDL(schema))
    return met.groupBy("i", "j").applyInArrow(run, schema)


SEPARATION = "low_same double, high_other double, sum_same double, n_same long, sum_other double, n_other long"


def separation_work(t: Pair) -> pa.Table:
    """Least product, sum and number within labels; largest, sum and number between labels. Sums are those of the labels' sums."""
    low, high = math.inf, -math.inf
    for r, c, sim in t.patches():
        for less in (True, False):
            p, q = places(sim <= low + t.slack if less else sim >= high - t.slack)
            g, h = t.x.codes[p + r.start], t.y.codes[q + c.start]
            some = np.flatnonzero((g >= 0) & (h >= 0) & ((g == h) if less else (g != h)))
            if not len(some):
                continue
            p, q = p[some], q[some]
            near = sim[p, q]
            some = np.flatnonzero(near <= near.min() + 2 * t.slack if less else near >= near.max() - 2 * t.slack)
            found = t.exact(p[some] + r.start, q[some] + c.start)
            low, high = (min(low, found.min()), high) if less else (low, max(high, found.max()))
    labels = len(t.names)
    of = lambda s, m, v: np.stack([np.bincount(s.codes[m][s.codes[m] >= 0], w[s.codes[m] >= 0], labels) for w in v.T], axis=1) if v.shape[1] else np.zeros((labels, 0))
    sum_same = sum_all = 0.0
    for width, (mine, v) in t.x.of_width.items():
        if width in t.y.of_width:
            x, y = of(t.x, mine, v), of(t.y, *t.y.of_width[width])
            sum_same += float((x * y).sum())
            sum_all += float(x.sum(axis=0) @ y.sum(axis=0))
            if t.square:
                own = float((v[t.x.codes[mine] >= 0] ** 2).sum())
                sum_same, sum_all = sum_same - own, sum_all - own
    x, y = (np.bincount(s.codes[s.codes >= 0], minlength=labels) for s in (t.x, t.y))
    n_same, n_all = int(x @ y), int(x.sum() * y.sum())
    if t.square:
        sum_same, sum_all, n_same, n_all = sum_same / 2, sum_all / 2, (n_same - int(x.sum())) // 2, (n_all - int(x.sum())) // 2
    g, h = t.x.codes[t.p], t.y.codes[t.q]
    some = (g >= 0) & (h >= 0)
    no, same = t.exact(t.p[some], t.q[some]), (g == h)[some]  # no pairs
    sum_same, sum_all, n_same, n_all = sum_same - float(no[same].sum()), sum_all - float(no.sum()), n_same - int(same.sum()), n_all - len(no)
    end = lambda v: pa.array([None if math.isinf(v) else v], pa.float64())
    return pa.table({"low_same": end(low), "high_other": end(high), "sum_same": [sum_same], "n_same": [n_same], "sum_other": [sum_all - sum_same], "n_other": [n_all - n_same]})


class Best:
    """The k best found of each row, by product at 9 places and then by id."""

    def __init__(self, n: int, k: int):
        self.k, self.sim, self.ids = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def rivals(self, rows: slice, sim: np.ndarray, turned: bool, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray], slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, other) of the places in `sim`, whose columns are the rows if `turned`, that may be among the k best. Others come by ascending ids, so what only equals the k-th is not."""
        floor = self.sim[rows, -1]
        least = floor + CLOSER - slack
        new = np.flatnonzero(np.isneginf(floor))
        others = sim.shape[0 if turned else 1]
        if len(new) and others > self.k:
            own = np.ascontiguousarray(sim[:, new].T if turned else sim[new])
            p, q = places(~np.isnan(own))
            some = allowed(new[p], q)
            here = np.full(own.shape, -np.inf)
            here[p[some], q[some]] = own[p[some], q[some]]
            least[new] = np.partition(here, others - self.k, axis=1)[:, others - self.k] - 2 * (WIDER + slack)
        p, q = places(sim >= (least[None] if turned else least[:, None]))
        if turned:
            p, q = q, p
        some = allowed(p, q)
        return p[some], q[some]

    def add(self, p: np.ndarray, sim: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(p)
        p = np.concatenate([p, np.repeat(rows, self.k)])
        sim, ids = np.concatenate([np.round(sim, 9), self.sim[rows].ravel()]), np.concatenate([ids, self.ids[rows].ravel()])
        order = np.lexsort((ids, -sim, p))
        p = p[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1])
        kept = order[np.arange(len(p)) - np.repeat(first, np.diff([*first, len(p)])) < self.k]
        self.sim[rows], self.ids[rows] = sim[kept].reshape(-1, self.k), ids[kept].reshape(-1, self.k)


BEST = "q long, group_q string, b long, sim double"


def best_work(k: int, other_group: bool) -> Callable[[Pair], pa.Table]:
    """The k best rows of the other block with each row, and the other way round."""

    def work(t: Pair) -> pa.Table:
        left = Best(len(t.x), k)
        right = left if t.square else Best(len(t.y), k)
        for r, c, sim in t.patches():
            # on the diagonal smaller ids come first
            for best, mine, s, rows, cols, turned in ((right, t.y, t.x, c, r, True), (left, t.x, t.y, r, c, False)):
                if other_group:
                    g, h = mine.codes[rows], s.codes[cols]
                    allowed = lambda p, q, g=g, h=h: np.flatnonzero((g[p] >= 0) & (h[q] >= 0) & (g[p] != h[q]))
                else:
                    allowed = lambda p, q: slice(None)
                p, q = best.rivals(rows, sim, turned, allowed, t.slack)
                if len(p):
                    p, q = p + rows.start, q + cols.start
                    best.add(p, t.exact(q, p) if turned else t.exact(p, q), s.ids[q])
        names = np.array([*t.names, None], object)
        parts = []
        for best, s in ((left, t.x),) if t.square else ((left, t.x), (right, t.y)):
            p, at = np.nonzero(best.sim > -np.inf)
            parts.append(pa.table({"q": s.ids[p], "group_q": pa.array(names[s.codes[p]].tolist(), pa.string()), "b": best.ids[p, at], "sim": best.sim[p, at]}))
        return pa.concat_tables(parts)

    return work


LINKS = "a long, b long"


def link_work(least: float) -> Callable[[Pair], pa.Table]:
    """Pairs that connect both blocks' rows as all their pairs of at least `least` do."""

    def work(t: Pair) -> pa.Table:
        n = len(t.x)
        ids = t.x.ids if t.square else np.concatenate([t.x.ids, t.y.ids])
        right = 0 if t.square else n
        top = np.arange(len(ids))

        def one(r: slice, c: slice) -> bool:
            """Whether all rows of a patch are connected already."""
            return bool((top[r] == top[r.start]).all() and (top[c.start + right : c.stop + right] == top[r.start]).all())

        for r, c, sim in t.patches(one):
            p, q = places(sim >= least - t.slack)
            doubt = np.flatnonzero(sim[p, q] < least + t.slack)
            p, q = p + r.start, q + c.start
            sure = np.ones(len(p), bool)
            sure[doubt] = t.exact(p[doubt], q[doubt]) >= least
            p, q = p[sure], q[sure] + right
            while True:
                a, b = top[p], top[q]
                apart = np.flatnonzero(a != b)
                if not len(apart):
                    break
                p, q, a, b = p[apart], q[apart], a[apart], b[apart]
                np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
                while (top[top] != top).any():
                    top = top[top]
        at = np.flatnonzero(ids[top] != ids)
        return pa.table({"a": ids[top[at]], "b": ids[at]})

    return work


BOUNDARY = "part int, a long, b long, k double"


class Ends:
    """The n first pairs by sign * product (at 9 places) and then by ids."""

    def __init__(self, sign: int, n: int):
        self.sign, self.n, self.key, self.low, self.high = sign, n, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def most(self) -> float:
        """What sign * product may be at most."""
        return self.key[-1] + WIDER if len(self.key) == self.n else math.inf

    def rivals(self, near: np.ndarray, low: np.ndarray, sure: np.ndarray, slack: float) -> np.ndarray:
        """Places in `near` that may be among the first; `sure` are those that surely belong to this end."""
        key = self.sign * near
        at = np.flatnonzero(key <= self.most() + slack)
        if len(self.key) == self.n:
            at = at[(key[at] <= self.key[-1] - CLOSER + slack) | (low[at] <= self.low[-1])]
        known = key[at[sure[at]]]
        if len(known) > self.n:
            at = at[key[at] <= np.partition(known, self.n - 1)[self.n - 1] + 2 * (WIDER + slack)]
        return at

    def add(self, sim: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        key, low, high = np.concatenate([self.key, self.sign * np.round(sim, 9)]), np.concatenate([self.low, low]), np.concatenate([self.high, high])
        first = np.lexsort((high, low, key))[: self.n]
        self.key, self.low, self.high = key[first], low[first], high[first]


def boundary_work(least: float, top: int, above: int, below: int) -> Callable[[Pair], pa.Table]:
    """The ends of two blocks' pairs: largest of all (part 0), least that reach `least` (1), largest that do not (2)."""

    def work(t: Pair) -> pa.Table:
        ends = [Ends(-1, top), Ends(1, above), Ends(-1, below)]
        for r, c, sim in t.patches():
            # the most that the third end leaves out is below what the others want
            p, q = places(sim >= min(-ends[2].most(), -ends[0].most(), least) - t.slack)
            near = sim[p, q]
            p, q = p + r.start, q + c.start
            low, high = np.minimum(t.x.ids[p], t.y.ids[q]), np.maximum(t.x.ids[p], t.y.ids[q])
            for end, may, sure in (
                (ends[0], np.ones(len(p), bool), np.ones(len(p), bool)), (ends[1], near >= least - t.slack, near >= least + t.slack), (ends[2], near < least + t.slack, near < least - t.slack),
            ):
                at = np.flatnonzero(may)
                at = at[end.rivals(near[at], low[at], sure[at], t.slack)]
                if len(at):
                    found = t.exact(p[at], q[at])
                    own = slice(None) if end is ends[0] else found >= least if end is ends[1] else found < least
                    end.add(found[own], low[at][own], high[at][own])
        columns = [np.concatenate([getattr(e, c) for e in ends]) for c in ("low", "high")]
        k = np.concatenate([e.sign * e.key for e in ends])
        part = np.repeat(np.arange(3, dtype=np.int32), [len(e.key) for e in ends])
        return pa.table({"part": part, "a": columns[0], "b": columns[1], "k": k})

    return work
