"""Vector operators on arrays, by column expressions and joins."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored
from ..sources.tables import small
from . import all_pairs as ap

#: Centroids that are sent to all rows at most.
LABELS = 10_000


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for vectors of different lengths or none."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), product).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def unit(a: Column) -> Column:
    return F.when(norm(a) > 0, scaled(a, 1.0 / norm(a))).otherwise(a)


def fit_length(a: Column, n: int) -> Column:
    """The first n components, filled up with zeros."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def sums(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, total, n): element-wise sums, combined before the shuffle by position."""
    each = vectors.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("total"), F.max("n").alias("n"))


def centroids(vectors: DataFrame, group: str, vector: str, normalised: bool = False) -> DataFrame:
    mean = scaled(F.col("total"), 1.0 / F.col("n"))
    return sums(vectors, group, vector).select(group, (unit(mean) if normalised else mean).alias("centroid"))


def pooled(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, vector): the sum of a group's vectors made of length one; groups whose sum is zero have none."""
    return sums(vectors, group, vector).filter(norm(F.col("total")) > 0).select(group, unit(F.col("total")).alias("vector"))


def windows(docs: DataFrame, tokens: Column, size: int = 512, key: str = "doc_id") -> DataFrame:
    """(key, window, part): tokens in windows of `size`, the last one shorter; a text without tokens has none."""
    each = docs.select(key, tokens.alias("t")).filter(F.size("t") > 0)
    return each.select(key, "t", F.explode(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / size).cast("int"))).alias("window")).select(key, "window", F.slice("t", F.col("window") * size + 1, size).alias("part"))


def leave_one_out(vectors: DataFrame, key: str = "vec_id", group: str = "label", vector: str = "embedding") -> DataFrame:
    """(key, group, predicted, rank): nearest centroid by inner product, each row's own group without the row itself.

    The groups' sums are one row a group and go to the rows if counted few; a group of one has no centroid for its row.
    """
    totals = sums(vectors, group, vector).withColumnRenamed(group, "g")
    own = F.col(group) == F.col("g")
    n = F.when(own, F.col("n") - 1).otherwise(F.col("n"))
    left = F.when(own, F.zip_with("total", vector, lambda t, x: t - x.cast("double"))).otherwise(F.col("total"))
    scored = vectors.crossJoin(small(totals, LABELS)).filter(n > 0).select(key, group, "g", F.round(dot(left, F.col(vector)) / n, 9).alias("sim"))
    ranked = scored.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("sim"), "g")))
    return ranked.groupBy(key, group).agg(F.min_by("g", "r").alias("predicted"), F.min(F.when(F.col(group) == F.col("g"), F.col("r"))).alias("rank"))


#: Vectors of a block, about; a tile holds the products of two blocks (8 MB).
BLOCK = 1024


def tiled(vectors: DataFrame, work: Callable[[Tile], pa.Table], schema: str, key: str = "vec_id", group: str = "label", vector: str = "embedding", asks: str = "true", block: int = BLOCK) -> DataFrame:
    """`work` on every tile of two blocks of rows: together the tiles hold each pair of rows once.

    Rows are dealt into blocks by a hash, so a task's memory is bounded by `block` and does not grow with the
    table; the number of tiles does, with its square, as exact work over all pairs must.
    """
    rows = vectors.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(group).cast("string").alias("label"), F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>")).alias("vector"),
        F.coalesce(F.expr(asks), F.lit(False)).alias("asks"),
    )
    blocks = max(1, math.ceil(rows.count() / block))
    if asks != "true":  # blocks of asking rows against blocks of all, no others
        asking = max(1, math.ceil(rows.filter("asks").count() / block))
        part = lambda n: F.expr(f"cast(pmod(xxhash64(id, vector), {n}) as int)")
        left = rows.filter("asks").select(part(asking).alias("i"), F.explode(F.sequence(F.lit(-blocks), F.lit(-1))).alias("j"), F.lit(0).alias("side"), "id", "label", "vector", "asks")
        right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(asking - 1))).alias("i"), (-1 - part(blocks)).alias("j"), F.lit(1).alias("side"), "id", "label", "vector", F.lit(False).alias("asks"))
        return left.union(right).groupBy("i", "j").applyInArrow(lambda t: work(Tile(t)), schema)
    dealt = rows.withColumn("mine", F.expr(f"cast(pmod(xxhash64(id, vector), {blocks}) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sides = dealt.select(F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"), "id", "label", "vector", "asks")
    return sides.groupBy("i", "j").applyInArrow(lambda t: work(Tile(t)), schema)


class Tile:
    """Two blocks of rows (of one block twice, on the diagonal) with the products and which of them are pairs."""

    def __init__(self, rows: pa.Table):
        ids, side, asks = (rows.column(c).to_numpy() for c in ("id", "side", "asks"))
        square = not (rows.column("j").to_numpy() != rows.column("i").to_numpy()).any()
        left = np.flatnonzero(side == 0)
        right = left if square else np.flatnonzero(side == 1)
        label = rows.column("label").combine_chunks().dictionary_encode()
        codes, self.labels = label.indices.fill_null(-1).to_numpy(zero_copy_only=False), label.dictionary
        flat = rows.column("vector").combine_chunks()
        bounds, values = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False)
        lengths = np.diff(bounds)
        self.x, self.y, self.x_asks, self.y_asks = ids[left], ids[right], asks[left], asks[right]
        self.gx, self.gy = codes[left], codes[right]
        self.sim = np.zeros((len(left), len(right)))
        for width in np.unique(lengths[left]).tolist():
            p, q = (np.flatnonzero(lengths[s] == width) for s in (left, right))
            a, b = (np.stack([values[at : at + width] for at in bounds[s].tolist()]) if len(s) else np.zeros((0, width)) for s in (left[p], right[q]))
            product = np.zeros((len(p), len(q)))
            for c in range(width):  # from the first component to the last, as dot() sums
                product += np.multiply.outer(a[:, c], b[:, c])
            self.sim[np.ix_(p, q)] = product
        self.pair = self.x[:, None] != self.y[None]
        if square:
            self.pair &= np.arange(len(left))[:, None] < np.arange(len(right))[None]
        known = (self.gx >= 0)[:, None] & (self.gy >= 0)[None]
        self.same = self.pair & known & (self.gx[:, None] == self.gy[None])
        self.other = self.pair & known & (self.gx[:, None] != self.gy[None])
        self.square = square


def separation(vectors: DataFrame, **of) -> DataFrame:
    """One row over all pairs: least, sum and number of products within groups, largest, sum and number between groups."""

    parts = ap.all_pairs(vectors, ap.separation_work, ap.SEPARATION, **of)
    mean = lambda k: F.try_divide(F.sum(f"sum_{k}"), F.sum(f"n_{k}")).alias(f"mean_{k}")
    return parts.agg(F.min("low_same").alias("low_same"), F.max("high_other").alias("high_other"), mean("same"), mean("other"))


def best_work(k: int, other_group: bool) -> Callable[[Tile], pa.Table]:
    """A tile's k best of each asking row, with all that tie at the edge of the k decided by ids."""

    def work(t: Tile) -> pa.Table:
        may = t.other if other_group else t.pair
        if t.square:
            may = may | may.T
        sim = np.round(t.sim, 9)
        out: list[tuple] = []

        def best(asking, ids, groups, others, sims, mask):
            for i in np.flatnonzero(asking).tolist():
                at = np.flatnonzero(mask[i])
                if len(at) > k:  # all that tie with the k-th stay until ids decide
                    at = at[sims[i, at] >= np.partition(sims[i, at], len(at) - k)[len(at) - k]]
                at = at[np.lexsort((others[at], -sims[i, at]))][:k]
                name = t.labels[int(groups[i])].as_py() if groups[i] >= 0 else None
                out.extend((int(ids[i]), name, int(others[c]), float(sims[i, c])) for c in at.tolist())

        best(t.x_asks, t.x, t.gx, t.y, sim, may)
        if not t.square:
            best(t.y_asks, t.y, t.gy, t.x, sim.T, may.T)
        q, g, b, s = zip(*out) if out else ((), (), (), ())
        return pa.table({"q": pa.array(q, pa.int64()), "group_q": pa.array(g, pa.string()), "b": pa.array(b, pa.int64()), "sim": pa.array(s, pa.float64())})

    return work


def nearest(vectors: DataFrame, k: int, asks: str = "true", other_group: bool = False, **of) -> DataFrame:
    """(q, group_q, b, sim, r): the k rows of largest product (9 places, ties to the smaller id) with each row that `asks`, of all or of other groups."""
    if asks == "true":
        found = ap.all_pairs(vectors, ap.best_work(k, other_group), ap.BEST, **of)
    else:
        found = tiled(vectors, best_work(k, other_group), ap.BEST, asks=asks, **of)
    return found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "b"))).filter(F.col("r") <= k)


def link_work(least: float) -> Callable[[Tile], pa.Table]:
    """Pairs that connect a tile's rows as all its pairs of at least `least` do."""

    def work(t: Tile) -> pa.Table:
        linked = t.pair & (t.sim >= least)
        if t.square:
            near = linked | linked.T
            ids = t.x
        else:
            n, m = linked.shape
            near = np.zeros((n + m, n + m), bool)
            near[:n, n:], near[n:, :n] = linked, linked.T
            ids = np.concatenate([t.x, t.y])
        a, b, new = [], [], np.ones(len(ids), bool)
        for start in range(len(ids)):
            if not new[start]:
                continue
            new[start], stack = False, [start]
            while stack:
                v = stack.pop()
                ahead = np.flatnonzero(near[v] & new)
                new[ahead] = False
                stack += ahead.tolist()
                a.append(np.full(len(ahead), ids[v]))
                b.append(ids[ahead])
        a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return work


def links(vectors: DataFrame, least: float, **of) -> DataFrame:
    """(a, b): pairs that connect the same rows as all pairs of at least `least` do, fewer than both blocks' rows from every two blocks."""
    return ap.all_pairs(vectors, ap.link_work(least), ap.LINKS, **of)


def boundary(vectors: DataFrame, least: float, top: int = 3, above: int = 3, below: int = 4, **of) -> DataFrame:
    """(a, b, k): the `top` pairs of largest product (9 places), the `above` least that reach `least`, the `below` largest that do not."""

    p = stored(ap.all_pairs(vectors, ap.boundary_work(least, top, above, below), ap.BOUNDARY, **of))
    first = lambda part, n, *order: p.filter(F.col("part") == part).select("a", "b", "k").distinct().orderBy(*order).limit(n)
    return first(0, top, F.desc("k"), "a", "b").union(first(1, above, "k", "a", "b")).union(first(2, below, F.desc("k"), "a", "b")).distinct()


def structural_classes(programs: DataFrame, calls: DataFrame, domains: DataFrame, crossing: DataFrame, least_callers: int = 2) -> DataFrame:
    """(name, domain, how): classes of programs by the call graph and their pooled vectors.

    Programs are (name, layer, vector), calls (source, target), domains (domain, vector), crossing (name, domain): programs
    whose class is given. Programs of the layer "Data" that `least_callers` or more others call are shared. The rest are
    joined by their calls; a component's vectors are pooled and it goes to the domain of the largest product, ties to
    the first. A shared program takes the domain of most of its callers, ties to the first, null if none has one.
    """
    from .graph import connected

    known = programs.select("name").distinct()
    among = lambda e, c: e.join(known.select(F.col("name").alias(c)), c, "left_semi")
    edges = among(among(calls.select("source", "target").distinct(), "source"), "target")
    callers = edges.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("n")).filter(F.col("n") >= least_callers)
    shared = programs.filter("layer = 'Data'").join(callers, "name", "left_semi").select("name").distinct()
    out = crossing.select("name").union(shared).distinct()
    left = programs.join(out, "name", "left_anti")
    inner = edges.join(out.withColumnRenamed("name", "source"), "source", "left_anti").join(out.withColumnRenamed("name", "target"), "target", "left_anti")
    label = connected(programs.sparkSession, inner.select(F.col("source").alias("a"), F.col("target").alias("b")), left.select(F.col("name").alias("id")).distinct())
    group = left.join(label.withColumnRenamed("id", "name"), "name")
    pool = sums(group, "label", "vector").select("label", "total")
    scored = pool.crossJoin(small(domains.select("domain", F.col("vector").alias("dv"))))
    best = scored.groupBy("label").agg(F.min_by("domain", F.struct(-F.round(dot(F.col("total"), F.col("dv")), 9), F.col("domain"))).alias("domain"))
    placed = group.select("name", "label").join(best, "label").select("name", "domain")
    votes = edges.join(shared.withColumnRenamed("name", "target"), "target", "left_semi").join(placed.withColumnRenamed("name", "source"), "source").groupBy("target", "domain").agg(F.count("*").alias("n"))
    voted = votes.groupBy(F.col("target").alias("name")).agg(F.min_by("domain", F.struct(-F.col("n"), F.col("domain"))).alias("domain"))
    rest = shared.join(crossing.select("name"), "name", "left_anti").join(voted, "name", "left")
    given = crossing.join(known, "name", "left_semi").select("name", "domain")
    return placed.withColumn("how", F.lit("component")).union(rest.select("name", "domain", F.lit("callers"))).union(given.withColumn("how", F.lit("given")))


#: Components of a vector and classes that the sums of a regression are held for.
MOST_COMPONENTS, MOST_CLASSES = 2048, 10_000


def class_sums(width: int):
    """A row for each class of a task: its rows, their sum, and the sum of their outer products."""

    def run(batches):
        sums: dict[str, list] = {}
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            coded = batch.column("g").dictionary_encode()
            for c, name in enumerate(coded.dictionary.to_pylist()):
                mine = x[coded.indices.to_numpy() == c]
                old = sums.get(name, (0, 0.0, 0.0))
                sums[name] = (old[0] + len(mine), old[1] + mine.sum(axis=0), old[2] + mine.T @ mine)
        if sums:
            yield packed_sums(sums)

    return run


def packed_sums(sums: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()), pa.array([n for n, _, _ in sums.values()], pa.int64()), pa.array([s.tobytes() for _, s, _ in sums.values()], pa.binary()), pa.array([o.tobytes() for _, _, o in sums.values()], pa.binary())],
        names=["g", "n", "total", "outer"],
    )


def added_sums(t: pa.Table) -> pa.Table:
    add = lambda c: sum(np.frombuffer(x) for x in t.column(c).to_pylist())
    return pa.Table.from_batches([packed_sums({t.column("g")[0].as_py(): (sum(t.column("n").to_pylist()), add("total"), add("outer"))})])


def supervised_leave_one_out(vectors: DataFrame, key: str = "vec_id", group: str = "label", vector: str = "embedding", penalty: float = 1e-3) -> DataFrame:
    """(key, group, predicted): each row's class by a ridge regression on class indicators that is fitted without it.

    One pass sums the outer products; what a row's own fit lacks is a change of rank one, so every row is predicted from
    the whole's inverse by Sherman and Morrison's formula and no row meets another. The penalty is a share of the
    scatter's mean diagonal. Ties go to the first class by name. Rows without a key, a class or a finite vector of the first row's
    length take no part. With one row there is no prediction. The sums, bounded by MOST_COMPONENTS and MOST_CLASSES, are what tasks get.
    """
    rows = vectors.filter(F.col(key).isNotNull() & F.col(group).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(group).cast("string").alias("g"), F.col(vector).cast("array<double>").alias("v"))
    first = rows.filter("size(v) > 0").orderBy("id").select(F.size("v").alias("n")).first()
    schema = "id long, g string, predicted string"
    if first is None:
        return rows.limit(0).select(F.col("id").alias(key), F.col("g").alias(group), F.lit(None).cast("string").alias("predicted"))
    width = first.n
    rows = rows.filter((F.size("v") == width) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)))
    if width > MOST_COMPONENTS or rows.select("g").distinct().limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_COMPONENTS} components or {MOST_CLASSES} classes")
    kind = "g string, n long, total binary, outer binary"
    found = rows.mapInArrow(class_sums(width), kind).groupBy("g").applyInArrow(added_sums, kind)
    total = found.select("g", "n", "total").orderBy("g").collect()  # a row a class
    whole = found.select(F.lit("all").alias("g"), "n", "total", "outer").groupBy("g").applyInArrow(added_sums, kind).first()
    names, sizes = np.array([r.g for r in total], object), np.array([r.n for r in total], float)
    n, mean = whole.n, np.frombuffer(whole.total) / whole.n
    scatter = np.frombuffer(whole.outer).reshape(width, width) - n * np.outer(mean, mean)
    inverse = np.linalg.inv(scatter + penalty * max(float(np.trace(scatter)) / width, 1e-12) * np.eye(width))
    apart = np.stack([np.frombuffer(r.total) - r.n * mean for r in total])

    def run(batches):
        for batch in batches:
            z = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - mean
            own = names[None] == np.array(batch.column("g").to_pylist(), object)[:, None]
            left = sizes[None] - own
            u = z @ inverse
            h = np.einsum("ij,ij->i", u, z)[:, None]
            a = n / (n - 1) if n > 1 else 1.0
            lift = a / np.maximum(1 - a * h, 1e-12)
            score = left / max(n - 1, 1) + lift * (u @ apart.T - own * h + left * h / max(n - 1, 1))
            score[left == 0] = -np.inf  # a class of this row alone is not there without it
            best = [names[i] if n > 1 else None for i in np.round(score, 12).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("g"), pa.array(best, pa.string())], names=["id", "g", "predicted"])

    return rows.mapInArrow(run, schema).select(F.col("id").alias(key), F.col("g").alias(group), "predicted")


#: Pivots at most, what a distance may be off by, and how many pairs of blocks of all rows are multiplied in the time of one of a cell.
PIVOTS, SLACK, GAIN = 256, 1e-6, 40


def distances(batch: pa.RecordBatch, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The batch's vectors, and how far each is from each pivot."""
    x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, pivots.shape[1])
    return x, np.sqrt(((x[:, None, :] - pivots[None]) ** 2).sum(axis=2))


def nearest_pivot(pivots: np.ndarray):
    """Rows with the cell of their nearest pivot, their distance from it and their norm."""

    def run(batches):
        for whole in batches:
            for first in range(0, len(whole), BLOCK):
                batch = whole.slice(first, BLOCK)
                x, away = distances(batch, pivots)
                cell = away.argmin(axis=1)
                more = [pa.array(cell, pa.int32()), pa.array(away[np.arange(len(batch)), cell]), pa.array(np.sqrt((x**2).sum(axis=1)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["id", "label", "vector", "cell", "away", "norm"])

    return run


class Cells:
    """Rows dealt to the cells of pivots, for exact searches by the triangle inequality.

    A row belongs to its nearest pivot. A row and a cell can only hold a pair within distance r if the row is no farther than r plus
    the cell's radius from its pivot, and no farther than r beyond the plane between both pivots. Pivots are bounded in number
    and are all that is sent to tasks, with a radius of each.
    """

    def __init__(self, vectors: DataFrame, key: str = "vec_id", group: str = "label", vector: str = "embedding"):
        rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(group).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
        n = rows.count()
        chosen = rows.filter("size(vector) > 0").orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, 2 * math.isqrt(n)))).collect()  # at most PIVOTS rows
        width = len(chosen[0].vector) if chosen else 0
        sound = (F.size("vector") == width) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)) if width else F.lit(False)
        #: Whether every row is a finite vector of one length; else nothing can be pruned.
        self.sound = bool(width) and rows.filter(~F.coalesce(sound, F.lit(False))).isEmpty()
        if not self.sound:
            return
        self.pivots = np.unique(np.array([r.vector for r in chosen]), axis=0)
        self.rows = stored(rows.mapInArrow(nearest_pivot(self.pivots), "id long, label string, vector array<double>, cell int, away double, norm double"))
        sizes = {r.cell: r for r in self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm").alias("norm")).collect()}  # at most PIVOTS rows
        each = lambda f, none: np.array([getattr(sizes[c], f) if c in sizes else none for c in range(len(self.pivots))])
        self.size, self.radius, self.norm = each("n", 0), each("radius", 0.0), each("norm", 0.0)

    def visitors(self, rows: DataFrame, later: bool) -> DataFrame:
        """`rows` (with `least`, the smallest product that still matters) once for each other cell that can hold such a product, as (to, ..); with `later` for cells of larger numbers alone."""

        def run(batches):
            for batch, may in reached(batches):
                at, to = np.nonzero(may)
                out = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(out.column(c) for c in ("id", "label", "vector"))], names=["to", "id", "label", "vector"])

        reached = self.reach(later)
        return self.asking(rows).mapInArrow(run, "to int, id long, label string, vector array<double>")

    def asking(self, rows: DataFrame) -> DataFrame:
        return rows.select("id", "label", "vector", "cell", "norm", F.col("least").cast("double").alias("least"))

    def reach(self, later: bool):
        """Batches of rows with the cells that each may hold a pair with."""
        pivots, radius, norms, held = self.pivots, self.radius, self.norm, self.size > 0
        between = np.sqrt(((pivots[:, None, :] - pivots[None]) ** 2).sum(axis=2))

        def run(batches):
            for whole in batches:
                for first in range(0, len(whole), BLOCK):
                    batch = whole.slice(first, BLOCK)
                    _, away = distances(batch, pivots)
                    own, norm, least = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "norm", "least"))
                    # x.y >= least bounds the distance by norms
                    r = np.sqrt(np.maximum(norm[:, None] ** 2 + norms[None] ** 2 - 2 * least[:, None], 0.0)) + SLACK
                    own_away = away[np.arange(len(batch)), own]
                    gap = np.maximum(between[own], 1e-300)
                    may = (away <= r + radius[None]) & ((away**2 - own_away[:, None] ** 2) / (2 * gap) <= r) & held[None]
                    may &= np.arange(len(pivots))[None] > own[:, None] if later else np.arange(len(pivots))[None] != own[:, None]
                    yield batch, may

        return run

    def pays(self, rows: DataFrame, later: bool) -> bool:
        """Whether the pairs that `rows` (with `least`) make by cells are so few that all pairs, multiplied as matrices, would take longer."""
        size, every, reached = self.size.astype(float), float(self.size.sum()) ** 2 / 2, self.reach(later)
        if GAIN * float((size**2).sum()) / 2 > every:
            return False

        def run(batches):
            pairs = sum((float(may.sum(axis=0) @ size) for _, may in reached(batches)), 0.0)  # a split of a file may hold no rows
            yield pa.RecordBatch.from_arrays([pa.array([pairs])], names=["pairs"])

        came = self.asking(rows).mapInArrow(run, "pairs double").agg(F.sum("pairs")).first()[0] or 0.0
        return GAIN * (came + float((size**2).sum()) / 2) <= every

    def tiles(self, work: Callable[[Tile], pa.Table], schema: str, visitors: DataFrame | None = None, inner: bool = True, visitors_ask: bool = False, block: int = BLOCK) -> DataFrame:
        """`work` on tiles of each cell: blocks of its own rows against each other (`inner`), and against its visitors' blocks."""
        own = self.rows.select(F.col("cell").alias("to"), "id", "label", "vector")
        counts = own.groupBy("to").agg(F.ceil(F.count("*") / block).cast("int").alias("b"))
        came = visitors.groupBy("to").agg(F.ceil(F.count("*") / block).cast("int").alias("v")) if visitors is not None else counts.select("to", F.lit(0).alias("v"))
        sizes = F.broadcast(counts.join(came, "to", "left").select("to", "b", F.coalesce("v", F.lit(0)).alias("v")))  # at most PIVOTS rows
        place = lambda n: F.expr(f"cast(pmod(xxhash64(id, vector), {n}) as int)")
        mine = own.join(sizes, "to").withColumn("m", place("b"))
        parts = []
        if inner:
            met = mine.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
            parts.append(met.select("to", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"), F.when(F.col("m") > F.col("o"), 1).otherwise(0).alias("side"), "id", "label", "vector", F.lit(True).alias("asks")))
        if visitors is not None:
            hosts = mine.filter("v > 0").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("v") - 1)))
            parts.append(hosts.select("to", F.col("m").alias("i"), (F.col("b") + F.col("o")).alias("j"), F.lit(0).alias("side"), "id", "label", "vector", F.lit(not visitors_ask).alias("asks")))
            guests = visitors.join(sizes, "to").withColumn("m", place("v")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
            parts.append(guests.select("to", F.col("o").alias("i"), (F.col("b") + F.col("m")).alias("j"), F.lit(1).alias("side"), "id", "label", "vector", F.lit(True).alias("asks")))
        sides = parts[0]
        for p in parts[1:]:
            sides = sides.union(p)
        return sides.groupBy("to", "i", "j").applyInArrow(lambda t: work(Tile(t)), schema)


def linked(vectors: DataFrame, least: float, **of) -> DataFrame:
    """(a, b) as `links` gives it, by cells where that pays: only rows within reach of the threshold of each other meet."""
    cells = Cells(vectors, **of)
    if not cells.sound:
        return links(vectors, least, **of)
    asking = cells.rows.withColumn("least", F.lit(least))
    if not cells.pays(asking, later=True):
        return links(vectors, least, **of)
    guests = cells.visitors(asking, later=True)
    return cells.tiles(link_work(least), "a long, b long", visitors=stored(guests))


def nearest_by_cells(vectors: DataFrame, k: int, **of) -> DataFrame:
    """(q, group_q, b, sim, r) as `nearest` gives it for all rows, by cells where that pays: a row's k best in its own cell say which other cells can hold a better one. Its product with its pivot tells beforehand how many those are."""
    cells = Cells(vectors, **of)
    pivot = F.lit(0.0) if not cells.sound else F.get(F.array(*(F.lit(float(p @ p)) for p in cells.pivots)), F.col("cell"))
    if not cells.sound or not cells.pays(cells.rows.withColumn("least", (F.col("norm") ** 2 + pivot - F.col("away") ** 2) / 2), later=False):
        return nearest(vectors, k, **of)
    schema, best = "q long, group_q string, b long, sim double", Window.partitionBy("q").orderBy(F.desc("sim"), "b")
    ranked = lambda found: found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k)
    home = stored(ranked(cells.tiles(best_work(k, False), schema)).drop("r"))
    floor = home.groupBy(F.col("q").alias("id")).agg(F.when(F.count("*") >= k, F.min("sim")).alias("least"))
    asking = cells.rows.join(floor, "id", "left").withColumn("least", F.coalesce(F.col("least") - SLACK, F.lit(-1e300)))
    guests = stored(cells.visitors(asking, later=False))
    return ranked(home.unionByName(cells.tiles(best_work(k, False), schema, visitors=guests, inner=False, visitors_ask=True)).distinct())
