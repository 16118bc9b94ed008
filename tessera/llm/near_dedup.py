"""Near duplicates by b-bit MinHash.

A document's set is its distinct word shingles. Its minima under 128 hash functions give (a) band
keys, which propose candidates, and (b) a signature of the low 4 bits of each minimum, packed into
eight 64-bit integers; counting equal lanes by bits and correcting for chance collisions estimates
the similarity of a candidate pair, and pairs safely below the threshold go no further. The rest
are confirmed on the full sets.

No group is ever expanded into all its pairs. Equal sets are collapsed first. Within a bucket every
document is compared with two leaders; what the confirmed links join is one component. Only members
of a bucket that still lie in different components are compared further, by signatures of 768 lanes:
in small buckets as pairs, in large ones in square tiles. Tiles first propose, in rounds, each
member's best partner in another component, which joins nearly all that belongs together; then
every pair across the components left that the estimate cannot exclude, each in its first bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Scratch, components
from .words import distinct, mix, word_blocks

LANES, BITS = 128, 4
#: Lanes of the signatures by which members of larger buckets are compared.
LONG_LANES = 768
#: Rounds of best partners before all pairs across components; they save work, results do not depend on them.
PARTNER_ROUNDS = 2
#: Buckets of more members are compared in tiles, not as pairs.
SMALL_BUCKET = 48
TILE = 4096
#: Documents that one task confirms against one leader.
LEADER_LOAD = 256

_seeds = np.random.default_rng(20240229).integers(1, 1 << 32, (LONG_LANES, 2), dtype=np.uint32).T
XORS, FACTORS = _seeds[0], _seeds[1] | np.uint32(1)
NIBBLES = 0x1111111111111111


def minima(hashes: np.ndarray, bounds: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """For each non-empty segment the minima under all hash functions (rows: functions)."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    starts = bounds[:-1]
    out = np.empty((lanes, len(starts)), np.uint32)
    kept = np.empty_like(low)
    for k in range(lanes):
        np.bitwise_xor(low, XORS[k], out=kept)
        np.multiply(kept, FACTORS[k], out=kept)
        out[k] = np.minimum.reduceat(kept, starts)
    return out


def pack(least: np.ndarray) -> np.ndarray:
    """The low bits of mixed minima, 16 lanes to an integer: one row for each document."""
    lanes = (mix(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(len(least) // 16, 16, -1)
    shifts = (np.arange(16, dtype=np.uint64) * np.uint64(BITS))[None, :, None]
    return np.bitwise_or.reduce(lanes << shifts, axis=1).T


def equal_lanes_needed(similarity: float, lanes: int = LANES, spread: float = 5.0) -> int:
    """Equal lanes below which a pair of this similarity falls only beyond `spread` standard deviations."""
    chance = 2.0**-BITS
    p = similarity + (1 - similarity) * chance
    return int(np.floor(lanes * (p - spread * np.sqrt(p * (1 - p) / lanes))))


def estimate(equal: float, lanes: int = LANES) -> float:
    """Similarity for a number of equal lanes, corrected for lanes that are equal by chance."""
    chance = 2.0**-BITS
    return (equal / lanes - chance) / (1 - chance)


SIGNATURE = "id long, n_shingles long, h1 long, h2 long, buckets array<long>, signature array<long>"


def signer(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, last, block in word_blocks(batch.column(1)):
                hashes, bounds = distinct(*block.shingles(words))
                sizes = np.diff(bounds)
                some = np.flatnonzero(sizes)
                h1, h2 = np.zeros((2, len(sizes)), np.uint64)
                buckets = signature = np.zeros((0, 0), np.uint64)
                if len(some):
                    starts = bounds[:-1][some]
                    h1[some] = np.add.reduceat(mix(hashes), starts)
                    h2[some] = np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts)
                    least = minima(hashes, np.append(starts, bounds[-1]))
                    signature = pack(least)
                    keys = np.empty((len(some), bands), np.uint64)
                    for band in range(bands):
                        key = np.full(len(some), band + 1, np.uint64)
                        for row in least[band * rows : (band + 1) * rows]:
                            key = mix(key * np.uint64(0x9FB21C651E98DF25) + row)
                        keys[:, band] = key
                    buckets = keys
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, last - first).cast(pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        _lists(buckets, sizes, bands),
                        _lists(signature, sizes, LANES // 16),
                    ],
                    names=["id", "n_shingles", "h1", "h2", "buckets", "signature"],
                )

    return run


def long_signer(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, block in word_blocks(batch.column(1)):
                hashes, bounds = distinct(*block.shingles(words))
                some = np.flatnonzero(np.diff(bounds))  # an id may have a row without words besides
                if not len(some):
                    continue
                signature = pack(minima(hashes, np.append(bounds[:-1][some], bounds[-1]), LONG_LANES))
                ids = batch.column(0).slice(first, last - first).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, _lists(signature, np.diff(bounds)[some], LONG_LANES // 16)], names=["id", "signature"])

    return run


def _lists(rows: np.ndarray, sizes: np.ndarray, width: int) -> pa.ListArray:
    """Rows for the documents that have shingles, empty lists for the others."""
    offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, width, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64)))


def _unequal(a: str, b: str, lanes: int) -> str:
    """SQL for the number of unequal lanes of two signature columns."""
    parts = []
    for i in range(lanes // 16):
        x = f"({a}[{i}] ^ {b}[{i}])"
        y = f"({x} | shiftrightunsigned({x}, 1))"
        parts.append(f"bit_count(({y} | shiftrightunsigned({y}, 2)) & {NIBBLES}L)")
    return " + ".join(parts)


def _alike(pairs: DataFrame, signatures: DataFrame, needed: int, lanes: int = LANES) -> DataFrame:
    """The pairs (a, b) with at least `needed` equal lanes."""
    sa, sb = signatures.select(F.col("id").alias("a"), F.col("signature").alias("sa")), signatures.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(sa.hint("merge"), "a").join(sb.hint("merge"), "b").filter(f"{_unequal('sa', 'sb', lanes)} <= {lanes - needed}").select("a", "b").distinct()


def _tile(needed: int, best_only: bool):
    """Compares the members of a tile's two sides that have different labels, by long signatures.

    Emits each member's best partner, or all pairs that may be linked, except in a later bucket than
    the first that both share.
    """

    def run(rows: pa.Table) -> pa.Table:
        ids, labels, side, band = (rows.column(c).to_numpy() for c in ("id", "label", "side", "band"))
        signatures, keys = (rows.column(c).combine_chunks().flatten().to_numpy().reshape(len(ids), -1) for c in ("signature", "buckets"))
        signatures = signatures.view(np.uint64)
        out_a, out_b = [], []
        square = not (side == 1).any()
        left = np.flatnonzero(side == 0)
        right = left if square else np.flatnonzero(side == 1)
        other, other_labels, other_ids = signatures[right], labels[right], ids[right]
        earlier = keys[:, : int(band[0])] if len(band) else keys
        for k, i in enumerate(left.tolist()):
            at = np.flatnonzero(other_labels != labels[i])
            if square and not best_only:
                at = at[at > k]
            if not len(at):
                continue
            x = other[at] ^ signatures[i]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            x &= np.uint64(NIBBLES)
            unequal = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
            if best_only:
                hit = at[[unequal.argmin()]] if unequal.min() <= LONG_LANES - needed else at[:0]
            else:
                hit = at[unequal <= LONG_LANES - needed]
                hit = hit[~(earlier[right[hit]] == earlier[i]).any(axis=1)]
            out_a.append(np.minimum(ids[i], other_ids[hit]))
            out_b.append(np.maximum(ids[i], other_ids[hit]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _confirm(words: int, least: tuple[int, int]):
    """Rows sorted by (a, salt, kind): a leader's texts (kind 0), then texts of those to confirm against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for batch in batches:
            leaders, salts, kinds, others = (batch.column(i).to_pylist() for i in range(4))
            out_a, out_b = [], []
            for first, last, block in word_blocks(batch.column(4)):
                hashes, bounds = distinct(*block.shingles(words))
                for i in range(first, last):
                    own = hashes[bounds[i - first] : bounds[i - first + 1]]
                    if (leaders[i], salts[i]) != now:
                        now, sets = (leaders[i], salts[i]), []
                    if kinds[i] == 0:
                        sets.append(own.copy())
                        continue
                    for one in sets:
                        small, large = sorted((len(own), len(one)))
                        if small * least[1] < least[0] * large:
                            continue
                        merged = np.concatenate([one, own])
                        merged.sort(kind="stable")
                        union = 1 + int(np.count_nonzero(merged[1:] != merged[:-1]))
                        if (small + large - union) * least[1] >= least[0] * union:
                            out_a.append(leaders[i])
                            out_b.append(others[i])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, least: tuple[int, int], scratch: Scratch) -> DataFrame:
    """The pairs whose full sets are similar enough; a leader with many is dealt out by salts."""
    loads = scratch.table(pairs.groupBy("a").agg(F.ceil(F.count("*") / LEADER_LOAD).cast("int").alias("salts")), "loads")
    salted = pairs.join(loads.hint("merge"), "a").withColumn("salt", F.expr("cast(pmod(xxhash64(b), salts) as int)"))
    others = salted.join(texts.withColumnRenamed("id", "b").hint("merge"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "text")
    leaders = (
        loads.join(texts.withColumnRenamed("id", "a").hint("merge"), "a")
        .select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    )
    dealt = leaders.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")
    return dealt.mapInArrow(_confirm(words, least), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: tuple[int, int] = (4, 5), bands: int = 25, rows: int = 5) -> DataFrame:
    """Classes of documents whose shingle sets have a similarity of at least least[0] / least[1].

    Returns a row for each row of `docs`: the id column, n_shingles (size of the set), component_id
    (smallest id reachable over links, the row's own included) and kept (the row is its component's
    smallest id). Words are separated by ASCII white space, A-Z lower-cased. A text of fewer words
    than a shingle is one shingle; null, empty and blank texts have none and are linked with nothing.
    Rows that share an id are one document, linked wherever one of them is. A row without an id is
    in no component (component_id null) and kept. Other columns are ignored.

    bands * rows must be at most 128. With the defaults a pair at 0.85 is missed by all bands with
    probability 4e-7, one at 0.8 with 5e-5; the signature estimate cuts off 5 standard deviations
    below the threshold. A similarity of 0.8 or less needs more bands of fewer rows for the same risk.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    needed = equal_lanes_needed(least[0] / least[1])
    # Every step is a small plan from tables to a table. Joins are sort-merge joins of two tables, so nothing is built on
    # the driver, and a bucket, set or leader that holds a great part of the rows is split by adaptive execution.
    signed = scratch.table(docs.mapInArrow(signer(words, bands, rows), SIGNATURE), "signatures")
    sets = signed.filter("id is not null and n_shingles > 0")
    classes = scratch.table(sets.groupBy("h1", "h2", "n_shingles").agg(F.min("id").alias("rep")), "classes")
    members = scratch.table(sets.select("id", "h1", "h2", "n_shingles").join(classes.hint("merge"), ["h1", "h2", "n_shingles"]).select("id", "rep").distinct(), "members")
    twice = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z")
    chained = scratch.table(members.join(twice.hint("merge"), "id").select("a", F.col("rep").alias("b")), "chained")
    leads = members.filter("id = rep").select("id").distinct()
    nodes = scratch.table(sets.select("id", "buckets", "signature").join(leads.hint("merge"), "id", "left_semi"), "nodes")

    rows_of = nodes.select("id", F.posexplode("buckets").alias("band", "bucket"))
    heads = scratch.table(rows_of.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("lead"), F.min_by("id", F.expr("xxhash64(id)")).alias("lead2")).filter("n > 1"), "heads")
    shared = scratch.table(rows_of.join(heads.hint("merge"), "bucket"), "buckets")
    signatures = nodes.select("id", "signature")
    stars = shared.select(F.explode(F.array("lead", "lead2")).alias("lead"), "id").filter("lead <> id").select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct()
    tested = scratch.table(_alike(stars, signatures, needed), "stars")

    beyond = scratch.table(shared.filter("n > 2 and id <> lead and id <> lead2").select("bucket", "band", "id", "n"), "beyond")
    scratch.drop(shared, heads, classes)
    wanted = tested.select(F.col("a").alias("id")).union(tested.select("b")).union(beyond.select("id")).distinct()
    texts = scratch.table(docs.join(wanted.hint("merge"), "id", "left_semi"), "texts")
    labels = components(scratch.table(_confirmed(tested, texts, words, least, scratch).union(chained), "links"), scratch)

    needed = equal_lanes_needed(least[0] / least[1], LONG_LANES)
    if not beyond.isEmpty():
        long_texts = texts.join(beyond.select("id").distinct().hint("merge"), "id", "left_semi").select("id", "text")
        long = long_texts.mapInArrow(long_signer(words), "id long, signature array<long>").join(nodes.select("id", "buckets").hint("merge"), "id")
        long = scratch.table(long, "long-signatures")

    def mixed(some: DataFrame) -> DataFrame:
        """Rows of the buckets whose members lie in several components, with their labels."""
        labelled = scratch.table(some.join(labels.hint("merge"), "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")
        several = scratch.table(labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket"), "mixed")
        return labelled.join(several.hint("merge"), "bucket", "left_semi")

    def tiles(best_only: bool) -> DataFrame:
        large = mixed(beyond.filter(F.col("n") > SMALL_BUCKET)).withColumn("cuts", F.ceil(F.col("n") / TILE).cast("int"))
        cut = large.withColumn("cut", F.expr("cast(pmod(xxhash64(id), cuts) as int)")).withColumn("with", F.explode(F.expr("sequence(0, cuts - 1)")))
        sides = cut.select("bucket", "band", F.least("cut", "with").alias("i"), F.greatest("cut", "with").alias("j"), F.when(F.col("cut") > F.col("with"), 1).otherwise(0).alias("side"), "id", "label")
        full = sides.join(long.hint("merge"), "id")
        return full.groupBy("bucket", "i", "j").applyInArrow(_tile(needed, best_only), "a long, b long").distinct()

    def join_up(pairs: DataFrame) -> DataFrame:
        """The components after the links among `pairs`."""
        links = scratch.table(_confirmed(pairs, texts, words, least, scratch), "links")
        la, lb = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        ends = links.join(la.hint("merge"), "a", "left").join(lb.hint("merge"), "b", "left")
        met = ends.select(F.explode(F.expr("array(struct(coalesce(la, a) as a, coalesce(lb, b) as b), struct(a, coalesce(la, a) as b), struct(b as a, coalesce(lb, b) as b))")).alias("e")).select("e.a", "e.b")
        return components(met.union(labels.select("id", "label")), scratch)

    large = not beyond.filter(F.col("n") > SMALL_BUCKET).isEmpty()
    for _ in range(PARTNER_ROUNDS if large else 0):
        pairs = scratch.table(tiles(best_only=True).join(tested.hint("merge"), ["a", "b"], "left_anti"), "partners")
        if pairs.isEmpty():
            break
        labels = join_up(pairs)
        tested = scratch.table(tested.union(pairs), "tested")
    if not beyond.isEmpty():
        small = scratch.table(mixed(beyond.filter(F.col("n") <= SMALL_BUCKET)).select("bucket", "id", "label"), "small-buckets")
        left, right = small.select("bucket", F.col("id").alias("a"), F.col("label").alias("la")), small.select("bucket", F.col("id").alias("b"), F.col("label").alias("lb"))
        across = left.join(right.hint("merge"), (left.bucket == right.bucket) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))).select("a", "b").distinct()
        near = scratch.table(_alike(across, long, needed, LONG_LANES), "near")
        if large:
            near = near.union(tiles(best_only=False)).distinct()
        rest = scratch.table(near.join(tested.hint("merge"), ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            labels = join_up(rest)
        scratch.drop(long)
    rep = members.groupBy("id").agg(F.min("rep").alias("rep"))
    found = rep.join(labels.withColumnRenamed("id", "rep").hint("merge"), "rep", "left").select("id", F.coalesce("label", "rep").alias("component_id"))
    out = signed.select("id", "n_shingles").join(found.hint("merge"), "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    scratch.drop(texts, beyond, tested, nodes)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: tuple[int, int] = (4, 5), bands: int = 32, rows: int = 4) -> DataFrame:
    """`docs` with one row of each class of near duplicates: the row of the smallest id.

    Of rows that share that id the one of the smallest text stays (of rows equal in both, any one). Rows without words or
    without an id stay.
    """
    found = near_duplicates(docs, id_col, text_col, words, least, bands, rows)
    flags = found.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.bool_or("kept").alias("_kept"), F.count("*").alias("_rows"))
    flags = Scratch(docs.sparkSession, "kept").table(flags, "flags")
    gone = flags.filter("not _kept or _rows > 1").select(id_col)
    single = docs.join(gone.hint("merge"), id_col, "left_anti").select(docs.columns)
    again = flags.filter("_kept and _rows > 1").select(id_col)
    if again.isEmpty():
        return single
    first = Window.partitionBy(id_col).orderBy(F.asc_nulls_first(text_col))
    multiple = docs.join(again.hint("merge"), id_col, "left_semi").withColumn("__tessera_row", F.row_number().over(first)).filter("__tessera_row = 1").select(docs.columns)
    return single.union(multiple)
