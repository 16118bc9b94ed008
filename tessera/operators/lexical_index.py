"""Ranked retrieval from a stored index of postings.

The index is three Parquet tables under one folder:

* `postings` (bucket, term, block, n, most, p): for each term and block of documents, the documents that hold the term and
  what each is worth before the term's weight (p: doc, part), and the most any is worth. Partitioned by a hash of
  the term and sorted by term and block within files.
* `terms` (term, df, most) and `corpus` (n_docs, mean_length): one row a term, one row in all.

A block is BLOCK_DOCS documents of about the same length, so that a block's most is close to what its documents have.

A search is MaxScore with blocks' bounds, as joins. A query's rarest terms give a score that its k-th document reaches at
least (`floor`). Terms whose caps together stay below the floor cannot lift a document to it alone, so only documents that hold one
of the other, essential terms are candidates. A candidate stays while its score by the essential terms and the most that the
others are worth, first anywhere and then in its block, reach the floor; only for those that stay are the other terms'
postings opened, and only in their blocks. Nothing is approximate: whoever goes cannot be among the k best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TERM, terms
from ..sources.shared import fingerprint, stored, written_once
from .retrieval import top

#: Rows of the queries' terms that become a local table; more are a table in the shared folder.
HELD_ROWS = 100_000
#: Documents of a block, and hash buckets of terms that are folders of their own.
BLOCK_DOCS, BUCKETS = 128, 16
#: A query's rarest terms are taken for its first floor until they have so many postings for each of the k.
FIRST = 16
#: What scores of two orders of addition may differ by.
SLACK = 1e-6


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def held(df: DataFrame) -> DataFrame:
    """`df` computed once: up to HELD_ROWS rows as a local table, whose size the optimizer knows, more as a table in the shared folder."""
    rows = df.limit(HELD_ROWS + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= HELD_ROWS else stored(df)


def floors(scores: DataFrame, k: int) -> DataFrame:
    """(query, floor): just below the k-th largest score of each query that has so many."""
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return scores.withColumn("r", nth).filter(F.col("r") <= k).filter(F.col("r") == k).select("query", (F.col("score") - SLACK).alias("floor"))


def postings_of(block: int, doc: pa.Array, length: np.ndarray, ts: pa.ListArray, mean: float, k1: float, b: float) -> pa.RecordBatch | None:
    """(term, block, n, most, p) of a block's documents; documents that repeat a doc count as one."""
    ids, term = doc.dictionary_encode(), ts.flatten().dictionary_encode()
    if not len(term):
        return None
    n = len(ids.dictionary)
    rank = np.empty(n, np.int64)
    rank[pa.compute.sort_indices(ids.dictionary).to_numpy()] = np.arange(n)
    owner = np.repeat(ids.indices.to_numpy(), np.diff(ts.offsets.to_numpy()))
    found, tf = np.unique(term.indices.to_numpy().astype(np.int64) * n + rank[owner], return_counts=True)
    code, place = np.divmod(found, n)
    at = np.argsort(rank)
    size = np.zeros(n, np.int64)
    size[rank[ids.indices.to_numpy()]] = length
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[place] / mean))
    first = np.flatnonzero(np.diff(code, prepend=-1))
    p = pa.StructArray.from_arrays([ids.dictionary.take(pa.array(at[place])), pa.array(part)], names=["doc", "part"])
    ends = pa.array([*first, len(code)], pa.int32())
    columns = [term.dictionary.take(pa.array(code[first])), pa.array(np.full(len(first), block)), pa.array(np.diff([*first, len(code)])), pa.array(np.maximum.reduceat(part, first)), pa.ListArray.from_arrays(ends, p)]
    return pa.RecordBatch.from_arrays(columns, names=["term", "block", "n", "most", "p"])


def block_postings(mean: float, k1: float, b: float):
    """Postings of blocks whose rows (block, doc, length, ts) follow each other; a block's rows are all that is held beside a batch."""

    def run(batches):
        held: list = []

        def done():
            t = pa.Table.from_batches(held).combine_chunks()
            one = lambda c: pa.concat_arrays(t.column(c).chunks)
            return postings_of(t.column("block")[0].as_py(), one("doc"), one("length").to_numpy(), one("ts"), mean, k1, b)

        for batch in batches:
            number = batch.column("block").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)] if len(number) else []
            for start, stop in zip(starts, starts[1:]):
                if held and held[0].column("block")[0].as_py() != number[start]:
                    out = done()
                    if out is not None:
                        yield out
                    held = []
                held.append(batch.slice(start, stop - start))
        if held:
            out = done()
            if out is not None:
                yield out

    return run


def write_index(docs: DataFrame, path: str, k1: float = 1.4, b: float = 0.75) -> None:
    """Write the index of documents (doc, text) under `path`. Null texts have no terms and count as documents of length 0; rows that repeat a doc may become one document, so docs should be unique."""
    spark = docs.sparkSession
    # mean length as SQL's average has it: a null text has no length
    docs.agg(F.count("*").alias("n_docs"), F.avg(F.regexp_count("text", F.lit(TERM))).alias("mean_length")).coalesce(1).write.parquet(f"{path}/corpus")
    corpus = spark.read.parquet(f"{path}/corpus").first()
    # texts are put in order, which are smaller than their terms
    measured = docs.select("doc", "text", F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).alias("length"))
    ordered = measured.repartitionByRange("length", "doc").sortWithinPartitions("length", "doc")
    place = F.monotonically_increasing_id()
    # the partition's number above, the row's place in it below
    blocks = ordered.select((F.shiftright(place, 33) * (1 << 28) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / BLOCK_DOCS)).cast("long").alias("block"), "doc", "length", F.coalesce(terms(F.col("text")), F.array().cast("array<string>")).alias("ts"))
    # a block lies in one partition in order, so its postings are made there; they are shuffled once, by term
    rows = blocks.mapInArrow(block_postings(corpus.mean_length or 1.0, k1, b), f"term string, block long, n long, most double, p array<struct<doc:{docs.schema['doc'].dataType.simpleString()},part:double>>")
    rows = rows.select(_bucket("term").alias("bucket"), "term", "block", "n", "most", "p")
    rows.repartitionByRange("bucket", "term", "block").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most")).sort("term").write.parquet(f"{path}/terms")


class Index:
    """A stored index."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.postings, self.terms = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms"))
        self.n_docs, self.mean_length = spark.read.parquet(f"{path}/corpus").first()

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query, term, df, weight, cap) of queries (query, text): the weight is the term's inverse document frequency times its occurrences in the query, the cap the most it can add to a score."""
        own = queries.select("query", F.explode(terms(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
        idf = F.ln(1 + (self.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        rows = own.join(self.terms, "term").withColumn("weight", idf * F.col("times"))
        return rows.select("query", "term", "df", "weight", (F.col("weight") * F.col("most")).alias("cap"))

    def of(self, asked: DataFrame, *columns: str) -> DataFrame:
        """Columns of the postings of the asked terms' buckets: folders of other buckets are not listed, columns not asked for not read."""
        wanted = [r.bucket for r in asked.select(_bucket("term").alias("bucket")).distinct().collect()]  # at most BUCKETS
        return self.postings.filter(F.col("bucket").isin(wanted)).select("term", "block", *columns)

    def scores(self, asked: DataFrame) -> DataFrame:
        """(query, block, doc, score) by the asked terms alone, of all documents that hold one."""
        opened = self.of(asked, "p").join(asked.select("query", "term", "weight"), "term")
        each = opened.select("query", "block", "weight", F.inline("p"))
        return each.groupBy("query", "block", "doc").agg(F.sum(F.col("weight") * F.col("part")).alias("score"))

    def essential(self, asked: DataFrame, k: int) -> DataFrame:
        """The asked terms with `floor`, a score that the query's k-th document reaches, and whether each is essential: those are all but the ones of the smallest caps whose sum stays below the floor."""
        rarest = Window.partitionBy("query").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        first = asked.withColumn("before", F.coalesce(F.sum("df").over(rarest), F.lit(0))).filter(F.col("before") < FIRST * k)
        floor = held(floors(self.scores(first), k))
        rising = Window.partitionBy("query").orderBy("cap", "term").rowsBetween(Window.unboundedPreceding, 0)
        marked = asked.join(floor, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
        return marked.withColumn("essential", F.sum("cap").over(rising) >= F.col("floor"))

    def candidates(self, marked: DataFrame, k: int) -> DataFrame:
        """(query, block, doc, score): documents that may be among the k best, with their scores by the essential terms. Of the other terms it reads what their blocks are worth at most, no postings."""
        found = stored(self.scores(marked.filter("essential")))
        others = marked.filter("not essential")
        rest = marked.groupBy("query").agg(F.coalesce(F.sum(F.when(~F.col("essential"), F.col("cap"))), F.lit(0.0)).alias("rest"))
        # the k-th best by the essential terms alone is a floor that is no lower than the first
        bound = held(rest.join(floors(found, k), "query", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))))
        alive = found.join(bound, "query").filter(F.col("score") + F.col("rest") >= F.col("floor"))
        here = self.of(others, "most").join(others.select("query", "term", "weight"), "term").groupBy("query", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("here"))
        alive = alive.join(here, ["query", "block"], "left").filter(F.col("score") + F.coalesce("here", F.lit(0.0)) >= F.col("floor"))
        return alive.select("query", "block", "doc", "score")

    def opened(self, marked: DataFrame, candidates: DataFrame) -> DataFrame:
        """(query, weight, wanted, p): the postings of other terms in blocks that hold candidates, and the candidates."""
        wanted = candidates.groupBy("query", "block").agg(F.collect_list("doc").alias("wanted"))  # at most a block's documents
        others = marked.filter("not essential").select("query", "term", "weight")
        return self.of(others, "p").join(others, "term").join(wanted, ["query", "block"]).drop("block")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, doc, score, rank): the k documents of the highest BM25 score with each query (query, text), compared at 9 decimals, ties to the smaller doc.

        Only documents that share a term are found. A term that a query repeats counts each time; queries of null or unknown text find nothing.
        """
        marked = held(self.essential(held(self.asked(queries)), k))
        alive = stored(self.candidates(marked, k))
        added = self.opened(marked, alive).select("query", "weight", "wanted", F.inline("p")).filter(F.array_contains("wanted", F.col("doc")))
        added = added.select("query", "doc", (F.col("weight") * F.col("part")).alias("score"))
        whole = alive.select("query", "doc", "score").unionByName(added).groupBy("query", "doc").agg(F.sum("score").alias("score"))
        return top(whole, k)


#: The layout of the tables, a part of a stored index's name.
LAYOUT = 4


def index_of(docs: DataFrame) -> Index:
    """The stored index of documents (doc, text) read from files: written the first time, read again until the files or the layout change."""
    spark = docs.sparkSession
    return Index(spark, written_once(spark, f"lexical-index-{LAYOUT}-{BLOCK_DOCS}-{BUCKETS}-{fingerprint(docs)}", lambda path: write_index(docs, path)))
