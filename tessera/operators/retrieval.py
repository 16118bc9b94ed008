"""Lexical retrieval over postings, and fusion of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TERM, terms
from ..sources.tables import small


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.4, b: float = 0.75) -> DataFrame:
    """(query, doc, score): docs (doc, text), queries (query, text); a term that a query repeats counts each time.

    Only postings of terms that some query has are kept: the queries' terms prune them before any shuffle of counts.
    """
    asked = queries.select("query", F.explode(terms(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    # lengths by counting matches alone; terms are made lower-case after they are rows
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg(F.regexp_count("text", F.lit(TERM))).alias("mean_length"))
    words = docs.select("doc", F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("ts"))
    wanted = asked.select("term").distinct()
    postings = words.select("doc", F.size("ts").alias("length"), F.explode("ts").alias("term")).withColumn("term", F.lower("term")).join(small(wanted), "term", "left_semi").groupBy("doc", "length", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    scored = postings.join(df, "term").crossJoin(F.broadcast(stats)).select("doc", "term", part.alias("part"))  # one row
    return scored.join(small(asked), "term").groupBy("query", "doc").agg(F.sum(F.col("part") * F.col("times")).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best docs of each query with ranks from 1; ties to the smaller doc, scores compared at 9 decimals."""
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(arms: list[DataFrame], k: int = 8, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings (query, doc, rank): the k best by the sum of 1 / (constant + rank)."""
    rows = arms[0].select("query", "doc", "rank")
    for arm in arms[1:]:
        rows = rows.union(arm.select("query", "doc", "rank"))
    return top(rows.groupBy("query", "doc").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score")), k)
