from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexical_index, retrieval as ret
from ..operators.graph import cut
from ..operators.vectors import nearest
from ..sources.tables import small, table
from .registry import query

_T = "list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9_-]+'), lambda w: lower(w))"
_BM25 = f"""
WITH d AS (SELECT doc_id AS doc, {_T.format('text')} AS ts FROM documents), s AS (SELECT count(*) AS n, avg(len(ts)) AS m FROM d),
q AS (SELECT query, term, count(*) AS times FROM (SELECT item_id AS query, unnest({_T.format('text')}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(ts) AS len, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
scores AS (SELECT query, doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * len / m)) * times) AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY query, doc),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM scores)"""


def _texts(spark, sf_dir):
    """The stored index of all documents, and the benchmark's items as queries."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return lexical_index.index_of(docs), queries


@query(_BM25 + " SELECT query, doc, round(score, 6) AS score, rank::INT AS rank FROM lexical WHERE rank <= 8")
def bm25_topk(spark, sf_dir):
    index, queries = _texts(spark, sf_dir)
    return index.search(queries, 8).withColumn("score", F.round("score", 6)).select("query", "doc", "score", "rank")


def linked_by(places, best, k: int):
    """(query, doc, score): documents (doc, source, lang) of the sources and languages of `best` (query, source, lang, n). All of one are linked alike, so no more than its first k can be among a query's k."""
    few = ret.top(places.filter("source is not null and lang is not null").select(F.struct("source", "lang").alias("query"), "doc", F.lit(0.0).alias("score")), k)
    return few.select("query.source", "query.lang", "doc").join(small(best), ["source", "lang"]).select("query", "doc", F.col("n").cast("double").alias("score"))


@query(_BM25 + """, near AS (SELECT * FROM (SELECT q.vec_id AS query, e.vec_id AS doc, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank
  FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)) WHERE rank <= 50),
linked AS (SELECT l.query, o.doc_id AS doc, count(*) AS n FROM lexical l JOIN documents d ON d.doc_id = l.doc JOIN documents o ON o.source = d.source AND o.lang = d.lang WHERE l.rank <= 3 GROUP BY ALL),
graph AS (SELECT * FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY n DESC, doc) AS rank FROM linked) WHERE rank <= 50),
fused AS (SELECT query, doc, sum(1.0 / (60 + rank)) AS score FROM (SELECT query, doc, rank FROM lexical WHERE rank <= 50 UNION ALL SELECT * FROM near UNION ALL SELECT * FROM graph) GROUP BY ALL)
SELECT query, doc, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM fused) WHERE rank <= 8""")
def rrf_fused_topk(spark, sf_dir):
    """Three arms fused by reciprocal ranks: terms, vectors (of the same ids), and links (documents of one source and language with the best by terms)."""
    index, queries = _texts(spark, sf_dir)
    lexical = cut(index.search(queries, 50))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"))
    e = table(spark, sf_dir, "embeddings")
    asks = e.join(small(items.distinct()), e.vec_id == F.col("query"), "left").withColumn("asks", F.col("query").isNotNull())
    near = nearest(asks.select("vec_id", "label", "embedding", "asks"), 50, "asks").select(F.col("q").alias("query"), F.col("b").alias("doc"), F.col("r").alias("rank"))
    places = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source", "lang")
    best = lexical.filter("rank <= 3").join(places, "doc").groupBy("query", "source", "lang").agg(F.count("*").alias("n"))
    linked = linked_by(places, cut(best), 50)
    return ret.fuse([lexical, near, ret.top(linked, 50)]).withColumn("score", F.round("score", 6)).select("query", "doc", "score", "rank")
