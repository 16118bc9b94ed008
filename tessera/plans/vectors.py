from __future__ import annotations

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, MinMaxScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import vectors as vec
from ..operators import scoring as sc
from ..operators.graph import connected
from ..sources.tables import spread, table
from .registry import query

_PAIRS = "SELECT a.vec_id AS a, b.vec_id AS b, a.label AS ga, b.label AS gb, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


@query("""
SELECT q, vec_id, r FROM (SELECT q.vec_id AS q, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id)::INT AS r
FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) WHERE r <= 5""")
def cosine_topk(spark, sf_dir):
    """Five nearest among all rows of each row whose id is divisible by 20."""
    return vec.nearest(table(spark, sf_dir, "embeddings"), 5, "vec_id % 20 = 0").select("q", F.col("b").alias("vec_id"), "r")


_LOO = """
WITH p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT label, i, sum(x) AS t, count(*) AS n FROM p GROUP BY label, i),
d AS (SELECT p.vec_id, p.label, s.label AS g, sum(p.x * (CASE WHEN p.label = s.label THEN t - x ELSE t END)) / max(CASE WHEN p.label = s.label THEN n - 1 ELSE n END) AS sim
  FROM p JOIN s USING (i) WHERE p.label <> s.label OR n > 1 GROUP BY p.vec_id, p.label, s.label),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, g) AS r FROM d)
SELECT vec_id, label, arg_min(g, r) AS predicted, min(r) FILTER (label = g)::INT AS rank FROM r GROUP BY vec_id, label"""


@query(_LOO)
def centroid_loo(spark, sf_dir):
    return vec.leave_one_out(table(spark, sf_dir, "embeddings"))


@query(f"SELECT count(*) AS n, round_even(100.0 * count(*) FILTER (rank <= 1) / count(*), 2) AS top1, round_even(100.0 * count(*) FILTER (rank <= 3) / count(*), 2) AS top3 FROM ({_LOO})")
def top1_top3(spark, sf_dir):
    r = vec.leave_one_out(table(spark, sf_dir, "embeddings"))
    return r.agg(F.count("*").alias("n"), F.bround(100.0 * F.count_if(F.col("rank") <= 1) / F.count("*"), 2).alias("top1"), F.bround(100.0 * F.count_if(F.col("rank") <= 3) / F.count("*"), 2).alias("top3"))


@query("SELECT label, i::INT AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i")
def label_centroids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vec.centroids(e, "label", "embedding").select("label", F.posexplode("centroid").alias("pos", "mean")).withColumn("mean", F.round("mean", 6))


@query(f"""
WITH p AS ({_PAIRS}), s AS (SELECT min(sim) FILTER (ga = gb) AS low_same, max(sim) FILTER (ga <> gb) AS high_other, avg(sim) FILTER (ga = gb) AS mean_same, avg(sim) FILTER (ga <> gb) AS mean_other FROM p)
SELECT round(low_same, 6) AS low_same, round(high_other, 6) AS high_other, round(mean_same, 6) AS mean_same, round(mean_other, 6) AS mean_other, round(low_same - high_other, 6) AS margin, round((low_same + high_other) / 2, 6) AS threshold FROM s""")
def separation_metrics(spark, sf_dir):
    """Similarities within and between labels over all pairs of embeddings, by tiles."""
    s = vec.separation(table(spark, sf_dir, "embeddings"))
    s = s.withColumn("margin", F.col("low_same") - F.col("high_other")).withColumn("threshold", (F.col("low_same") + F.col("high_other")) / 2)
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


@query(f"""
WITH p AS ({_PAIRS}), b AS (SELECT a, ga, b, gb, sim FROM p UNION ALL SELECT b, gb, a, ga, sim FROM p),
n AS (SELECT a, ga, arg_max(b, (round(sim, 9), -b)) AS nearest FROM b WHERE ga <> gb GROUP BY a, ga)
SELECT a, ga AS label, nearest FROM n""")
def nearest_other_label(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vec.nearest(e, 1, other_group=True).select(F.col("q").alias("a"), F.col("group_q").cast(e.schema["label"].dataType).alias("label"), F.col("b").alias("nearest"))


@query(f"""
WITH p AS ({_PAIRS}), b AS (SELECT a, ga, b, gb, sim FROM p UNION ALL SELECT b, gb, a, ga, sim FROM p), n AS (SELECT a, ga, arg_max(gb, (round(sim, 9), -b)) AS g FROM b GROUP BY a, ga)
SELECT count(*) AS n, round(avg((ga = g)::INT), 6) AS hit_rate FROM n""")
def neighbour_hit_rate(spark, sf_dir):
    """The share of rows whose nearest row has their own label."""
    e = table(spark, sf_dir, "embeddings")
    best = vec.nearest_by_cells(e, 1).join(e.select(F.col("vec_id").alias("b"), F.col("label").alias("group_b")), "b")
    return best.agg(F.count("*").alias("n"), F.round(F.avg((F.col("group_q") == F.col("group_b").cast("string")).cast("int")), 6).alias("hit_rate"))


@query(f"""
WITH RECURSIVE p AS ({_PAIRS}), e AS (SELECT a, b FROM p WHERE sim >= 0.6 UNION SELECT b, a FROM p WHERE sim >= 0.6), 
c AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.id)
SELECT id, min(r) AS label FROM c GROUP BY id""")
def threshold_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return connected(spark, vec.linked(e, 0.6), e.select(F.col("vec_id").alias("id")).filter("id is not null").distinct())


@query(f"""
WITH p AS ({_PAIRS}), r AS (SELECT a, b, round(sim, 6) AS sim, row_number() OVER (ORDER BY round(sim, 9) DESC, a, b) AS hi, row_number() OVER (PARTITION BY sim >= 0.6 ORDER BY round(sim, 9), a, b) AS lo, row_number() OVER (PARTITION BY sim >= 0.6 ORDER BY round(sim, 9) DESC, a, b) AS down, sim >= 0.6 AS above FROM p)
SELECT a, b, sim FROM r WHERE hi <= 3 OR (above AND lo <= 3) OR (NOT above AND down <= 4)""")
def boundary_view(spark, sf_dir):
    """Top three pairs, the lowest three above the threshold, the highest four below: top-k reports, no window over all."""
    return vec.boundary(table(spark, sf_dir, "embeddings"), 0.6).select("a", "b", F.round("k", 6).alias("sim"))


@query()
def classifier_pca_logreg(spark, sf_dir):
    """Labels by multinomial regression on 24 principal components; accuracy on rows held out by a hash."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("v"))
    e = e.withColumn("fold", F.pmod(F.xxhash64("vec_id"), F.lit(5)))
    pca = PCA(k=24, inputCol="v", outputCol="features").fit(e.filter("fold <> 0"))
    model = LogisticRegression(maxIter=50, regParam=1e-3).fit(pca.transform(e.filter("fold <> 0")))
    out = model.transform(pca.transform(e))
    return out.groupBy((F.col("fold") == 0).alias("held_out")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 4).alias("accuracy"))


@query()
def context_classifier(spark, sf_dir):
    """Quality of documents by a multinomial regression on min-max scaled structure features beside 24 principal components of the vector of the same id; accuracy on rows held out by a hash."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    features = sc.structure(F.col("text"))
    rows = d.select("doc_id", "label", *(c.cast("double").alias(n) for n, c in features.items()))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), array_to_vector("embedding").alias("v"))
    rows = rows.join(e, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(5)))
    rows = VectorAssembler(inputCols=list(features), outputCol="structure").transform(rows)
    learn = rows.filter("fold <> 0")
    scaler, pca = MinMaxScaler(inputCol="structure", outputCol="scaled").fit(learn), PCA(k=24, inputCol="v", outputCol="components").fit(learn)
    both = VectorAssembler(inputCols=["scaled", "components"], outputCol="features")
    ready = lambda x: both.transform(pca.transform(scaler.transform(x)))
    out = LogisticRegression(maxIter=50, regParam=1e-3, family="multinomial").fit(ready(learn)).transform(ready(rows))
    return out.groupBy((F.col("fold") == 0).alias("held_out")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 4).alias("accuracy"))


@query("""
WITH RECURSIVE b AS (SELECT p_partkey, 70 + p_retailprice % 60 AS price, (1 + p_size % 5)::DOUBLE AS coupon, (2 + p_size % 20)::INT AS periods FROM part),
i AS (SELECT p_partkey, price, coupon, periods, 0 AS n, 0.05::DOUBLE AS y, false AS done, true AS live FROM b
  UNION ALL SELECT p_partkey, price, coupon, periods, n + 1, CASE WHEN abs(diff) < 1e-8 OR abs(slope) < 1e-12 THEN y ELSE y - diff / slope END, abs(diff) < 1e-8, abs(diff) >= 1e-8 AND abs(slope) >= 1e-12 AND y - diff / slope BETWEEN -0.99 AND 5
  FROM (SELECT *, list_sum(list_transform(range(1, periods + 1), lambda t: (coupon + CASE WHEN t = periods THEN 100 ELSE 0 END) / power(1 + y / 2, t))) - price AS diff,
    list_sum(list_transform(range(1, periods + 1), lambda t: -t * (coupon + CASE WHEN t = periods THEN 100 ELSE 0 END) / power(1 + y / 2, t + 1) / 2)) AS slope FROM i WHERE live AND n < 100))
SELECT p_partkey, CASE WHEN bool_or(done) THEN round(arg_max(y, n), 6) END AS ytm FROM i GROUP BY p_partkey""")
def ytm_newton(spark, sf_dir):
    """Yield to maturity by Newton's method on whole batches of bonds made from parts."""

    def solve(price: pd.Series, coupon: pd.Series, periods: pd.Series) -> pd.Series:
        import numpy as np

        y, live = np.full(len(price), 0.05), np.ones(len(price), bool)
        p, c, n = price.to_numpy(float), coupon.to_numpy(float), periods.to_numpy(int)
        t = np.arange(1, (n.max() if len(n) else 0) + 1)
        cash = np.where(t <= n[:, None], c[:, None], 0.0) + np.where(t == n[:, None], 100.0, 0.0)
        done = np.zeros(len(price), bool)
        for _ in range(100):
            base = 1 + y[:, None] / 2
            present = cash / base**t
            diff = present.sum(axis=1) - p
            slope = (-t * present / base / 2).sum(axis=1)
            done |= live & (np.abs(diff) < 1e-8)
            live &= ~done & (np.abs(slope) >= 1e-12)
            y = np.where(live, y - diff / np.where(slope == 0, 1, slope), y)
            live &= (y >= -0.99) & (y <= 5)
        return pd.Series(np.where(done, y, np.nan))

    yields = F.pandas_udf(solve, "double")
    part = table(spark, sf_dir, "part").select("p_partkey", (70 + F.col("p_retailprice") % 60).alias("price"), (1 + F.col("p_size") % 5).cast("double").alias("coupon"), (2 + F.col("p_size") % 20).cast("int").alias("periods"))
    return part.withColumn("ytm", F.round(yields("price", "coupon", "periods"), 6)).select("p_partkey", "ytm")
