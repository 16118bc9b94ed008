from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import clamp
from ..operators import reports as rep
from ..operators.vectors import dot
from ..sources.tables import small, table
from .registry import query


@query("SELECT doc_id, i::INT AS chunk, substr(text, (i * 1400 + 1)::BIGINT, 1400) AS body FROM documents, range(0, 200) r(i) WHERE i * 1400 < length(text)")
def chunk_builder(spark, sf_dir):
    return rep.chunks(table(spark, sf_dir, "documents"))


@query("""
SELECT verdict, count(*) AS docs FROM (SELECT CASE WHEN NOT contains(lower(text), 'the') THEN 'absent' WHEN NOT contains(text, chr(10)) THEN 'not-given' WHEN n_chars < 1000 THEN 'unused' WHEN n_chars > 5000 THEN 'wrong' ELSE 'carried' END AS verdict FROM documents) GROUP BY 1""")
def fact_trace(spark, sf_dir):
    t = F.col("text")
    v = rep.trace_verdict(F.contains(F.lower(t), F.lit("the")), F.contains(t, F.lit("\n")), F.col("n_chars") >= 1000, F.col("n_chars") <= 5000)
    return table(spark, sf_dir, "documents").groupBy(v.alias("verdict")).agg(F.count("*").alias("docs"))


@query("SELECT e.vec_id, round(1 - list_inner_product(e.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS divergence FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) b USING (label)")
def baseline_divergence(spark, sf_dir):
    """Distance of each row from its group's first."""
    e = table(spark, sf_dir, "embeddings")
    b = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("base"))
    return e.join(b, "label").select("vec_id", (F.round(1 - dot(F.col("embedding"), F.col("base")), 6) + 0.0).alias("divergence"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '-7'), doc_id LIMIT 20")
def seeded_order(spark, sf_dir):
    """Twenty documents in an order that a seed decides: a sampling operator."""
    return table(spark, sf_dir, "documents").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7"))), "doc_id").limit(20).select("doc_id")


@query("SELECT o_orderpriority, list_position(['5-LOW', '1-URGENT', '3-MEDIUM'], o_orderpriority)::INT AS place, count(*) AS n FROM orders GROUP BY 1, 2")
def listed_order(spark, sf_dir):
    place = F.array_position(F.array(F.lit("5-LOW"), F.lit("1-URGENT"), F.lit("3-MEDIUM")), F.col("o_orderpriority")).cast("int")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.when(place > 0, place).alias("place")).agg(F.count("*").alias("n"))


@query("SELECT user_id, max(ts) > (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS live FROM events GROUP BY user_id")
def liveness(spark, sf_dir):
    """Whether a user was seen within a period before the latest event."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("now"))
    seen = e.groupBy("user_id").agg(F.max("ts").alias("seen"))
    return seen.crossJoin(F.broadcast(last)).select("user_id", (F.col("seen") > F.col("now") - F.expr("interval 1 day")).alias("live"))  # one row


@query("SELECT q.conv_id, q.turn, length(q.text) AS asked, length(a.text) AS answered FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
def question_answer_zip(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    q = c.filter("role = 'user'").select("conv_id", "turn", F.length("text").alias("asked"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("answered"))
    return q.join(a, ["conv_id", "turn"])


@query("SELECT l_linenumber AS slot, least(5, greatest(1, l_quantity::INT - 10)) AS score, left(l_returnflag || '-' || l_linestatus, 2) AS note FROM lineitem WHERE l_linenumber IN (1, 3)")
def score_ingest(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("slot"), (F.col("l_quantity").cast("int") - 10).alias("score"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("note"))
    return rep.ingest_scores(rows, spark.createDataFrame([(1,), (3,)], "slot int"), note=2)


@query("SELECT p_partkey, least(100, greatest(0, p_size * 2 + p_retailprice / 50)) AS score, CASE WHEN p_size * 2 + p_retailprice / 50 >= 90 THEN 'A' WHEN p_size * 2 + p_retailprice / 50 >= 80 THEN 'B' WHEN p_size * 2 + p_retailprice / 50 >= 70 THEN 'C' WHEN p_size * 2 + p_retailprice / 50 >= 60 THEN 'D' ELSE 'F' END AS grade FROM part")
def graded_parts(spark, sf_dir):
    score = clamp(F.col("p_size") * 2 + F.col("p_retailprice") / 50, 0.0, 100.0)
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score")).withColumn("grade", rep.grade(F.col("score")))


@query("""
WITH r AS (SELECT p_brand AS tier, p_partkey AS run, p_size AS score FROM part), m AS (SELECT tier, floor(quantile_cont(score, 0.5))::INT AS median, min(score) AS low, max(score) AS high FROM r GROUP BY tier)
SELECT m.tier, median, low, high, min(run) AS run FROM m LEFT JOIN r ON r.tier = m.tier AND r.score = m.median GROUP BY ALL""")
def tier_curve(spark, sf_dir):
    return rep.tier_curve(table(spark, sf_dir, "part").select(F.col("p_brand").alias("tier"), F.col("p_partkey").alias("run"), F.col("p_size").alias("score")))


@query("SELECT s_nationkey, string_agg(s_name, ', ' ORDER BY s_name) AS members, count(*) AS n FROM (SELECT DISTINCT s_nationkey, s_name FROM supplier) GROUP BY s_nationkey")
def ordered_members(spark, sf_dir):
    return rep.members(table(spark, sf_dir, "supplier"), "s_nationkey", "s_name")


@query("SELECT text AS item, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_texts(spark, sf_dir):
    """Groups of more than one: hashes are counted first, texts are fetched for the repeated alone."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("h"))
    often = d.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter("n > 1")
    return d.join(often.select("doc_id", "n"), "doc_id").select(F.col("text").alias("item"), "n")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS drafted, round_even(100.0 * count(*) FILTER (event_type = 'click' AND value > 50) / nullif(count(*) FILTER (event_type = 'click'), 0), 1) AS rate FROM events GROUP BY user_id")
def acceptance_rate(spark, sf_dir):
    """Accepted of drafted, null where none was."""
    click = F.col("event_type") == "click"
    n = F.count_if(click)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(n.alias("drafted"), F.bround(100.0 * F.count_if(click & (F.col("value") > 50)) / F.nullif(n, F.lit(0)), 1).alias("rate"))


@query("SELECT sha256(text) AS cluster, count(*) AS copies, sum(n_chars) - max(n_chars) AS saved FROM documents GROUP BY 1 HAVING count(*) > 1")
def consolidation_saving(spark, sf_dir):
    """What would be saved if each cluster kept its largest member."""
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("cluster"))
    return d.agg(F.count("*").alias("copies"), (F.sum("n_chars") - F.max("n_chars")).alias("saved")).filter("copies > 1")


@query("SELECT vec_id, round(100 * a + 60 * b + 15 * c, 4) AS score FROM (SELECT vec_id, abs(embedding[1]) / t AS a, abs(embedding[2]) / t AS b, abs(embedding[3]) / t AS c FROM (SELECT *, abs(embedding[1])::DOUBLE + abs(embedding[2]) + abs(embedding[3]) AS t FROM embeddings))")
def probability_score(spark, sf_dir):
    """Three shares weighted 100, 60 and 15."""
    e = F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x.cast("double")))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    score = F.aggregate(F.zip_with(e, F.array(F.lit(100.0), F.lit(60.0), F.lit(15.0)), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x) / total
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(score, 4).alias("score"))


@query("SELECT c_custkey, substr(c_name, 1, 4) || '…' || right(c_name, 4) AS wallet, lower(replace(c_mktsegment, '_', ' ')) AS segment FROM customer")
def masked_wallets(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.substring(n, 1, 4), F.lit("…"), F.right(n, F.lit(4))).alias("wallet"), F.lower(F.replace("c_mktsegment", F.lit("_"), F.lit(" "))).alias("segment"))


@query(r"SELECT doc_id, len(list_filter(['password', 'token', 'the', 'der'], lambda t: regexp_matches(text, '(?i)\b' || t || '\b')))::INT AS leaks FROM documents")
def leak_scan(spark, sf_dir):
    """Whole words of a list, case ignored."""
    hits = sum((F.col("text").rlike(rf"(?i)\b{t}\b").cast("int") for t in ("password", "token", "the", "der")), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("leaks"))


@query("SELECT event_id, json_valid(props) AS readable FROM events")
def json_soft(spark, sf_dir):
    """Decoding that fails soft: a text that is no JSON object gives null."""
    parsed = F.from_json("props", "map<string,string>", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").select("event_id", parsed.isNotNull().alias("readable"))


@query("""
WITH c AS (SELECT label AS g, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
s AS (SELECT e.vec_id, e.label, c.g, sum(e.x * c.m) AS sim FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) e JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, arg_max(g, (round(sim, 9), -g)) AS nearest, arg_max(g, (round(sim, 9), -g)) FILTER (g <> 0) AS without_first FROM s GROUP BY vec_id""")
def nearest_description(spark, sf_dir):
    """Nearest centroid of each row, with and without one target; centroids are a row a label."""
    from ..operators.vectors import LABELS, centroids

    e = table(spark, sf_dir, "embeddings")
    scored = e.crossJoin(small(centroids(e, "label", "embedding").withColumnRenamed("label", "g"), LABELS)).select("vec_id", "g", F.round(dot(F.col("embedding"), F.col("centroid")), 9).alias("sim"))
    key = F.struct("sim", -F.col("g"))
    return scored.groupBy("vec_id").agg(F.max_by("g", key).alias("nearest"), F.max_by(F.when(F.col("g") != 0, F.col("g")), F.when(F.col("g") != 0, key)).alias("without_first"))
