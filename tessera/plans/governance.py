from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import governance as gov
from ..sources.tables import small, table
from .registry import query

_list = lambda scale: "[" + ", ".join(f"'{s}'" for s in scale) + "]"
_AGENTS = f"""
SELECT c_custkey AS agent, CASE WHEN c_custkey % 23 = 0 THEN 'galaxy' ELSE {_list(gov.BLAST)}[(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey % 5 END + 1)::INT] END AS blast_radius,
  CASE WHEN c_custkey % 5 = 0 THEN upper({_list(gov.AUTONOMY)}[(c_custkey % 3 + 1)::INT]) ELSE {_list(gov.AUTONOMY)}[(c_custkey % 3 + 1)::INT] END AS autonomy,
  CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE {_list(gov.DATA)}[(CASE WHEN c_custkey % 4 > 0 THEN 0 ELSE c_custkey // 4 % 4 END + 1)::INT] END AS data_tier,
  c_custkey % 2 = 0 AS tools, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END AS owner, CASE WHEN c_custkey % 17 <> 0 THEN 'r' || c_custkey END AS release_id,
  CASE c_custkey % 9 WHEN 0 THEN 'm-latest2' WHEN 1 THEN 'm' WHEN 2 THEN NULL ELSE 'm-1.2' END AS model, CASE WHEN c_custkey % 11 = 0 THEN chr(9) || ' ' ELSE 'active' END AS agent_status,
  CASE WHEN c_custkey % 7 > 0 THEN 'id' END AS runtime_identity, CASE WHEN c_custkey % 29 > 0 THEN 'policy' END AS action_policy, CASE WHEN c_custkey % 31 > 0 THEN 'mode' END AS approval_mode, c_nationkey
FROM customer"""
#: Who invokes whom: chains of ten, one cycle for each nation of its agents by key, and calls of an agent that is not there.
_INVOKES = """
SELECT c_custkey AS caller, c_custkey + 1 AS callee FROM customer WHERE c_custkey % 10 > 0
UNION SELECT c_custkey, coalesce(lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), first_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey)) FROM customer WHERE c_nationkey < 3 AND c_custkey % 6 = 1
UNION SELECT c_custkey, c_custkey + 1000000000 FROM customer WHERE c_custkey % 50 = 0"""
_TIERS = f"""
SELECT o.*, r.tier FROM (SELECT *, greatest(0, CASE WHEN b >= 1 OR d >= 1 THEN 1 ELSE 0 END, CASE WHEN b >= 2 OR d = 2 THEN 2 ELSE 0 END, CASE WHEN b >= 3 OR d = 3 OR (a = 2 AND b >= 2) THEN 3 ELSE 0 END) AS own,
  (owner = '')::INT + (release_id IS NULL)::INT + (model IS NULL)::INT + (data_tier IS NULL)::INT + (agent_status <> 'active')::INT
  + CASE WHEN tools THEN (runtime_identity IS NULL)::INT + (action_policy IS NULL)::INT + (approval_mode IS NULL)::INT ELSE 0 END + coalesce((model IN ('m-latest2', 'm'))::INT, 0) AS missing
FROM (SELECT *, coalesce(list_position({_list(tuple(x.lower() for x in gov.BLAST))}, lower(blast_radius)) - 1, 0) AS b, coalesce(list_position({_list(tuple(x.lower() for x in gov.AUTONOMY))}, lower(autonomy)) - 1, 0) AS a,
  coalesce(list_position({_list(tuple(x.lower() for x in gov.DATA))}, lower(data_tier)) - 1, 0) AS d FROM agents)) o JOIN (SELECT agent, max(tier) AS tier FROM reach GROUP BY agent) r USING (agent)"""
_OWN = f"SELECT agent, greatest(0, CASE WHEN b >= 1 OR d >= 1 THEN 1 ELSE 0 END, CASE WHEN b >= 2 OR d = 2 THEN 2 ELSE 0 END, CASE WHEN b >= 3 OR d = 3 OR (a = 2 AND b >= 2) THEN 3 ELSE 0 END) AS tier FROM (SELECT agent, coalesce(list_position({_list(tuple(x.lower() for x in gov.BLAST))}, lower(blast_radius)) - 1, 0) AS b, coalesce(list_position({_list(tuple(x.lower() for x in gov.AUTONOMY))}, lower(autonomy)) - 1, 0) AS a, coalesce(list_position({_list(tuple(x.lower() for x in gov.DATA))}, lower(data_tier)) - 1, 0) AS d FROM agents)"
#: Tiers by recursion: each agent's own tier reaches all that invoke it, cycles ending as pairs repeat.
_WITH = f"WITH RECURSIVE agents AS ({_AGENTS}), invokes AS ({_INVOKES}), reach(agent, tier) AS ({_OWN} UNION SELECT i.caller, r.tier FROM reach r JOIN invokes i ON i.callee = r.agent JOIN agents g ON g.agent = i.caller), tiers AS ({_TIERS}) "


def _agents(spark, sf_dir):
    """Agents made from customers, with their own and inherited tiers and the fields they lack."""
    c, k = F.col, F.col("c_custkey")
    pick = lambda scale, at: F.element_at(F.array(*map(F.lit, scale)), (at + 1).cast("int"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    a = customers.select(
        k.alias("agent"), F.when(k % 23 == 0, "galaxy").otherwise(pick(gov.BLAST, F.when(k % 3 == 0, 0).otherwise(c("c_nationkey") % 5))).alias("blast_radius"),
        F.when(k % 5 == 0, F.upper(pick(gov.AUTONOMY, k % 3))).otherwise(pick(gov.AUTONOMY, k % 3)).alias("autonomy"),
        F.when(k % 19 > 0, pick(gov.DATA, F.when(k % 4 > 0, 0).otherwise(F.floor(k / 4) % 4))).alias("data_tier"), (k % 2 == 0).alias("tools"),
        F.when(k % 13 == 0, "").otherwise(c("c_name")).alias("owner"), F.when(k % 17 > 0, F.concat(F.lit("r"), k.cast("string"))).alias("release_id"),
        F.when(k % 9 == 0, "m-latest2").when(k % 9 == 1, "m").when(k % 9 > 2, "m-1.2").alias("model"), F.when(k % 11 == 0, "\t ").otherwise("active").alias("agent_status"),
        F.when(k % 7 > 0, "id").alias("runtime_identity"), F.when(k % 29 > 0, "policy").alias("action_policy"), F.when(k % 31 > 0, "mode").alias("approval_mode"),
    )
    a = a.withColumn("own", gov.risk_tier(c("blast_radius"), c("autonomy"), c("data_tier"))).withColumn("missing", gov.missing_fields(c("tools"), c("model")))
    ring = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    cycles = customers.filter("c_nationkey < 3 and c_custkey % 6 = 1").select(k.alias("caller"), F.coalesce(F.lead("c_custkey").over(ring), F.first("c_custkey").over(ring)).alias("callee"))
    invokes = customers.filter("c_custkey % 10 > 0").select(k.alias("caller"), (k + 1).alias("callee")).union(cycles).union(customers.filter("c_custkey % 50 = 0").select(k, k + 1_000_000_000))
    return a.join(gov.inherited(a.select("agent", F.col("own").alias("tier")), invokes), "agent")


@query(_WITH + "SELECT agent, own::INT AS own, tier::INT AS tier, missing::INT AS missing FROM tiers")
def agent_tiers(spark, sf_dir):
    """Risk tiers by floors, what agents inherit from those they invoke, and how many required fields are missing."""
    return _agents(spark, sf_dir).select("agent", "own", "tier", F.size("missing").alias("missing"))


@query(_WITH + """SELECT field, tools, count(*) AS agents FROM (SELECT tools, unnest(list_filter([CASE WHEN owner = '' THEN 'owner' END, CASE WHEN release_id IS NULL THEN 'release_id' END, CASE WHEN model IS NULL THEN 'model' END, CASE WHEN data_tier IS NULL THEN 'data_tier' END,
  CASE WHEN agent_status <> 'active' THEN 'agent_status' END, CASE WHEN tools AND runtime_identity IS NULL THEN 'runtime_identity' END, CASE WHEN tools AND action_policy IS NULL THEN 'action_policy' END,
  CASE WHEN tools AND approval_mode IS NULL THEN 'approval_mode' END, CASE WHEN model IN ('m-latest2', 'm') THEN 'pinned model' END], lambda x: x IS NOT NULL)) AS field FROM agents) GROUP BY ALL""")
def agent_missing(spark, sf_dir):
    """Which required fields agents lack, with tools and without."""
    return _agents(spark, sf_dir).select("tools", F.explode("missing").alias("field")).groupBy("field", "tools").agg(F.count("*").alias("agents"))


_ACT = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in a) + ")" for a in gov.ACTIONS)


@query(_WITH + f"""
SELECT action, verdict, count(*) AS agents FROM (SELECT action, CASE WHEN missing > 0 OR NOT in_envelope THEN 'DENY' WHEN customer_visible OR security OR NOT reversible OR production THEN 'APPROVE'
  WHEN lower(autonomy) = 'suggests' THEN 'PROPOSE' WHEN lower(autonomy) = 'acts-autonomously' THEN 'AUTO' ELSE 'APPROVE' END AS verdict
FROM tiers, (VALUES {_ACT}) c(action, reversible, production, customer_visible, security, in_envelope)) GROUP BY ALL""")
def action_authority(spark, sf_dir):
    """Verdicts on eleven actions for every agent: the catalog is broadcast."""
    actions = spark.createDataFrame(gov.ACTIONS, "action string, reversible boolean, production boolean, customer_visible boolean, security boolean, in_envelope boolean")
    rows = _agents(spark, sf_dir).crossJoin(F.broadcast(actions))
    return rows.groupBy("action", gov.authority(F.size("missing") == 0, F.col("autonomy")).alias("verdict")).agg(F.count("*").alias("agents"))


_CTL = ", ".join(f"('{n}', {r}, {a}, '{w}', {str(t).lower()})" for n, r, a, w, t in gov.CONTROLS)


@query(_WITH + f"""
SELECT tier::INT AS tier, tools, control, CASE WHEN tier >= required THEN 'Required' WHEN for_tools AND tools THEN 'Required (tool-enabled)' WHEN tier >= advised THEN advice ELSE 'Not required' END AS rule, count(*) AS agents
FROM tiers, (VALUES {_CTL}) c(control, required, advised, advice, for_tools) GROUP BY ALL""")
def controls_matrix(spark, sf_dir):
    """What each of the fifteen controls is to agents of each tier, with tools and without."""
    controls = spark.createDataFrame(gov.CONTROLS, "control string, required int, advised int, advice string, for_tools boolean")
    by_tier = _agents(spark, sf_dir).groupBy("tier", "tools").agg(F.count("*").alias("agents"))
    return by_tier.crossJoin(F.broadcast(controls)).select("tier", "tools", "control", gov.control_rule(F.col("tier"), F.col("tools")).alias("rule"), "agents")  # fifteen controls


@query("SELECT DISTINCT p_type AS token FROM part WHERE NOT (p_type LIKE 'STANDARD%' OR p_type LIKE 'PROMO A%') AND p_type NOT IN (SELECT p_type FROM part WHERE p_partkey % 400 = 1)")
def contract_missing(spark, sf_dir):
    """Required tokens that neither a declared token nor a declared prefix covers."""
    part = table(spark, sf_dir, "part")
    declared = part.filter("p_partkey % 400 = 1").select(F.col("p_type").alias("token")).union(spark.createDataFrame([("STANDARD*",), ("PROMO A*",)], "token string")).distinct()
    return gov.undeclared(part.select(F.col("p_type").alias("token")).distinct(), declared)


@query("SELECT k.n_nationkey, coalesce(upper(trim(k.n_name)) = upper(trim(g.v)), false) AS passed FROM nation k LEFT JOIN (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'x' ELSE lower(n_name) || ' ' END AS v FROM nation WHERE n_nationkey < 20) g USING (n_nationkey)")
def answer_key_score(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    given = n.filter("n_nationkey < 20").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, "x").otherwise(F.concat(F.lower("n_name"), F.lit(" "))).alias("value"))
    return gov.answer_key(n.select("n_nationkey", F.col("n_name").alias("value")), given, "n_nationkey")


@query("""
WITH c AS (SELECT DISTINCT p_brand AS owner, p_type AS col FROM part), u AS (SELECT p_partkey AS use, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'none' END AS scope, p_type AS col FROM part),
o AS (SELECT col, min(owner) AS other FROM c GROUP BY col HAVING count(*) = 1)
SELECT use, coalesce(c.owner, o.other) AS owner FROM u LEFT JOIN c ON c.owner = u.scope AND c.col = u.col LEFT JOIN o ON o.col = u.col""")
def column_binding(spark, sf_dir):
    """Scoped table first, else the only table with that column."""
    part = table(spark, sf_dir, "part")
    columns = part.select(F.col("p_brand").alias("owner"), F.col("p_type").alias("column")).distinct()
    uses = part.select(F.col("p_partkey").alias("use"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise("none").alias("scope"), F.col("p_type").alias("column"))
    return gov.bind_columns(uses, columns)


@query("""
WITH g AS (SELECT o_orderpriority AS rung, avg(o_totalprice / 1e6) AS cost, 100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*) AS success FROM orders GROUP BY 1)
SELECT rung, round(cost, 6) AS cost, round(success, 4) AS success, round(CASE WHEN success > 0 THEN cost * 100 / success ELSE 0 END, 6) AS cost_per_success FROM g""")
def cost_per_success(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("rung"), (F.col("o_totalprice") / 1e6).alias("cost"), (F.col("o_orderstatus") == "F").alias("ok"))
    e = gov.economics(runs)
    return e.select("rung", F.round("cost", 6).alias("cost"), F.round("success", 4).alias("success"), F.round("cost_per_success", 6).alias("cost_per_success"))


@query("""
SELECT n_name, count(*) AS customers, count(*) FILTER (c_acctbal < 0) AS overdrawn, round_even(100.0 * count(*) FILTER (c_acctbal >= 0) / count(*), 0)::INT AS coverage
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""")
def coverage_metrics(spark, sf_dir):
    """Resolved of total in percent, over a dimension that is broadcast."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(small(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("overdrawn"), F.bround(100.0 * F.count_if(F.col("c_acctbal") >= 0) / F.count("*"), 0).cast("int").alias("coverage"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def unreferenced(spark, sf_dir):
    """Anti-join: customers whom no large order names."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
WITH d AS (SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier)
SELECT s_nationkey, max(s_suppkey) FILTER (r = 1) AS best, round(max(s_acctbal) FILTER (r = 1) - coalesce(max(s_acctbal) FILTER (r = 2), 0), 2) AS margin FROM d GROUP BY s_nationkey""")
def top_margin(spark, sf_dir):
    """Best of each group and its lead over the second, by one aggregate of sorted pairs."""
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    d = table(spark, sf_dir, "supplier").withColumn("r", F.row_number().over(w)).filter("r <= 2")
    first, second = F.max(F.when(F.col("r") == 1, F.col("s_acctbal"))), F.max(F.when(F.col("r") == 2, F.col("s_acctbal")))
    return d.groupBy("s_nationkey").agg(F.max(F.when(F.col("r") == 1, F.col("s_suppkey"))).alias("best"), F.round(first - F.coalesce(second, F.lit(0.0)), 2).alias("margin"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), -1.0) AS k FROM events")
def typed_attributes(spark, sf_dir):
    """A typed read from an open map with a default."""
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') as double)"), F.lit(-1.0)).alias("k"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(list_inner_product(embedding[1:16]::DOUBLE[], embedding[17:32]::DOUBLE[]), 6) AS half FROM embeddings")
def vector_functions(spark, sf_dir):
    from ..operators.vectors import dot, norm

    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(e), 6).alias("norm"), F.round(dot(F.slice(e, 1, 16), F.slice(e, 17, 16)), 6).alias("half"))


_STEPS = {
    "step": "p_partkey", "scene": "p_size", "kind": "CASE p_partkey % 4 WHEN 0 THEN 'Observe' WHEN 1 THEN 'Select' WHEN 2 THEN 'Fill' ELSE 'Click' END",
    "selector": "CASE WHEN p_partkey % 7 = 0 THEN ' ' WHEN p_partkey % 11 = 0 THEN NULL ELSE '#x' END", "wait": "CASE WHEN p_partkey % 3 = 0 THEN 'State' ELSE 'None' END",
    "wait_key": "CASE WHEN p_partkey % 2 = 0 THEN 'k' END", "value": "CASE WHEN p_partkey % 5 <> 0 THEN 'v' END", "facts": "p_partkey % 6",
}


@query(f"""
WITH s AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _STEPS.items())} FROM part)
SELECT step::VARCHAR AS subject, 'facts' AS problem FROM s WHERE facts = 0 UNION ALL SELECT step::VARCHAR, 'selector' FROM s WHERE kind <> 'Observe' AND trim(coalesce(selector, '')) = ''
UNION ALL SELECT step::VARCHAR, 'wait key' FROM s WHERE wait = 'State' AND wait_key IS NULL UNION ALL SELECT step::VARCHAR, 'value' FROM s WHERE kind IN ('Select', 'Fill') AND value IS NULL
UNION ALL SELECT 'scene ' || i, 'coverage' FROM range(1, 61) r(i) WHERE i NOT IN (SELECT scene FROM s)""")
def step_problems(spark, sf_dir):
    """Steps of a manifest that break its rules, and scenes that no step covers."""
    steps = table(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in _STEPS.items()))
    return gov.step_problems(steps, spark.range(1, 61).withColumnRenamed("id", "scene"))


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 4 THEN false ELSE CASE c_custkey % 3 WHEN 0 THEN c_custkey % 5 <> 3 ELSE c_custkey % 5 NOT IN (2, 3) END END AS passed FROM customer""")
def answer_checks(spark, sf_dir):
    """Hexadecimal answers, rows and texts against a key."""
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "hex").when(k % 3 == 1, "row").otherwise("exact")
    digits = F.hex(k + 4096)
    want = F.when(k % 3 == 0, digits).otherwise(F.concat(F.lit("a |b|"), k.cast("string")))
    # exact for 0; other ends for 1; changed inside for 2, which only hexadecimal answers forgive; wrong for 3; missing for 4
    loose = F.when(k % 3 == 0, F.concat(F.lit("0x"), F.lower(digits))).when(k % 3 == 1, F.concat(want, F.lit("|\n"))).otherwise(F.concat(F.lit(" "), want, F.lit(" ")))
    inside = F.when(k % 3 == 0, F.concat_ws(" ", F.left(digits, F.lit(2)), F.substring(digits, 3, 20))).otherwise(F.concat(F.lit("a|b|"), k.cast("string")))
    got = F.when(k % 5 == 0, want).when(k % 5 == 1, loose).when(k % 5 == 2, inside).when(k % 5 == 3, F.concat(want, F.lit("1")))
    c = table(spark, sf_dir, "customer")
    return gov.answer_checks(c.select("c_custkey", want.alias("want"), kind.alias("kind")), c.filter(k % 5 != 4).select("c_custkey", got.alias("got")), "c_custkey")

