"""Queries over session traces, judged answers, rendered documents and small text rules; inputs are made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as nu
from ..functions import text as tx
from ..operators import reports as rep
from ..operators import scoring as sc
from ..operators import vectors as vec
from ..sources.tables import table
from .registry import query


def _made(spark, sf_dir, name: str, **columns: str):
    """Columns made from a table by expressions that read the same in Spark and in the SQL."""
    return table(spark, sf_dir, name).selectExpr(*(f"{e} AS {n}" for n, e in columns.items()))


def _sql(name: str, **columns: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {name}"


@query("SELECT event_type, 'orders.' || event_type || '.v1' AS topic FROM events GROUP BY 1")
def topic_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type").distinct().select("event_type", tx.topic(F.col("event_type")).alias("topic"))


@query("SELECT p_partkey, true AS full_, p_size % 2 = 0 AS full_safe, p_size % 3 = 0 AS plain, p_size % 2 = 0 AND p_size % 3 = 0 AS plain_safe FROM part")
def profile_steps(spark, sf_dir):
    """Which profiles keep a step that needs the bridge (size no multiple of 3) or runs in process (odd size)."""
    bridge, inside = F.col("p_size") % 3 != 0, F.col("p_size") % 2 != 0
    kept = {"full_": (True, True), "full_safe": (True, False), "plain": (False, True), "plain_safe": (False, False)}
    return table(spark, sf_dir, "part").select("p_partkey", *(rep.for_profile(bridge, inside, *p).alias(n) for n, p in kept.items()))


_MARKED = {
    "o_orderkey": "o_orderkey",
    "t": "concat('total=', o_custkey, chr(10), 'x qty=', CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN '99999999999' ELSE concat(o_orderkey, 'qty=5') END, chr(10), 'qty=', o_custkey % 100, ' at 0x', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('fA', o_orderkey % 10, 'zz') END)",
}


@query(f"""
SELECT o_orderkey, coalesce(list_filter(list_transform(list_filter(string_split(t, chr(10)), lambda l: contains(l, 'qty=')), lambda l: try_cast(regexp_extract(substr(l, instr(l, 'qty=') + 4), '^[0-9]+') AS INT)), lambda x: x IS NOT NULL)[1], 0) AS number,
  upper(regexp_extract(substr(t, instr(t, '0x') + 2), '^[0-9A-Fa-f]*')) AS hex, coalesce(try_cast(regexp_extract(t, 'none([0-9]+)', 1) AS INT), 0) AS missing FROM ({_sql('orders', **_MARKED)})""")
def numbers_after_markers(spark, sf_dir):
    """Leading digits after a marker, of the first line where they make an integer, and hexadecimal digits after another."""
    t = F.col("t")
    return _made(spark, sf_dir, "orders", **_MARKED).select("o_orderkey", tx.number_after(t, "qty=").alias("number"), tx.hex_after(t, "0x").alias("hex"), tx.number_after(t, "none").alias("missing"))


_REVIEW = {
    "session": "user_id", "sequence": "event_id % 25", "arrived": "event_id", "stage": "CASE WHEN event_id % 17 = 0 THEN '  ' WHEN event_id % 31 = 0 THEN NULL ELSE event_type END",
    "evidence": "CASE WHEN event_id % 23 = 0 THEN repeat('x', 501) ELSE props END", "decision": "CASE WHEN event_id % 29 = 0 THEN '' ELSE 'keep' END",
}


@query(f"""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY session, sequence ORDER BY arrived) AS r FROM ({_sql('events', **_REVIEW)}) WHERE sequence BETWEEN 1 AND 20 AND trim(stage) <> '' AND length(stage) <= 80 AND trim(evidence) <> '' AND length(evidence) <= 500 AND trim(decision) <> '')
SELECT session, row_number() OVER (PARTITION BY session ORDER BY sequence)::INT AS place, sequence, stage, arrived FROM e WHERE r = 1""")
def review_trace(spark, sf_dir):
    """Valid review events in order, the first of each number in a session."""
    return rep.review_trace(_made(spark, sf_dir, "events", **_REVIEW))


@query("SELECT l_returnflag AS arm, count(*) FILTER (l_quantity > 25) AS met, 5::BIGINT AS total FROM lineitem WHERE l_linenumber + l_orderkey % 3 BETWEEN 1 AND 5 GROUP BY 1")
def criteria_by_arm(spark, sf_dir):
    scores = _made(spark, sf_dir, "lineitem", arm="l_returnflag", criterion="l_linenumber + l_orderkey % 3", met="l_quantity > 25")
    return sc.criteria_by_arm(scores, spark.createDataFrame([(k,) for k in range(1, 6)], "ordinal long"))


_FRAGMENT = {
    "conv_id": "conv_id", "turn": "turn",
    "t": """concat('{"trace":[{"sequence":', turn, ',"stage":"', role, '","evidence":"', coalesce(text, ''), '","decision":"keep"},{"sequence":2}]}')""",
}
_PROSE = "replace(replace(t, '\\\"', '\"'), '\\n', ' ')"
for _f, _p in tx.TRACE_FIELDS:
    _PROSE = f"replace({_PROSE}, '{_f}', '{_p}')"
_PROSE = rf"""trim(regexp_replace(trim(regexp_replace(regexp_replace({_PROSE}, '[{{}}\[\]"]', '', 'g'), ' {{2,}}', ' ', 'g')), '^[·, ]+', ''))"""


@query(f"SELECT conv_id, turn, CASE WHEN length(p) > 400 THEN '…' || right(p, 400) ELSE p END AS prose FROM (SELECT conv_id, turn, {_PROSE} AS p FROM ({_sql('conversations', **_FRAGMENT)}))")
def humanised_fragments(spark, sf_dir):
    """Fragments of a streamed trace read as prose."""
    return _made(spark, sf_dir, "conversations", **_FRAGMENT).select("conv_id", "turn", tx.humanise_fragment(F.col("t")).alias("prose"))


_ANSWER = {
    "conv_id": "conv_id", "turn": "turn", "role": "role",
    "t": r"concat(chr(10), '```cs', chr(10), '// FILE: a.cs', chr(10), '  int a = ', turn, ';  ', chr(10), '  // assumption: first ', role, ' ', chr(10), '   // and more', chr(10), '/// doc', chr(10), '// plain', chr(10), '// ASSUMPTION: second', chr(10), '```', chr(10))",
}


@query("SELECT conv_id, turn, 'int a = ' || turn || ';' || chr(10) || '/// doc' || chr(10) || '// plain' AS body, 'first ' || role || ' and more|second' AS assumptions FROM conversations")
def assumptions_split(spark, sf_dir):
    """Assumptions, those that go on over several lines too, apart from the body."""
    s = _made(spark, sf_dir, "conversations", **_ANSWER).withColumn("s", tx.split_assumptions(F.col("t")))
    return s.select("conv_id", "turn", F.col("s.body").alias("body"), F.array_join("s.assumptions", "|").alias("assumptions"))


_PATCH = {
    "o_orderkey": "o_orderkey",
    "t": "concat('  public class Retry', chr(10), CASE WHEN o_orderkey % 2 = 0 THEN 'const int MaxAttempts = 6;' ELSE 'const int MaxAttempts = 8;' END, CASE WHEN o_orderkey % 3 = 0 THEN ' MaxDelay' ELSE '' END, CASE WHEN o_orderkey % 5 = 0 THEN ' new RANDOM()' ELSE '' END, repeat(concat(chr(10), ' public int F();'), cast(o_custkey % 5 as int)))",
}


@query(f"""
WITH c AS (SELECT o_orderkey, (o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT + (o_orderkey % 5 <> 0)::INT + (o_custkey % 5 <= 2)::INT AS met, (o_custkey % 5)::INT AS members FROM orders)
SELECT o_orderkey, round_even(100.0 * met / 4, 0)::INT AS score, members FROM c""")
def drift_scores(spark, sf_dir):
    """Structural checks of patches to a frozen class."""
    score, members = sc.drift(F.col("t"))
    return _made(spark, sf_dir, "orders", **_PATCH).select("o_orderkey", score.alias("score"), members.alias("members"))


def _segments(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    name = lambda k: F.concat(F.lit("SU-"), F.translate(k.cast("string"), "0123456789", "ABCDEFGHIJ"))
    k = F.col("s_suppkey")
    return s.select(F.col("s_nationkey").alias("doc"), k.alias("position"), name(k).alias("id"), F.col("s_name").alias("title"), F.concat(F.lit(" see §"), name(k), F.lit(", §"), name(k * 10 + 1), F.lit("X and §"), name(k - 25), F.lit(". ")).alias("body"))


_SUPPLIED = "'SU-' || translate(({0})::VARCHAR, '0123456789', 'ABCDEFGHIJ')"
_NUMBERED = f"""
n AS (SELECT s_nationkey AS doc, s_suppkey AS k, s_name AS title, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS number FROM supplier),
r AS (SELECT a.doc, a.number, {_SUPPLIED.format('a.k')} AS id, a.title, 'see §' || a.number || ', §' || {_SUPPLIED.format('a.k * 10 + 1')} || 'X and §' || coalesce(b.number::VARCHAR, {_SUPPLIED.format('a.k - 25')}) || '.' AS body FROM n a LEFT JOIN n b ON b.doc = a.doc AND b.k = a.k - 25)"""


@query(f"WITH {_NUMBERED} SELECT * FROM r")
def renumbered_segments(spark, sf_dir):
    """Segments of each document numbered, their references with them; ids that are longer or unknown stay."""
    return rep.renumber(_segments(spark, sf_dir))


@query(f"WITH {_NUMBERED} SELECT doc, string_agg('## Section ' || number || ' — ' || title || chr(10) || body, chr(10) || chr(10) ORDER BY number) AS text FROM r GROUP BY doc")
def rendered_sections(spark, sf_dir):
    return rep.sections(rep.renumber(_segments(spark, sf_dir)))


@query("WITH e AS (SELECT l_linenumber AS slot, min(l_orderkey * 10 + (l_partkey % 7)) AS p FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1) SELECT slot, row_number() OVER (ORDER BY p, slot)::INT AS place FROM e")
def slot_ranking(spark, sf_dir):
    """Known slots in the order in which a ranking first names them."""
    entries = _made(spark, sf_dir, "lineitem", position="l_orderkey * 10 + l_partkey % 7", slot="l_linenumber")
    return rep.ranking(entries, spark.createDataFrame([(k,) for k in (1, 3, 4, 5, 6, 7)], "slot int"))


@query("""
WITH r AS (SELECT p_brand AS rung, max(p_size) - 25 AS success, round(avg(p_retailprice) / 1000, 6) AS attempt FROM part GROUP BY 1), c AS (SELECT *, CASE WHEN success > 0 THEN round(attempt * (100.0 / success), 6) END AS per FROM r)
SELECT by_success, by_attempt, coalesce(by_success <> by_attempt, false) AS differ FROM (SELECT (SELECT rung FROM c WHERE success > 0 ORDER BY per, rung LIMIT 1) AS by_success, (SELECT rung FROM c ORDER BY attempt, rung LIMIT 1) AS by_attempt)""")
def cheapest_rungs(spark, sf_dir):
    """The cheapest by cost of a success and by cost of an attempt."""
    rungs = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("rung")).agg((F.max("p_size") - 25).alias("success"), F.round(F.avg("p_retailprice") / 1000, 6).alias("attempt"))
    return sc.cheapest(rungs)


_PLAIN = r"regexp_replace(regexp_replace(printf('%.4f', {0}), '0+$', ''), '\.$', '')"


@query(f"""
SELECT l_orderkey, l_linenumber, CASE WHEN v < 0 THEN '-$' ELSE '$' END || format('{{:,.2f}}', abs(v)) AS money, {_PLAIN.format('l_discount * 100')} || '%' AS percent, printf('%.0f', l_quantity) AS whole, {_PLAIN.format('v')} AS plain, CASE WHEN l_tax <> 0 THEN 'true' ELSE 'false' END AS flag
FROM (SELECT *, round(l_extendedprice - 30000, 2) AS v FROM lineitem)""")
def formatted_values(spark, sf_dir):
    """Money, percent, integer, plain number and boolean as a policy prints them."""
    li = table(spark, sf_dir, "lineitem").withColumn("v", F.round(F.col("l_extendedprice") - 30000, 2))
    show = {"money": ("v", "money"), "percent": ("l_discount", "percent"), "whole": ("l_quantity", "integer"), "plain": ("v", "number"), "flag": ("l_tax", "boolean")}
    return li.select("l_orderkey", "l_linenumber", *(tx.formatted(F.col(c), kind).alias(n) for n, (c, kind) in show.items()))


def _article_sql() -> str:
    n = range(len(tx.ARTICLE_STARTS))
    at = ", ".join(f"strpos(low, '{s}') AS at{k}" for k, s in enumerate(tx.ARTICLE_STARTS))
    opened = ", ".join(f"CASE WHEN at{k} > 0 AND contains(substr(low, at{k}), '>') THEN at{k} - 1 + strpos(substr(low, at{k}), '>') END AS o{k}" for k in n)
    size = ", ".join("coalesce(" + ", ".join(f"nullif(strpos(substr(low, o{k}), '{e}'), 0)" for e in tx.ARTICLE_ENDS) + f") - 2 AS n{k}" for k in n)
    body = "CASE " + " ".join(f"WHEN n{k} >= 0 THEN substr(html, o{k} + 1, n{k})" for k in n) + " ELSE '' END"
    return (
        "WITH p AS (SELECT page_id, concat('<Main id=a>', html, '</ARTICLE>') AS html, lower(concat('<Main id=a>', html, '</ARTICLE>')) AS low FROM pages), "
        f"a AS (SELECT *, {at} FROM p), o AS (SELECT *, {opened} FROM a), e AS (SELECT *, {size} FROM o) SELECT page_id, {body} AS body, length({body}) AS n FROM e"
    )


@query(_article_sql())
def article_bodies(spark, sf_dir):
    """The article of each page, by the first start that has an end."""
    p = table(spark, sf_dir, "pages").withColumn("html", F.concat(F.lit("<Main id=a>"), "html", F.lit("</ARTICLE>")))
    return p.select("page_id", tx.article_body(F.col("html")).alias("body")).withColumn("n", F.length("body"))


_COLUMNS = {"p_partkey": "p_partkey", "t": "concat('a int, b decimal(', p_size, ', 2), c f(g(x, y), z)', CASE WHEN p_size % 2 = 0 THEN ',' ELSE ', d' END)"}


@query("SELECT p_partkey, 'a int|b decimal(' || p_size || ', 2)|c f(g(x, y), z)' || CASE WHEN p_size % 2 = 0 THEN '' ELSE '|d' END AS parts FROM part")
def top_level_parts(spark, sf_dir):
    """Parts between commas outside parentheses of any depth."""
    return _made(spark, sf_dir, "part", **_COLUMNS).select("p_partkey", F.array_join(tx.top_level_commas(F.col("t")), "|").alias("parts"))


@query("""
WITH r AS (SELECT vec_id, list_transform(range(0, floor(len(embedding) / 3.0 + 0.5)::BIGINT), lambda i: embedding[i * 3 + 1]::DOUBLE) AS s FROM embeddings),
u AS (SELECT vec_id, list_transform(range(0, 96), lambda i: embedding[floor(i * (64 / 96.0))::BIGINT + 1]::DOUBLE * (1 - (i * (64 / 96.0) - floor(i * (64 / 96.0)))) + embedding[least(floor(i * (64 / 96.0))::BIGINT + 2, 64)]::DOUBLE * (i * (64 / 96.0) - floor(i * (64 / 96.0)))) AS s FROM embeddings)
SELECT r.vec_id, len(r.s)::INT AS n, list_sum(list_transform(r.s, lambda x: trunc(greatest(-1, least(1, x)) * CASE WHEN x < 0 THEN 32768 ELSE 32767 END)::BIGINT))::BIGINT AS sum_down, list_sum(list_transform(u.s, lambda x: trunc(greatest(-1, least(1, x)) * CASE WHEN x < 0 THEN 32768 ELSE 32767 END)::BIGINT))::BIGINT AS sum_up FROM r JOIN u USING (vec_id)""")
def resampled(spark, sf_dir):
    """Rows as samples at a third of their rate and at one and a half of it, as 16-bit integers."""
    total = lambda a: F.aggregate(nu.pcm16(a), F.lit(0).cast("long"), lambda s, x: s + x)
    e = table(spark, sf_dir, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    e = e.withColumns({"down": nu.resample(F.col("x"), 48000, 16000), "up": nu.resample(F.col("x"), 64, 96)})
    return e.select("vec_id", F.size("down").alias("n"), total(F.col("down")).alias("sum_down"), total(F.col("up")).alias("sum_up"))


@query("""
WITH s AS (SELECT vec_id // 4 AS doc, i, sum(x) AS t FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL), n AS (SELECT doc, sqrt(sum(t * t)) AS norm FROM s GROUP BY doc)
SELECT doc::BIGINT AS doc, i::INT AS pos, round(t / norm, 6) + 0.0 AS x FROM s JOIN n USING (doc)""")
def pooled_windows(spark, sf_dir):
    """Vectors of a long document's windows (four ids a document) summed and made of length one."""
    e = table(spark, sf_dir, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 4))
    return vec.pooled(e, "doc").select("doc", F.posexplode("vector").alias("pos", "x")).withColumn("x", F.round("x", 6) + 0.0)


@query("SELECT doc_id, (i - 1)::INT AS win, len(w)::INT AS n FROM (SELECT doc_id, unnest(generate_series(1, greatest(1, ceil(len(t) / 512.0)::BIGINT))) AS i, t FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\n\\t]+') AS t FROM documents)), LATERAL (SELECT t[(i - 1) * 512 + 1 : i * 512] AS w) WHERE len(w) > 0")
def token_windows(spark, sf_dir):
    """Texts in windows of 512 words, the last one shorter."""
    return vec.windows(table(spark, sf_dir, "documents"), F.regexp_extract_all("text", F.lit(r"[^ \n\t]+"), F.lit(0))).select("doc_id", F.col("window").alias("win"), F.size("part").alias("n"))


@query(r"""
SELECT c_custkey, CASE WHEN a = b THEN -1 ELSE (list_position(list_transform(range(1, greatest(length(a), length(b)) + 1), lambda i: substr(a, i, 1) = substr(b, i, 1)), false) - 1)::INT END AS differs,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE a END AS heard, (CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END * c_custkey / 100.0)::DECIMAL(18,2) AS amount, 'customer Name ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS spoken, '{"k":' || c_custkey || '}' AS body
FROM (SELECT *, c_name AS a, left(c_name, (c_custkey % 25)::INT) || substr('#' , 1, (c_custkey % 2)::INT) AS b FROM customer)""")
def small_text_rules(spark, sf_dir):
    """First difference, transcript clean-up, numbers with their sign last, names spelled out, JSON in a fence."""
    c = table(spark, sf_dir, "customer").selectExpr("*", "concat(left(c_name, cast(c_custkey % 25 as int)), substr('#', 1, cast(c_custkey % 2 as int))) AS b")
    heard = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" ["), "c_name", F.lit("] "))).otherwise(F.col("c_name"))
    number = F.concat(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.when(F.col("c_custkey") % 2 == 0, "-").otherwise("+"))
    fenced = F.concat(F.lit("text\n```json\nx {\"k\":"), F.col("c_custkey").cast("string"), F.lit("} y\n```\n"))
    return c.select(
        "c_custkey", tx.first_difference(F.col("c_name"), F.col("b")).alias("differs"), tx.clean_transcript(heard).alias("heard"), tx.trailing_sign_number(number).alias("amount"),
        tx.expand_name(F.concat(F.lit("cust-name-"), "c_mktsegment"), {"cust": "customer"}).alias("spoken"), tx.json_body(fenced).alias("body"),
    )


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS allowed, 'Cust ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' x' AS pretty FROM customer")
def cited_paths(spark, sf_dir):
    """Whether all cited paths are on a list, and identifiers made readable."""
    cited = F.array(F.lit("BUILDING"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.all_allowed(cited, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).alias("allowed"), tx.prettify(F.concat(F.lit("CUST_"), "c_mktsegment", F.lit("-x"))).alias("pretty"))
