"""Queries over files, bundles, code metrics, classes by structure, and order records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import program as pr
from ..operators import reports as rep
from ..operators import trading as tr
from ..operators import vectors as vec
from ..operators.metrics_of_code import code_metrics
from ..sources.tables import front_matter, read_vectors, scan_files, table, write_files
from ..streaming.jobs import checkpoint_root
from .orders import _O, _REJECT, _checked
from .programs import _M, _members, _rows
from .registry import query

_TEXT = "SELECT string_agg('name: ' || n_name || chr(10), '' ORDER BY n_nationkey) AS t FROM nation"


@query(f"SELECT role, lower(substr(sha256(t), 1, 16)) AS sha256, 26 AS lines, (SELECT n_name FROM nation WHERE n_nationkey = 0) AS first_name FROM ({_TEXT}), (VALUES ('source'), ('test'), ('documentation')) r(role)")
def scanned_files(spark, sf_dir):
    """Files under a root with their roles, hashes and front matter; build output is skipped."""
    root = f"{checkpoint_root(spark)}/scan-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.concat(F.lit("name: "), "n_name").alias("value"))
    for folder in ("src", "tests", "docs", "obj"):
        lines.write.text(f"{root}/{folder}/x")
    return scan_files(spark, root, "*.txt").select("role", "sha256", "lines", front_matter(F.col("text"), "name").alias("first_name"))


@query("SELECT n_nationkey, n_name || ' x' AS name, n_regionkey * 1.5 AS rate FROM nation")
def test_vectors(spark, sf_dir):
    """Comma-separated vectors with a header, blank lines and remarks."""
    path = f"{checkpoint_root(spark)}/vectors-{uuid.uuid4().hex}"
    n = table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey")
    row = F.concat_ws(" , ", "n_nationkey", F.concat("n_name", F.lit(" x ")), (F.col("n_regionkey") * 1.5).cast("string"))
    both = F.when(F.col("n_nationkey") == 0, F.array(F.lit("key,name,rate"), F.lit("# remark"), F.lit(""), row)).otherwise(F.array(row, F.lit("# 1,2,3")))
    n.select(F.explode(both).alias("value")).write.text(path)
    return read_vectors(spark, path, "n_nationkey int, name string, rate double")


@query(f"""
SELECT o_orderkey, CASE WHEN reason IS NULL THEN 'FILLED' ELSE 'REJECTED' END AS status, reason, CASE WHEN reason IS NULL THEN 'validated ' || symbol || ' | routed' ELSE 'received' END AS journal FROM (SELECT o_orderkey, symbol, {_REJECT} AS reason FROM ({_O}))""")
def order_records(spark, sf_dir):
    """Orders as they are stored: status, reason and journal."""
    journal = F.when(F.col("reason").isNull(), F.array(F.concat(F.lit("validated "), "symbol"), F.lit("routed"))).otherwise(F.array(F.lit("received")))
    status, joined = tr.order_record(F.col("reason"), journal)
    return _checked(spark, sf_dir).select("o_orderkey", status.alias("status"), "reason", joined.alias("journal"))


@query("SELECT p_brand, CASE WHEN count(*) FILTER (p_size % 2 = 0) >= count(*) FILTER (p_size % 2 = 1) THEN 'Non-functional' ELSE 'Functional' END AS kind FROM part GROUP BY 1")
def cluster_kinds(spark, sf_dir):
    """The kind of most of a cluster's members, equal numbers being non-functional."""
    members = table(spark, sf_dir, "part").withColumn("role", F.when(F.col("p_size") % 2 == 0, "Non-functional").otherwise("Functional"))
    return rep.cluster_kind(members, "p_brand", "role")


_FRONT = "'---' || chr(10) || 'type: ' || {0} || chr(10) || 'title: ' || {1} || chr(10) || 'status: draft' || chr(10) || 'verified: null' || chr(10) || '---' || chr(10) || '# ' || {1} || chr(10) || chr(10)"


@query(f"""
WITH {_M}, b AS (SELECT nation AS community, artifact, min(CASE WHEN access = 'READS' THEN 0 ELSE 1 END) AS r FROM acc JOIN s USING (k) WHERE access = 'READS' OR (access = 'UPDATES' AND confidence <> 'unresolved') GROUP BY ALL),
l AS (SELECT community, array_to_string(list(artifact ORDER BY r, artifact)[1:2], ' / ') AS label FROM b GROUP BY community), mem AS (SELECT nation AS community, string_agg('P' || k, ', ' ORDER BY 'P' || k) AS members FROM s GROUP BY nation),
d AS (SELECT artifact, count(DISTINCT nation) AS communities, count(DISTINCT k) FILTER (access = 'UPDATES') AS writers, count(DISTINCT k) AS holders FROM acc JOIN s USING (k) WHERE confidence <> 'unresolved' GROUP BY artifact)
SELECT 'okf/index.md' AS path, '---' || chr(10) || 'okf_version: "0.2"' || chr(10) || 'title: domain map' || chr(10) || 'status: draft' || chr(10) || 'verified: null' || chr(10) || '---' || chr(10) || '# Domain map' || chr(10) || chr(10) || count(DISTINCT nation) || ' communities over ' || count(*) || ' programs.' || chr(10) AS text FROM s
UNION ALL SELECT 'okf/communities/community-' || community || '.md', {_FRONT.format("'Domain'", 'label')} || 'Members: ' || members || '.' || chr(10) FROM l JOIN mem USING (community)
UNION ALL SELECT * FROM (SELECT 'okf/boundaries/' || lower(artifact) || '.md', {_FRONT.format("'Boundary'", 'artifact')} || 'Held by ' || holders || ' programs.' || chr(10) FROM d ORDER BY holders DESC, artifact LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'okf/contracts/' || lower(artifact) || '.md', {_FRONT.format("'Contract'", 'artifact')} || 'Crossing: ' || CASE WHEN writers = 0 THEN 'read-only' ELSE 'write crossing' END || '.' || chr(10) FROM d WHERE communities >= 2 ORDER BY communities DESC, artifact LIMIT 4)""")
def bundle_files(spark, sf_dir):
    """A knowledge bundle, written as files and read back."""
    rows, members = _rows(spark, sf_dir), _members(spark, sf_dir)
    access, edges = pr.data_access(rows), pr.evidence_edges(rows)
    data = pr.contracts(members, access, edges).filter("kind <> 'Copybook'")
    held = access.filter("confidence <> 'unresolved'").groupBy("artifact").agg(F.countDistinct("program").alias("holders"))
    path = f"{checkpoint_root(spark)}/bundle-{uuid.uuid4().hex}"
    write_files(rep.bundle(members, pr.community_labels(members, access, edges).select("community", "label"), data, held), path)
    return spark.read.schema("value string, file string").text(path, wholetext=True).select(F.col("file").alias("path"), F.regexp_replace("value", r"\n\z", "").alias("text"))


_SOURCE = {
    "name": "concat('S', s_suppkey)",
    "source": """concat('public class A', s_suppkey, ' {', chr(10), '  private const int Max = 50;', CASE WHEN s_suppkey % 2 = 0 THEN ' // TODO later' ELSE '' END, chr(10), '  public int F(int a, Map<int, int> b) {', chr(10),
      repeat(concat('    if (a > 0 && b.Ok) { Write("if (x) {"); a = 7; }', chr(10)), cast(s_suppkey % 5 as int)), '    return a == 1 ? 3 : 4;', chr(10), '  }', chr(10), '  public int G() => 5;', chr(10), '}', chr(10), CASE WHEN s_suppkey % 3 = 0 THEN concat('class B { A', s_suppkey, ' a; /* hack */ }') ELSE '' END)""",
}


@query("""
WITH s AS (SELECT s_suppkey AS k, (s_suppkey % 5)::INT AS n FROM supplier)
SELECT 'S' || k AS name, 1 + (k % 3 = 0)::INT AS types, 2 AS methods, 2 + 2 * n AS complexity, CASE WHEN n > 0 THEN 3 ELSE 1 END AS nesting, 3 + n AS lines, 2 AS parameters, n + 3 AS magic_numbers, (k % 2 = 0)::INT + (k % 3 = 0)::INT AS todos, CASE WHEN k % 3 = 0 THEN 'B -> A' || k ELSE '' END AS dependencies FROM s""")
def source_metrics(spark, sf_dir):
    """Metrics of generated sources."""
    sources = table(spark, sf_dir, "supplier").selectExpr(*(f"{e} AS {n}" for n, e in _SOURCE.items()))
    return code_metrics(sources).withColumn("dependencies", F.array_join("dependencies", ","))


_CALLS = "SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings WHERE vec_id % 4 <> 3 UNION SELECT vec_id, vec_id - vec_id % 12 FROM embeddings WHERE vec_id % 12 <> 0"


@query(f"""
WITH RECURSIVE n AS (SELECT vec_id AS v FROM embeddings), e AS (SELECT a, b FROM ({_CALLS}) WHERE b IN (SELECT v FROM n)), given AS (SELECT v FROM n WHERE v % 50 = 49),
shared AS (SELECT b AS v FROM e WHERE b % 3 = 0 GROUP BY b HAVING count(DISTINCT a) >= 2), gone AS (SELECT v FROM shared UNION SELECT v FROM given),
i AS (SELECT a, b FROM e WHERE a NOT IN (SELECT v FROM gone) AND b NOT IN (SELECT v FROM gone)), u AS (SELECT a, b FROM i UNION SELECT b, a FROM i),
r AS (SELECT v, v AS root FROM n WHERE v NOT IN (SELECT v FROM gone) UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.v), c AS (SELECT v, min(root) AS label FROM r GROUP BY v),
p AS (SELECT label, pos, sum(x) AS t FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM c JOIN (SELECT vec_id, embedding FROM embeddings) q ON q.vec_id = c.v) GROUP BY ALL),
dm AS (SELECT vec_id AS domain, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE vec_id IN (1, 2, 5, 7, 10)),
sc AS (SELECT label, domain, round(sum(t * x), 9) AS sim FROM p JOIN dm USING (pos) GROUP BY ALL), best AS (SELECT label, arg_min(domain, (-sim, domain)) AS domain FROM sc GROUP BY label),
placed AS (SELECT v, domain FROM c JOIN best USING (label)), votes AS (SELECT e.b AS v, domain, count(DISTINCT a) AS n FROM e JOIN placed ON placed.v = e.a WHERE e.b IN (SELECT v FROM shared) GROUP BY ALL)
SELECT v AS name, domain, 'component' AS how FROM placed
UNION ALL SELECT v, (SELECT arg_min(domain, (-n, domain)) FROM votes WHERE votes.v = s.v), 'callers' FROM shared s WHERE v NOT IN (SELECT v FROM given) UNION ALL SELECT v, 10, 'given' FROM given""")
def structural_classes(spark, sf_dir):
    """Classes by components of calls and their pooled vectors, shared data by its callers, crossing programs as given."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    programs = e.select(v.alias("name"), F.when(v % 3 == 0, "Data").otherwise("Logic").alias("layer"), F.col("embedding").alias("vector"))
    calls = e.filter(v % 4 != 3).select(v.alias("source"), (v + 1).alias("target")).union(e.filter(v % 12 != 0).select(v, v - v % 12)).distinct()
    domains = e.filter(v.isin(1, 2, 5, 7, 10)).select(v.alias("domain"), F.col("embedding").alias("vector"))
    return vec.structural_classes(programs, calls, domains, e.filter(v % 50 == 49).select(v.alias("name"), F.lit(10).cast("long").alias("domain")))


@query()
def supervised_leave_one_out(spark, sf_dir):
    """Labels by a regression on components that is fitted without the row, and how many are right."""
    found = vec.supervised_leave_one_out(table(spark, sf_dir, "embeddings"))
    return found.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("hits"))
