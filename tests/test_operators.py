import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.policy import Compiled, PolicyError, kind_of, mutants, parse
from tessera.functions.sensitive import DETECTORS, luhn, redact
from tessera.operators import graph, metrics, program, trading
from tessera.operators.sensitive import assess
from tessera.plans.policies import SHIPPING
from tessera.sources.tables import front_matter, hash_id, scan_files, upsert


def values(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_text_functions(spark):
    got = values(
        spark, tx.collapse(F.lit("  a \n b ")), tx.normal(F.lit("A-b  C!")), tx.tokens(F.lit("RegTMarginCalculator with 1234")), tx.ellipsis(F.lit("abcdef"), 3), tx.questions(F.lit("Is it? Yes. Why?")),
        tx.clean_transcript(F.lit("[noise]")), tx.first_difference(F.lit("abc"), F.lit("abd")), tx.first_difference(F.lit("ab"), F.lit("ab")), tx.fenced_body(F.lit("x ```json\n{}\n``` y")),
        tx.trailing_sign_number(F.lit("00001582-")), tx.hex_normal(F.lit("0x0a ff")), tx.top_level_commas(F.lit("a, f(b, c), d")), tx.expand_name(F.lit("cust-nm"), {"cust": "customer"}), tx.estimated_tokens(F.lit("abcde")),
    )
    assert got == ["a b", "a b c", ["tmargin", "calculator"], "abc…", ["Is it?", "Why?"], "", 2, -1, "{}", Decimal("-15.82"), "0AFF", ["a", "f(b, c)", "d"], "customer Nm", 2]


def test_html_text(spark):
    assert values(spark, tx.html_text(F.lit("<p>a &amp; b</p><script>x</script><!-- c --><b>d</b>"))) == ["a & b\n d"]


def test_luhn_and_redaction(spark):
    assert values(spark, luhn(F.lit("4111 1111 1111 1111")), luhn(F.lit("4111 1111 1111 1112")), luhn(F.lit("1"))) == [True, False, False]
    rows = spark.createDataFrame([(1, "mail a@b.com"), (2, "card 4111 1111 1111 1111"), (3, None), (4, "host db.corp")], "doc_id long, text string")
    got = {r.doc_id: (r.tier, r.decision, r.redacted) for r in assess(rows).collect()}
    assert got == {1: (2, "SCRUB", "mail [EMAIL_REDACTED]"), 2: (3, "BLOCK", ""), 3: (0, "ALLOW", ""), 4: (1, "ALLOW-INTERNAL", "host [INTERNAL_HOST_REDACTED]")}


def test_only_the_match_is_redacted(spark):
    """A valid card's text inside a longer run of digits that is no match, and matches that fail the checksum, stay; a match takes the blank after its last digit."""
    rows = ["4111111111111111, 99994111111111111111999999999", "4111111111111112 4111111111111111", "4111111111111111", "4111111111111111;5500005555555559 x4111111111111112", ""]
    pan = next(d for d in DETECTORS if d.checked)
    df = spark.createDataFrame(list(enumerate(rows)), "k int, t string")
    got = [r.x for r in df.orderBy("k").select(redact(F.col("t"), pan).alias("x")).collect()]
    m = pan.mark
    assert got == [f"{m}, 99994111111111111111999999999", f"4111111111111112 {m}", m, f"{m};{m}x4111111111111112", ""]


def test_incident_paths(spark):
    """Four to seven steps; the credential first, the record last; no incident below tier 2."""
    rows = [("k", "password=hunter22x"), ("c", "4111 1111 1111 1111"), ("p", "a@b.com"), ("i", "db.corp"), ("n", None)]
    got = {r.doc_id: r.incident for r in assess(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {k: (v.severity, len(v.steps)) for k, v in got.items()} == {"k": ("Sev1", 7), "c": ("Sev2", 6), "p": ("Sev3", 4), "i": ("None", 0), "n": ("None", 0)}
    assert got["k"].steps[0].startswith("revoke") and got["c"].steps[0].startswith("stop") and all(v.steps[-1].startswith("record") for v in got.values() if v.steps)
    assert got["c"].due != got["p"].due and got["i"].due == "n/a" and got["p"].responder == "Repo owner + AI Quality"


def test_policy_examples_and_errors(spark):
    assert all(ok for _, ok in Compiled(SHIPPING).run_examples(spark))
    with pytest.raises(PolicyError) as fault:
        Compiled(SHIPPING.replace("total * share * 2", "total + share"))
    assert fault.value.code == "P007"
    assert parse("not a = b").value == "=" and parse("1 + 2 * 3").value == "+"
    assert kind_of(parse("$6.00 / $2.00"), {}) == "number"
    assert len(mutants(parse("a < 2 + b"))) == 3


def test_policy_money_is_exact(spark):
    rows = spark.createDataFrame([(Decimal("1999.99"), True, True)], "total decimal(18,2), urgent boolean, open boolean")
    r = Compiled(SHIPPING).apply(rows).first()
    assert r.fee == Decimal("100.00000000") and r.fired_rule == 2 and r.failed_requirement == -1


def test_fifo_against_loop_and_overlap(spark):
    rng = random.Random(3)
    trades = [(1, i, f"2024-01-{1 + i:02d} 00:00:00", "Buy" if i < 12 else "Sell", float(rng.randint(5, 9)) if i < 12 else 4.0, float(rng.randint(1, 9))) for i in range(24)]
    df = spark.createDataFrame(trades, "key long, id long, at string, side string, quantity double, price double").withColumn("at", F.to_timestamp("at"))
    by = {(r.sell): r.m for r in trading.fifo_overlap(df).groupBy("sell").agg(F.sum("matched").alias("m")).collect()}
    got = {r.id: r for r in trading.fifo(df).collect()}
    assert all(r.short == 0 for r in got.values()) and all(by[i] == 4.0 for i in got)
    lots = [[t[4], t[5]] for t in trades if t[3] == "Buy"]
    for t in trades:
        if t[3] == "Sell":
            left, gain = t[4], 0.0
            while left:
                part = min(left, lots[0][0])
                gain += (t[5] - lots[0][1]) * part
                left -= part
                lots[0][0] -= part
                if not lots[0][0]:
                    lots.pop(0)
            assert abs(got[t[1]].realised - gain) < 1e-9


def test_business_days(spark):
    assert [str(v) for v in values(spark, trading.add_business_days(F.to_date(F.lit("2024-01-05")), 1), trading.add_business_days(F.to_date(F.lit("2024-01-04")), 2), trading.add_business_days(F.to_date(F.lit("2024-01-06")), 7))] == ["2024-01-08", "2024-01-08", "2024-01-16"]


def test_components_and_closure(spark):
    nodes = spark.range(12)
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(10, 11)], "a long, b long")
    assert {r.id: r.label for r in graph.connected(spark, edges, nodes).collect()} == {**{i: 0 for i in range(9)}, 9: 9, 10: 10, 11: 10}
    assert {r.id for r in graph.closure(spark, spark.createDataFrame([(6,)], "id long"), edges).collect()} == {6, 7, 8}


def test_communities_hang_together(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(0, 10, 0.1)], "a long, b long, weight double")
    got = graph.communities(edges, [1.0], [1, 2]).toPandas()
    for _, run in got.groupby("seed"):
        labels = run.set_index("id").label
        assert labels[range(5)].nunique() == 1 and labels[range(10, 15)].nunique() == 1 and labels.nunique() == 2


def test_histogram_is_cumulative(spark):
    rows = spark.createDataFrame([("a", 0.4), ("a", 3.0), ("a", 2000.0)], "kind string, ms double")
    got = {r.le: (r.cumulative, r.n) for r in metrics.histogram(rows, "ms", "kind").collect()}
    assert got[0.5] == (1, 3) and got[5.0] == (2, 3) and got[1000.0] == (2, 3)


def test_sources(spark, tmp_path):
    (tmp_path / "src" / "obj").mkdir(parents=True)
    (tmp_path / "src" / "a.md").write_text("title: T\nx")
    (tmp_path / "src" / "obj" / "b.md").write_text("skip")
    rows = scan_files(spark, str(tmp_path), "*.md").select("name", "role", "lines", front_matter(F.col("text"), "Title").alias("t"), (hash_id(F.col("text")) == F.col("sha256")).alias("same")).collect()
    assert [tuple(r) for r in rows] == [("a.md", "documentation", 2, "T", True)]
    old, new = (spark.createDataFrame(r, "k int, v int, x string") for r in ([(1, 1, "a"), (2, 5, "b")], [(1, 2, "c"), (2, 5, "d")]))
    assert {(r.k, r.x) for r in upsert(old, new, "k", "v").collect()} == {(1, "c"), (2, "d")}
