import random
import re

from pyspark.sql import functions as F

from tessera.operators import governance as gov
from tessera.operators import reports as rep
from tessera.operators import scoring as sc


def test_tiers_are_floors(spark):
    rows = [
        ("file", "Suggests", "Public", 0), ("repo", "Suggests", "Public", 1), ("file", "Suggests", "internal", 1), ("REPO", "acts-autonomously", "Public", 1), ("team-system", "Acts-with-approval", "Public", 2),
        ("team-system", "Acts-Autonomously", "Public", 3), ("file", "Suggests", "Confidential", 2), ("file", "Suggests", "Restricted", 3), ("production", "Suggests", "Public", 3), ("customer", None, "Public", 3),
        ("galaxy", "?", "", 0), (None, None, None, 0),
    ]
    df = spark.createDataFrame(rows, "b string, a string, d string, want int")
    assert df.filter(gov.risk_tier(F.col("b"), F.col("a"), F.col("d")) != F.col("want")).count() == 0


def test_tiers_are_inherited(spark):
    """Along chains, through cycles, from several; a hot callee; unknown agents and loops add nothing."""
    rng = random.Random(5)
    agents = [(i, 3 if i == 40 else rng.choice([0, 0, 0, 1, 2])) for i in range(60)] + [(99, None)]
    invokes = [(i, i + 1) for i in range(30, 40)] + [(50, 51), (51, 52), (52, 50), (53, 50)] + [(i, 7) for i in range(20)] + [(8, 8), (9, 777), (None, 3), (99, 50)]
    want, changed = {a: t or 0 for a, t in agents}, True
    while changed:
        new = {a: max([want[a], *(want[y] for x, y in invokes if x == a and y in want)]) for a in want}
        changed, want = new != want, new
    got = gov.inherited(spark.createDataFrame(agents, "agent int, tier int"), spark.createDataFrame(invokes, "caller int, callee int"))
    assert {r.agent: r.tier for r in got.collect()} == want and want[30] == 3
    assert gov.inherited(spark.createDataFrame(agents, "agent int, tier int"), spark.createDataFrame([], "caller int, callee int")).count() == 61


def test_required_fields(spark):
    columns = [*gov.FIELDS, *gov.TOOL_FIELDS]
    full = dict.fromkeys(columns, "v1")
    rows = [(0, True, full), (1, False, {**full, "runtime_identity": None}), (2, True, {**full, "runtime_identity": " ", "owner": "\t"}), (3, None, {**full, "model": "Latest-2"}), (4, False, {**full, "model": "two"}), (5, True, dict.fromkeys(columns))]
    df = spark.createDataFrame([(i, t, *(r[c] for c in columns)) for i, t, r in rows], f"k int, tools boolean, {', '.join(f'{c} string' for c in columns)}")
    got = {r.k: r.m for r in df.select("k", gov.missing_fields(F.col("tools"), F.col("model")).alias("m")).collect()}
    assert got == {0: [], 1: [], 2: ["owner", "runtime_identity"], 3: ["pinned model"], 4: ["pinned model"], 5: columns}


def test_controls_by_tier_and_tools(spark):
    controls = spark.createDataFrame(gov.CONTROLS, "control string, required int, advised int, advice string, for_tools boolean")
    rows = spark.createDataFrame([(t, x) for t in range(4) for x in (True, False)], "tier int, tools boolean").crossJoin(controls)
    got = {(r.tier, r.tools, r.control): r.rule for r in rows.select("tier", "tools", "control", gov.control_rule(F.col("tier"), F.col("tools")).alias("rule")).collect()}
    assert [got[t, x, "action envelope"] for t in range(4) for x in (True, False)] == ["Required (tool-enabled)", "Not required"] * 2 + ["Required"] * 4
    assert [got[t, True, "drift gate"] for t in range(4)] == ["Not required", "Opportunistic", "Required", "Required"]
    assert [got[t, True, "reviewer competency"] for t in range(4)] == ["Not required", "Recommended", "Required", "Required"]


def test_undeclared_by_prefix(spark):
    required, declared = (spark.createDataFrame([(t,) for t in ts], "token string") for ts in (["a-1", "b", "c", "ab"], ["a-*", "b", "unused"]))
    assert sorted(r.token for r in gov.undeclared(required, declared).collect()) == ["ab", "c"]


def test_answers_and_bindings(spark):
    key, given = spark.createDataFrame([(1, "x"), (2, "Y"), (3, "z")], "k int, value string"), spark.createDataFrame([(1, " X "), (2, "n")], "k int, value string")
    assert {r.k: r.passed for r in gov.answer_key(key, given, "k").collect()} == {1: True, 2: False, 3: False}
    uses = spark.createDataFrame([(1, "T", "a"), (2, "U", "a"), (3, "U", "b"), (4, "U", "none")], "use int, scope string, column string")
    columns = spark.createDataFrame([("T", "a"), ("V", "a"), ("V", "b")], "owner string, column string")
    assert {r.use: r.owner for r in gov.bind_columns(uses, columns).collect()} == {1: "T", 2: None, 3: "V", 4: None}


def test_plan_verdicts(spark):
    good = "# Executive Summary\n" + "word " * 30 + "\n## Risks\nsome\n```mermaid\n```\nverified by tests"
    rows = spark.createDataFrame([(1, good), (2, good + "\n```python\n```"), (3, "nothing"), (4, None), (5, "# Executive summary\n" + "x\n\n" * 2000)], "k int, t string")
    score, verdict, words = sc.plan_score(F.col("t"))
    got = {r.k: (r.s, r.v) for r in rows.select("k", score.alias("s"), verdict.alias("v")).collect()}
    assert got[1] == (100, "accepted") and got[2] == (83, "code") and got[3][1] == got[4][1] == got[5][1] == "incomplete"


def test_criteria_round_half_even(spark):
    rules = {f"c{i}": (w,) for i, w in enumerate("abcdefgh")}
    rows = spark.createDataFrame([("a",), ("abc",), (None,)], "t string")
    score, met, missed = sc.criteria(F.col("t"), rules)
    assert [(r.s, r.m, r.x) for r in rows.select(score.alias("s"), F.size(met).alias("m"), F.size(missed).alias("x")).collect()] == [(12, 1, 7), (38, 3, 5), (0, 0, 8)]


def test_chunks_cover_the_text(spark):
    text = "x" * 2801 + "é"
    parts = rep.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")).orderBy("chunk").collect()
    assert "".join(p.body for p in parts) == text and [p.chunk for p in parts] == [0, 1, 2]


def test_summaries_as_by_the_backtracking_pattern(spark):
    """The possessive pattern finds what the original one (fixed value) finds: presence and words, over random plans."""
    original = re.compile(r"(?im)^#{0,4}\s*executive\s+summary\s*:?\s*$\r?\n(?P<body>(?:.++\n?+)+?)(?=^#{1,4}\s|\Z)")  # its lines made atomic: else exponential
    rng = random.Random(2)
    pieces = ["# Executive summary", "executive  Summary:", "## Risks", "##### deep", "#tag", "words in a line", "  indented words", "", "", "   ", "\n", "# "]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    found = {r.k: (r.there, r.words) for r in rows.select("k", F.col("t").rlike(sc.SUMMARY).alias("there"), sc.plan_score(F.col("t"))[2].alias("words")).collect()}
    for k, t in enumerate(texts):
        m = original.search(t)
        assert found[k] == (bool(m), len([w for w in m["body"].split(" ") if w]) if m else 0), t
    assert 50 < sum(there for there, _ in found.values()) < 550

