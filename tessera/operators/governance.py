"""Registration tiers, action authority, controls, contracts, answer keys, economics, graph questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

# Ordered scales; the position in a scale counts.
BLAST = ("file", "repo", "team-system", "production", "customer")
AUTONOMY = ("Suggests", "Acts-with-approval", "Acts-autonomously")
DATA = ("Public", "Internal", "Confidential", "Restricted")

# Controls with the tier from which each is required, the tier from which it is advised, the word for that, and whether tools alone require it.
CONTROLS = (
    ("named owner", 0, 0, "", False), ("accountable human", 0, 0, "", False), ("default guardrails", 0, 0, "", False), ("human review", 0, 0, "", False), ("pinned model", 1, 1, "", False), ("prompt regression tests", 1, 1, "", False),
    ("action envelope", 2, 2, "", True), ("reviewer competency", 2, 1, "Recommended", False), ("trap QA", 2, 2, "", False), ("drift gate", 2, 1, "Opportunistic", False), ("runtime logging", 2, 2, "", False),
    ("gold eval set", 3, 3, "", False), ("kill switch tested", 3, 3, "", False), ("incident responder", 3, 3, "", False), ("second-model check", 3, 3, "", False),
)

# Fields without which no agent is registered, and those that one with tools needs besides.
FIELDS = ("owner", "release_id", "model", "data_tier", "autonomy", "blast_radius", "agent_status")
TOOL_FIELDS = ("runtime_identity", "action_policy", "approval_mode")

# Actions with reversible, production, customer-visible, security, in-envelope.
ACTIONS = (
    ("read-repo", True, False, False, False, True), ("draft-pr", True, False, False, False, True), ("run-tests", True, False, False, False, True),
    ("write-branch", True, False, False, False, True), ("merge-main", False, False, False, False, True), ("force-push", False, False, False, False, True),
    ("deploy-prod", False, True, False, False, True), ("alter-iam", False, True, False, True, True), ("email-customer", False, True, True, False, True),
    ("drop-table", False, True, False, False, True), ("write-other-repo", True, False, False, False, False),
)


def level(value: Column, scale: tuple[str, ...]) -> Column:
    """Position from 0 in a scale, case ignored; 0 where it is not there."""
    found = F.array_position(F.array(*(F.lit(s.lower()) for s in scale)), F.lower(F.coalesce(value, F.lit(""))))
    return F.greatest(found - 1, F.lit(0)).cast("int")


def risk_tier(blast: Column, autonomy: Column, data: Column) -> Column:
    """An agent's own tier: the highest floor that any axis, or autonomy with reach, sets; never an average."""
    b, a, d = level(blast, BLAST), level(autonomy, AUTONOMY), level(data, DATA)
    floors = (((b >= 1) | (d >= 1), 1), (b >= 2, 2), (d == 2, 2), (d == 3, 3), (b >= 3, 3), ((a == 2) & (b >= 2), 3))
    return F.greatest(F.lit(0), *(F.when(c, t).otherwise(0) for c, t in floors))


def inherited(agents: DataFrame, invokes: DataFrame) -> DataFrame:
    """(agent, tier): the largest tier among an agent and all that it invokes, directly or through others; cycles share one.

    Agents are (agent, tier), invokes (caller, callee). Only agents whose tier rose in a round offer it to their callers in
    the next, so a round's work follows what changed; there are as many rounds as the longest chain along which a tier
    rises. Invocations of agents that are not registered, and null tiers, add nothing.
    """
    tiers = stored(agents.groupBy("agent").agg(F.coalesce(F.max("tier"), F.lit(0)).alias("tier")))
    invokes = stored(invokes.filter("caller <> callee").select("caller", "callee").distinct())
    rising = tiers.filter("tier > 0")
    while True:
        offers = invokes.join(rising.withColumnRenamed("agent", "callee"), "callee").groupBy(F.col("caller").alias("agent")).agg(F.max("tier").alias("offer"))
        rising = stored(offers.join(tiers, "agent").filter("offer > tier").select("agent", F.col("offer").alias("tier")))
        if rising.isEmpty():
            return tiers
        tiers = stored(tiers.join(rising.withColumnRenamed("tier", "rose"), "agent", "left").select("agent", F.greatest("tier", "rose").alias("tier")))


def missing_fields(tools: Column, model: Column, fields: tuple[str, ...] = FIELDS, tool_fields: tuple[str, ...] = TOOL_FIELDS) -> Column:
    """Names of required columns that are blank, of those that an agent with tools needs, and of a model that is no pinned version."""
    blank = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(r"\S")
    floating = model.rlike(r"\S") & (F.contains(F.lower(model), F.lit("latest")) | ~model.rlike(r"\d"))
    need = [F.when(blank(c), F.lit(c)) for c in fields] + [F.when(F.coalesce(tools, F.lit(False)) & blank(c), F.lit(c)) for c in tool_fields]
    return F.array_compact(F.array(*need, F.when(floating, F.lit("pinned model"))))


def control_rule(tier: Column, tools: Column) -> Column:
    """What a control (columns of CONTROLS) is to an agent of a tier, with tools or without."""
    c = F.col
    return (
        F.when(tier >= c("required"), "Required").when(c("for_tools") & F.coalesce(tools, F.lit(False)), "Required (tool-enabled)")
        .when(tier >= c("advised"), c("advice")).otherwise("Not required")
    )


def authority(registrable: Column, autonomy: Column) -> Column:
    """Verdict on an action (columns of ACTIONS): the first rule that applies."""
    c = F.col
    return (
        F.when(~registrable | ~c("in_envelope"), "DENY").when(c("customer_visible") | c("security") | ~c("reversible") | c("production"), "APPROVE")
        .when(F.lower(autonomy) == "suggests", "PROPOSE").when(F.lower(autonomy) == "acts-autonomously", "AUTO").otherwise("APPROVE")
    )


def undeclared(required: DataFrame, declared: DataFrame) -> DataFrame:
    """Required tokens that no declared token is, nor any declared `prefix*` begins. Patterns join by each prefix of a token, an equality."""
    exact = declared.filter("not endswith(token, '*')")
    prefixes = declared.filter("endswith(token, '*')").select(F.expr("left(token, length(token) - 1)").alias("prefix")).distinct()
    left = required.join(exact, "token", "left_anti")
    cut = left.select("token", F.explode(F.transform(F.sequence(F.lit(0), F.length("token")), lambda n: F.left(F.col("token"), n))).alias("prefix"))
    return left.join(cut.join(prefixes, "prefix", "left_semi").select("token").distinct(), "token", "left_anti")


def answer_key(key: DataFrame, given: DataFrame, on: str, value: str = "value") -> DataFrame:
    """(on, passed): every key entry; an answer that is missing fails, others compare trimmed and in upper case."""
    norm = lambda c: F.upper(F.trim(c.cast("string")))
    both = key.select(on, F.col(value).alias("want")).join(given.select(on, F.col(value).alias("got")), on, "left")
    return both.select(on, F.coalesce(norm(F.col("want")) == norm(F.col("got")), F.lit(False)).alias("passed"))


def bind_columns(uses: DataFrame, columns: DataFrame) -> DataFrame:
    """(use, owner): the scoped table's column, else the only table that has the name, else null.

    `uses` is (use, scope, column), `columns` is (owner, column).
    """
    scoped = columns.select(F.col("owner").alias("scope"), "column", F.col("owner").alias("own"))
    only = columns.groupBy("column").agg(F.count("*").alias("n"), F.min("owner").alias("other")).filter("n = 1").select("column", "other")
    return uses.join(scoped, ["scope", "column"], "left").join(only, "column", "left").select("use", F.coalesce("own", "other").alias("owner"))


def economics(runs: DataFrame) -> DataFrame:
    """(rung, cost, success, cost_per_success): a failed attempt still costs. Runs are (rung, cost, ok)."""
    g = runs.groupBy("rung").agg(F.avg("cost").alias("cost"), (100.0 * F.count_if("ok") / F.count("*")).alias("success"))
    return g.withColumn("cost_per_success", F.when(F.col("success") > 0, F.col("cost") * 100.0 / F.col("success")).otherwise(0.0))


def step_problems(steps: DataFrame, scenes: DataFrame) -> DataFrame:
    """(subject, problem): what leaves a step unconstrained, and scenes (scene) that no step covers.

    Steps are (step, scene, kind, selector, wait, wait_key, value, facts); a step without facts, one that does not observe but has
    no selector, a wait for a state without a key, a selection or entry without a value. A step may have several problems.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = {
        "facts": F.coalesce("facts", F.lit(0)) == 0, "selector": (F.col("kind") != "Observe") & blank("selector"),
        "wait key": (F.col("wait") == "State") & blank("wait_key"), "value": F.col("kind").isin("Select", "Fill") & F.col("value").isNull(),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    own = steps.select(F.col("step").cast("string").alias("subject"), F.explode(found).alias("problem"))
    bare = scenes.join(steps.select("scene").distinct(), "scene", "left_anti").select(F.concat(F.lit("scene "), F.col("scene").cast("string")).alias("subject"), F.lit("coverage").alias("problem"))
    return own.union(bare)


def answer_checks(key: DataFrame, given: DataFrame, on: str) -> DataFrame:
    """(on, passed) of every key entry (on, want, kind): texts compare trimmed, rows of fields with or without their last separator and line end, hexadecimal ones without case, blanks, hyphens and 0x; an answer that is missing fails."""

    def row(c: Column) -> Column:
        cut = F.regexp_replace(c, r"[\r\n]+\z", "")
        return F.when(cut.endswith("|"), cut).otherwise(F.concat(cut, F.lit("|")))

    digits = lambda c: F.replace(F.upper(F.regexp_replace(c, r"[\s-]", "")), F.lit("0X"), F.lit(""))
    same = lambda f: f(F.col("want")) == f(F.col("got"))
    both = key.select(on, "want", "kind").join(given.select(on, "got"), on, "left")
    passed = F.when(F.col("kind") == "hex", same(digits)).when(F.col("kind") == "row", same(row)).otherwise(same(F.trim))
    return both.select(on, F.coalesce(passed, F.lit(False)).alias("passed"))
