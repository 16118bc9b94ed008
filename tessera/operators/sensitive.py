"""Assessment of texts by the ordered detectors: findings, tier, decision, redacted text, incident."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sensitive import DECISIONS, DETECTORS, TIERS, ascii_pattern, by_tier, incident, luhn, mask, matches, redact


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", beside: bool = False) -> DataFrame:
    """id, findings (array of label, category, tier, count, sample), tier, tier_name, decision, redacted, incident (severity, responder, due, steps).

    Every detector reads the text that the one before left. A blocked text's `redacted` is empty.
    A detector skips texts that lack a string which all of its matches hold. `beside` is for SQL without look-around (see `redact`).
    """
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t0"))
    for k, d in enumerate(DETECTORS):
        out = out.withColumn(f"m{k}", matches(F.col(f"t{k}"), d)).withColumn(f"t{k + 1}", F.when(F.size(f"m{k}") > 0, redact(F.col(f"t{k}"), d, beside)).otherwise(F.col(f"t{k}")))
    found = F.filter(
        F.array(*(F.struct(F.lit(d.name).alias("label"), F.lit(d.category).alias("category"), F.lit(d.tier).alias("tier"), F.size(f"m{k}").alias("count"), mask(F.get(F.col(f"m{k}"), 0)).alias("sample")) for k, d in enumerate(DETECTORS))),
        lambda f: f["count"] > 0,
    )
    out = out.select("id", found.alias("findings"), F.col(f"t{len(DETECTORS)}").alias("left"))
    tier = F.coalesce(F.array_max(F.transform("findings", lambda f: f["tier"])), F.lit(0))
    out = out.withColumn("tier", tier)
    decision = by_tier(F.col("tier"), DECISIONS)
    return out.select(F.col("id").alias(id_col), "findings", "tier", by_tier(F.col("tier"), TIERS).alias("tier_name"), decision.alias("decision"), F.when(decision == "BLOCK", "").otherwise(F.col("left")).alias("redacted"), incident(F.col("tier"), F.transform("findings", lambda f: f["category"])).alias("incident"))


def card_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, candidate, valid) of every run that looks like a card number."""
    pan = next(d for d in DETECTORS if d.checked)
    runs = docs.select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(ascii_pattern(pan.pattern)), F.lit(0))).alias("candidate"))
    return runs.withColumn("valid", luhn(F.col("candidate")))
