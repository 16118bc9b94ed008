"""Small report operators: chunks, ingest of scores, grades, tier curves, ordered members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored
from ..sources.tables import small
from .medians import medians


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1400) -> DataFrame:
    """(id, chunk, body): a text in pieces of at most `size` characters; an empty text has none."""
    n = F.ceil(F.length(text_col) / F.lit(float(size))).cast("int")
    each = docs.filter(F.length(text_col) > 0).select(id_col, text_col, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return each.select(id_col, "chunk", F.substring(F.col(text_col), F.col("chunk") * size + 1, F.lit(size)).alias("body"))


def trace_verdict(known: Column, given: Column, used: Column, right: Column) -> Column:
    """Where a fact was lost: never known, not given, given but unused, used but wrong, or not at all."""
    return F.when(~known, "absent").when(~given, "not-given").when(~used, "unused").when(~right, "wrong").otherwise("carried")


def ingest_scores(rows: DataFrame, slots: DataFrame, top: int = 5, note: int = 400) -> DataFrame:
    """Rows (slot, score, note) of known slots, scores held to 1 to `top`, notes cut; where no slots are given all are known."""
    known = rows if slots.isEmpty() else rows.join(small(slots), "slot", "left_semi")
    return known.select("slot", F.greatest(F.lit(1), F.least(F.lit(top), "score")).alias("score"), F.left("note", F.lit(note)).alias("note"))


def ranking(entries: DataFrame, slots: DataFrame) -> DataFrame:
    """(slot, place): known slots in the order in which they are first named; entries are (position, slot)."""
    known = entries.join(slots.select("slot"), "slot", "left_semi").groupBy("slot").agg(F.min("position").alias("position"))
    return known.select("slot", F.row_number().over(Window.orderBy("position", "slot")).alias("place"))  # a row a slot


# Bounds of a review event.
SEQUENCES, STAGE_LENGTH, TEXT_LENGTH = (1, 20), 80, 500


def valid_event(sequence: Column, stage: Column, evidence: Column, decision: Column) -> Column:
    """Whether a review event is within its bounds: its number, and texts that are not blank and not too long."""
    good = lambda c, n: F.coalesce((F.regexp_replace(c, r"\s", "") != "") & (F.length(c) <= n), F.lit(False))
    return F.coalesce(sequence.between(*SEQUENCES), F.lit(False)) & good(stage, STAGE_LENGTH) & good(evidence, TEXT_LENGTH) & good(decision, TEXT_LENGTH)


def review_trace(events: DataFrame) -> DataFrame:
    """Valid events in order of sequence, of each (session, sequence) the one that came first: (session, place, sequence, stage, arrived)."""
    good = events.filter(valid_event(F.col("sequence"), F.col("stage"), F.col("evidence"), F.col("decision")))
    first = good.groupBy("session", "sequence").agg(F.min_by(F.struct("stage", "arrived"), "arrived").alias("e"))  # an event a sequence, twenty a session at most
    return first.select("session", F.row_number().over(Window.partitionBy("session").orderBy("sequence")).alias("place"), "sequence", "e.stage", "e.arrived")


def for_profile(bridge: Column, in_process: Column, full: bool, allowed: bool) -> Column:
    """Whether a step is for a profile: one that needs the bridge only in full, one that runs in process only where that is allowed."""
    return (F.lit(full) | ~bridge) & (F.lit(allowed) | ~in_process)


REFERENCE = "§([A-Z]{2}-[A-Z]+)"


def renumber(segments: DataFrame) -> DataFrame:
    """(doc, number, id, title, body): segments (doc, position, id, title, body) numbered from 1 in each doc, with §ID of a segment of the doc made §number.

    References are joined by (doc, id) and replaced, the longest id first, so that none is taken for the beginning of another.
    """
    numbered = segments.withColumn("number", F.row_number().over(Window.partitionBy("doc").orderBy("position")))
    cited = numbered.select("doc", "number", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(REFERENCE), F.lit(1)))).alias("target"))
    known = numbered.groupBy("doc", F.col("id").alias("target")).agg(F.min("number").alias("becomes"))
    swaps = cited.join(known, ["doc", "target"]).groupBy("doc", "number").agg(F.sort_array(F.collect_list(F.struct(F.length("target").alias("n"), "target", "becomes")), asc=False).alias("swaps"))
    body = F.aggregate(F.coalesce("swaps", F.array().cast("array<struct<n:int,target:string,becomes:int>>")), F.col("body"), lambda b, s: F.regexp_replace(b, F.concat(F.lit("§"), s["target"], F.lit("(?![A-Z])")), F.concat(F.lit("§"), s["becomes"].cast("string"))))
    return numbered.join(swaps, ["doc", "number"], "left").select("doc", "number", "id", "title", F.trim(body).alias("body"))


def sections(rendered: DataFrame) -> DataFrame:
    """(doc, text): segments (doc, number, title, body) under their headings, in order."""
    block = F.concat(F.lit("## Section "), F.col("number").cast("string"), F.lit(" — "), "title", F.lit("\n"), F.trim("body"))
    return rendered.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", block.alias("block")))), lambda s: s["block"]), "\n\n").alias("text"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def tier_curve(runs: DataFrame) -> DataFrame:
    """(tier, median, low, high, run): of runs (tier, run, score), cut-off median and the first run that has it (null if none)."""
    kind = runs.schema["score"].dataType
    m = medians(runs, "tier", "score").select("tier", F.floor("median").cast("int").alias("median"), F.col("low").cast(kind).alias("low"), F.col("high").cast(kind).alias("high"))
    hit = runs.join(m.select("tier", "median"), "tier").filter("score = median").groupBy("tier").agg(F.min("run").alias("run"))
    return m.join(hit, "tier", "left")


def degradation(tiers: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: the tiers of the best and the worst median score, the drop, the criteria that the best one's median run met and the worst one's did not, and the last tier that keeps 80 percent of the best.

    Tiers are (tier, index), runs (tier, run, status, score, met). Only tiers with a completed run count, and only such runs; with fewer than
    two tiers there is no row. Of equal medians the first tier by index is best or worst; a median that no run has met no criteria.
    """
    done = runs.filter("status = 'completed'")
    curve = stored(tier_curve(done).join(tiers, "tier").select("tier", "index", "median", "run"))
    met = curve.join(done.select("tier", "run", "met"), ["tier", "run"], "left")
    each = F.struct("tier", "median", F.coalesce("met", F.array().cast("array<string>")).alias("met"))
    ends = met.agg(F.max_by(each, F.struct("median", -F.col("index"))).alias("best"), F.min_by(each, F.struct("median", "index")).alias("worst"), F.countDistinct("tier").alias("n")).filter("n >= 2")
    floor = curve.crossJoin(F.broadcast(ends.select(F.col("best.median").alias("top")))).filter(F.col("median") >= 0.8 * F.col("top")).agg(F.max_by("tier", "index").alias("floor_tier"))  # one row
    lost = F.array_sort(F.array_except("best.met", "worst.met"))
    return ends.crossJoin(floor).select(F.col("best.tier").alias("best"), F.col("worst.tier").alias("worst"), (F.col("best.median") - F.col("worst.median")).alias("drop_"), lost.alias("lost"), "floor_tier")


def members(rows: DataFrame, group: str, member: str, separator: str = ", ") -> DataFrame:
    """(group, members, n): distinct members in order, joined."""
    return rows.select(group, member).distinct().groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(member)), separator).alias("members"), F.count("*").alias("n"))


def cluster_kind(members: DataFrame, cluster: str, role: str) -> DataFrame:
    """(cluster, kind): functional only where more members are functional than not."""
    functional, other = F.count_if(F.col(role) == "Functional"), F.count_if(F.col(role) == "Non-functional")
    return members.groupBy(cluster).agg(F.when(other >= functional, "Non-functional").otherwise("Functional").alias("kind"))


def bundle(members: DataFrame, labels: DataFrame, contracts: DataFrame, boundaries: DataFrame, root: str = "okf", top_boundaries: int = 3, top_contracts: int = 4) -> DataFrame:
    """(path, text): a knowledge bundle in markdown: an index, a file for each community, the widest boundaries and contracts (a report of the first few).

    Members are (program, community), labels (community, label), contracts (artifact, communities, crossing), boundaries (artifact, holders).
    """
    front = lambda kind, title: F.concat(F.lit("---\ntype: "), F.lit(kind), F.lit("\ntitle: "), title, F.lit("\nstatus: draft\nverified: null\n---\n# "), title, F.lit("\n\n"))
    listed = members.groupBy("community").agg(F.array_join(F.array_sort(F.collect_set("program")), ", ").alias("members")).join(labels, "community")
    community = listed.select(F.concat(F.lit(f"{root}/communities/community-"), F.col("community").cast("string"), F.lit(".md")).alias("path"), F.concat(front("Domain", F.col("label")), F.lit("Members: "), "members", F.lit(".\n")).alias("text"))
    widest = boundaries.orderBy(F.desc("holders"), "artifact").limit(top_boundaries)
    boundary = widest.select(F.concat(F.lit(f"{root}/boundaries/"), F.lower("artifact"), F.lit(".md")).alias("path"), F.concat(front("Boundary", F.col("artifact")), F.lit("Held by "), F.col("holders").cast("string"), F.lit(" programs.\n")).alias("text"))
    first = contracts.orderBy(F.desc("communities"), "artifact").limit(top_contracts)
    contract = first.select(F.concat(F.lit(f"{root}/contracts/"), F.lower("artifact"), F.lit(".md")).alias("path"), F.concat(front("Contract", F.col("artifact")), F.lit("Crossing: "), "crossing", F.lit(".\n")).alias("text"))
    sums = members.agg(F.countDistinct("community").alias("c"), F.countDistinct("program").alias("p"))
    index = sums.select(F.lit(f"{root}/index.md").alias("path"), F.concat(F.lit('---\nokf_version: "0.2"\ntitle: domain map\nstatus: draft\nverified: null\n---\n# Domain map\n\n'), F.col("c").cast("string"), F.lit(" communities over "), F.col("p").cast("string"), F.lit(" programs.\n")).alias("text"))
    return index.union(community).union(boundary).union(contract)
