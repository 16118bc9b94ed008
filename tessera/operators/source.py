"""Fixed-format program source to rows by expressions alone: lines, continuations, byte sizes, record layouts, declared columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored
from ..sources.tables import merged


def lines(members: DataFrame) -> DataFrame:
    """(name, line, indicator, code): columns 7 and 8 to 72 of every line."""
    each = members.select("name", F.posexplode(F.split("source", "\r?\n")).alias("at", "text"))
    return each.select("name", (F.col("at") + 1).alias("line"), F.substring("text", 7, 1).alias("indicator"), F.rtrim(F.substring("text", 8, 65)).alias("code")).filter("code <> '' or indicator = '*'")


def code(members: DataFrame) -> DataFrame:
    return lines(members).filter(~F.col("indicator").isin("*", "/")).withColumn("code", F.upper(F.trim("code")))


def picture_bytes(picture: Column, usage: Column) -> Column:
    """Bytes of an elementary item: its digits, X and A count, signs, points and editing symbols do not; an item without a picture has none."""
    body = F.upper(picture)
    symbols = F.regexp_extract_all(body, F.lit(r"[^()](?:\([0-9]+\))?"), F.lit(0))
    times = lambda of: F.aggregate(
        F.filter(symbols, lambda p: F.left(p, F.lit(1)).isin(*of)), F.lit(0), lambda n, p: n + F.coalesce(F.regexp_extract(p, r"\(([0-9]+)\)", 1).try_cast("int"), F.lit(1))
    )
    digits = times("9")
    size = (
        F.when(usage == "COMP-3", F.floor(digits / 2) + 1).when(usage.isin("COMP", "COMP-4", "COMP-5", "BINARY"), F.when(digits <= 4, 2).when(digits <= 9, 4).otherwise(8))
        .when(usage == "COMP-1", 4).when(usage == "COMP-2", 8).otherwise(digits + times("XA"))
    )
    return F.coalesce(F.when(picture.isNotNull(), size), F.lit(0)).cast("int")


#: Levels of data items.
LEVELS = range(1, 50)
#: What is kept of an item that stands above others.
ABOVE = "struct<n:int,name:string,other:string,bytes:int>"


def layout_of(items: DataFrame) -> DataFrame:
    """Items (program, at, section, level, name, redefines, bytes, ..) with path, offset and total: a group's total is the sum of its fields'.

    A record is an item of level 1 or 77 with those after it. An item's ancestors are the last items before it of each smaller
    level that no later item of a still smaller one ends. Offsets are running sums of bytes within the nearest
    ancestor (or the item itself) that redefines another; that one starts where the other does, and what lies in it moves nothing outside. A
    redefinition of a name that the record does not hold before is none. OCCURS multiplies an elementary item's bytes, as given; that of a group is not multiplied.
    """
    c, order = F.col, Window.partitionBy("program").orderBy("at")
    rows = items.withColumn("n", F.row_number().over(order)).withColumn("record", F.sum(F.when(c("level").isin(1, 77) | (F.coalesce(c("section"), F.lit("")) != F.coalesce(F.lag("section").over(order), F.lit(""))), 1).otherwise(0)).over(order))
    # a name that the record does not hold before is redefined by nothing
    held = rows.groupBy("program", "record", c("name").alias("redefines")).agg(F.min("n").alias("first"))
    rows = rows.join(merged(held), ["program", "record", "redefines"], "left").withColumn("redefines", F.when(c("first") < c("n"), c("redefines"))).drop("first")
    prior = Window.partitionBy("program", "record").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("over", F.struct("n", "name", F.col("redefines").alias("other"), "bytes"))
    # a level that no item has needs no window; levels have two digits, so these are few
    levels = sorted(r.level for r in items.filter(c("level").isin(*LEVELS)).select("level").distinct().collect())
    last = (F.when(c("level") > k, F.last(F.when(c("level") == k, c("over")), ignorenulls=True).over(prior)) for k in levels)
    smaller = F.filter(F.array(F.lit(None).cast(ABOVE), *last), lambda x: x.isNotNull())
    kept = F.aggregate(smaller, F.array().cast(f"array<{ABOVE}>"), lambda a, x: F.when((F.size(a) == 0) | (F.element_at(a, -1)["n"] < x["n"]), F.array_append(a, x)).otherwise(a))
    rows = rows.withColumn("above", kept)
    path = F.concat(F.transform("above", lambda x: x["name"]), F.array("name"))
    chain = F.concat("above", F.array("over"))
    # the place of the redefining item that holds this one, the item itself included; level 1 redefines at 0 anyway
    redefining = F.array_max(F.transform(F.filter(chain, lambda x, i: x["other"].isNotNull() & (i > 0)), lambda x: x["n"]))
    rows = rows.withColumns({"path": path, "inside": redefining})
    # bytes of items that have items below them are no place of those
    below = F.aggregate(F.filter("above", lambda x: x["n"] >= F.coalesce(c("inside"), F.lit(0))), F.lit(0), lambda s, x: s + x["bytes"])
    rows = stored(rows.withColumn("held", F.when(F.coalesce(c("inside") == c("n"), F.lit(False)), 0).otherwise(below)))
    sums = Window.partitionBy("program", "record", "inside").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("bytes").over(sums), F.lit(0)) - c("held")).drop("above", "over", "held")
    # where each redefining item starts: the item of that name last before it
    starts = rows.filter("inside = n").select("program", "record", c("n").alias("inside"), "redefines")
    named = rows.select("program", "record", c("name").alias("redefines"), c("n").alias("target"), c("inside").alias("outer"), c("within").alias("at_target"))
    bases = starts.join(merged(named), ["program", "record", "redefines"], "left").filter("target is null or target < inside")
    bases = bases.groupBy("program", "record", "inside").agg(F.max_by(F.struct("outer", "at_target"), "target").alias("t")).select("program", "record", "inside", "t.*")
    known = stored(starts.select("program", "record", "inside").join(merged(bases), ["program", "record", "inside"], "left").select("program", "record", "inside", "outer", F.coalesce("at_target", F.lit(0)).alias("base")))
    while not known.filter("outer is not null").isEmpty():  # a redefinition within another: as many rounds as they are nested
        up = known.select("program", "record", c("inside").alias("outer"), c("outer").alias("next"), c("base").alias("more"))
        known = stored(known.join(merged(up), ["program", "record", "outer"], "left").select("program", "record", "inside", c("next").alias("outer"), (c("base") + F.coalesce("more", F.lit(0))).alias("base")))
    rows = rows.join(merged(known.select("program", "record", "inside", "base")), ["program", "record", "inside"], "left").withColumn("offset", (c("within") + F.coalesce("base", F.lit(0))).cast("int"))
    # what a field adds to the groups that hold it, up to the one that redefines
    share = rows.filter("bytes > 0").select("program", "record", "inside", "bytes", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k))).alias("path"), "n")
    own = rows.select("program", "record", "path", c("n").alias("group"), F.coalesce("inside", F.lit(0)).alias("room"))
    fits = share.join(merged(own), ["program", "record", "path"]).filter("group <= n and (group >= coalesce(inside, 0))")
    total = fits.groupBy("program", "record", "group", "n").agg(F.max("bytes").alias("bytes")).groupBy("program", c("group").alias("n")).agg(F.sum("bytes").cast("int").alias("total"))
    return rows.join(merged(total), ["program", "n"], "left").withColumn("total", F.coalesce("total", F.lit(0)))


_ITEM = r"^(\d\d?)\s+([A-Z0-9-]+)"


def layout(members: DataFrame) -> DataFrame:
    """(name, line, level, item, path, picture, bytes, offset) of the data items of members whose sentences are lines."""
    c = F.col("code")
    ex = lambda pattern, k=1: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    rows = code(members).filter(c.rlike(_ITEM)).select(
        F.col("name").alias("program"), F.array("line").alias("at"), "line", F.lit("").alias("section"), ex(_ITEM).cast("int").alias("level"), ex(_ITEM, 2).alias("name"), F.rtrim(ex(r"\bPIC(?:TURE)?\s+(\S+)"), F.lit(".")).alias("picture"),
        F.coalesce(ex(r"\b(COMP(?:-\d)?|BINARY)\b"), F.lit("DISPLAY")).alias("usage"), ex(r"\bREDEFINES\s+([A-Z0-9-]+)").alias("redefines"), F.coalesce(ex(r"\bOCCURS\s+(\d+)").cast("int"), F.lit(1)).alias("occurs"),
    ).filter("level <> 88")
    laid = layout_of(rows.withColumn("bytes", picture_bytes(F.col("picture"), F.col("usage")) * F.greatest("occurs", F.lit(1))))
    return laid.select(F.col("program").alias("name"), "line", "level", F.col("name").alias("item"), F.array_join("path", ".").alias("path"), "picture", F.when(F.col("picture").isNull(), F.col("total")).otherwise(F.col("bytes")).alias("bytes"), "offset")


def declared_columns(members: DataFrame) -> DataFrame:
    """(member, table, position, column, kind) of `DECLARE name TABLE (...)` and `CREATE TABLE name (...)`, commas in parentheses respected."""
    found = members.select("name", F.explode(F.regexp_extract_all("source", F.lit(r"(?is)(?:DECLARE\s+\S+\s+TABLE|CREATE\s+TABLE\s+\S+)\s*\((?:[^()]|\([^()]*\))*\)"), F.lit(0))).alias("ddl"))
    table = F.upper(F.regexp_extract("ddl", r"(?i)(?:DECLARE\s+(\S+)\s+TABLE|CREATE\s+TABLE\s+([A-Za-z0-9_.]+))", 1))
    other = F.upper(F.regexp_extract("ddl", r"(?i)CREATE\s+TABLE\s+([A-Za-z0-9_.]+)", 1))
    body = F.regexp_extract("ddl", r"(?s)^[^(]*\((.*)\)$", 1)
    parts = found.select("name", F.when(table != "", table).otherwise(other).alias("table"), F.posexplode(F.split(body, r",(?![^(]*\))")).alias("position", "part"))
    return parts.select(F.col("name").alias("member"), "table", "position", F.upper(F.regexp_extract(F.trim(F.regexp_replace("part", r"\s+", " ")), r"^(\S+)", 1)).alias("column"), F.upper(F.regexp_extract(F.trim(F.regexp_replace("part", r"\s+", " ")), r"^\S+ ([^\s(]+(?: ?\([^)]*\))?)", 1)).alias("kind"))


def continued(members: DataFrame) -> DataFrame:
    """(name, line, code): continuation lines (indicator -), without their blanks before, joined to the last line of code before them."""
    c = lines(members).filter(~F.upper("indicator").isin("*", "/", "D"))
    order = Window.partitionBy("name").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("indicator") != "-", F.col("line")), ignorenulls=True).over(order)
    joined = c.withColumn("owner", F.coalesce(owner, F.col("line"))).groupBy("name", "owner").agg(F.array_sort(F.collect_list(F.struct("line", "code"))).alias("parts"))
    return joined.select("name", F.col("owner").alias("line"), F.array_join(F.transform("parts", lambda p, i: F.when(i == 0, p["code"]).otherwise(F.ltrim(p["code"]))), "").alias("code"))
