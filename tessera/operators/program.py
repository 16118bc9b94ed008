"""Views of programs' rows (see `statements.parsed`): the evidence graph, access to data, layers, labels, contracts, cards, chunks, questions; comments, decks and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored
from ..sources.tables import merged
from .graph import coupled
from .statements import FILE_ACCESS

LINK_WEIGHT = {"CICS_LINK": 1.0, "CICS_XCTL": 0.7}


def of(rows: DataFrame, record: str) -> DataFrame:
    return rows.filter(F.col("record") == record)


def linkage_bytes(rows: DataFrame) -> DataFrame:
    """(program, bytes): length of the top items of the linkage section, 1 at least."""
    top = of(rows, "item").filter("section = 'LINKAGE' and level = 1").groupBy("program").agg(F.sum("length").alias("b"))
    return rows.select("program").distinct().join(merged(top), "program", "left").select("program", F.greatest(F.lit(1), F.coalesce("b", F.lit(1))).alias("bytes"))


def evidence_edges(rows: DataFrame) -> DataFrame:
    """(source, target, kind, confidence, weight, line): copies, transfers weighted by linkage, transactions, maps, files, calls and tables."""
    node = lambda kind, name: F.concat(F.lit(f"{kind}:"), name)
    own = node("program", F.col("program"))
    copies = of(rows, "copy").select(node("program", F.col("name")).alias("source"), node("copybook", F.col("target")).alias("target"), F.lit("INCLUDES").alias("kind"), "confidence", F.lit(1.0).alias("weight"), "line")
    transfer = F.when(F.col("kind") == "CICS_LINK", LINK_WEIGHT["CICS_LINK"]).otherwise(LINK_WEIGHT["CICS_XCTL"]) * F.log1p("bytes")
    kind = F.col("kind")
    where = F.when(kind.isin(*LINK_WEIGHT), "program:").when(kind.isin("NEXT_TRANSID", "CICS_START"), "transaction:").when(kind == "USES_MAP", "map:").otherwise("file:")
    weight = F.when(kind.isin(*LINK_WEIGHT), F.round(transfer, 3)).when(kind.isin("NEXT_TRANSID", "CICS_START"), 0.4).when(kind == "USES_MAP", 0.3).otherwise(1.0)
    cics = of(rows, "cics").join(merged(linkage_bytes(rows)), "program").select(own.alias("source"), F.concat(where, "target").alias("target"), "kind", "confidence", weight.alias("weight"), "line")
    calls = of(rows, "call").select(own.alias("source"), node("program", F.col("target")).alias("target"), "kind", "confidence", F.lit(1.0), "line")
    tables = of(rows, "sql").filter(F.col("name").isin("READS", "WRITES", "UPDATES", "DELETES")).select(own.alias("source"), node("table", F.col("target")).alias("target"), F.col("name").alias("kind"), "confidence", F.lit(1.2), "line")
    return copies.union(cics).union(calls).union(tables)


def evidence_nodes(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, name, detail): programs with their paragraphs and statements, and every other end of an edge; a program that was read stands before one that is only named."""
    own = rows.groupBy("program").agg(F.count_if(F.col("record") == "paragraph").alias("p"), F.count_if(F.col("record") == "statement").alias("s"))
    known = own.select(F.concat(F.lit("program:"), "program").alias("id"), F.concat(F.col("p").cast("string"), F.lit(" paragraph(s), "), F.col("s").cast("string"), F.lit(" statement(s)")).alias("detail"), F.lit(0).alias("rank"))
    kind = F.initcap(F.substring_index("id", ":", 1))
    said = F.when(kind == "Program", "referenced but absent").when(kind == "Copybook", "copybook").when(kind == "Transaction", "transaction identifier").when(kind == "Map", "screen map").when(kind == "Table", "relational table").otherwise("keyed file")
    named = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().select("id", said.alias("detail"), F.lit(1).alias("rank"))
    first = known.union(named).groupBy("id").agg(F.min_by("detail", "rank").alias("detail"))
    return first.select("id", kind.alias("kind"), F.regexp_replace("id", "^[^:]*:", "").alias("name"), "detail")


def data_access(rows: DataFrame) -> DataFrame:
    """(program, artifact, kind, access, confidence, line): what programs read and change, the first of equals by line."""
    files = of(rows, "cics").filter(F.col("kind").isin(*FILE_ACCESS.values())).select("program", F.col("target").alias("artifact"), F.lit("File").alias("kind"), F.col("kind").alias("access"), "confidence", "line")
    tables = of(rows, "sql").filter(F.col("name").isin("READS", "WRITES", "UPDATES", "DELETES", "UNKNOWN")).select("program", F.col("target").alias("artifact"), F.lit("Table").alias("kind"), F.col("name").alias("access"), "confidence", "line")
    first = files.union(tables).groupBy("program", "artifact", "access").agg(F.min_by(F.struct("kind", "confidence", "line"), "line").alias("f"))
    return first.select("program", "artifact", "f.kind", "access", "f.confidence", "f.line")


def layered_weights(edges: DataFrame, access: DataFrame, programs: DataFrame) -> DataFrame:
    """(a, b, weight): programs coupled by copybooks (ln of programs over holders), by data (one and a half times that) and by transfers of control."""
    known = merged(programs.select("name").distinct())
    bare = lambda c: F.regexp_replace(c, "^program:", "")
    among = lambda m: m.join(known.select(F.col("name").alias("holder")), "holder", "left_semi")
    copies = among(edges.filter("kind = 'INCLUDES'").select(bare("source").alias("holder"), F.col("target").alias("item")))
    data = among(access.filter("confidence <> 'unresolved'").select(F.col("program").alias("holder"), F.col("artifact").alias("item")))
    control = edges.filter(F.col("kind").isin("CICS_LINK", "CICS_XCTL", "CALLS_STATIC", "CALLS_DYNAMIC")).select(bare("source").alias("x"), bare("target").alias("y"), "weight").filter("x <> y and weight > 0")
    control = control.join(known.select(F.col("name").alias("x")), "x", "left_semi").join(known.select(F.col("name").alias("y")), "y", "left_semi").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight")
    control = control.groupBy("a", "b").agg(F.sum("weight").alias("given")).withColumn("item", F.concat(F.lit("control:"), "a", F.lit(" "), "b"))
    layer = lambda m, name, factor: m.select("holder", F.concat(F.lit(f"{name}:"), "item").alias("item"), F.lit(factor).alias("factor"), F.lit(None).cast("double").alias("given"))
    ends = control.select(F.explode(F.array("a", "b")).alias("holder"), "item", F.lit(0.0).alias("factor"), "given")
    return coupled(stored(layer(copies, "copies", 1.0).union(layer(data, "data", 1.5)).union(ends), "layers"), population=known, positive=True)


CHANGING = ("WRITES", "UPDATES", "DELETES")


def community_labels(members: DataFrame, access: DataFrame, edges: DataFrame, name: Column | None = None) -> DataFrame:
    """(community, label, source): of members (program, community) the first two artifacts read, then changed; else maps; else the members' names."""
    from ..functions.text import prettify

    used = access.join(merged(members), "program")
    rank = F.when((F.col("access") == "READS"), 0).when(F.col("access").isin(*CHANGING) & (F.col("confidence") != "unresolved"), 1)
    basis = used.withColumn("rank", rank).filter("rank is not null").groupBy("community", "artifact").agg(F.min("rank").alias("rank"))
    data = basis.groupBy("community").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "artifact"))), 1, 2).alias("two")).select("community", F.array_join(F.transform("two", lambda t: prettify(t["artifact"])), " / ").alias("data"))
    maps = edges.filter("kind = 'USES_MAP'").select(F.regexp_replace("source", "^program:", "").alias("program"), F.regexp_replace("target", "^map:", "").alias("map")).join(merged(members), "program")
    screens = maps.groupBy("community").agg(F.slice(F.array_sort(F.collect_set("map")), 1, 2).alias("two")).select("community", F.concat(F.lit("presentation ("), F.array_join("two", ", "), F.lit(")")).alias("screens"))
    names = members.groupBy("community").agg(F.array_join(F.array_sort(F.collect_set("program")), ", ").alias("names"))
    out = names.join(data, "community", "left").join(screens, "community", "left")
    return out.select("community", F.coalesce("data", "screens", "names").alias("label"), F.when(F.col("data").isNotNull(), "data artifacts").when(F.col("screens").isNotNull(), "maps").otherwise("member names").alias("source"))


def contracts(members: DataFrame, access: DataFrame, edges: DataFrame) -> DataFrame:
    """(artifact, kind, communities, crossing, writers, readers): artifacts and resolved copybooks that two communities or more touch."""
    used = access.filter("confidence <> 'unresolved'").join(merged(members), "program")
    writes, reads = F.col("access").isin(*CHANGING), F.col("access") == "READS"
    data = used.groupBy("artifact").agg(
        F.min("kind").alias("kind"), F.countDistinct("community").alias("communities"), F.size(F.collect_set(F.when(writes, F.col("program")))).alias("writers"), F.size(F.collect_set(F.when(reads, F.col("program")))).alias("readers")
    ).filter("communities >= 2")
    data = data.select("artifact", "kind", "communities", F.when(F.col("writers") == 0, "read-only").otherwise("write crossing").alias("crossing"), "writers", "readers")
    held = edges.filter("kind = 'INCLUDES' and confidence = 'exact'").select(F.regexp_replace("source", "^program:", "").alias("program"), F.regexp_replace("target", "^copybook:", "").alias("artifact")).distinct()
    books = held.join(merged(members), "program", "left").groupBy("artifact").agg(F.countDistinct("community").alias("communities"), F.countDistinct("program").cast("int").alias("readers")).filter("communities >= 2")
    return data.union(books.select("artifact", F.lit("Copybook"), "communities", F.lit("shared contract"), F.lit(0), "readers"))


def dependence(rows: DataFrame) -> DataFrame:
    """(program, ordinal, parent, condition, depth, paragraph): each statement with the statement that governs it, which its row names as its target."""
    return of(rows, "statement").select("program", "ordinal", "parent", F.coalesce("target", F.lit("(unconditional)")).alias("condition"), "depth", "paragraph")


def conditions(rows: DataFrame) -> DataFrame:
    """(program, item, state, value): level-88 items with the item of another level before them."""
    order = Window.partitionBy("program").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    above = F.last(F.when(F.col("level") != 88, F.col("name")), ignorenulls=True).over(order)
    return of(rows, "item").withColumn("item", above).filter("level = 88 and item is not null").select("program", "item", F.col("name").alias("state"), F.col("text").alias("value"))


def type_prose(picture: Column, usage: Column, length: Column) -> Column:
    """An elementary item's type in words."""
    body = F.upper(picture)
    count = lambda text, symbols: F.aggregate(
        F.regexp_extract_all(text, F.lit(rf"([{symbols}](?:\([0-9]+\))?)"), F.lit(1)), F.lit(0), lambda n, p: n + F.coalesce(F.regexp_extract(p, r"\(([0-9]+)\)", 1).try_cast("int"), F.lit(1))
    )
    digits, scale, letters = count(body, "9"), count(F.when(F.contains(body, F.lit("V")), F.substring_index(body, "V", -1)).otherwise(""), "9"), count(body, "XA")
    places = F.when(scale > 0, F.concat(F.lit(" with "), scale.cast("string"), F.lit(" decimal place(s)"))).otherwise("")
    signed = F.when(F.contains(body, F.lit("S")), ", signed").otherwise("")
    n, d = length.cast("string"), digits.cast("string")
    return (
        F.when(usage == "COMP-3", F.concat(F.lit("a packed-decimal number of "), d, F.lit(" digits"), places, signed, F.lit(", occupying "), n, F.lit(" byte(s)")))
        .when(usage.isin("COMP", "BINARY", "COMP-4", "COMP-5"), F.concat(F.lit("a binary integer of "), d, F.lit(" digits"), signed, F.lit(", occupying "), n, F.lit(" byte(s)")))
        .when(letters > 0, F.concat(F.lit("a "), letters.cast("string"), F.lit("-character alphanumeric field")))
        .when(digits > 0, F.concat(F.lit("a "), d, F.lit("-digit zoned decimal number"), places, signed)).otherwise(F.concat(F.lit("a "), n, F.lit("-byte field")))
    )


def field_cards(rows: DataFrame) -> DataFrame:
    """(origin, field, line, text): a sentence for each declared elementary item: type, path, states and users; one for each declaration, of the first program.

    States are those of the declaring program's level-88 items; users are the programs that copy the item's book.
    """
    items = of(rows, "item").filter("level < 88 and picture is not null and name <> 'FILLER'")
    one = items.groupBy("origin", "name", "line").agg(F.min_by(F.struct("program", "picture", "usage", "length", F.col("text").alias("path")), "program").alias("i")).select("origin", "name", "line", "i.*")
    states = conditions(rows).groupBy("program", F.col("item").alias("name")).agg(F.array_join(F.array_sort(F.collect_set(F.concat("state", F.lit(" when "), F.coalesce("value", F.lit(""))))), "; ").alias("states"))
    users = of(rows, "copy").select(F.col("target").alias("origin"), "program").distinct().groupBy("origin").agg(F.array_join(F.array_sort(F.collect_set("program")), ", ").alias("users"))
    full = one.join(merged(states), ["program", "name"], "left").join(merged(users), "origin", "left")
    place = F.when(F.contains("path", F.lit(" > ")), F.concat(F.lit(" It sits at "), "path", F.when(F.col("origin") == F.col("program"), F.lit(" in program ")).otherwise(" in copybook "), "origin", F.lit("."))).otherwise("")
    text = F.concat(
        "name", F.lit(" is "), type_prose(F.col("picture"), F.col("usage"), F.col("length")), F.lit("."), place,
        F.coalesce(F.concat(F.lit(" Valid states: "), "states", F.lit(".")), F.lit("")), F.coalesce(F.concat(F.lit(" Used by "), "users", F.lit(".")), F.lit("")),
    )
    return full.select("origin", F.col("name").alias("field"), "line", text.alias("text"))


# What marks comment blocks, log entries and call targets.
BOILERPLATE = "COPYRIGHT|DISCLAIMER|WARRANT|INDEMNIF|ALL RIGHTS RESERVED|LICENSED MATERIALS|IBM CORP|THESE SAMPLES"
CODE_LIKE = r"^\s*(MOVE|COMPUTE|PERFORM|IF|EVALUATE|CALL|EXEC|ADD|SUBTRACT|MULTIPLY|DIVIDE|GO\s+TO|SET|INITIALIZE|END-IF|END-EXEC|WHEN)\b"
MAINTAINED = r"\b(CHANGE\s+LOG|MAINTENANCE|MODIFICATION|REVISION HISTORY|PR#|CR-|DEFECT)\b"
LOG_ENTRY = r"(?i)(\d{2}[/-]\d{2}[/-]\d{2,4})\s+(?:([A-Z][A-Z0-9]{2,8})\b)?\s*((?:PR#|CR-|DEF-|INC)\s*\d+)?\s*(.*)$"
HEADER_LINES = 30


def comment_lines(members: DataFrame) -> DataFrame:
    """(name, line, mark, text) of all lines of members (name, source) that say something; text is columns 8 to 72."""
    each = members.select("name", F.posexplode(F.split("source", "\r\n|\r|\n")).alias("at", "raw")).filter("trim(raw) <> ''")
    return each.select("name", (F.col("at") + 1).alias("line"), F.substring(F.rpad("raw", 7, " "), 7, 1).alias("mark"), F.rtrim(F.substring("raw", 8, 65)).alias("text"))


def comment_blocks(members: DataFrame) -> DataFrame:
    """(name, line, n_lines, kind, text, duplicate): runs of comment lines by gaps and islands, each of one of six kinds; a text that another block has before it (by name and line) is a duplicate.

    Half of its lines or more that read as statements make a block commented-out code. A block is one row, as the result demands.
    """
    order = Window.partitionBy("name").orderBy("line")
    lines = comment_lines(members).withColumn("said", F.col("mark").isin("*", "/"))
    runs = lines.withColumn("run", F.sum(F.when(F.col("said") & ~F.lag("said", 1, False).over(order), 1).otherwise(0)).over(order)).filter("said")
    stripped = F.regexp_replace("text", r"^[* ]+|[* ]+$", "")
    runs = runs.select("name", "run", "line", "text", stripped.alias("s"))
    some = F.col("s") != ""
    b = runs.groupBy("name", "run").agg(
        F.min("line").alias("line"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "s"))), lambda x: x["s"]), " ").alias("text"),
        F.count_if(some).alias("lines_said"), F.count_if(some & F.upper("s").rlike(CODE_LIKE)).alias("code"),
    )
    b = b.filter(F.regexp_replace("text", "[* -]", "") != "").withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    up = F.upper("text")
    kind = (
        F.when(up.rlike(BOILERPLATE), "boilerplate").when((F.col("code") > 0) & (F.col("code") * 2 >= F.col("lines_said")), "commented-out-code").when(up.rlike(MAINTAINED), "maintenance-log")
        .when(F.contains(up, F.lit("MODULE NAME")) | F.contains(up, F.lit("PROGRAM-ID")) | (F.col("line") < HEADER_LINES), "header").when(F.col("n_lines") > 1, "paragraph").otherwise("inline")
    )
    first = b.groupBy(F.sha2("text", 256).alias("h")).agg(F.min(F.struct("name", "line")).alias("first"))
    b = b.withColumn("kind", kind).withColumn("h", F.sha2("text", 256)).join(merged(first), "h")
    return b.select("name", "line", "n_lines", "kind", "text", (F.struct("name", "line") != F.col("first")).alias("duplicate"))


def maintenance(members: DataFrame) -> DataFrame:
    """(name, line, date, author, ticket, description) of every comment line that holds a log entry; author and ticket are null where there is none."""
    c = comment_lines(members).filter(F.col("mark").isin("*", "/") & F.col("text").rlike(LOG_ENTRY))
    part = lambda k: F.regexp_extract("text", LOG_ENTRY, k)
    return c.select("name", "line", part(1).alias("date"), F.nullif(part(2), F.lit("")).alias("author"), F.nullif(part(3), F.lit("")).alias("ticket"), F.trim(F.regexp_replace(part(4), r"\s+", " ")).alias("description"))


CHUNK_LENGTH = 1400


def typed_chunks(rows: DataFrame, cards: DataFrame, comments: DataFrame, most: int = CHUNK_LENGTH) -> DataFrame:
    """(kind, title, text, member, line): a chunk for each field card, program, paragraph and comment that is neither boilerplate, code nor inline, cut at `most` characters.

    A program's chunk is its name, its first header and its first 40 items; a paragraph's its statements in order.
    """
    fields = cards.select(F.lit("field").alias("kind"), F.concat_ws(".", "origin", "field").alias("title"), "text", F.col("origin").alias("member"), "line")
    header = comments.filter("kind = 'header' and not duplicate").groupBy("name").agg(F.min_by("text", "line").alias("header"))
    items = of(rows, "item").groupBy("program").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("line", "origin", "name"))), 1, 40), lambda i: i["name"]), " ").alias("items"))
    whole = rows.select("program").distinct().join(merged(items), "program", "left").join(merged(header.withColumnRenamed("name", "program")), "program", "left")
    programs = whole.select(F.lit("program").alias("kind"), F.col("program").alias("title"), F.concat_ws(" ", "program", F.coalesce("header", F.lit("")), F.coalesce("items", F.lit(""))).alias("text"), F.col("program").alias("member"), F.lit(1).alias("line"))
    said = of(rows, "statement").groupBy("program", "paragraph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), " ").alias("body"))
    paragraphs = of(rows, "paragraph").select("program", F.col("name").alias("paragraph"), "line").join(merged(said), ["program", "paragraph"], "left")
    paragraphs = paragraphs.select(F.lit("paragraph").alias("kind"), F.concat_ws(".", "program", "paragraph").alias("title"), F.concat_ws(" ", "paragraph", F.coalesce("body", F.lit(""))).alias("text"), F.col("program").alias("member"), "line")
    notes = comments.filter(F.col("kind").isin("header", "paragraph", "maintenance-log") & ~F.col("duplicate")).select(F.lit("comment").alias("kind"), F.concat("name", F.lit(" note")).alias("title"), "text", F.col("name").alias("member"), "line")
    return fields.union(programs).union(paragraphs).union(notes).withColumn("text", F.left("text", F.lit(most)))


QUESTION = r"(?i)\b(?:who|what|which)\b.*?\b(writes?|updates?|owns|reads?|uses?|calls?|links)\b\s+(?:to\s+|from\s+|the\s+)?([A-Za-z0-9_$#@-]+)"


def graph_answers(questions: DataFrame, access: DataFrame, edges: DataFrame) -> DataFrame:
    """(question, answers): programs in order, by a question's predicate over data access and edges; `calls` gives the programs that its subject calls. Null where no edge answers; questions of another form have no row.

    Questions are few and join with facts by their subject, so facts are read once.
    """
    q = questions.filter(F.col("question").rlike(QUESTION)).select("question", F.upper(F.regexp_extract("question", QUESTION, 1)).alias("intent"), F.upper(F.regexp_extract("question", QUESTION, 2)).alias("subject"))
    bare = lambda c: F.regexp_replace(c, "^program:", "")
    writes = access.filter(F.col("access").isin(*CHANGING)).select(F.lit("W").alias("form"), F.upper("artifact").alias("subject"), "program")
    reads = access.filter("access = 'READS'").select(F.lit("R"), F.upper("artifact"), "program")
    uses = edges.select(F.lit("R"), F.upper(F.regexp_replace("target", "^[^:]*:", "")), bare("source"))
    calls = edges.filter(F.col("kind").isin("CICS_LINK", "CICS_XCTL", "CALLS_STATIC", "CALLS_DYNAMIC")).select(F.lit("C"), F.upper(bare("source")), bare("target"))
    form = F.when(F.col("intent").isin("WRITES", "WRITE", "UPDATES", "OWNS"), "W").when(F.col("intent").isin("READS", "READ", "USES", "USE"), "R").when(F.col("intent").isin("CALLS", "CALL", "LINKS"), "C")
    found = q.withColumn("form", form).join(merged(writes.union(reads).union(uses).union(calls)), ["form", "subject"], "left")
    return found.groupBy("question").agg(F.array_sort(F.collect_set("program")).alias("a")).select("question", F.when(F.size("a") > 0, F.array_join("a", ", ")).alias("answers"))


def resource_facts(members: DataFrame, programs: DataFrame) -> DataFrame:
    """(member, kind, subject, target, known, line) of job control and resource decks: steps, programs run under a plan, tables made, programs defined, transactions routed.

    A transaction goes to the first PROGRAM() that follows its definition before the next one. `known` is whether the target is one of `programs` (name).
    """
    each = members.select("name", F.posexplode(F.split("source", "\r?\n")).alias("at", "text")).filter("not startswith(text, '//*')").withColumn("line", F.col("at") + 1).withColumn("text", F.upper("text"))
    ex = lambda pattern, k: F.regexp_extract("text", pattern, k)
    step, run = r"^//([A-Z0-9@#$]+)\s+EXEC\s+PGM=([A-Z0-9@#$]+)", r"\bRUN\s+PROGRAM\(([A-Z0-9@#$]+)\)(?:\s+PLAN\(([A-Z0-9@#$]+)\))?"
    create, define, routed = r"\bCREATE\s+TABLE\s+(?:&?[A-Z0-9@#$_]+\.)?([A-Z0-9@#$_]+)", r"^\s*DEFINE\s+(PROGRAM|TRANSACTION|DB2ENTRY)\(([A-Z0-9@#$]+)\)", r"\bPROGRAM\(([A-Z0-9@#$]+)\)"
    order = Window.partitionBy("name").orderBy("line")
    form = F.when(F.col("text").rlike(step), "STEP").when(F.col("text").rlike(run), "RUNS").when(F.col("text").rlike(create), "CREATES_TABLE").when(F.col("text").rlike(define), "DEFINE").when(F.col("text").rlike(routed), "ROUTE")
    marked = each.withColumn("form", form).withColumn("deck", F.sum(F.when(F.col("form") == "DEFINE", 1).otherwise(0)).over(order))
    defined = F.last(F.when(F.col("form") == "DEFINE", F.struct(ex(define, 1).alias("kind"), ex(define, 2).alias("name"))), ignorenulls=True).over(order)
    marked = marked.withColumn("last", defined).filter("form is not null")
    first = F.row_number().over(Window.partitionBy("name", "deck", "form").orderBy("line"))
    marked = marked.withColumn("nth", first)
    subject = F.when(F.col("form") == "STEP", ex(step, 1)).when(F.col("form") == "RUNS", F.when(ex(run, 2) != "", ex(run, 2)).otherwise("batch")).when(F.col("form") == "CREATES_TABLE", "DB2").when(F.col("form") == "DEFINE", "CICS").otherwise(F.col("last.name"))
    target = F.when(F.col("form") == "STEP", ex(step, 2)).when(F.col("form") == "RUNS", ex(run, 1)).when(F.col("form") == "CREATES_TABLE", ex(create, 1)).when(F.col("form") == "DEFINE", ex(define, 2)).otherwise(ex(routed, 1))
    kept = marked.filter("form not in ('DEFINE', 'ROUTE') or (form = 'DEFINE' and last.kind = 'PROGRAM') or (form = 'ROUTE' and last.kind = 'TRANSACTION' and nth = 1)")
    kind = F.when(F.col("form") == "DEFINE", "DEFINES_PROGRAM").when(F.col("form") == "ROUTE", "ROUTES_TO").otherwise(F.col("form"))
    facts = kept.select(F.col("name").alias("member"), kind.alias("kind"), subject.alias("subject"), target.alias("target"), "line")
    known = merged(programs.select(F.upper("name").alias("target")).distinct().withColumn("known", F.lit(True)))
    return facts.join(known, "target", "left").select("member", "kind", "subject", "target", F.coalesce("known", F.lit(False)).alias("known"), "line")


def call_targets(members: DataFrame, books: DataFrame) -> DataFrame:
    """(name, target): programs that a member links to, calls, moves the name of (if it is a member) or reaches by a copybook whose first link names one; comment lines are left out."""
    pattern = {"link": r"(?:LINK|XCTL)\s+PROGRAM\(\s*'([A-Z0-9]{4,8})'", "call": r"CALL\s+'([A-Z0-9]{4,8})'", "move": r"MOVE\s+'([A-Z0-9]{4,8})'\s+TO", "copy": r"COPY\s+(C[A-Z0-9]{3,7})"}
    code = lambda m: m.select("name", F.posexplode(F.split("source", "\r?\n")).alias("line", "text")).filter("substring(text, 7, 1) <> '*' and not startswith(ltrim(text), '*')")
    mined = lambda rows, what: rows.select("name", "line", F.explode(F.regexp_extract_all("text", F.lit(pattern[what]), F.lit(1))).alias("target"))
    own = code(members)
    plain = mined(own, "link").union(mined(own, "call")).select("name", "target")
    moved = mined(own, "move").join(merged(members.select(F.col("name").alias("target"))), "target", "left_semi").select("name", "target")
    first = mined(code(books), "link").groupBy("name").agg(F.min_by("target", "line").alias("linked"))
    copied = mined(own, "copy").select("name", F.col("target").alias("book")).join(first.withColumnRenamed("name", "book"), "book").select("name", F.col("linked").alias("target"))
    return plain.union(moved).union(copied).distinct()


def catalog(documents: DataFrame) -> DataFrame:
    """(program, domain, function) of the rows of markdown tables `| PROGRAM | .. | domain | function |`, the first of a program by document and line."""
    row = r"^\|\s*([A-Z][A-Z0-9]{2,9})\s*\|\s*[^|]*\|\s*(\d{1,2})(?:/\d+)?\s*\|\s*(.+?)\s*\|"
    each = documents.select("name", F.posexplode(F.split("text", "\r?\n")).alias("line", "text")).filter(F.col("text").rlike(row))
    found = each.select(F.regexp_extract("text", row, 1).alias("program"), F.lpad(F.regexp_extract("text", row, 2), 2, "0").alias("domain"), F.trim(F.regexp_replace(F.regexp_extract("text", row, 3), r"\*", "")).alias("function"), "name", "line")
    return found.groupBy("program").agg(F.min_by(F.struct("domain", "function"), F.struct("name", "line")).alias("f")).select("program", "f.*")


def descriptions(documents: DataFrame, heading: str = "Business purpose") -> DataFrame:
    """(name, title, purpose) of markdown documents: the first heading, and the section of that heading or else the first paragraph of more than 40 characters."""
    t = F.col("text")
    title = F.regexp_extract(t, r"(?m)^#\s+(?:Domain\s+\d+\s+[—-]\s+)?(.+)$", 1)
    section = F.trim(F.regexp_replace(F.regexp_extract(t, rf"(?ms)^##+\s*{heading}\s*$(.+?)(?=^##\s|\z)", 1), r"\s+", " "))
    blocks = F.filter(F.transform(F.split(t, "\n\n"), lambda b: F.trim(b)), lambda b: (F.length(b) > 40) & ~b.startswith("#") & ~b.startswith("|"))
    paragraph = F.trim(F.regexp_replace(F.coalesce(F.get(blocks, 0), t), r"\s+", " "))
    return documents.select("name", F.when(title != "", F.trim(title)).otherwise(F.col("name")).alias("title"), F.when(section != "", section).otherwise(paragraph).alias("purpose"))
