"""Fixed-format programs as rows: lines, copybooks in their place, sentences, statements, items and facts, by windows and joins.

`parsed` gives one row for each thing found, told apart by `record`. Nothing reads a program as a whole: a line is a row, what
a line belongs to (a division, a paragraph, an embedded command, a sentence) is the last row before it that opens such a
thing, and what a fact refers to (a cursor's declaration, the literal in an item) is the last row of that name before it. A
program's rows, with its copybooks', are what a window sorts at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored
from ..sources.tables import merged
from .source import continued, layout_of, picture_bytes

NUMBERS = ("ordinal", "line", "depth", "parent", "level", "occurs", "offset", "length")
FIELDS = ("record", "ordinal", "line", "origin", "kind", "name", "target", "confidence", "text", "paragraph", "depth", "parent", "level", "picture", "usage", "redefines", "occurs", "offset", "length", "section")

# The language's words and the patterns of what is looked for.
VERBS = (
    "ACCEPT", "ADD", "ALTER", "CALL", "CLOSE", "COMPUTE", "CONTINUE", "DELETE", "DISPLAY", "DIVIDE", "ELSE", "END-EVALUATE", "END-IF", "END-PERFORM", "EVALUATE", "EXEC", "EXIT", "GO", "GOBACK",
    "IF", "INITIALIZE", "INSPECT", "MOVE", "MULTIPLY", "OPEN", "PERFORM", "READ", "RETURN", "REWRITE", "SEARCH", "SET", "SORT", "START", "STOP", "STRING", "SUBTRACT", "UNSTRING", "WHEN", "WRITE",
)
CLOSERS = ("END-IF", "END-EVALUATE", "END-PERFORM")
NAME, TABLE = "[A-Z0-9$#@_-]+", r'[A-Z0-9_"$#@.]+'
DIVISION, SECTION = r"^(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION", r"^(FILE|WORKING-STORAGE|LOCAL-STORAGE|LINKAGE|REPORT|SCREEN)\s+SECTION"
BOOK, EXEC = rf"^(?:COPY|EXEC\s+SQL\s+INCLUDE)\s+['\"]?({NAME})", r"^EXEC\s+(SQLIMS|SQL|CICS|DLI)\b"
OPTION = r"\b(TRUNC|NUMPROC|ARITH|CODEPAGE|NSYMBOL|PGMNAME|OPTIMIZE)\s*\(\s*([A-Z0-9]+)\s*\)"
ITEM, PICTURE = rf"^(\d{{1,2}})\s+({NAME})\b", r"\bPIC(?:TURE)?\s+(?:IS\s+)?([X9AVSZ0-9()+\-.,/*$CRDB]+)"
USAGE = r"\b(COMP(?:UTATIONAL)?(?:-[1-5])?|BINARY|PACKED-DECIMAL)\b"
FROM = r'\bFROM\s+([A-Z0-9_"$#@., ]+?)(?=\s+(?:WHERE|ORDER|GROUP|HAVING|FETCH|FOR|UNION|INTO)\b|$)'
IDENTIFIER = r"\b(?:[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+|[A-Z][A-Z0-9]{2,})\b"
LITERAL = r"(?:'([^']+)'|\"([^\"]+)\")"
FILE_ACCESS = {"READ": "READS", "WRITE": "WRITES", "REWRITE": "UPDATES", "DELETE": "DELETES"}


def found(text: Column | str, pattern: str, group: int = 1) -> Column:
    """A group of a pattern's first match, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def before(*keys: str, own: bool = False) -> Window:
    """The rows of the same keys up to this one in the program's order, this one included or not."""
    return Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0 if own else -1)


def latest(value: Column, *keys: str, own: bool = True) -> Column:
    """The last value that is there, up to this row."""
    return F.last(value, ignorenulls=True).over(before(*keys, own=own))


def running(mark: Column, *keys: str, own: bool = True) -> Column:
    return F.coalesce(F.sum(mark.cast("int")).over(before(*keys, own=own)), F.lit(0))


def record(rows: DataFrame, what: str, /, **values: Column) -> DataFrame:
    """Rows of one kind, with the columns of all."""
    cast = lambda f: "int" if f in NUMBERS else "string"
    return rows.select("program", F.lit(what).alias("record"), *(values.get(f, F.lit(None)).cast(cast(f)).alias(f) for f in FIELDS[1:]))


def placed(programs: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of code of each program with its copybooks' in their place, and what copies what.

    Lines are (program, at, origin, line, code): `at` is the path of line numbers that leads to a line, so paths in order are the
    program's order. A copybook stands at the first place that names it, nearest to the program; later ones and cycles
    add nothing. Copies are (program, name, target, line, known).
    """
    own, kept = (stored(continued(members.filter("source is not null"))) for members in (programs, books))
    named = lambda lines: lines.select("name", "line", found(F.upper(F.trim("code")), BOOK).alias("target")).filter("target is not null")
    inner = stored(named(kept))
    first = lambda rows: rows.groupBy("program", "member").agg(F.min("path").alias("path"))
    new = stored(first(named(own).select(F.col("name").alias("program"), F.col("target").alias("member"), F.array("line").alias("path"))))
    seen = new
    while not new.isEmpty():
        ahead = new.join(inner, new.member == inner.name).select("program", F.col("target").alias("member"), F.concat("path", F.array("line")).alias("path"))
        new = stored(first(ahead.join(merged(seen), ["program", "member"], "left_anti")))
        seen = seen.unionByName(new)
    lines = own.select(F.col("name").alias("program"), F.array("line").alias("at"), F.col("name").alias("origin"), "line", "code")
    lines = lines.unionByName(seen.join(kept, seen.member == kept.name).select("program", F.concat("path", F.array("line")).alias("at"), F.col("member").alias("origin"), "line", "code"))
    known = books.select(F.col("name").alias("target"), F.lit(True).alias("known")).distinct()
    copies = named(own).withColumn("program", F.col("name")).unionByName(seen.join(inner, seen.member == inner.name).select("program", "name", "line", "target"))
    return lines, copies.join(known, "target", "left").select("program", "name", "target", "line", F.coalesce("known", F.lit(False)).alias("known"))


def sentences(lines: DataFrame) -> DataFrame:
    """(program, at, origin, line, code, text, division, section, exec): lines joined to what they continue.

    An embedded command runs to its END-EXEC, a data item to its period, a statement to the next line that begins one.
    """
    up = F.upper(F.trim(F.regexp_replace("code", r"\s+", " ")))
    rows = lines.filter("trim(code) <> ''").withColumn("text", up)
    opens, ends = F.col("text").rlike(EXEC), F.contains("text", F.lit("END-EXEC"))
    rows = rows.withColumns({"opens": opens, "division": latest(found("text", DIVISION), "program"), "prior": F.lag("text").over(Window.partitionBy("program").orderBy("at"))})
    rows = rows.withColumns({"inside": (running(opens, "program") > running(ends, "program", own=False)) & ~opens, "divided": running(F.col("text").rlike(DIVISION), "program")})
    # the last section of the program if it is of this division: a window by division too would sort the lines twice more
    named = found("text", SECTION)
    last = latest(F.when((F.col("division") == "DATA") & named.isNotNull(), F.struct("divided", named.alias("section"))), "program")
    section = F.when(last["divided"] == F.col("divided"), last["section"])
    verb = F.col("text").rlike(rf"^(?:{'|'.join(VERBS)})(?![A-Z0-9-])")
    header = F.col("text").rlike(rf"{DIVISION}|{SECTION}|^PROGRAM-ID|^COPY\s|^(?:CBL|PROCESS)\s")
    item = (F.col("division") == "DATA") & (F.col("text").rlike(r"^\d{1,2}\s") | F.col("prior").endswith("."))
    statement = (F.col("division") == "PROCEDURE") & (verb | F.col("text").rlike(rf"^{NAME}\.$"))
    apart = F.col("prior").isNull() | F.contains("prior", F.lit("END-EXEC")) | F.col("prior").rlike(rf"{DIVISION}|{SECTION}|^COPY\s") | ~F.coalesce(F.col("division").isin("DATA", "PROCEDURE"), F.lit(False))
    rows = rows.withColumn("section", section).withColumn("starts", F.coalesce(F.when(F.col("inside"), False).otherwise(opens | header | item | statement | apart), F.lit(True)))
    rows = rows.withColumn("sentence", running(F.col("starts"), "program"))
    parts = F.array_sort(F.collect_list(F.struct("at", "origin", "line", "code", "text", "division", "section", "opens")))
    one = rows.groupBy("program", "sentence").agg(parts.alias("p"))
    first = F.get("p", F.lit(0))
    text = F.array_join(F.transform("p", lambda x: x["text"]), " ")
    return one.select("program", *(first[c].alias(c) for c in ("at", "origin", "line", "code", "division", "section")), text.alias("text"), first["opens"].alias("exec"))


def nested(rows: DataFrame) -> DataFrame:
    """Statements (program, at, line, origin, verb, text) with ordinal, paragraph, depth and the ordinal and text of the statement that governs each (parent, condition; -1 and null: none).

    Depth is a running sum of scopes opened and closed within a paragraph, never below zero: the sum less its lowest
    value so far where that is negative. The governing statement is the last that opened a scope at the depth above.
    """
    verb, text = F.col("verb"), F.col("text")
    lacks = lambda end: ~F.contains(text, F.lit(end))
    opens = ((verb == "IF") & lacks("END-IF")) | ((verb == "EVALUATE") & lacks("END-EVALUATE")) | ((verb == "PERFORM") & text.rlike(r" (?:UNTIL|VARYING) ") & lacks("END-PERFORM"))
    place = ("program", "number")
    rows = rows.withColumn("step", F.when(verb.isin(*CLOSERS), -1).when(opens, 1).otherwise(0)).withColumn("sum", F.sum("step").over(before(*place, own=True)))
    rows = rows.withColumn("depth", F.coalesce(F.sum("step").over(before(*place)), F.lit(0)) - F.least(F.lit(0), F.coalesce(F.min("sum").over(before(*place)), F.lit(0))))
    rows = rows.filter(~verb.isin(*CLOSERS)).withColumn("ordinal", F.row_number().over(Window.partitionBy("program").orderBy("at")) - 1)
    # a statement asks at the level above its own; one that opens a scope offers itself at its own
    offer = F.struct(F.col("depth").alias("level"), F.when(F.col("step") == 1, F.struct("ordinal", "text")).alias("offer"), F.lit(False).alias("asks"))
    ask = F.struct((F.col("depth") - 1).alias("level"), F.lit(None).cast("struct<ordinal:int,text:string>").alias("offer"), F.lit(True).alias("asks"))
    both = rows.withColumn("e", F.explode(F.array(offer, ask))).select("*", "e.*").drop("e")
    governed = both.withColumn("above", latest(F.col("offer"), *place, "level", own=False)).filter("asks")
    return governed.withColumns({"parent": F.coalesce("above.ordinal", F.lit(-1)), "condition": F.col("above.text")})


def cursor_uses(rows: DataFrame) -> DataFrame:
    """Rows that use a cursor (program, at, cursor, tables: null) with the tables of the declaration last before them; rows with tables declare. Uses of undeclared cursors have none."""
    return rows.withColumn("bound", latest(F.col("tables"), "program", "cursor"))


def moved_literals(rows: DataFrame) -> DataFrame:
    """Rows that call by an item (program, at, item, literal: null) with the literal last moved into it before; rows with a literal move it. Items never moved into have none."""
    return rows.withColumn("value", latest(F.col("literal"), "program", "item"))


def sql_facts(blocks: DataFrame) -> DataFrame:
    """(program, line, kind, target, access, confidence) of embedded SQL commands (program, at, line, body)."""
    body = F.col("body")
    plain = lambda c: F.regexp_replace(F.trim(c), '"', "")
    listed = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.coalesce(found(c, FROM), F.lit("")), ","), lambda t: plain(F.split(F.trim(t), " ")[0])), lambda t: t != ""))
    declared, used = rf"^DECLARE\s+({NAME})\s+CURSOR\s+(?:WITH\s+\w+\s+)?FOR\s+(.+)$", rf"^(OPEN|CLOSE|FETCH)\s+({NAME})"
    prepared = rf"^PREPARE\s+({NAME})"
    b = blocks.withColumns({"declares": found(body, declared), "uses": found(body, used, 2), "prepares": found(body, prepared)})
    b = b.withColumn("cursor", F.coalesce("declares", "uses", "prepares")).withColumn("tables", F.when(F.col("declares").isNotNull(), listed(F.regexp_extract(body, declared, 2))))
    b = cursor_uses(b).withColumn("ready", latest(F.col("prepares"), "program", "cursor"))
    fact = lambda kind, target, access, confidence: F.struct(F.lit(kind).cast("string").alias("kind") if isinstance(kind, str) else kind.alias("kind"), target.alias("target"), F.lit(access).alias("access"), F.lit(confidence).alias("confidence"))
    none = F.array().cast("array<struct<kind:string,target:string,access:string,confidence:string>>")
    dynamic = F.array(fact("dynamic", F.lit("(unresolved)"), "UNKNOWN", "unresolved"))
    each = lambda tables, kind, access, confidence: F.transform(tables, lambda t: fact(kind, t, access, confidence))
    changes = {rf"^INSERT\s+INTO\s+({TABLE})": "WRITES", rf"^UPDATE\s+({TABLE})\s+SET\b": "UPDATES", rf"^DELETE\s+FROM\s+({TABLE})": "DELETES"}
    changed = reduce(lambda c, p: c.when(body.rlike(p), F.array(fact("dml", plain(found(body, p)), changes[p], "exact"))), changes, F.when(F.lit(False), none))
    facts = (
        F.when(body.rlike(rf"^DECLARE\s+{TABLE}\s+TABLE\b"), F.array(fact("declare-table", plain(found(body, rf"^DECLARE\s+({TABLE})")), "DECLARE", "exact")))
        .when(F.col("declares").isNotNull(), F.flatten(F.transform("tables", lambda t: F.when(F.contains(body, F.lit("FOR UPDATE")), F.array(fact("cursor", t, "READS", "exact"), fact("cursor", t, "UPDATES", "exact"))).otherwise(F.array(fact("cursor", t, "READS", "exact"))))))
        .when(F.col("uses").isNotNull(), F.when(F.col("bound").isNotNull(), each(F.col("bound"), F.lower(found(body, used)), "READS", "resolved")).when(F.col("ready").isNotNull(), dynamic).otherwise(none))
        .when(F.col("prepares").isNotNull() | body.rlike(rf"^EXECUTE\s+(?!IMMEDIATE){NAME}"), dynamic)
        .when(body.rlike("^SELECT"), each(listed(body), "dml", "READS", "exact"))
        .when(body.rlike(rf"^CONNECT\s+TO\s+{NAME}"), F.array(fact("connect", found(body, rf"^CONNECT\s+TO\s+({NAME})"), "CONNECT", "exact")))
        .otherwise(F.coalesce(changed, none))
    )
    return b.select("program", "line", F.explode(facts).alias("f")).select("program", "line", "f.*")


def monitor_facts(blocks: DataFrame) -> DataFrame:
    """(program, line, kind, target, confidence) of transaction-monitor commands (program, line, body)."""
    body, command = F.col("body"), F.split("body", " ")[0]
    operand = lambda what: found(body, rf"\b{what}\s*\(\s*'?({NAME})'?\s*\)")
    quoted = F.coalesce(found(body, rf"\bPROGRAM\s*\(\s*{LITERAL}\s*\)"), found(body, rf"\bPROGRAM\s*\(\s*{LITERAL}\s*\)", 2))
    item = found(body, rf"\bPROGRAM\s*\(\s*({NAME})\s*\)")
    transfer = command.isin("LINK", "XCTL")
    access = reduce(lambda c, k: c.when(command == k, FILE_ACCESS[k]), FILE_ACCESS, F.when(F.lit(False), ""))
    kind = F.when(transfer, F.concat(F.lit("CICS_"), command)).when(command == "RETURN", "NEXT_TRANSID").when(command == "START", "CICS_START").when(command.isin("SEND", "RECEIVE"), "USES_MAP").otherwise(access)
    target = F.when(transfer, F.coalesce(quoted, item)).when(command.isin("RETURN", "START"), operand("TRANSID")).when(command.isin("SEND", "RECEIVE"), operand("MAP")).otherwise(operand("FILE"))
    rows = blocks.select("program", "line", kind.alias("kind"), target.alias("target"), F.when(transfer & quoted.isNull(), "inferred").otherwise("exact").alias("confidence"))
    return rows.filter("kind is not null and target is not null")


def call_facts(statements: DataFrame) -> DataFrame:
    """(program, line, kind, target, confidence) of CALL statements (program, at, line, verb, text), a dynamic one by the literal last moved into its item."""
    verb, text = F.col("verb"), F.col("text")
    moved, moves, static, dynamic = rf"^MOVE\s+{LITERAL}\s+TO\s+({NAME})", verb == "MOVE", rf"^CALL\s+{LITERAL}", rf"^CALL\s+({NAME})"
    either = lambda pattern: F.coalesce(found(text, pattern, 1), found(text, pattern, 2))
    rows = statements.filter(verb.isin("MOVE", "CALL")).withColumns({"literal": F.when(moves, either(moved)), "item": F.when(moves, found(text, moved, 3)).otherwise(found(text, dynamic)), "named": F.when(~moves, either(static))})
    rows = moved_literals(rows).filter((verb == "CALL") & (F.col("named").isNotNull() | F.col("item").isNotNull()))
    by_name = F.col("named").isNotNull()
    return rows.select(
        "program", "line", F.when(by_name, "CALLS_STATIC").otherwise("CALLS_DYNAMIC").alias("kind"), F.coalesce("named", "value", F.lit("(unresolved)")).alias("target"),
        F.when(by_name, "exact").when(F.col("value").isNotNull(), "resolved").otherwise("unresolved").alias("confidence"),
    )


def flow_facts(statements: DataFrame, items: DataFrame) -> DataFrame:
    """(program, source, target, via, line): data flows between declared items (program, name, redefines, line), the first line of each."""
    text, verb = F.col("text"), F.col("verb")
    names = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(IDENTIFIER), F.lit(0)))
    move, compute, into = r"^MOVE\s+(.+?)\s+TO\s+(.+)$", rf"^COMPUTE\s+({NAME})(?:\s+ROUNDED)?\s*=\s*(.+)$", r"\bINTO\s+(:.+?)(?=\s+(?:FROM|WHERE|END-EXEC)\b|$)"
    ends = lambda pattern, source, target: F.struct(names(found(text, pattern, source)).alias("s"), names(found(text, pattern, target)).alias("t"))
    e = F.when(verb == "MOVE", ends(move, 1, 2)).when(verb == "COMPUTE", F.struct(names(found(text, compute, 2)).alias("s"), F.array(found(text, compute)).alias("t")))
    e = e.when(verb == "EXEC", F.struct(F.array(F.lit("(sql result)")).alias("s"), names(found(text, into)).alias("t")))
    via = F.when(verb == "EXEC", "FETCH INTO").otherwise(verb)
    rows = statements.select("program", "line", via.alias("via"), e.alias("e")).filter("e is not null").select("program", "line", "via", F.col("e.s").alias("s"), F.explode("e.t").alias("target")).select("program", "line", "via", "target", F.explode("s").alias("source"))
    declared = merged(items.filter("name <> 'FILLER'").select("program", "name").distinct())
    rows = rows.join(declared.withColumnRenamed("name", "target"), ["program", "target"], "left_semi")
    # one join for results of queries, which are no items, and for items, so that texts are searched once
    held = declared.withColumnRenamed("name", "source").withColumn("held", F.lit(True))
    rows = rows.join(merged(held), ["program", "source"], "left").filter((F.col("source") == "(sql result)") | F.col("held")).select(rows.columns)
    over = items.filter("redefines is not null").select("program", "line", F.lit("REDEFINES overlap").alias("via"), F.explode(F.array(F.struct(F.col("name").alias("a"), F.col("redefines").alias("b")), F.struct(F.col("redefines").alias("a"), F.col("name").alias("b")))).alias("p"))
    every = rows.unionByName(over.select("program", "line", "via", F.col("p.a").alias("source"), F.col("p.b").alias("target"))).filter("source <> target")
    return every.groupBy("program", "source", "target", "via").agg(F.min("line").alias("line"))


def parsed(programs: DataFrame, books: DataFrame) -> DataFrame:
    """Rows of all programs (name, source), with copybooks (name, source) in their place: records copy, option, program, exec, item, paragraph, statement, sql, cics, call, flow.

    Null sources and empty tables give no rows. Texts are in upper case, blanks made one.
    """
    lines, copies = placed(programs, books)
    s = stored(sentences(lines))
    text, c = F.col("text"), F.col
    bare = F.trim(F.regexp_replace(text, r"\.\s*$", ""))
    blocks = s.filter("exec").withColumn("kind", found(text, EXEC)).withColumn("body", F.trim(F.regexp_replace(bare, r"^EXEC\s+\w+\b|\bEND-EXEC\b", "")))
    options = s.filter(text.rlike(r"^(?:CBL|PROCESS)\s")).select("program", "line", "origin", F.explode(F.arrays_zip(F.regexp_extract_all(text, F.lit(OPTION), F.lit(1)).alias("o"), F.regexp_extract_all(text, F.lit(OPTION), F.lit(2)).alias("v"))).alias("z"))
    usage = F.regexp_replace(F.regexp_replace(F.coalesce(found(bare, USAGE), F.lit("DISPLAY")), "COMPUTATIONAL", "COMP"), "PACKED-DECIMAL", "COMP-3")
    items = s.filter((c("division") == "DATA") & ~c("exec") & text.rlike(ITEM)).select(
        "program", "at", "line", "origin", "section", found(text, ITEM).cast("int").alias("level"), found(text, ITEM, 2).alias("name"), F.rtrim(found(bare, PICTURE), F.lit(".")).alias("picture"), usage.alias("usage"),
        found(bare, rf"\bREDEFINES\s+({NAME})").alias("redefines"), F.coalesce(found(bare, r"\bOCCURS\s+(\d+)").cast("int"), F.lit(0)).alias("occurs"), found(bare, r"\bVALUES?\s+(?:IS\s+|ARE\s+)?(.+)$").alias("value"),
    )
    items = stored(items)
    laid = stored(layout_of(items.filter("level <> 88").withColumn("bytes", picture_bytes(c("picture"), c("usage")) * F.greatest("occurs", F.lit(1)))))
    code = s.filter((c("division") == "PROCEDURE") & ~text.rlike(DIVISION))
    paragraph = F.when(~c("exec") & text.rlike(rf"^{NAME}\.$") & ~c("code").startswith(" "), F.rtrim(text, F.lit(".")))
    code = code.withColumn("opens", paragraph).withColumns({"paragraph": F.coalesce(latest(c("opens"), "program"), F.lit("(program)")), "number": running(c("opens").isNotNull(), "program")})
    verbs = code.filter("opens is null").withColumn("verb", found(text, rf"^({'|'.join(VERBS)})(?![A-Z0-9-])")).filter("verb is not null").withColumn("text", F.rtrim(text, F.lit(".")))
    # commands of the hierarchical database are facts, not statements
    statements = stored(nested(verbs.filter(~text.rlike(r"^EXEC\s+DLI\b"))))
    sql, cics, calls, flows = sql_facts(blocks.filter("kind = 'SQL'")), monitor_facts(blocks.filter("kind = 'CICS'")), call_facts(statements), flow_facts(statements, items.filter("level <> 88"))
    rows = (
        record(copies, "copy", name=c("name"), target=c("target"), line=c("line"), confidence=F.when(c("known"), "exact").otherwise("unresolved")),
        record(options, "option", name=c("z.o"), target=c("z.v"), line=c("line"), origin=c("origin")),
        record(s.filter(text.rlike("^PROGRAM-ID")), "program", name=found(text, rf"^PROGRAM-ID\.?\s+({NAME})"), line=c("line")),
        record(blocks, "exec", kind=c("kind"), text=bare, line=c("line"), origin=c("origin")),
        record(laid, "item", **{f: c(f) for f in ("level", "name", "picture", "usage", "redefines", "occurs", "offset", "section", "line", "origin")}, length=c("bytes"), text=F.array_join("path", " > ")),
        record(items.filter("level = 88"), "item", level=c("level"), name=c("name"), section=c("section"), line=c("line"), origin=c("origin"), text=F.trim(F.regexp_replace("value", "^['\" ]+|['\" ]+$", ""))),
        record(code.filter("opens is not null"), "paragraph", name=c("opens"), line=c("line"), origin=c("origin")),
        record(statements, "statement", kind=c("verb"), target=c("condition"), **{f: c(f) for f in ("ordinal", "text", "paragraph", "depth", "parent", "line", "origin")}),
        record(sql, "sql", kind=c("kind"), target=c("target"), name=c("access"), confidence=c("confidence"), line=c("line")),
        record(cics, "cics", kind=c("kind"), target=c("target"), confidence=c("confidence"), line=c("line")),
        record(calls, "call", kind=c("kind"), target=c("target"), confidence=c("confidence"), line=c("line")),
        record(flows, "flow", name=c("source"), target=c("target"), kind=c("via"), line=c("line")),
    )
    return reduce(DataFrame.unionByName, rows)
