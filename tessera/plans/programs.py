"""Queries over fixed-format programs: one program a supplier, with copybooks, tables, maps and calls made from the tables."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import program as pr
from ..operators import source
from ..operators import statements as st
from ..sources.shared import fingerprint, sized, version, written_once
from ..sources.tables import table
from .registry import query

#: Copybooks from this number on are named but are not in the library.
BOOKS = 60


def _line(*parts: Column | str, indent: int = 7) -> Column:
    return F.concat(F.lit(" " * indent), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _programs(spark, sf_dir):
    """(name, source): a program for each supplier; what it copies, reads and changes follows from its line items."""
    li = table(spark, sf_dir, "lineitem")
    when = lambda c, v: F.array_sort(F.collect_set(F.when(c, v)))
    used = li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.array_sort(F.collect_set(F.col("l_partkey") % 97)).alias("books"),
        when((F.col("l_returnflag") == "N") & (F.col("l_quantity") < 5), F.col("l_linenumber")).alias("reads"), when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48), F.col("l_linenumber")).alias("writes"),
    )
    s = table(spark, sf_dir, "supplier").join(used, "s_suppkey", "left")
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    many = lambda c, f: F.coalesce(F.transform(c, f), F.array().cast("array<string>"))
    some = lambda c, *lines: F.when(c, F.array(*lines)).otherwise(F.array().cast("array<string>"))
    parts = [
        F.array(
            _line("CBL TRUNC(BIN)"), _line("IDENTIFICATION DIVISION."), _line("PROGRAM-ID. P", k, "."), F.lit("      * 01/02/2020 JSM PR#12 first version"), _line("DATA DIVISION."), _line("WORKING-STORAGE SECTION."),
            _line("01 WS-TEXT PIC X(8)."), _line("01 WS-PGM PIC X(8)."), _line("01 WS-CNT PIC S9(7)V99"), F.lit("           COMP-3."), _line("   88 WS-DONE VALUE 1."), _line("01 WS-ALT REDEFINES WS-CNT PIC X(5)."), _line("01 WS-TOT PIC 9(5)."), _line("01 WS-BOOK."),
        ),
        many(F.col("books"), lambda n: _line("COPY C", n, ".")),
        F.array(_line("LINKAGE SECTION."), _line("01 COMMAREA PIC X(", k % 500 + 1, ")."), _line("PROCEDURE DIVISION."), _line("MAIN-PARA."), _line("IF WS-CNT = 1", indent=11), _line("    MOVE WS-TEXT TO WS-ALT", indent=11), _line("    IF WS-TOT = 2", indent=11),
                _line("        COMPUTE WS-TOT = WS-CNT + 1", indent=11), _line("    END-IF", indent=11), _line("END-IF.", indent=11)),
        many(F.col("reads"), lambda n: _line("EXEC SQL SELECT A INTO :WS-TEXT FROM T", n, " WHERE B = 1 END-EXEC.", indent=11)),
        many(F.col("writes"), lambda n: F.concat(_line("EXEC SQL UPDATE T", n, indent=11), F.lit("\n               SET A = 1 END-EXEC."))),
        F.array(_line("EXEC CICS LINK PROGRAM('P", k * 7 % 101, "') END-EXEC.", indent=11), _line("CALL 'P", k * 3 % 101, "'.", indent=11)),
        some(k % 3 == 0, _line("EXEC CICS XCTL PROGRAM(WS-PGM) END-EXEC.", indent=11)),
        some(k % 2 == 0, _line("MOVE 'P", k * 5 % 101, "' TO WS-PGM.", indent=11)),
        F.array(_line("CALL WS-PGM.", indent=11), _line("EXEC CICS SEND MAP('M", nation, "') END-EXEC.", indent=11), _line("EXEC CICS READ FILE('F", k % 5, "') END-EXEC.", indent=11)),
        some(k % 4 == 0, _line("EXEC CICS REWRITE FILE('F", k % 5, "') END-EXEC.", indent=11)),
        some(k % 6 == 0, _line("EXEC SQL PREPARE S1 FROM :WS-TEXT END-EXEC.", indent=11)),
        F.array(_line("LAST-PARA."), _line("EXEC CICS RETURN TRANSID('X", nation % 5, "') END-EXEC.", indent=11)),
    ]
    return s.select(F.concat(F.lit("P"), k.cast("string")).alias("name"), F.array_join(F.concat(*parts), "\n").alias("source"))


def _books(spark, sf_dir):
    """(name, source): copybooks; every tenth copies the next, and one copies itself."""
    n = table(spark, sf_dir, "part").select((F.col("p_partkey") % 97).alias("n")).distinct().filter(F.col("n") < BOOKS)
    k = F.col("n")
    more = F.when(k % 10 == 0, F.concat(F.lit("\n"), _line("COPY C", k + 1, "."))).when(k == 7, F.lit("\n       COPY C7.")).otherwise("")
    return n.select(F.concat(F.lit("C"), k.cast("string")).alias("name"), F.concat(_line("    05 FLD-", k, " PIC X(", k % 9 + 1, ")."), more).alias("source"))


def _parsed(spark, sf_dir, name: str, programs, books):
    """Rows of programs that are made from tables: a table in the shared folder, made once for each state of the tables and of the code."""
    tables = [table(spark, sf_dir, t).select(F.lit(0)) for t in ("supplier", "lineitem", "part")]
    key = f"{name}-{version(st, source, sys.modules[__name__])}-{'-'.join(fingerprint(t)[:8] for t in tables)}"

    def build(path):
        own = sized(spark, table(spark, sf_dir, "lineitem").count())
        st.parsed(programs(own, sf_dir), books(own, sf_dir)).write.parquet(path)

    return spark.read.parquet(written_once(spark, key, build))


def _rows(spark, sf_dir):
    return _parsed(spark, sf_dir, "program-rows", _programs, _books)


_M = f"""
s AS (SELECT s_suppkey AS k, s_nationkey AS nation FROM supplier), lib AS (SELECT DISTINCT p_partkey % 97 AS n FROM part WHERE p_partkey % 97 < {BOOKS}),
m AS (SELECT DISTINCT l_suppkey AS k, l_partkey % 97 AS n FROM lineitem WHERE l_suppkey IN (SELECT k FROM s)),
inner_copies AS (SELECT n, CASE WHEN n % 10 = 0 THEN n + 1 ELSE n END AS t FROM lib WHERE n % 10 = 0 OR n = 7),
copies AS (SELECT k, 'P' || k AS who, n FROM m UNION ALL SELECT k, 'C' || m.n, t FROM m JOIN inner_copies i ON i.n = m.n),
reads AS (SELECT DISTINCT l_suppkey AS k, l_linenumber AS t FROM lineitem WHERE l_returnflag = 'N' AND l_quantity < 5), writes AS (SELECT DISTINCT l_suppkey AS k, l_linenumber AS t FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48),
e AS (
  SELECT 'program:' || who AS source, 'copybook:C' || n AS target, 'INCLUDES' AS kind, CASE WHEN n IN (SELECT n FROM lib) THEN 'exact' ELSE 'unresolved' END AS confidence, 1.0 AS weight FROM copies
  UNION ALL SELECT 'program:P' || k, 'program:P' || (k * 7 % 101), 'CICS_LINK', 'exact', round(ln(1 + k % 500 + 1), 3) FROM s
  UNION ALL SELECT 'program:P' || k, 'program:WS-PGM', 'CICS_XCTL', 'inferred', round(0.7 * ln(1 + k % 500 + 1), 3) FROM s WHERE k % 3 = 0
  UNION ALL SELECT 'program:P' || k, 'program:P' || (k * 3 % 101), 'CALLS_STATIC', 'exact', 1.0 FROM s
  UNION ALL SELECT 'program:P' || k, CASE WHEN k % 2 = 0 THEN 'program:P' || (k * 5 % 101) ELSE 'program:(unresolved)' END, 'CALLS_DYNAMIC', CASE WHEN k % 2 = 0 THEN 'resolved' ELSE 'unresolved' END, 1.0 FROM s
  UNION ALL SELECT 'program:P' || k, 'map:M' || nation, 'USES_MAP', 'exact', 0.3 FROM s
  UNION ALL SELECT 'program:P' || k, 'transaction:X' || (nation % 5), 'NEXT_TRANSID', 'exact', 0.4 FROM s
  UNION ALL SELECT 'program:P' || k, 'file:F' || (k % 5), 'READS', 'exact', 1.0 FROM s UNION ALL SELECT 'program:P' || k, 'file:F' || (k % 5), 'UPDATES', 'exact', 1.0 FROM s WHERE k % 4 = 0
  UNION ALL SELECT 'program:P' || k, 'table:T' || t, 'READS', 'exact', 1.2 FROM reads JOIN s USING (k) UNION ALL SELECT 'program:P' || k, 'table:T' || t, 'UPDATES', 'exact', 1.2 FROM writes JOIN s USING (k)),
acc AS (
  SELECT k, 'F' || (k % 5) AS artifact, 'File' AS kind, 'READS' AS access, 'exact' AS confidence FROM s UNION ALL SELECT k, 'F' || (k % 5), 'File', 'UPDATES', 'exact' FROM s WHERE k % 4 = 0
  UNION ALL SELECT k, 'T' || t, 'Table', 'READS', 'exact' FROM reads JOIN s USING (k) UNION ALL SELECT k, 'T' || t, 'Table', 'UPDATES', 'exact' FROM writes JOIN s USING (k)
  UNION ALL SELECT k, '(unresolved)', 'Table', 'UNKNOWN', 'unresolved' FROM s WHERE k % 6 = 0)"""


@query(f"WITH {_M} SELECT source, target, kind, confidence, weight::DOUBLE AS weight, count(*) AS n FROM e GROUP BY ALL")
def evidence_edges(spark, sf_dir):
    """Edges of the evidence graph with their weights: a transfer weighs the logarithm of the area that it passes."""
    return pr.evidence_edges(_rows(spark, sf_dir)).groupBy("source", "target", "kind", "confidence", "weight").agg(F.count("*").alias("n"))


@query(f"""
WITH {_M}, ends AS (SELECT DISTINCT unnest([source, target]) AS id FROM e), st AS (SELECT k, 7 + (SELECT count(*) FROM reads r WHERE r.k = s.k) + (SELECT count(*) FROM writes w WHERE w.k = s.k) + (k % 3 = 0)::INT + (k % 2 = 0)::INT + (k % 4 = 0)::INT + (k % 6 = 0)::INT + 3 AS n FROM s)
SELECT id, upper(left(split_part(id, ':', 1), 1)) || substr(split_part(id, ':', 1), 2) AS kind, regexp_replace(id, '^[^:]*:', '') AS name,
  CASE WHEN st.k IS NOT NULL THEN '2 paragraph(s), ' || st.n || ' statement(s)' WHEN id LIKE 'program:%' THEN 'referenced but absent' WHEN id LIKE 'copybook:%' THEN 'copybook' WHEN id LIKE 'transaction:%' THEN 'transaction identifier' WHEN id LIKE 'map:%' THEN 'screen map' WHEN id LIKE 'table:%' THEN 'relational table' ELSE 'keyed file' END AS detail
FROM ends LEFT JOIN st ON id = 'program:P' || k""")
def evidence_nodes(spark, sf_dir):
    """Nodes of the evidence graph, a parsed program before one that is only named."""
    rows = _rows(spark, sf_dir)
    return pr.evidence_nodes(rows, pr.evidence_edges(rows))


@query(f"WITH {_M} SELECT 'P' || k AS program, artifact, kind, access, confidence FROM acc")
def data_access(spark, sf_dir):
    """What each program reads and changes."""
    return pr.data_access(_rows(spark, sf_dir)).drop("line")


_PAIR = "SELECT a.who AS a, b.who AS b, ln(tot.n::DOUBLE / held.n) * {factor} AS w FROM {of} a JOIN {of} b ON a.item = b.item AND a.who < b.who JOIN (SELECT item, count(*) AS n FROM {of} GROUP BY item) held ON held.item = a.item, (SELECT count(*) AS n FROM s) tot"
_LAYERS = f"""
held_books AS (SELECT DISTINCT who, 'C' || n AS item FROM copies WHERE who LIKE 'P%'), held_data AS (SELECT DISTINCT 'P' || k AS who, artifact AS item FROM acc WHERE confidence <> 'unresolved'),
ctl AS (SELECT substr(source, 9) AS x, substr(target, 9) AS y, weight AS w FROM e WHERE kind IN ('CICS_LINK', 'CICS_XCTL', 'CALLS_STATIC', 'CALLS_DYNAMIC') AND substr(source, 9) <> substr(target, 9) AND substr(target, 9) IN (SELECT 'P' || k FROM s)),
pairs AS ({_PAIR.format(factor=1, of='held_books')} UNION ALL {_PAIR.format(factor=1.5, of='held_data')} UNION ALL SELECT least(x, y), greatest(x, y), w FROM ctl WHERE w > 0)"""


@query(f"WITH {_M}, {_LAYERS} SELECT a, b, round(sum(w), 6) AS weight FROM pairs WHERE w > 0 GROUP BY a, b")
def layered_weights(spark, sf_dir):
    """Programs coupled in three layers: copybooks, data, transfers of control."""
    rows, programs = _rows(spark, sf_dir), _programs(spark, sf_dir)
    return pr.layered_weights(pr.evidence_edges(rows), pr.data_access(rows), programs).withColumn("weight", F.round("weight", 6))


def _members(spark, sf_dir):
    """Programs by nation, as communities."""
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("program"), F.col("s_nationkey").alias("community"))


@query(f"""
WITH {_M}, b AS (SELECT nation AS community, artifact, min(CASE WHEN access = 'READS' THEN 0 ELSE 1 END) AS r FROM acc JOIN s USING (k) WHERE access = 'READS' OR (access = 'UPDATES' AND confidence <> 'unresolved') GROUP BY ALL),
d AS (SELECT community, list(artifact ORDER BY r, artifact)[1:2] AS two FROM b GROUP BY community) SELECT community, array_to_string(two, ' / ') AS label, 'data artifacts' AS source FROM d""")
def community_labels(spark, sf_dir):
    """Communities named by what they read and own."""
    rows = _rows(spark, sf_dir)
    return pr.community_labels(_members(spark, sf_dir), pr.data_access(rows), pr.evidence_edges(rows))


@query(f"""
WITH {_M}, d AS (SELECT artifact, min(kind) AS kind, count(DISTINCT nation) AS communities, count(DISTINCT k) FILTER (access = 'UPDATES') AS writers, count(DISTINCT k) FILTER (access = 'READS') AS readers FROM acc JOIN s USING (k) WHERE confidence <> 'unresolved' GROUP BY artifact),
b AS (SELECT 'C' || n AS artifact, count(DISTINCT nation) AS communities, count(DISTINCT k) + (SELECT count(DISTINCT who) FROM copies x WHERE x.n = m.n AND who LIKE 'C%') AS readers FROM m JOIN s USING (k) WHERE n IN (SELECT n FROM lib) GROUP BY n)
SELECT artifact, kind, communities, CASE WHEN writers = 0 THEN 'read-only' ELSE 'write crossing' END AS crossing, writers::INT AS writers, readers::INT AS readers FROM d WHERE communities >= 2
UNION ALL SELECT artifact, 'Copybook', communities, 'shared contract', 0, readers::INT FROM b WHERE communities >= 2""")
def community_contracts(spark, sf_dir):
    """What crosses between communities: data that is only read, data that is changed, shared copybooks."""
    rows = _rows(spark, sf_dir)
    return pr.contracts(_members(spark, sf_dir), pr.data_access(rows), pr.evidence_edges(rows))


@query(f"""
WITH {_M}, f AS (SELECT 'P' || k AS program, source, target, via FROM s, (VALUES ('WS-TEXT', 'WS-ALT', 'MOVE'), ('WS-CNT', 'WS-TOT', 'COMPUTE'), ('WS-ALT', 'WS-CNT', 'REDEFINES overlap'), ('WS-CNT', 'WS-ALT', 'REDEFINES overlap')) v(source, target, via))
SELECT * FROM f UNION ALL SELECT DISTINCT 'P' || k, '(sql result)', 'WS-TEXT', 'FETCH INTO' FROM reads JOIN s USING (k)""")
def data_flows(spark, sf_dir):
    """From which item to which data flows: moves, computations, results of queries, and items over the same bytes."""
    return pr.of(_rows(spark, sf_dir), "flow").select("program", F.col("name").alias("source"), "target", F.col("kind").alias("via"))


#: Statements of the long programs, by a number from 0 to 10 of each line item.
_STEPS = (
    ("IF A = ", "l_quantity"), ("END-IF", None), ("EVALUATE B", "l_quantity"), ("END-EVALUATE", None), ("PERFORM UNTIL C = ", "l_quantity"), ("END-PERFORM", None),
    ("MOVE 'P{0}' TO W{1}P", None), ("CALL W{2}P", None), ("EXEC SQL DECLARE C{3} CURSOR FOR\n             SELECT A FROM T{4}, U{5} WHERE X = 1 END-EXEC", None), ("EXEC SQL OPEN C{2} END-EXEC", None), ("ELSE", None),
)
_STEP = "(l_partkey * 7 + l_linenumber * 3) % 11"
_PARTS = ("l_partkey % 50", "l_linenumber % 3", "l_partkey % 4", "l_partkey % 3", "l_partkey % 7", "l_partkey % 2")


def _long_programs(spark, sf_dir):
    """(name, source): a program for each supplier, a statement for each of its line items in order, a paragraph for each third order whose first item it has."""
    text = lambda step, n: "concat('           '" + "".join(f", {x if k % 2 else repr(x)}" for k, x in enumerate(_split(step))) + (f", cast(cast({n} as int) as string)" if n else "") + ")"
    statement = f"CASE {_STEP} " + " ".join(f"WHEN {k} THEN {text(t, n)}" for k, (t, n) in enumerate(_STEPS)) + " END"
    head = "CASE WHEN l_linenumber = 1 AND l_orderkey % 3 = 0 THEN concat('       PARA-', l_orderkey, '.', chr(10)) ELSE '' END"
    # numbers are shuffled, texts made where they come together
    dealt = table(spark, sf_dir, "lineitem").selectExpr("concat('P', l_suppkey) AS name", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").repartition("name")
    rows = dealt.selectExpr("name", "struct(l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS at", f"concat({head}, {statement}) AS text")
    whole = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"))
    return whole.select("name", F.concat(F.lit("       PROCEDURE DIVISION.\n"), F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("source"))


def _split(step: str) -> list[str]:
    """A template as its texts and, between them, the expressions that it names."""
    out = [""]
    for piece in step.replace("{", "\0").replace("}", "\0").split("\0"):
        if piece.isdigit() and len(out) % 2:
            out += [_PARTS[int(piece)], ""]
        else:
            out[-1] += piece
    return out


def _long_rows(spark, sf_dir):
    return _parsed(spark, sf_dir, "long-program-rows", _long_programs, lambda spark, _: spark.createDataFrame([], "name string, source string"))


_LONG = f"""
l AS (SELECT l_suppkey AS k, l_orderkey AS o, l_linenumber AS n, {_STEP} AS t, {', '.join(f'{p} AS p{i}' for i, p in enumerate(_PARTS))}, l_quantity::INT AS q, (l_linenumber = 1 AND l_orderkey % 3 = 0) AS opens, (l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS place FROM lineitem),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY k ORDER BY place) AS para, row_number() OVER (PARTITION BY k ORDER BY place) AS seq, coalesce('PARA-' || last_value(CASE WHEN opens THEN o END IGNORE NULLS) OVER (PARTITION BY k ORDER BY place), '(program)') AS paragraph,
  CASE WHEN t IN (1, 3, 5) THEN -1 WHEN t IN (0, 2, 4) THEN 1 ELSE 0 END AS step FROM l),
summed AS (SELECT *, sum(step) OVER (PARTITION BY k, para ORDER BY seq) AS s FROM numbered),
deep AS (SELECT *, (s - step - least(0, coalesce(min(s) OVER (PARTITION BY k, para ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::INT AS depth FROM summed),
st AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY seq) - 1)::INT AS ordinal,
  CASE t WHEN 0 THEN 'IF A = ' || q WHEN 2 THEN 'EVALUATE B' || q WHEN 4 THEN 'PERFORM UNTIL C = ' || q END AS said FROM deep WHERE t NOT IN (1, 3, 5))"""


@query(f"""
WITH {_LONG} SELECT 'P' || a.k AS program, a.ordinal, coalesce(b.ordinal, -1)::INT AS parent, coalesce(b.said, '(unconditional)') AS condition, a.depth, a.paragraph
FROM (SELECT *, depth - 1 AS above FROM st) a ASOF LEFT JOIN (SELECT * FROM st WHERE step = 1) b ON a.k = b.k AND a.para = b.para AND a.above = b.depth AND a.seq > b.seq""")
def statement_dependence(spark, sf_dir):
    """Which statement governs each, over whole programs of scopes of three kinds, closed too often and too rarely."""
    rows = _long_rows(spark, sf_dir)
    return pr.dependence(rows)


@query(f"""
WITH {_LONG} SELECT 'P' || c.k AS program, count(*) AS calls, coalesce('P' || m.p0, '(unresolved)') AS target, CASE WHEN m.k IS NULL THEN 'unresolved' ELSE 'resolved' END AS confidence
FROM (SELECT k, seq, p2 AS item FROM st WHERE t = 7) c ASOF LEFT JOIN (SELECT k, seq, p1 AS item, p0 FROM st WHERE t = 6) m ON c.k = m.k AND c.item = m.item AND c.seq > m.seq GROUP BY ALL""")
def dynamic_calls(spark, sf_dir):
    """Programs called by an item: the literal last moved into it before the call. Items are moved into again and again; one never is."""
    calls = pr.of(_long_rows(spark, sf_dir), "call")
    return calls.groupBy("program", "target", "confidence").agg(F.count("*").alias("calls"))


@query(f"""
WITH {_LONG}, d AS (SELECT k, seq, p3 AS c, ['T' || p4, 'U' || p5] AS tables FROM st WHERE t = 8),
u AS (SELECT u.k, d.tables FROM (SELECT k, seq, p2 AS c FROM st WHERE t = 9) u ASOF JOIN d ON u.k = d.k AND u.c = d.c AND u.seq > d.seq)
SELECT 'P' || k AS program, kind, target, count(*) AS n FROM (SELECT k, 'cursor' AS kind, unnest(tables) AS target FROM d UNION ALL SELECT k, 'open', unnest(tables) FROM u) GROUP BY ALL""")
def cursor_tables(spark, sf_dir):
    """Tables that cursors read: where declared, and at each opening those of the declaration last before it; opening an undeclared cursor reads none."""
    facts = pr.of(_long_rows(spark, sf_dir), "sql")
    return facts.groupBy("program", "kind", "target").agg(F.count("*").alias("n"))


@query(f"WITH {_M} SELECT 'P' || k AS program, 'WS-CNT' AS item, 'WS-DONE' AS state, '1' AS value FROM s")
def condition_names(spark, sf_dir):
    """Level-88 names with the item that they describe."""
    return pr.conditions(_rows(spark, sf_dir))


@query(f"""
WITH {_M}, u AS (SELECT n, string_agg(DISTINCT 'P' || k, ', ' ORDER BY 'P' || k) AS users FROM (SELECT k, n FROM copies) GROUP BY n),
b AS (SELECT 'C' || n AS origin, 'FLD-' || n AS field, 1 AS line, 'FLD-' || n || ' is a ' || (n % 9 + 1) || '-character alphanumeric field. It sits at WS-BOOK > FLD-' || n || ' in copybook C' || n || '. Used by ' || users || '.' AS text FROM u WHERE n IN (SELECT n FROM lib)),
w AS (SELECT 'P' || k AS origin, field, line, text FROM s, (VALUES ('WS-TEXT', 7, 'WS-TEXT is a 8-character alphanumeric field.'), ('WS-PGM', 8, 'WS-PGM is a 8-character alphanumeric field.'),
  ('WS-CNT', 9, 'WS-CNT is a packed-decimal number of 9 digits with 2 decimal place(s), signed, occupying 5 byte(s). Valid states: WS-DONE when 1.'), ('WS-ALT', 12, 'WS-ALT is a 5-character alphanumeric field.'), ('WS-TOT', 13, 'WS-TOT is a 5-digit zoned decimal number.')) v(field, line, text)),
c AS (SELECT 'P' || k AS origin, 'COMMAREA' AS field, (16 + (SELECT count(*) FROM m WHERE m.k = s.k))::INT AS line, 'COMMAREA is a ' || (k % 500 + 1) || '-character alphanumeric field.' AS text FROM s)
SELECT * FROM b UNION ALL SELECT * FROM w UNION ALL SELECT * FROM c""")
def field_cards(spark, sf_dir):
    """A sentence for each declared item."""
    return pr.field_cards(_rows(spark, sf_dir))


@query(f"WITH {_M} SELECT 'P' || k AS program, 'TRUNC' AS name, 'BIN' AS value, 'P' || k AS program_id, 2::BIGINT AS paragraphs FROM s")
def compiler_options(spark, sf_dir):
    """Compiler options, the program's own name and its paragraphs."""
    rows = _rows(spark, sf_dir)
    p = rows.groupBy("program").agg(F.max(F.when(F.col("record") == "program", F.col("name"))).alias("program_id"), F.count_if(F.col("record") == "paragraph").alias("paragraphs"))
    return pr.of(rows, "option").select("program", "name", F.col("target").alias("value")).join(p, "program")


_CODE = "'       MOVE 1 TO X.'"
_NOTES = {
    "name": "concat('N', s_suppkey)",
    "source": f"concat_ws(chr(10), CASE WHEN s_suppkey % 2 = 0 THEN concat('      * Copyright holder ', s_suppkey) END, {_CODE}, '      *  MOVE A TO B', '      * ADD 1 TO C', '      * words', {_CODE}, '      * Change log', "
    "concat('      * 01/02/2020 JSM PR#', s_suppkey, '  made   it'), concat('      * 3-04-99 12-11-21 note ', s_suppkey % 5), " + _CODE + ", concat('      * Reads orders of nation ', s_nationkey), " + _CODE + ", '      *---', "
    + _CODE + ", repeat(concat(' ', chr(10)), 22), '      / first', '      * second', " + _CODE + ", '      * alone')",
}


def _notes(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr(*(f"{e} AS {n}" for n, e in _NOTES.items()))


@query("""
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS nation, (s_suppkey % 2 = 0)::INT AS d FROM supplier),
b AS (SELECT 'N' || k AS name, 1 AS line, 1 AS n_lines, 'boilerplate' AS kind, 'Copyright holder ' || k AS text FROM s WHERE d = 1
  UNION ALL SELECT 'N' || k, d + 2, 3, 'commented-out-code', 'MOVE A TO B ADD 1 TO C words' FROM s
  UNION ALL SELECT 'N' || k, d + 6, 3, 'maintenance-log', 'Change log 01/02/2020 JSM PR#' || k || ' made it 3-04-99 12-11-21 note ' || (k % 5) FROM s
  UNION ALL SELECT 'N' || k, d + 10, 1, 'header', 'Reads orders of nation ' || nation FROM s
  UNION ALL SELECT 'N' || k, d + 37, 2, 'paragraph', 'first second' FROM s UNION ALL SELECT 'N' || k, d + 40, 1, 'inline', 'alone' FROM s)
SELECT name, line::INT AS line, n_lines::BIGINT AS n_lines, kind, text, row_number() OVER (PARTITION BY text ORDER BY name, line) > 1 AS duplicate FROM b""")
def comment_kinds(spark, sf_dir):
    """Comment blocks of six kinds, later copies marked."""
    return pr.comment_blocks(_notes(spark, sf_dir))


@query("""
WITH s AS (SELECT s_suppkey AS k, (s_suppkey % 2 = 0)::INT AS d FROM supplier)
SELECT 'N' || k AS name, d + 7 AS line, '01/02/2020' AS date, 'JSM' AS author, 'PR#' || k AS ticket, 'made it' AS description FROM s
UNION ALL SELECT 'N' || k, d + 8, '12-11-21', 'note', NULL, (k % 5)::VARCHAR FROM s""")
def maintenance_log(spark, sf_dir):
    """Dates, authors, tickets and descriptions of log entries in comments."""
    return pr.maintenance(_notes(spark, sf_dir))


@query(f"""
WITH {_M} SELECT 'field' AS kind, count(*) AS n FROM (SELECT DISTINCT n FROM copies WHERE n IN (SELECT n FROM lib) UNION ALL SELECT k FROM s, range(6)) UNION ALL SELECT 'program', count(*) FROM s UNION ALL SELECT 'paragraph', 2 * count(*) FROM s
UNION ALL SELECT 'comment', 1""")
def chunks_by_kind(spark, sf_dir):
    """Typed chunks of programs, counted: the log entry, which all programs share, is one."""
    rows = _rows(spark, sf_dir)
    chunks = pr.typed_chunks(rows, pr.field_cards(rows), pr.comment_blocks(_programs(spark, sf_dir)))
    return chunks.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {_M} SELECT 'P' || k || '.LAST-PARA' AS title, concat('LAST-PARA EXEC CICS RETURN TRANSID(''X', nation % 5, ''') END-EXEC') AS text, 'P' || k AS member FROM s")
def paragraph_chunks(spark, sf_dir):
    """The chunks of last paragraphs."""
    rows = _rows(spark, sf_dir)
    chunks = pr.typed_chunks(rows, pr.field_cards(rows), pr.comment_blocks(_programs(spark, sf_dir)))
    return chunks.filter("kind = 'paragraph' and endswith(title, 'LAST-PARA')").select("title", "text", "member")


_ASKED = ("who writes F4", "Which programs update the T3?", "what reads from T2", "who uses M3", "what calls P1", "which program links to P2", "who owns T99", "how many?")


@query(f"""
WITH {_M}, f AS (SELECT 'W' AS form, artifact AS subject, 'P' || k AS program FROM acc WHERE access = 'UPDATES' UNION ALL SELECT 'R', artifact, 'P' || k FROM acc WHERE access = 'READS'
  UNION ALL SELECT 'R', regexp_replace(target, '^[^:]*:', ''), substr(source, 9) FROM e UNION ALL SELECT 'C', substr(source, 9), substr(target, 9) FROM e WHERE kind IN ('CICS_LINK', 'CICS_XCTL', 'CALLS_STATIC', 'CALLS_DYNAMIC')),
q AS (SELECT * FROM (VALUES ('who writes F4', 'W', 'F4'), ('Which programs update the T3?', NULL, 'T3'), ('what reads from T2', 'R', 'T2'), ('who uses M3', 'R', 'M3'), ('what calls P1', 'C', 'P1'), ('which program links to P2', 'C', 'P2'), ('who owns T99', 'W', 'T99')) v(question, form, subject))
SELECT question, string_agg(DISTINCT program, ', ' ORDER BY program) AS answers FROM q LEFT JOIN f USING (form, subject) GROUP BY question""")
def graph_answers(spark, sf_dir):
    """Questions in words answered by predicates over access and edges."""
    rows = _rows(spark, sf_dir)
    return pr.graph_answers(spark.createDataFrame([(q,) for q in _ASKED], "question string"), pr.data_access(rows), pr.evidence_edges(rows))


_DECKS = {
    "name": "concat('J', s_suppkey)",
    "source": "concat_ws(chr(10), '//* //S0 EXEC PGM=NONE', concat('//S1 EXEC PGM=P', s_suppkey), concat('  run program(P', s_suppkey + 7, ')', CASE WHEN s_suppkey % 2 = 0 THEN concat(' plan(PL', s_nationkey, ')') ELSE '' END), concat('  CREATE TABLE &DB.T', s_suppkey % 9, ' ('), concat(' DEFINE TRANSACTION(X', s_nationkey, ') GROUP(A)'), concat('   PROGRAM(P', s_suppkey * 3, ')'), '   PROGRAM(LATER)', concat(' DEFINE PROGRAM(P', s_suppkey * 2, ')'), '   PROGRAM(OTHER)', ' DEFINE DB2ENTRY(D)')",
}


@query("""
WITH s AS (SELECT s_suppkey AS k, s_nationkey AS nation FROM supplier), f AS (
  SELECT k, 'STEP' AS kind, 'S1' AS subject, 'P' || k AS target, 2 AS line FROM s UNION ALL SELECT k, 'RUNS', CASE WHEN k % 2 = 0 THEN 'PL' || nation ELSE 'batch' END, 'P' || (k + 7), 3 FROM s
  UNION ALL SELECT k, 'CREATES_TABLE', 'DB2', 'T' || (k % 9), 4 FROM s UNION ALL SELECT k, 'ROUTES_TO', 'X' || nation, 'P' || (k * 3), 6 FROM s UNION ALL SELECT k, 'DEFINES_PROGRAM', 'CICS', 'P' || (k * 2), 8 FROM s)
SELECT 'J' || k AS member, kind, subject, target, target IN (SELECT 'P' || k FROM s) AS known, line FROM f""")
def resource_facts(spark, sf_dir):
    """Facts of job control and resource decks."""
    decks = table(spark, sf_dir, "supplier").selectExpr(*(f"{e} AS {n}" for n, e in _DECKS.items()))
    return pr.resource_facts(decks, _programs(spark, sf_dir))


_CALLERS = {
    "name": "concat('PG', 1000 + s_suppkey)",
    "source": "concat_ws(chr(10), concat('      * CALL ', chr(39), 'PG9999', chr(39)), concat('           CALL ', chr(39), 'PG', 1000 + s_suppkey % 7, chr(39), '.'), concat('           MOVE ', chr(39), 'PG', 1000 + s_suppkey * 2, chr(39), ' TO X'), concat('           EXEC CICS LINK PROGRAM(', chr(39), 'PGLINK', chr(39), ') END-EXEC'), concat('           COPY CBK', s_suppkey % 4, '.'))",
}


@query("""
WITH s AS (SELECT s_suppkey AS k FROM supplier)
SELECT DISTINCT 'PG' || (1000 + k) AS name, target FROM (SELECT k, 'PG' || (1000 + k % 7) AS target FROM s UNION ALL SELECT k, 'PG' || (1000 + k * 2) FROM s WHERE k * 2 IN (SELECT k FROM s) UNION ALL SELECT k, 'PGLINK' FROM s UNION ALL SELECT k, 'PGVIA' || (k % 4) FROM s WHERE k % 4 < 3)""")
def call_targets(spark, sf_dir):
    """Call targets by four patterns, one of them through copybooks."""
    members = table(spark, sf_dir, "supplier").selectExpr(*(f"{e} AS {n}" for n, e in _CALLERS.items()))
    books = [(f"CBK{k}", f"      * LINK PROGRAM('NOTTHIS')\n           EXEC CICS XCTL PROGRAM('PGVIA{k}')\n           LINK PROGRAM('LATER')") for k in range(3)]
    return pr.call_targets(members, spark.createDataFrame(books, "name string, source string"))


@query("SELECT 'PRG' || chr((65 + s_suppkey % 26)::INT) || s_suppkey AS program, lpad((s_nationkey % 12)::VARCHAR, 2, '0') AS domain, 'Does ' || s_suppkey AS function FROM supplier")
def catalog_rows(spark, sf_dir):
    """Programs of a markdown catalog, the first row of each."""
    row = "concat('| PRG', chr(65 + s_suppkey % 26), s_suppkey, ' | layer | ', s_nationkey % 12, '/3 | **Does ', s_suppkey, '** | more |')"
    docs = table(spark, sf_dir, "supplier").selectExpr("concat('d', s_suppkey) AS name", f"concat_ws(chr(10), '# Catalog', '| Program | Layer |', '|---|---|', {row}, replace({row}, 'Does', 'Again')) AS text")
    return pr.catalog(docs)


@query("""
SELECT 'd' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'd' || s_suppkey ELSE 'Title ' || s_suppkey END AS title,
  CASE WHEN s_suppkey % 2 = 0 THEN 'It sells. Twice.' ELSE 'This paragraph of ' || s_suppkey || ' is long enough to be a description of it.' END AS purpose FROM supplier""")
def domain_descriptions(spark, sf_dir):
    """Titles and purposes of markdown documents."""
    text = "concat(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('# Domain 4 — Title ', s_suppkey) END, chr(10), chr(10), 'short', chr(10), chr(10), 'This paragraph of ', s_suppkey, ' is long enough', chr(10), 'to be a description of it.', chr(10), chr(10), CASE WHEN s_suppkey % 2 = 0 THEN concat('## Business purpose', chr(10), 'It sells.', chr(10), 'Twice.', chr(10), '## Next', chr(10), 'x') ELSE '' END)"
    return pr.descriptions(table(spark, sf_dir, "supplier").selectExpr("concat('d', s_suppkey) AS name", f"{text} AS text"))
