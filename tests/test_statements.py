"""Programs as rows, by hand and against loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import program, source, statements

PROGRAM = """000100 IDENTIFICATION DIVISION.
000200 PROGRAM-ID. DEMO1.
000300* 2020-01-02 JS TKT-12 first version
000400 DATA DIVISION.
000500 WORKING-STORAGE SECTION.
000600 01  WS-REC.
000700     05 WS-NAME      PIC X(20).
000800     05 WS-AMT       PIC S9(7)V99 COMP-3.
000900     05 WS-CNT       PIC 9(4) COMP.
001000     05 WS-ALT REDEFINES WS-CNT PIC X(2).
001100 01  WS-PGM          PIC X(8).
001200     COPY CUSTREC.
001300 PROCEDURE DIVISION.
001400 MAIN-PARA.
001500     MOVE 'SUBPGM' TO WS-PGM.
001600     CALL WS-PGM.
001700     CALL 'STATIC1'.
001800     EXEC SQL SELECT NAME INTO :WS-NAME
001810         FROM CUSTOMER WHERE ID = 1 END-EXEC.
001900     EXEC SQL DECLARE C1 CURSOR FOR SELECT NAME FROM ORDERS
001910         FOR UPDATE END-EXEC.
002000     EXEC SQL FETCH C1 INTO :WS-NAME END-EXEC.
002100     EXEC CICS LINK PROGRAM('NEXTPGM') END-EXEC.
002110     EXEC SQL INSERT INTO LOG VALUES (1) END-EXEC.
002120     EXEC SQL DELETE FROM LOG END-EXEC.
002130     EXEC SQL CONNECT TO DB1 END-EXEC.
002140     EXEC SQL EXECUTE S9 END-EXEC.
002150     EXEC CICS START TRANSID('TX1') END-EXEC.
002160     EXEC CICS DELETE FILE('CUSTF') END-EXEC.
002200     STOP RUN.
"""



@pytest.fixture(scope="module")
def demo(spark):
    books = spark.createDataFrame([("CUSTREC", "           05 CR-ID PIC X(4).\n       COPY CUSTREC.")], "name string, source string")
    return statements.parsed(spark.createDataFrame([("DEMO1", PROGRAM)], "name string, source string"), books).cache()


def of(rows, record, *keys):
    return [tuple(r[k] for k in keys) for r in program.of(rows, record).orderBy("line").collect()]


def test_program_facts(demo):
    """By hand from the rules, a program with every kind of fact; a copybook that copies itself ends."""
    assert of(demo, "copy", "name", "target", "confidence") == [("CUSTREC", "CUSTREC", "exact"), ("DEMO1", "CUSTREC", "exact")]
    assert of(demo, "call", "kind", "target", "confidence") == [("CALLS_DYNAMIC", "SUBPGM", "resolved"), ("CALLS_STATIC", "STATIC1", "exact")]
    assert sorted(of(demo, "sql", "kind", "target", "name", "confidence")) == sorted([
        ("dml", "CUSTOMER", "READS", "exact"), ("cursor", "ORDERS", "READS", "exact"), ("cursor", "ORDERS", "UPDATES", "exact"), ("fetch", "ORDERS", "READS", "resolved"), ("dml", "LOG", "WRITES", "exact"),
        ("dml", "LOG", "DELETES", "exact"), ("connect", "DB1", "CONNECT", "exact"), ("dynamic", "(unresolved)", "UNKNOWN", "unresolved"),
    ])
    assert of(demo, "cics", "kind", "target") == [("CICS_LINK", "NEXTPGM"), ("CICS_START", "TX1"), ("DELETES", "CUSTF")]
    assert set(of(demo, "item", "name", "length", "offset")) == {("WS-REC", 0, 0), ("WS-NAME", 20, 0), ("WS-AMT", 5, 20), ("WS-CNT", 2, 25), ("WS-ALT", 2, 25), ("WS-PGM", 8, 0), ("CR-ID", 4, 0)}
    assert set(of(demo, "flow", "name", "target", "kind")) == {("(sql result)", "WS-NAME", "FETCH INTO"), ("WS-ALT", "WS-CNT", "REDEFINES overlap"), ("WS-CNT", "WS-ALT", "REDEFINES overlap")}
    assert of(demo, "paragraph", "name") == [("MAIN-PARA",)] and of(demo, "program", "name") == [("DEMO1",)]


def test_books_through_each_other(spark):
    programs = spark.createDataFrame([("P1", "       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       COPY A."), ("P2", None), ("P3", "")], "name string, source string")
    books = spark.createDataFrame([("A", "       01 GA.\n       COPY B."), ("B", "           05 FB PIC 9.\n       COPY A."), ("C", "       COPY C.")], "name string, source string")
    rows = statements.parsed(programs, books)
    assert {(r.program, r.origin, r.name) for r in program.of(rows, "item").collect()} == {("P1", "A", "GA"), ("P1", "B", "FB")}
    assert statements.parsed(programs.limit(0), books).count() == 0
    assert program.of(statements.parsed(programs, books.limit(0)), "copy").first().confidence == "unresolved"


def test_nesting_as_by_a_stack(spark):
    """Random scopes, closed too often and left open; a paragraph starts anew."""
    rng = random.Random(3)
    rows, want = [], []
    for name in ("P1", "P2", "P3"):
        stack, ordinal = [], 0
        for at in range(150):
            verb = rng.choice(["IF", "END-IF", "MOVE", "EVALUATE", "END-EVALUATE", "ELSE", "PERFORM", "END-PERFORM"])
            number = at // 40
            if at % 40 == 0:
                stack = []
            text = "PERFORM X UNTIL Y" if verb == "PERFORM" and rng.random() < 0.7 else verb
            rows.append((name, [at], at, "o", verb, text, "para", number))
            if verb.startswith("END-"):
                stack = stack[:-1]
                continue
            want.append((name, at, ordinal, len(stack), stack[-1] if stack else -1))
            if verb in ("IF", "EVALUATE") or "UNTIL" in text:
                stack = [*stack, ordinal]
            ordinal += 1
    df = spark.createDataFrame(rows, "program string, at array<int>, line int, origin string, verb string, text string, paragraph string, number int")
    assert sorted(tuple(r) for r in statements.nested(df).select("program", "line", "ordinal", "depth", "parent").collect()) == sorted(want)


def test_as_of_lookups(spark):
    """Against loops: names bound again, used before and after, in several programs, and never bound."""
    rng = random.Random(4)
    rows, want, bound = [], {}, {}
    for at in range(300):
        p, c, makes = rng.choice("PQ"), rng.choice("abc"), rng.random() < 0.3
        if makes and c != "c":
            bound[p, c] = [f"T{at}"]
            rows.append((p, [at], c, bound[p, c]))
        else:
            rows.append((p, [at], c, None))
        want[at] = bound.get((p, c))
    df = spark.createDataFrame(rows, "program string, at array<int>, cursor string, tables array<string>").repartition(3)
    assert {r.at[0]: r.bound for r in statements.cursor_uses(df).collect()} == want
    moved = df.select("program", "at", F.col("cursor").alias("item"), F.get("tables", F.lit(0)).alias("literal"))
    assert {r.at[0]: r.value for r in statements.moved_literals(moved).collect()} == {k: v and v[0] for k, v in want.items()}


def test_picture_bytes(spark):
    cases = [("X(9)", "DISPLAY", 9), ("ZZ9.99", "DISPLAY", 3), ("S9(7)V99", "DISPLAY", 9), ("S9(7)V99", "COMP-3", 5), ("9(4)", "COMP", 2), ("9(5)", "BINARY", 4), ("S9(10)", "COMP-5", 8), ("-(5)9", "DISPLAY", 1), ("A(3)X", "DISPLAY", 4), (None, "COMP-1", 0), ("9", "COMP-2", 8), ("$$,$$9CR", "DISPLAY", 1)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "k int, p string, u string, want int")
    assert [(r.p, r.got) for r in df.withColumn("got", source.picture_bytes(F.col("p"), F.col("u"))).orderBy("k").collect()] == [(p, n) for p, _, n in cases]


def loop_layout(items):
    """Offsets and totals by recursion over children; what redefines adds nothing outside."""
    out, k = {}, 0
    names = []

    def take(level, at, path):
        nonlocal k
        total = 0
        while k < len(items) and items[k][0] > level:
            own, name, other, size = items[k]
            k += 1
            start = at + total
            if other and len(path):
                before = [o for n, o, rec in names if n == other and rec == record]
                start = before[-1] if before else start
                other = before[-1] if before else None
            else:
                other = None
            names.append((name, start, record))
            me = k - 1
            inner = take(own, start, (*path, name))
            out[me] = (".".join((*path, name)), start, size + inner)
            if other is None:
                total += size + inner
        return total

    while k < len(items):
        record, (own, name, _, size) = k, items[k]
        k += 1
        names.append((name, 0, record))
        me = k - 1
        out[me] = (name, 0, size + take(own, 0, (name,)))
    return [out[i] for i in range(len(items))]


def test_layout_as_by_recursion(spark):
    rng = random.Random(6)
    everything, want = [], []
    for p in range(8):
        items, n = [(1, "R0", None, 0)], 1
        while n < 40:
            level = 1 if rng.random() < 0.08 else min(items[-1][0] + 4, 13) if items[-1][3] == 0 and rng.random() < 0.6 else rng.choice([5, 9, 13])
            size = rng.choice([0, 1, 2, 5]) if level < 13 else rng.randrange(1, 6)
            if items[-1][3] and level > items[-1][0]:
                level = items[-1][0]  # only groups have children
            other = f"R{rng.randrange(max(0, n - 4), n)}" if level > 1 and rng.random() < 0.25 else None
            items.append((level, f"R{n}", other, size if level > 1 else 0))
            n += 1
        everything += [(f"P{p}", [i], "S", *x) for i, x in enumerate(items)]
        want += [(f"P{p}", i, *x) for i, x in enumerate(loop_layout(items))]
    df = spark.createDataFrame(everything, "program string, at array<int>, section string, level int, name string, redefines string, bytes int")
    got = sorted((r.program, r.at[0], ".".join(r.path), r.offset, r.total) for r in source.layout_of(df).collect())
    assert got == sorted(want)
