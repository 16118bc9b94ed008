"""Plans that pass nothing that grows through the driver."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators import program as pr
from tessera.operators import source
from tessera.operators import statements as st
from tessera.plans import programs as plans
from tessera.sources import shared
from tessera.sources.shared import stored

SOURCE = """       CBL TRUNC(BIN)
       IDENTIFICATION DIVISION.
       PROGRAM-ID. P1.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 WS-A PIC X(8).
       01 WS-B REDEFINES WS-A PIC X(5).
          88 WS-ON VALUE 1.
       COPY C1.
       PROCEDURE DIVISION.
       MAIN-PARA.
           IF WS-A = 1
               MOVE WS-A TO WS-B
           END-IF.
           EXEC CICS LINK PROGRAM('P2') END-EXEC.
           EXEC CICS READ FILE('F1') END-EXEC."""


@pytest.fixture(scope="module")
def rows(spark):
    programs = spark.createDataFrame([(f"P{k}", SOURCE.replace("P1", f"P{k}")) for k in range(4)], "name string, source string")
    return stored(st.parsed(programs, spark.createDataFrame([("C1", "           05 C-X PIC X.")], "name string, source string")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_views_of_programs_broadcast_no_rows(spark, rows, tmp_path):
    """A table in files is many times larger in rows than the optimizer takes it for."""
    spark.range(4).selectExpr("concat('P', id) AS program", "id % 2 AS community").write.parquet(str(tmp_path / "m"))
    members = spark.read.parquet(str(tmp_path / "m"))
    access, edges = pr.data_access(rows), pr.evidence_edges(rows)
    cards = pr.field_cards(rows)
    for view in (edges, pr.dependence(rows), cards, pr.contracts(members, access, edges), pr.typed_chunks(rows, cards, pr.comment_blocks(stored(spark.createDataFrame([("P1", SOURCE)], "name string, source string"))))):
        assert "BroadcastHashJoin" not in plan(view) and view.count() > 0
    items = stored(pr.of(rows, "item").filter("level < 88").selectExpr("program", "array(line) AS at", "section", "level", "name", "redefines", "length AS bytes"))
    assert "BroadcastHashJoin" not in plan(source.layout_of(items))


def test_tiles_are_not_broadcast(spark):
    members = stored(spark.range(300).selectExpr("id AS holder", "id % 2 AS item"))
    assert re.search(r"SortMergeJoin \[item#\d+L?, i#", plan(graph.co_membership(members, holders=20)))


def test_governing_statements_need_no_join(rows):
    """A statement's row holds the text of the one that governs it."""
    found = pr.dependence(rows)
    assert "Join" not in plan(found)
    assert {(r.ordinal, r.parent, r.condition) for r in found.filter("program = 'P2'").collect()} >= {(0, -1, "(unconditional)"), (1, 0, "IF WS-A = 1")}


def test_shuffles_of_programs_grow_with_the_input(spark, monkeypatch):
    """What makes the rows of programs has a partition for every so many line items, and leaves the session as it was."""
    monkeypatch.setattr(shared, "PARTITION_ROWS", 100)
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")

    def programs(own, sf_dir):
        seen.append(int(own.conf.get("spark.sql.shuffle.partitions")))
        return own.createDataFrame([("P1", SOURCE)], "name string, source string")

    found = plans._parsed(spark, "/root/testdata/sf0.001", "sized-rows", programs, lambda own, _: own.createDataFrame([], "name string, source string"))
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert seen == [n // 100 + 1] and seen[0] > int(before) and found.count() > 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_layouts_ask_for_levels_that_items_have(spark, monkeypatch):
    """Two of 49 levels are there, so each row is asked for two, not 49; what stands above an item is as before."""
    said = []
    monkeypatch.setattr(source, "stored", lambda df: said.append(plan(df)) or stored(df))
    rows = [("P", k, level, name) for k, (level, name) in enumerate([(1, "R"), (5, "A"), (5, "B"), (77, "C"), (1, "S"), (5, "A")])]
    items = spark.createDataFrame(rows, "program string, k int, level int, name string").selectExpr("program", "array(k) AS at", "'' AS section", "level", "name", "cast(null AS string) AS redefines", "4 AS bytes")
    found = source.layout_of(items).orderBy("at").collect()
    assert len(set(re.findall(r"level#\d+ = (\d+)\)", said[0]))) == 2
    assert [".".join(r.path) for r in found] == ["R", "R.A", "R.B", "C", "S", "S.A"] and [r.offset for r in found] == [0, 0, 4, 0, 0, 0]


def test_lines_are_sorted_once(spark):
    """Sections are found in the program's order; one of a division before is not taken over."""
    code = ["       DATA DIVISION.", "       LINKAGE SECTION.", "       01 A PIC X.", "       DATA DIVISION.", "       01 B PIC X."]
    lines = stored(spark.createDataFrame([("P", [k], "P", k, c[7:]) for k, c in enumerate(code)], "program string, at array<int>, origin string, line int, code string"))
    found = st.sentences(lines)
    assert len(re.findall(r"Sort \[program#\d+ ASC NULLS FIRST, (?:at|divided)#", plan(found))) == 1
    assert [r.section for r in found.orderBy("line").filter("text like '01%'").collect()] == ["LINKAGE", None]


def test_texts_of_statements_are_searched_once_for_flows(spark):
    statements = stored(spark.createDataFrame([("P", 1, "MOVE", "MOVE AAA TO BBB CCC"), ("P", 2, "EXEC", "EXEC SQL SELECT A INTO :BBB FROM T END-EXEC"), ("P", 3, "MOVE", "MOVE DDD TO AAA")], "program string, line int, verb string, text string"))
    items = stored(spark.createDataFrame([("P", "AAA", None, 1), ("P", "BBB", "AAA", 1), ("Q", "DDD", None, 1)], "program string, name string, redefines string, line int"))
    found = st.flow_facts(statements, items)
    assert plan(found).count("Generate explode") == 3  # targets, sources and redefinitions
    assert {(r.source, r.target, r.via) for r in found.collect()} == {("AAA", "BBB", "MOVE"), ("(sql result)", "BBB", "FETCH INTO"), ("AAA", "BBB", "REDEFINES overlap"), ("BBB", "AAA", "REDEFINES overlap")}


def test_lists_of_many_groups_are_sorted_once(spark):
    """Hashed aggregates of lists sort nearly all rows again where groups are many; the session that is given keeps its own way."""
    lists = lambda session: plan(session.range(10).groupBy("id").agg(F.collect_list("id")))
    assert "ObjectHashAggregate" not in lists(shared.sized(spark, 1)) and "ObjectHashAggregate" in lists(spark)
