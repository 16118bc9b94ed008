"""Queries over single lines of fixed-format sources and over links of pages; sources are made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import program as pr
from ..operators import source as src
from ..sources.tables import table
from .programs import _M, _rows
from .registry import query


@query(f"""
WITH {_M}, f AS (SELECT DISTINCT k, n FROM copies WHERE n IN (SELECT n FROM lib)), b AS (SELECT 'P' || k AS program, 5 AS level, 'FLD-' || n AS name, 'X(' || (n % 9 + 1) || ')' AS picture, (n % 9 + 1) AS length, coalesce(sum(n % 9 + 1) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offset_ FROM f)
SELECT program, level, name, picture, length::INT AS length, offset_::INT AS offset_ FROM b UNION ALL SELECT 'P' || k, 1, name, picture, length, 0 FROM s, (VALUES ('WS-TEXT', 'X(8)', 8), ('WS-PGM', 'X(8)', 8), ('WS-CNT', 'S9(7)V99', 5), ('WS-ALT', 'X(5)', 5), ('WS-TOT', '9(5)', 5), ('WS-BOOK', NULL, 0)) v(name, picture, length)
UNION ALL SELECT 'P' || k, 1, 'COMMAREA', 'X(' || (k % 500 + 1) || ')', (k % 500 + 1)::INT, 0 FROM s""")
def item_layout(spark, sf_dir):
    """Data items with byte sizes and offsets, copybooks' among them; one that redefines another starts where it does."""
    return pr.of(_rows(spark, sf_dir), "item").filter("level <> 88").select("program", "level", "name", "picture", "length", F.col("offset").alias("offset_"))


_LAYOUT = {
    "name": "concat('L', s_suppkey)",
    "source": "concat_ws(chr(10), '       01  REC.', concat('           05 A PIC X(', s_suppkey % 30 + 1, ').'), '           05 B PIC S9(7)V99 COMP-3.', '           05 C OCCURS 3 PIC 9(4) COMP.', '           05 D REDEFINES C PIC X(6).', '           05 E PIC X.')",
}


@query("""
WITH s AS (SELECT s_suppkey AS k, (s_suppkey % 30 + 1)::INT AS a FROM supplier)
SELECT 'L' || k AS name, item, path, bytes::INT AS bytes, offset_::INT AS offset_ FROM s, LATERAL (VALUES ('REC', 'REC', a + 12, 0), ('A', 'REC.A', a, 0), ('B', 'REC.B', 5, a), ('C', 'REC.C', 6, a + 5), ('D', 'REC.D', 6, a + 5), ('E', 'REC.E', 1, a + 11)) v(item, path, bytes, offset_)""")
def record_layout(spark, sf_dir):
    """Groups and fields with sizes, a group's being the sum of its fields'."""
    members = table(spark, sf_dir, "supplier").selectExpr(*(f"{e} AS {n}" for n, e in _LAYOUT.items()))
    return src.layout(members).select("name", "item", "path", "bytes", F.col("offset").alias("offset_"))


@query(r"SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))) AS target FROM pages")
def page_links(spark, sf_dir):
    """Targets mined from markup: the reference rows of a graph of pages."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("target"))


_DDL = "concat('EXEC SQL DECLARE CUST', s_suppkey, ' TABLE (ID INTEGER NOT NULL, N', s_suppkey, ' VARCHAR(20),', chr(10), ' price DECIMAL(6, 0)) END-EXEC.', chr(10), 'CREATE TABLE T2 (A DATE, B CHAR(1));')"


@query("""
SELECT 'M' || s_suppkey AS member, table_ , position_::INT AS position_, column_, kind FROM supplier, LATERAL (VALUES ('CUST' || s_suppkey, 0, 'ID', 'INTEGER'), ('CUST' || s_suppkey, 1, 'N' || s_suppkey, 'VARCHAR(20)'), ('CUST' || s_suppkey, 2, 'PRICE', 'DECIMAL(6, 0)'), ('T2', 0, 'A', 'DATE'), ('T2', 1, 'B', 'CHAR(1)')) v(table_, position_, column_, kind)""")
def declared_columns(spark, sf_dir):
    """Columns of declared and created tables."""
    found = src.declared_columns(table(spark, sf_dir, "supplier").selectExpr("concat('M', s_suppkey) AS name", f"{_DDL} AS source"))
    return found.select("member", F.col("table").alias("table_"), F.col("position").alias("position_"), F.col("column").alias("column_"), "kind")


_LONG = "concat_ws(chr(10), concat('           MOVE ', chr(39), 'LONG', s_suppkey), '      * between', '      -    ', concat('      -     TAIL', chr(39), ' TO X.'), '           STOP RUN.')"


@query("SELECT 'C' || s_suppkey AS name, line, code FROM supplier, LATERAL (VALUES (1, concat('    MOVE ', chr(39), 'LONG', s_suppkey, 'TAIL', chr(39), ' TO X.')), (5, '    STOP RUN.')) v(line, code)")
def continued_lines(spark, sf_dir):
    """Lines of code with those that continue them."""
    return src.continued(table(spark, sf_dir, "supplier").selectExpr("concat('C', s_suppkey) AS name", f"{_LONG} AS source"))
