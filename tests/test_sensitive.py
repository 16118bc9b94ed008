"""Detectors read texts as their SQL does: edges of words in ASCII, folded case, blanks, numbers side by side."""

import duckdb
import pytest

from tessera.operators.sensitive import assess
from tessera.plans import ORACLES, QUERIES

TEXTS = (
    "mail à a.b@c.comé", "épassword=hunter22", "host.internalé", "wordé4111111111111111é", "4111 1111 1111 1111-é", "hoſt.corp", "bacK.locAl", "ſecret=abcdefgh", "password=abcde\x0bfgh", "secret\x0b=abcdefgh",
    "call 555-123-4567 555-123-4568 or 555-123-4569", "(555) 123-4567 (555) 123-4568", "555-123-4567\n", "x٣555-123-4567,555-123-4568,555-123-4569", "10.1.2.3é 192.168.1.20", "123-45-6789é", "", None,
)


@pytest.mark.parametrize("name", ["pii_redacted", "pii_tier_summary", "pii_incidents", "card_luhn_valid"])
def test_odd_texts_as_in_sql(spark, tmp_path, name):
    rows = [(i, t, "en") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = c.execute(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_the_operator_leaves_no_number(spark):
    docs = spark.createDataFrame([(1, "555-123-4567 555-123-4568 555-123-4569")], "doc_id long, text string")
    assert assess(docs).first().redacted == "[PHONE_REDACTED] [PHONE_REDACTED] [PHONE_REDACTED]"
