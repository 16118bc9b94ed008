import random
import re

import pyarrow as pa
import pytest

from tessera.operators import lexical_index, retrieval
from tessera.sources.shared import fingerprint, shared_dir, stored, written_once


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Documents of common words and, in groups, of words of their own; null, empty and equal texts."""
    rng = random.Random(7)
    rows = [(i, " ".join([rng.choice(["of", "The", "and"]) for _ in range(rng.randrange(2, 30))] + [f"own{i // 20}-{rng.randrange(6)}" for _ in range(rng.randrange(12))])) for i in range(600)]
    rows += [(700, None), (701, ""), (702, rows[3][1]), (703, rows[3][1])]
    path = str(tmp_path_factory.mktemp("texts") / "docs")
    spark.createDataFrame(rows, "doc long, text string").repartition(3).write.parquet(path)
    return path


QUERIES = [(1, "of own3-1 own3-2 own3-2"), (2, "THE and of"), (3, "unknown"), (4, None), (5, "own7-0"), (6, " ".join(f"own{k}-{k % 6}" for k in range(30)) + " of")]


@pytest.mark.parametrize("k", [1, 8, 1000])
def test_search_as_by_joins(spark, texts, k, monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK_DOCS", 16)
    docs, queries = spark.read.parquet(texts), spark.createDataFrame(QUERIES, "query long, text string")
    rows = lambda df: sorted((r.query, r["rank"], r.doc, round(r.score, 8)) for r in df.collect())
    want = rows(retrieval.top(retrieval.bm25(docs, queries), k))
    index = lexical_index.index_of(docs)
    assert rows(index.search(queries, k)) == want
    assert index.search(queries.limit(0), k).count() == 0
    monkeypatch.setattr(lexical_index, "HELD_ROWS", 3)  # more terms than a local table takes
    assert rows(index.search(queries, k)) == want


def test_few_blocks_are_opened(spark, texts, monkeypatch):
    """Of a query's common terms only blocks that hold candidates are opened; documents without an essential term are never scored."""
    monkeypatch.setattr(lexical_index, "BLOCK_DOCS", 16)
    index = lexical_index.index_of(spark.read.parquet(texts))
    asked = lexical_index.held(index.asked(spark.createDataFrame(QUERIES[:1], "query long, text string")))
    marked = lexical_index.held(index.essential(asked, 3))
    essential = {r.term: r.essential for r in marked.collect()}
    assert essential["own3-2"] and not essential["of"]
    alive = stored(index.candidates(marked, 3))
    opened, every = index.opened(marked, alive).count(), index.of(asked, "n").filter("term = 'of'").count()
    assert opened < 0.5 * every and alive.count() < 20 < index.scores(asked).count()


def test_the_index_follows_its_files(spark, texts):
    docs = spark.read.parquet(texts)
    first = lexical_index.index_of(docs)
    assert lexical_index.index_of(spark.read.parquet(texts)).path == first.path
    before = fingerprint(docs)
    spark.createDataFrame([(900, "late words")], "doc long, text string").write.mode("append").parquet(texts)
    more = spark.read.parquet(texts)
    assert fingerprint(more) != before and lexical_index.index_of(more).path != first.path
    assert lexical_index.index_of(more).search(spark.createDataFrame([(1, "late")], "query long, text string"), 2).first().doc == 900


def test_a_build_that_dies_leaves_nothing(spark, tmp_path):
    name = f"dies-{random.random()}"

    def dies(path):
        spark.range(3).write.parquet(f"{path}/half")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        written_once(spark, name, dies)
    path = written_once(spark, name, lambda p: spark.range(5).write.parquet(f"{p}/whole"))
    assert path == f"{shared_dir(spark)}/{name}" and spark.read.parquet(f"{path}/whole").count() == 5
    assert written_once(spark, name, dies) == path


def test_postings_are_made_where_blocks_lie(spark, texts, tmp_path, monkeypatch):
    """Postings of small blocks, cut over batches, as counted one by one; no count of a term in a document is shuffled."""
    monkeypatch.setattr(lexical_index, "BLOCK_DOCS", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        docs = spark.read.parquet(texts)
        path = str(tmp_path / "index")
        lexical_index.write_index(docs, path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    words = {r.doc: [w.lower() for w in re.findall("[A-Za-z][A-Za-z0-9_-]+", r.text or "")] for r in docs.collect()}
    mean = spark.read.parquet(f"{path}/corpus").first().mean_length
    want = {(w, d): ws.count(w) * 2.4 / (ws.count(w) + 1.4 * (0.25 + 0.75 * len(ws) / mean)) for d, ws in words.items() for w in ws}
    rows = spark.read.parquet(f"{path}/postings").collect()
    got = {(r.term, x.doc): x.part for r in rows for x in r.p}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-12 for k, v in want.items()) and sum(r.n for r in rows) == len(want)
    assert all(r.n == len(r.p) <= 16 and r.most == max(x.part for x in r.p) and [x.doc for x in r.p] == sorted(x.doc for x in r.p) for r in rows)
    assert len({(r.term, r.block) for r in rows}) == len(rows)
    batch = pa.record_batch([pa.array([1, 1, 2]), pa.array([9, 4, 5]), pa.array([2, 1, 0], pa.int32()), pa.array([["a", "a"], ["a"], []])], names=["block", "doc", "length", "ts"])
    out = pa.Table.from_batches(lexical_index.block_postings(1.0, 1.4, 0.75)([batch])).to_pylist()
    assert [(r["term"], r["block"], r["n"], [x["doc"] for x in r["p"]]) for r in out] == [("a", 1, 2, [4, 9])]
