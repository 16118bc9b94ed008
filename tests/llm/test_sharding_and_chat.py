import duckdb

from tessera.llm import chat, sharding


def test_shards_fit_and_match_sql(spark, odd_docs, no_docs):
    limit = 3000
    got = sharding.assign_shards(odd_docs, limit).toPandas()
    con = duckdb.connect()
    con.register("documents", odd_docs.select("doc_id", "text").toArrow())
    want = con.execute(f"SELECT doc_id, n_bytes, shard, shard_depth, shard_bytes, oversize FROM ({sharding.oracle(limit)})").fetchall()
    rows = sharding.assign_shards(odd_docs, limit).select("doc_id", "n_bytes", "shard", "shard_depth", "shard_bytes", "oversize").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    fits = got[~got.oversize]
    assert (fits.groupby("shard").n_bytes.sum() <= limit).all() and got.oversize.any()
    shards = sorted(got["shard"].unique())
    assert all(not b.startswith(a) for a in shards for b in shards if a != b)
    assert sharding.assign_shards(no_docs, limit).count() == 0
    assert sharding.assign_shards(odd_docs, 1 << 40).select("shard").distinct().collect()[0][0] == ""


def test_write_shards(spark, odd_docs, tmp_path):
    unique = odd_docs.filter("doc_id < 100").dropDuplicates(["doc_id"])
    sharding.write_shards(unique, sharding.assign_shards(unique, 3000), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == unique.count()


TURNS = [
    (1, 0, "user", "a"), (1, 1, "assistant", "b"),
    (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"),
    (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"),
    (4, 0, "user", "b"), (5, 0, "user", None), (6, 0, "user", ""), (6, 1, None, "z"),
    (7, 5, "user", "x"), (7, 5, "user", "x"), (7, None, "system", "first"), (None, 0, "user", "a"),
]


def test_chats(spark):
    turns = spark.createDataFrame([(*t, 1, "y") for t in TURNS], "conv_id long, turn long, role string, text string, k int, h1 string")
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.format_chats(turns).collect()}
    assert set(got) == {2, 4, 6, 7}
    assert got[2][1] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert got[7][0] == 3 and got[7][1].startswith("<|im_start|>system")
    con = duckdb.connect()
    con.register("conversations", turns.toArrow())
    assert {r[0]: (r[1], r[2]) for r in con.execute(chat.ORACLE).fetchall()} == got
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_long_chat_over_many_stretches(spark):
    long = [(1, t, "user", f"t{t}") for t in range(3000)] + [(2, t, "user", f"t{t}") for t in range(2500)] + [(3, t, "user", f"t{t + (t == 2400)}") for t in range(2500)]
    got = {r.conv_id: r.n_turns for r in chat.maximal_conversations(spark.createDataFrame(long, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: 3000, 3: 2500}
