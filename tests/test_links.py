from tessera.operators import retrieval
from tessera.plans.search import linked_by


def test_links_of_a_source_are_bounded(spark):
    """A query is linked with no more documents of one source and language than can be among its best."""
    places = spark.createDataFrame([(d, f"s{d % 2}", None if d % 50 == 0 else "en") for d in range(400)], "doc long, source string, lang string")
    best = spark.createDataFrame([(1, "s0", "en", 2), (1, "s1", "en", 1), (2, "s1", "en", 3)], "query long, source string, lang string, n long")
    linked = linked_by(places, best, 5)
    assert linked.count() == 15
    every = places.join(best, ["source", "lang"]).select("query", "doc", best.n.cast("double").alias("score"))
    rows = lambda df: sorted(map(tuple, retrieval.top(df, 5).collect()))
    assert rows(linked) == rows(every)
