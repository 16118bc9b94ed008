import random

import pytest


def words_of(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Near and exact copies, null, empty and blank texts, a null id, repeated rows, a very long text, and extra columns with clashing names."""
    rng = random.Random(11)
    rows = []
    for k in range(12):
        base = words_of(rng, 60).split()
        for c in range(4):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
            rows.append((k * 10 + c, " ".join(copy)))
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "Ein kurzer"), (504, "ein  KURZER"), (505, words_of(rng, 60_000)), (None, "no id here at all, six words"), (None, None)]
    rows += [rows[0], rows[0], (506, "été à Ñandú\n\n. 　 x")]
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), i, 1, "x", 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id long, label int, a string, bucket int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
