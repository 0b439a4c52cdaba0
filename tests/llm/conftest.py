import pytest

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    schema = "doc_id long, text string, row string, counts long, kept string, id long, key string, block int, shard int, component long, n long, size long"
    rows = [
        (1, None), (2, ""), (3, "one two"), (4, "one two"), (5, LONG), (6, LONG + " end"), (7, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (None, "a b c d e f g h i j"), (None, None),
        (8, "Same line that is long enough.\nother"), (9, "  SAME line that is long enough.\t\nmore"), (10, "same line that is long enough.\nsame line that is long enough."), (11, "\n\n \n"), (12, "ü€ 😀 ñandú"),
    ]
    return spark.createDataFrame([(i, t, "r", 1, "k", 2, "y", 3, 4, 5, 6, 7) for i, t in rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def prose():
    """Seeded texts: near copies of a few bases, exact copies, lone texts."""
    import random

    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("lo", "mi", "re", "sa", "tu", "ne") for b in ("ka", "po", "dir", "um", "est", "ol", "ar")]
    out = []
    for b in range(6):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 200))]
        out.append(" ".join(base))
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(words) + str(rng.randrange(99))
            out.append(" ".join(copy))
        out.append(out[-1])
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(40)]
    rng.shuffle(out)
    return out
