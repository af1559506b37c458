import random

import pytest

KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use themselves.
CLASHES = ("key", "node", "band", "packed", "bands", "path", "bytes", "x0", "h", "topic", "weight", "probability", "tokens", "component", "rank", "_key", "vec_id", "gram", "token_ids", "toxic", "label")


def prose(seed: int, words: int, stock: int = 400) -> str:
    r = random.Random(seed)
    names = ["".join(random.Random(i).choices("abdeghiklmnoprstuv", k=2 + i % 7)) for i in range(stock)]
    return " ".join(r.choices(names, k=words)).capitalize() + "."


def edge_rows():
    long = prose(99, 60_000)
    rows = [(i, prose(i, 30 + 5 * i), "en" if i % 2 else "fr", f"src{i % 3}", 10 * i) for i in range(12)]
    return [
        *rows, rows[3], rows[3], rows[3],
        (None, prose(50, 20), "en", "src1", 5), (None, None, None, None, None), (20, None, "de", None, None), (21, "", None, "src0", 0),
        (22, long, "en", "src0", len(long)), (23, "   \n\t ", "en", "src2", 6), (24, "\U0001f600 éè � !!", "fr", "src2", 8), (25, "word", "en", "src2", 4), (26, prose(3, 45), "en", "src0", 30),
    ]


@pytest.fixture(scope="session")
def edges(spark):
    """Documents with nulls in every column, empty, blank and very long texts, repeated rows, and clashing columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), KINDS)
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], KINDS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(12)] + [(None, None, None), (3, 0, None), (5, None, 7)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def topics(spark):
    return spark.createDataFrame([(i, [float(i), 1.0], i % 3) for i in range(12)] + [(None, None, None), (4, [1.0, 1.0], 0)], "vec_id bigint, embedding array<float>, label int")
