import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone amber quill harbor lantern meadow copper violet thistle ember willow anchor cinder".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(seed=5, n=60):
    """Small documents with exact and near copies, shared lines and passages,
    blanks, marks and several sources."""
    rng = random.Random(seed)
    shared = [prose(rng, k) for k in (3, 7, 12, 60)]
    rows = []
    for i in range(n):
        lines = [prose(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        if i % 7 == 0:
            lines.insert(0, "")
        text = "\n".join(lines)
        if i % 9 == 4 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if i % 9 == 7 and rows:
            text = rows[rng.randrange(len(rows))][1].replace("stone", "pebble", 1)
        rows.append((i, text, "en", f"src{i % 5}" if i % 11 else None, len(text)))
    return rows


ODD = [
    (1001, None, "en", "src0", 0), (1002, "", "en", "src0", 0), (1003, " \t\n ", None, None, None),
    (None, "amber quill harbor lantern meadow copper violet thistle ember", "en", "src1", 9),
    (1004, "amber quill harbor lantern meadow copper violet thistle ember", "en", "src1", 9),
    (1005, "x" * 30_000 + " " + "long words " * 20_000, "en", "src2", 9),
    (1006, "same row", "en", "src3", 8), (1006, "same row", "en", "src3", 8),
    (1007, "same id", "en", "src3", 8), (1007, "other text", "en", "src4", 8),
    (-5, "negative id é中 \U0001f600 licença", "en", "é", 8),
]


@pytest.fixture(scope="session")
def rows():
    return corpus() + ODD


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)
    for name in ("pos", "line", "h1", "fp", "doc", "copies", "host", "score", "start", "node", "k", "n", "depth", "text_hash",
                 "g_lines", "target", "size", "salt", "row", "ord", "sequence_id"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
