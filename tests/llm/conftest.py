import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 0, n: int = 160) -> list[tuple]:
    """Texts with copies, near copies, shared lines and passages, junk, nulls and ties."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßñT") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) + rng.choice(["", "", ".", ",", "!"]) for _ in range(k))
    lines = [text(12) for _ in range(4)] + ["short line"]
    passages = [text(70) for _ in range(3)]
    out: list[tuple] = []
    for i in range(n):
        parts = [text(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            parts.append(rng.choice([rng.choice(lines), rng.choice(lines).upper() + "  ", rng.choice(passages), "a b c d e " * rng.randint(1, 9), text(rng.randint(0, 40))]))
        t = "\n".join(parts)
        if out and rng.random() < 0.15:
            t = rng.choice(out)[1] or ""
        elif out and rng.random() < 0.1:
            w = (rng.choice(out)[1] or "x").split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        out.append((i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), len(t)))
    long = text(9000)
    out += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (1002, " \t\n\x0b\x0c\r ", "en", "s1", 7), (1003, long, "en", "s2", len(long)), (1004, long, "en", "s2", len(long)), (1005, "one", "en", "s1", 3), (1006, "\n\n", "en", "s1", 2)]
    out += [(None, out[3][1], "en", "s9", 1), (7, out[7][1], out[7][2], out[7][3], out[7][4]), (8, "another text of number eight " + text(60), "en", "s1", 9)]
    return out


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("row", "bucket", "grp", "part", "key", "fp", "h1", "keep", "score", "size", "target", "stratum", "kept", "doc"):
        df = df.withColumn(c, F.lit("x"))
    return df.cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
