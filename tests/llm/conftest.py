import random

import pytest

#: Columns that operators use inside; inputs may have them too.
CLASH = "n_words long, component_id long, pos int, words string, fp long, key long, at int, spans string, kept boolean, row_key long, first long, start long, n_tokens long, seed long"


def prose(r: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): nulls, empty, very short and very long texts, copies, near copies, shared passages, ties, rows with one id, repeated rows."""
    r = random.Random(3)
    passage = prose(r, 80)
    base = prose(r, 120)
    near = list(base)
    near[60] = "changed"
    long = prose(r, 30_000, 5000)
    out = [
        (1, " ".join(base)),
        (2, " ".join(near)),
        (3, " ".join(prose(r, 30) + passage + prose(r, 20))),
        (4, " ".join(prose(r, 5) + passage + prose(r, 50))),
        (5, "\n".join([" ".join(passage[:40]), " ".join(passage[40:])])),
        (6, None),
        (7, ""),
        (8, " \n\t "),
        (9, "one two three"),
        (10, "One  TWO\tthree"),
        (11, " ".join(base)),
        (12, " ".join(long)),
        (13, " ".join(long[:200] + ["x"] + long[200:])),
        (None, " ".join(base)),
        (None, "a lonely text of a few words only"),
        (15, "same row"),
        (15, "same row"),
        (16, "one id, two texts: " + " ".join(passage)),
        (16, "one id, two texts"),
        (17, "é " * 60 + "ÀB C  x"),
        (18, " ".join(["spam"] * 400)),
        (19, " ".join(["spam"] * 400)),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows as a table with columns whose names clash."""
    from pyspark.sql import functions as F

    out = spark.createDataFrame([(i, t, ["en", "de", None][k % 3], ["a", "a", "b", None][k % 4]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    out = out.withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASH.split(", "):
        name, kind = c.split()
        out = out.withColumn(name, F.lit(None).cast(kind))
    return out.cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
