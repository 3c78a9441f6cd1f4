import random

import pytest

#: Names that operators use inside, as extra columns of the input.
CLASHING = ["score", "n", "key", "block", "bucket", "parts", "rate", "salt", "before", "offset", "shift", "node",
            "cluster", "hit_words", "mix_size", "source_size", "target", "text_", "class_id", "ordinal", "row"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, extra columns."""
    rng = random.Random(11)
    voc = [f"w{i}" for i in range(80)] + ["Élan", "ß", "日本", "x,", "End."]
    base = [" ".join(rng.choice(voc) for _ in range(n)) for n in (1, 2, 5, 30, 60, 120)]
    rows = [(i, rng.choice(base) + (" " + rng.choice(voc)) * rng.randint(0, 2), "en", rng.choice(["a", "b", None]), 1) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "en", "a", 0), (62, " \n\t ", "en", "c", 4), (None, base[4], "en", "a", 9),
             (None, None, None, None, None), (63, " ".join(base) * 40, "de", "hot", 7), (64, "a" * 3000, "de", "hot", 7),
             (65, "ab " * 2000, "de", "hot", 7), (5, base[3], "en", "a", 1), (5, base[3], "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHING:
        df = df.selectExpr("*", f"'x' AS {c}")
    return df.repartition(4)


@pytest.fixture(scope="session")
def edge_rows(edge_docs):
    return [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
