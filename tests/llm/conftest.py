import random

import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strange potions under pale moonlight near old harbour".split()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = "fp long, component_id string, ids string, key int, label string, rep int, sequence_id int, score string, base string, found int, curve int, root int, __id int, __q0 int, part int, n int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) * (rng.random() < 0.5) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls everywhere, empty and very long texts, repeated rows, copies and near copies."""
    rng = random.Random(9)
    out = [(i, prose(rng, rng.randint(1, 120)), "en", f"src{i % 3}", None) for i in range(60)]
    out += [(60, None, None, None, None), (61, "", "en", "src0", 0), (62, " \n\t ", "de", None, 4), (None, "no id at all here", None, "src1", None), (None, None, None, None, None)]
    out += [(63, prose(rng, 9000), "en", "src0", 50000), (64, "é ① ﬁ  日本語 <|endoftext|> ΑΣ\n\nDon't 12", "fr", "src2", 30)]
    same = prose(rng, 200)
    out += [(70 + i, same, "en", "src0", len(same)) for i in range(6)] + [(70, same, "en", "src0", len(same))]
    near = prose(rng, 900)
    out += [(80 + i, near + f" tail{i}", "en", "src0", len(near)) for i in range(5)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    clash = [c.split()[0] for c in CLASH.split(", ")]
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3, "n_chars")
    from pyspark.sql import functions as F

    return df.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASH.split(", ")}).select(*df.columns, *clash)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
