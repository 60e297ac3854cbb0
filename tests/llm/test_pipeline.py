import random
import re

import corpus_pipeline
from lectern.llm import queries, simhash

from .conftest import DOCUMENTS, prose


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(240):
        words = prose(rng, rng.randint(60, 120)).split()
        if i % 6 == 1:
            words = [w.upper() + "!!" for w in words]
        if i % 6 == 2:
            words.insert(5, "idiot")
        if i % 6 == 3:
            words.insert(7, "password=hunter2222")
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(i % 6 != 1), int(i % 6 == 2)))
    docs += [(500 + i, docs[0][1], "en", "s", 0) for i in range(5)] + [(600, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    table = spark.read.parquet(f"{d}/documents.parquet")
    ids = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, d)
        assert out.columns == table.columns
        out.write.parquet(f"{d}/{name}")
        table = spark.read.parquet(f"{d}/{name}")
        ids[name] = {r["doc_id"] for r in table.collect()}
    left = ids["secret scans"]
    assert not {i for i in left if i < 240 and i % 6 in (1, 2)}
    clean = {i for i in range(240) if i % 6 in (0, 3, 4, 5)}
    assert len(clean - left) <= 2  # a clean document may be a near copy of another
    assert not left & set(range(500, 505)) and 0 in left
    assert not any(re.search("hunter", r["text"] or "") for r in table.collect())
    packed = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in packed.collect()} == left


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "simhash near-dedup", "secret scans", "packing"]
    assert simhash.DISTANCE == 3


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls everywhere, empty and very long texts, repeated rows, clashing names; then nothing at all."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    good = [(i, prose(rng, rng.randint(40, 90)), "en", "s", 1) for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in prose(rng, 50).split()), "en", "s", 1) for i in range(20)]
    odd = [(None, prose(rng, 70), None, None, None), (None, None, None, None, None), (200, "", "en", "s", 0), (201, None, "en", "s", 0), good[3], good[3], (202, prose(rng, 60_000), "en", "s", 9)]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(20)] + [(None, 1, 1), (3, None, None)]
    names = ("fp", "key", "label", "x", "y", "g", "lanes", "row", "found", "sequence_id", "__id", "text_hash", "family")
    for folder, docs in (("full", good + bad + odd), ("none", [])):
        d = str(tmp_path / folder)
        spark.createDataFrame(docs, DOCUMENTS).withColumns({c: F.lit("c") for c in names}).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        packed = corpus_pipeline.run(spark, d).collect()
        ids = {r["doc_id"] for r in packed}
        if not docs:
            assert not packed
            continue
        assert set(range(60)) <= ids and 202 in ids and None in ids and not ids & set(range(100, 120))
        assert sum(r["doc_tokens"] for r in packed if r["doc_id"] == 3 and r["start"] == 0) == next(r["doc_tokens"] for r in packed if r["doc_id"] == 3)
        assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)


def test_near_copies_equal_brute_force(spark):
    """The stage's documents: the smallest of each component by similarity of five-word shingle sets."""
    from .test_sketch import jaccard_roots

    rng = random.Random(13)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(6, 150))]
        for changes in (0, 0, 1, 2, 5):
            mine = list(words)
            for _ in range(changes):
                mine[rng.randrange(len(mine))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(mine))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCUMENTS).repartition(3)
    got = corpus_pipeline.one_of_near_copies(spark, df, "")
    assert got.columns == df.columns and {r["doc_id"] for r in got.collect()} == set(jaccard_roots(texts))
