import random

from pyspark.sql import functions as F

from lectern.operators import align, dups, tables


def all_alignments(p, g):
    """Every way to turn the tokens of one side into the other's, as operations from the end."""
    if not p and not g:
        yield ()
    if p and g:
        for rest in all_alignments(p[:-1], g[:-1]):
            yield ("match" if p[-1] == g[-1] else "sub", *rest)
    if p:
        for rest in all_alignments(p[:-1], g):
            yield ("ins", *rest)
    if g:
        for rest in all_alignments(p, g[:-1]):
            yield ("del", *rest)


def test_alignment_against_all_alignments(monkeypatch):
    """Of the alignments with the fewest edits the one that, from the end, prefers a match, a substitution, an insertion, a deletion."""
    monkeypatch.setattr(align, "KEEP", 2)
    rng = random.Random(2)
    for _ in range(120):
        p, g = ([rng.choice("abc") for _ in range(rng.randint(0, 5))] for _ in "pg")
        edits = lambda ops: sum(o != "match" for o in ops)
        best = min(all_alignments(p, g), key=lambda ops: (edits(ops), [align.OPS.index(o) for o in ops]))
        assert [o for o, _, _ in align.alignment(p, g)] == list(best[::-1])
        s, d, i = align.sdi(p, g)
        assert (s, d, i) == tuple(best.count(x) for x in ("sub", "del", "ins"))
        assert align.distance(p, g) == s + d + i == align.distance(g, p) and d - i == len(g) - len(p)


def test_ties_and_empty_sides():
    assert align.sdi(["a"], ["b", "c"]) == (1, 1, 0)
    assert align.error_rate("x y z", "")["wer"] == 0.0
    assert align.error_rate("", "x y")["wer"] == 1.0
    pairs = align.aligned_slides(["## a\nx"], ["## a\nx", "## b y"])["pairs"]
    assert [p["kind"] for p in pairs] == ["match", "pred_only"] and pairs[1]["wer"] == 1.0


def test_native_distance(spark):
    rng = random.Random(4)
    rows = [([rng.choice("abcdef") for _ in range(rng.randint(0, 20))], [rng.choice("abcdef") for _ in range(rng.randint(0, 20))]) for _ in range(60)] + [([], [])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for a, b, n in df.select("a", "b", align.native_distance(F.col("a"), F.col("b"))).collect():
        assert n == align.distance(a, b)


def test_relaxation():
    text, log = align.relaxed("one\ntwo\nthree four\nkeep", "one two\nthree\nfour\nkeep")
    assert text == "one two\nthree\nfour\nkeep" and [x["kind"] for x in log] == ["merge", "split"]
    assert align.relaxed("one\ntwo", "one\ntwo\none two")[0] == "one\ntwo"


def test_three_way_and_lines():
    rows = align.three_way(["a", "b", "c"], ["a", "x", "c"], ["b", "c", "z"])
    assert rows[0] == {"gt": "a", "before": "a", "after": None}
    assert {"gt": "b", "before": "x", "after": "b"} in rows and rows[-1] == {"gt": None, "before": None, "after": "z"}
    assert align.line_diff("a\n\nb", "a\nc") == [("equal", "a", "a"), ("replace", "b", "c")]


def test_slides_fall_back():
    r = align.slide_error_rate(["a b", "c"], "a b c")
    assert r == {"wer": 0.0, "pairs": None, "aligned": False}
    gone = align.slide_error_rate(["## a\nx y", "## b\nz"], "## a\nx y\n## b\nz\n")
    assert gone["aligned"] and gone["wer"] == 0.0


def test_teds():
    x = [["a", "b"], ["c", "d"]]
    assert tables.teds([], [])["teds_content"] == 1.0 == tables.teds(x, x)["teds_content"]
    assert tables.teds([], x)["teds_content"] == 1 - 6 / 7
    assert tables.average_teds([], [x]) is None
    assert tables.average_teds([x, [], x], [x, x]) == (1.0 + 1 / 7) / 2 or abs(tables.average_teds([x, [], x], [x, x]) - (1 + 1 / 7) / 2) < 1e-12


def test_cell_f1(spark):
    rows = [(1, [[["a", "a"], ["b"]]], [[["a", "b"], ["b", "null"]]]), (2, [], [[["N/A"]]]), (3, [[["x"]]], [])]
    got = {r["id"]: r for r in tables.cell_f1(spark.createDataFrame(rows, "id int, p array<array<array<string>>>, g array<array<array<string>>>"), ["id"], "p", "g").collect()}
    assert abs(got[1]["cell_f1"] - 2 / 3) < 1e-12 and got[2]["cell_f1"] == 1.0 and got[3]["cell_f1"] == 0.0


def test_repeated_lines(spark):
    t = "intro\nkim 429 322\n| lee | 3 | 4 |\nother words here kim"
    m = [[["kim", "429", "322"], ["lee", "3", "4"]]]
    df = spark.createDataFrame([(1, t, m), (2, "kim", m), (3, t, [])], "id int, text string, tables array<array<array<string>>>")
    got = dups.repeated_lines(df, ["id"]).orderBy("id", "line_no").collect()
    assert [(r["id"], r["line"]) for r in got] == [(1, "kim 429 322"), (1, "| lee | 3 | 4 |")]


def test_similarity_is_asymmetric_in_order():
    assert tables.similarity("", "") == 1.0 and tables.similarity("a", "") == 0.0 and tables.similarity("abcd", "abxd") == 0.75


def test_table_functions_of_sql(spark):
    """The same rows as the arrays give, in SQL, batch by batch."""
    align.register(spark)
    spark.createDataFrame([(1, "a x c", "a b c\nd", "a\nb"), (2, None, "q", "q\nr")], "id int, p string, g string, l string").createOrReplaceTempView("texts")
    got = spark.sql("select id, t.* from texts, lateral token_alignment(p, g) t order by id, seq").collect()
    assert [(r["op"], r["gt_token"], r["pred_token"]) for r in got] == align.alignment(["a", "x", "c"], ["a", "b", "c", "d"])
    lines = spark.sql("select id, t.* from texts, lateral line_diff(l, g) t order by id, seq").collect()
    assert [(r["tag"], r["gt_line"], r["pred_line"]) for r in lines if r["id"] == 2] == align.line_diff("q", "q\nr")
    rows = spark.sql("select id, t.* from texts, lateral three_way(g, l, p) t order by id, seq").collect()
    assert [(r["gt"], r["before"], r["after"]) for r in rows if r["id"] == 2] == [("q", "q", None), (None, "r", None)]


def test_repeated_lines_against_the_definition(spark):
    """A line repeats a table if half of its parts, rounded down and one at least, are cells; the lines of a table count if nine tenths of its cells are in them."""
    rng = random.Random(9)
    docs = []
    for i in range(80):
        words = [f"c{k}" for k in range(6)]
        m = [[[rng.choice([*words, "", " C1 "]) for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 2))]
        lines = [rng.choice([" ", " | "]).join(rng.choice([*words, "other"]) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 6))]
        docs.append((i, "\n".join(lines), m))
    want = set()
    for i, t, tables_ in docs:
        lines = t.split("\n")
        parts = [[p.strip().lower() for p in (x.strip().strip("|").split("|") if "|" in x else x.split()) if p.strip()] for x in lines]
        for m in tables_:
            cells = {c.strip().lower() for r in m for c in r if c.strip()}
            own = [k for k, ps in enumerate(parts) if sum(p in cells for p in ps) >= max(1, len(ps) // 2)]
            if cells and len({p for k in own for p in parts[k] if p in cells}) >= 0.9 * len(cells):
                want |= {(i, k) for k in own}
    df = spark.createDataFrame(docs, "id int, text string, tables array<array<array<string>>>")
    assert {(r["id"], r["line_no"]) for r in dups.repeated_lines(df, ["id"]).collect()} == want and len(want) > 20
