import pytest

from lectern import queries

duckdb = pytest.importorskip("duckdb")


def sql_rows(folder, name, *tables):
    """Rows of a query's SQL over the tables of a folder."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(queries.oracle_sql()[name]).fetchall(), key=repr)


def rows(spark, folder, name):
    return sorted((tuple(r) for r in queries.queries()[name](spark, str(folder)).collect()), key=repr)


def test_decks_of_short_slides(spark, tmp_path):
    """The parser's own sections meet no slide, however short the slides beside them are."""
    turns = [(c, t, " ".join(f"w{k}" for k in range((c * t) % 9))) for c in range(12) for t in range(3 + c)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows(spark, tmp_path, "slide_align") == sql_rows(tmp_path, "slide_align", "conversations")


def test_rows_that_cannot_match_are_not_compared(monkeypatch):
    """Blank cells and missing rows: few of the 81,000 pairs are compared, and the distance is the plain one."""
    from lectern.operators import tables

    gt = [[str(1000 + i), "O", "urgent"] for i in range(300)]
    pred = [[k, "" if i % 3 == 0 else s, p] for i, (k, s, p) in enumerate(gt) if i % 10 != 7]
    fold, n = tables._fold, []
    monkeypatch.setattr(tables, "_fold", lambda *a, **k: (n.append(1), fold(*a, **k))[1])
    assert tables.table_distance(gt, pred) == 4.0 * 30 + sum(i % 3 == 0 and i % 10 != 7 for i in range(300))
    assert len(n) < 12_000


def test_bounded_distance_against_the_plain_one():
    import random

    from lectern.operators import tables

    rng = random.Random(5)
    weight, one = (lambda r: 1.0 + len(r)), (lambda _: 1.0)
    change = lambda a, b: 0.0 if a == b else tables._fold(a, b, one, one, lambda x, y: 1.0 - tables.similarity(x, y))
    for _ in range(400):
        cell = lambda: rng.choice(["", "a", "ab", "abc", "xyz"])
        gt = [[cell() for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 8))]
        pred = [[c if rng.random() > 0.2 else cell() for c in r] for r in gt if rng.random() > 0.2] + [[cell()] for _ in range(rng.randint(0, 1))]
        if rng.random() < 0.3:
            rng.shuffle(pred)
        assert tables.table_distance(gt, pred) == tables._fold(gt, pred, weight, weight, change)


def test_repeated_lines_shuffle_nothing(spark):
    from lectern.operators import dups

    df = spark.createDataFrame([(1, "kim 4\nx", [[["kim", "4"]]]), (None, "kim 4", [[["kim", None], ["4"]]])], "id int, text string, tables array<array<array<string>>>")
    found = dups.repeated_lines(df, ["id"])
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, 0, "kim 4"), (None, 0, "kim 4")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_slides_without_common_words_need_no_edit_matrix(monkeypatch):
    """Only slides that share words after their first ones are compared word by word."""
    from lectern.operators import align

    gt = [f"## slide {i}\n" + " ".join(f"w{i}_{k}" for k in range(10)) for i in range(120)]
    distance, n = align.distance, []
    monkeypatch.setattr(align, "distance", lambda *a: (n.append(1), distance(*a))[1])
    pairs = align.aligned_slides(gt, [s for i, s in enumerate(gt) if i % 3 != 1])["pairs"]
    assert [p["kind"] for p in pairs] == ["gt_only" if i % 3 == 1 else "match" for i in range(120)] and len(n) < 200


def test_edits_that_the_lengths_ask_for_need_no_way_back(monkeypatch):
    from lectern.operators import align

    monkeypatch.setattr(align, "_walk", None)
    gt = [f"w{i}" for i in range(2000)]
    assert align.sdi(gt[::2], gt) == (0, 1000, 0) and align.sdi(gt, gt[1::2]) == (0, 0, 1000)


def test_batches_are_small_whatever_the_session_asks_for(spark, tmp_path):
    """Queries over texts hold at most so many rows and bytes in a Python worker; smaller settings stay."""
    spark.createDataFrame([(0, 0, "a b c d"), (0, 1, None), (1, 0, "")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "100000")
    got = rows(spark, tmp_path, "token_alignment")
    assert int(spark.conf.get(key)) <= 1000 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
    assert [r[2:4] for r in got] == [(0, "match"), (1, "match"), (2, "sub"), (3, "match")]
    spark.conf.set(key, "7")
    rows(spark, tmp_path, "token_alignment")
    assert spark.conf.get(key) == "7"
    spark.conf.unset(key)


def test_scores_parse_where_they_score(spark):
    """One Python function for a row: the parser's tables don't go back to Spark between parsing and scoring."""
    from lectern.plans import evaluate

    gt = spark.createDataFrame([("d", "before", "docx", False, "a b", None, [[["x"]]])], "doc_id string, stage string, type string, dual_gt boolean, text string, slides array<string>, tables array<array<array<string>>>")
    pred = spark.createDataFrame([("d", "before", "a b\n| x | y |\n")], "doc_id string, stage string, raw string")
    s = evaluate.scores(gt, pred)
    assert s._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in s.collect()] == [("d", "before", "docx", False, 0.0, 0.75)]


def test_sheets_are_paired_where_the_workbook_is(spark):
    """One join of outputs with ground truth; units by position, missing ones empty, pairs of empty ones left out."""
    from lectern.plans import evaluate

    gt = spark.createDataFrame([("d", "before", "xlsx", [[["a"]], [["nan"]], [["b"], ["c"]]]), ("e", "before", "xlsx", None)], "doc_id string, stage string, type string, tables array<array<array<string>>>")
    pred = spark.createDataFrame([("d", "before", "| a | |\n\nx\n\n| null | |\n"), ("e", "before", "| q | r |")], "doc_id string, stage string, raw string")
    units = evaluate.sheet_units(gt, pred)
    assert sorted(map(tuple, units.collect())) == [("d", "before", 0, 1.0, 1, 1), ("d", "before", 2, 0.0 + 1 - 4 / 5, 2, 0), ("e", "before", 0, 1 - 3 / 4, 0, 1)]
    assert units._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_bare_tables_need_no_parser(monkeypatch):
    from lectern.functions import markup

    html = "<table>\n<tr><td>a &lt;b</td><th> nan </th></tr>\n<tr></tr><tr><td></td></tr></table>"
    want = markup._Rows()
    want.feed(html)
    monkeypatch.setattr(markup, "_Rows", None)
    assert markup.matrix_of_html(html) == [["a <b", ""], [], [""]] == [[markup.cell_text("".join(c)) for c in r] for r in want.texts]


def test_differences_of_pages_are_those_of_difflib():
    """Blocks found by words are difflib's, and white space is not compared with all white space."""
    import difflib
    import random
    import re

    from lectern.plans import report

    rng = random.Random(8)
    text = lambda: "".join(rng.choice([" ", "  ", "\t"]) + rng.choice("abcdefgh") for _ in range(rng.randint(0, 20))) + rng.choice(["", " "])
    for _ in range(500):
        a = text()
        b = text() if rng.random() < 0.5 else "".join(c for c in a if rng.random() > 0.1)
        words = [re.findall(r"\S+|\s+", t) for t in (a, b)]
        assert report._Pieces(None, *words, autojunk=False).get_opcodes() == difflib.SequenceMatcher(None, *words, autojunk=False).get_opcodes()

    class Counted(str):
        n = 0

        def __eq__(self, other):
            Counted.n += 1
            return str.__eq__(self, other)

        __hash__ = str.__hash__

    words = [[Counted(t) for i in side for t in (f"w{i}", " ")] for side in (range(300), [i for i in range(300) if i % 7])]
    report._Pieces(None, *words, autojunk=False).get_opcodes()
    assert Counted.n < 300 * 300 / 2


def test_pages_join_once(spark):
    from lectern.plans import evaluate, report

    gt = spark.createDataFrame([("d", "before", "docx", False, "kim 4", None, [[["kim", "4"]]])], "doc_id string, stage string, type string, dual_gt boolean, text string, slides array<string>, tables array<array<array<string>>>")
    pred = spark.createDataFrame([("d", "before", "kim 4\n| kim | 4 |"), ("d", "after", None)], "doc_id string, stage string, raw string")
    wide = evaluate.per_document(evaluate.scores(gt, pred))
    pages = report.pages(gt, pred, wide.localCheckpoint())
    assert pages._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # outputs, scores
    page = pages.collect()[0]["html"]
    assert page.count('class="dup"') == 1 and "<li>kim 4</li>" in page


def test_normalisation_with_nfkc_is_one_function_and_steps_agree(spark):
    """The text that NFKC needs in Python stays there for all steps; the native steps give the same without NFKC."""
    import random

    from pyspark.sql import functions as F

    from lectern.functions import text

    rng = random.Random(6)
    pieces = ["**", "~~", "> ", "- ", "[a](b)", "`", "#", "\n", " ", "x", "AΣ", "—", "“", "​", "---", "* * *", "é", "　", "・ ", "_", "ﬁ"]
    texts = [None, "", *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select("t", text.normalized(F.col("t")).alias("all"), text.normalized(F.col("t"), text.Options(unify_unicode=False)).alias("native"))
    assert "regexp_replace" not in df.select(text.normalized(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    for t, done, native in both.collect():
        assert (done, native) == ((None, None) if t is None else (text.normalize(t), text.normalize(t, text.Options(unify_unicode=False))))


def test_missing_rows_need_no_comparison_of_cells(monkeypatch):
    from lectern.operators import tables

    monkeypatch.setattr(tables, "SequenceMatcher", None)
    gt = [[str(10_000 + i), "O", "urgent"] for i in range(60)]
    assert tables.table_distance(gt, [r for i, r in enumerate(gt) if i % 4]) == 60.0


def test_scores_read_the_ground_truth_once(spark):
    """One join; a side that is missing gives nulls."""
    from lectern.plans import evaluate

    gt = spark.createDataFrame([("d", s, "docx", False, t, None, []) for s, t in (("before", "a b"), ("after", None), ("x", "c"))], "doc_id string, stage string, type string, dual_gt boolean, text string, slides array<string>, tables array<array<array<string>>>")
    pred = spark.createDataFrame([("d", "before", "a b"), ("d", "after", "a"), ("e", "before", "q")], "doc_id string, stage string, raw string")
    s = evaluate.scores(gt, pred)
    assert s._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert sorted((tuple(r) for r in s.collect()), key=repr) == [("d", "after", "docx", False, None, None), ("d", "before", "docx", False, 0.0, None), ("d", "x", "docx", False, None, None)]
