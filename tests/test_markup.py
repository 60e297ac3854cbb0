from pyspark.sql import functions as F

from lectern.functions import markup as m


def test_cells(spark):
    values = ["NULL", " n/a ", "Unnamed: 3", "unnamed", "0", " x ", "", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(m.normalized_cell(F.col("c"))).collect()]
    assert got == ["", "", "", "", "0", "x", "", ""] == [m.cell_text(v) for v in values]


TEXT = "top\n| a | b |\n| --- | :--: |\n| 1 | - |\nno\n\n| one bar\n|x|y|\n\n|z||"


def test_pipe_tables(spark):
    native = spark.createDataFrame([(TEXT,)], "t string").select(m.pipe_tables(F.col("t")), m.without_pipe_rows(F.col("t"))).first()
    kept, tables = m.pipe_matrices_of(TEXT)
    assert tables == [[["a", "b"], ["1", "-"]], [["x", "y"]], [["z", ""]]]
    assert native[0] == tables and native[1] == kept


def test_html_comes_first_and_text_collapses():
    text, tables, sheets = m.split_output("|p|q|\r\nx\n< TABLE a='1'><tr><td>&lt;b&gt;</td><th>null</th></tr></table>\n\n\ny")
    assert text == "x\ny"
    assert tables == [[], [["p", "q"]]] and sheets == [[["p", "q"]]]  # "< table" is no tag to an HTML parser


def test_broken_html():
    assert m.matrix_of_html("<table><tr><th></th>stray</th><td>a<table><tr><td>in</td></tr></table></td></tr></table>") == [["", "ain"]]
    assert m.matrix_of_html("<table><tr><td>a<br>b</td><td/><td> N/A </td></tr><tr></tr></table>") == [["ab", "", ""], []]
    assert m.matrix_of_html("no table") == []


def test_matrices(spark):
    rows = [[["", "a", ""], ["", "", ""], ["", "b"]], [["null", " "]], []]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "m array<array<string>>").select(m.cleaned(F.col("m"))).collect()]
    assert got == [[["a"], ["b"]], [], []] == [m.clean_matrix(r) for r in rows]
    html = spark.createDataFrame([([["<a>", "'q'"]],)], "m array<array<string>>").select(m.matrix_html(F.col("m")).alias("h")).select("h", m.html_matrix(F.col("h"))).first()
    assert html[0] == "<table><tr><td>&lt;a&gt;</td><td>&#x27;q&#x27;</td></tr></table>" and html[1] == [["<a>", "'q'"]]


def test_sections(spark):
    t = "pre\n# no\n## one\nx\n### no\n  ##\ttwo\n##three"
    want = ["pre\n# no", "## one\nx\n### no", "  ##\ttwo\n##three"]
    assert m.sections_of(t) == want
    assert spark.createDataFrame([(t,)], "t string").select(m.sections(F.col("t"))).first()[0] == want


def test_runs(spark):
    runs = [("a", True, False), ("b", True, None), ("", False, False), ("c", True, True), ("d", None, True), ("e", False, False)]
    got = spark.createDataFrame([(runs,)], "r array<struct<text:string,bold:boolean,strike:boolean>>").select(m.coalesced_runs(F.col("r"))).first()[0]
    assert got == "**ab****~~c~~**~~d~~e"


def test_open_cells_hold_what_follows():
    assert m.matrix_of_html("<table><tr><td>a<tr><td>b</table>") == [["ab"], ["b"]]
    assert m.matrix_of_html("<table><tr><td>a<b>c</b></td><th>d</th></tr></table>z<table><tr><td>y") == [["ac", "d"]]
    assert m.matrix_of_html("< table>") == []


def test_tables_and_sections_take_linear_time(spark):
    import time

    n = 40_000
    raw = "\n".join("| a | b |" if i % 10 else "x" if i % 100 else "## s" for i in range(n))
    df = spark.createDataFrame([(raw,)], "t string")
    df.select(F.size(m.pipe_tables(F.lit("| a | b |"))), F.size(m.sections(F.lit("## a")))).collect()
    began = time.time()
    got = df.select(m.pipe_tables(F.col("t")).alias("p"), F.size(m.sections(F.col("t"))).alias("s")).collect()[0]
    assert time.time() - began < 10
    assert len(got["p"]) == n // 10 and {len(x) for x in got["p"]} == {9} and got["s"] == n // 100
    assert got["p"] == m.pipe_matrices_of(raw)[1]
