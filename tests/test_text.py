import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions.text import PROFILES, Options, normalize

ALPHABET = list("ab1 \t\n\r*~`#>-_|.,[]()!") + ["**", "~~", "> ", "\n- ", "\n--\n", "• ", " ", "　", "​", "“", "’", "—", "İ", "Σ", "①", "％", "\x1c", "\x85", " ", "﻿", "가"]


@pytest.mark.parametrize("options", [Options(), PROFILES["content_only"].options, Options(drop_strike_content=True, strip_punctuation=True), Options(normalize_whitespace=False, normalize_list_bullet=False, strip_strike=True)])
def test_columns_follow_python(spark, options):
    rng = random.Random(5)
    rows = [("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))),) for _ in range(500)] + [("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select("t", text.normalized(F.col("t"), options).alias("n")).collect()
    for t, n in got:
        assert n == (None if t is None else normalize(t, options)), repr(t)


def test_micro_cases():
    assert normalize("％①​") == "%1"
    assert normalize("• a") == "- a" and normalize("1. a") == "1. a" and normalize("x\n-\ny") == "x y"
    both = Options(strip_strike=True, drop_strike_content=True)
    assert normalize("a ~~b~~ c", both) == "a c"
    assert normalize("**  x  **") == "**x**"


def test_tokens_and_pieces(spark):
    r = spark.createDataFrame([(" a　b ",), ("",), (None,)], "t string").select(text.tokens(F.col("t")), F.array_join(text.pieces(F.col("t")), "")).collect()
    assert [x[0] for x in r] == [["a", "b"], [], None] and r[0][1] == " a　b "


def test_tokenizers():
    assert text.tokenizer("eojeol")("a  b") == ["a", "b"]
    with pytest.raises(ValueError):
        text.tokenizer("letters")
    with pytest.raises(ImportError, match="kiwipiepy"):
        text.tokenizer("morpheme")("a")


def test_group_references_mean_the_same_in_both_forms(spark):
    """Python's replacements, for columns and plain texts: numbered and named groups, dollar signs, escapes."""
    o = text.Options(custom_regex_subs=((r"([0-9]) +([0-9])", r"\1\2"), (r"(?<w>[a-z]+)=", r"\g<w>:"), (r"cost", "$5"), (r"(z)", r"\g<1>\\\1")), normalize_whitespace=False)
    py = text.Options(**(o.__dict__ | {"custom_regex_subs": tuple((p.replace("?<w>", "?P<w>"), r) for p, r in o.custom_regex_subs)}))
    texts = ["1 2 x", "key=1 cost z", "plain", "9  8=7"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.normalized(F.col("t"), o)).collect()]
    assert got == [text.normalize(t, py) for t in texts] and got[0] == "12 x" and got[1] == "key:1 $5 z\\z"
