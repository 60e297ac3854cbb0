"""Secret scans: fixed patterns, and a battery of randomness tests for what they miss. DataFrame operations only.

Patterns give the base spans. Every other run of 20 or more characters of an encoding's alphabet is a
candidate, and so is what is left, 20 characters or more, of a run that a base span covers in part. A candidate's
encoding is inferred (hexadecimal, base 32, base 36, base 62, base 64, base 64 for URLs). It must pass two examinations.

The battery asks whether its symbols are uniform and independent, as an encoded key's are: chi-squared over groups
of the alphabet (as many as leave five expected symbols each), Wald-Wolfowitz runs about the alphabet's middle, and
lag-one serial correlation. Fisher's method joins the three p-values; below ``STRUCTURED`` the candidate is no key.

False discoveries are those of natural strings (words, numbers, paths, identifiers). The null of the second examination is
such a string: letters by their frequency in prose, few capitals and digits (``NATURAL``). The statistic is the log ratio of
the uniform alphabet to that model, summed over the symbols; its mean and variance under the null are exact for independent
symbols, and the deviation is widened by ``WIDER`` because letters of words are not independent. Its p-value is exact in length, so long
candidates are told from words far more surely than short ones. Benjamini and Hochberg's procedure over all candidates of
the corpus, in bands of length with a ``RATE`` each, decides which are discoveries: ``random`` spans. Candidates that the
battery rejects count with a p-value of 1. The first pass over the corpus only counts p-values by band and step (at most 4 x 401
counts), and reads no further into texts without a candidate; the second is narrow. Nothing is shuffled but those counts.

The values that the patterns measure go through the same examinations: which base spans look random is reported, and changes none.

Defined cases: null and empty texts have no spans; repeated rows are scanned once each; nulls in the id
are kept; other columns are not read; ties in start go by kind; a very long text is scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
#: Pattern, group that is measured, least length of it.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
}
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, narrowest first: name, pattern, alphabet.
ENCODINGS = (
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^(?:[0-9a-z]+|[0-9A-Z]+)$", DIGITS + UPPER),
    ("base62", r"^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
#: Least length of each band.
BANDS = (20, 32, 48, 96)
#: Share of natural strings among the discoveries of a band that the procedure allows, on average.
RATE = 0.05
#: Joint p-value of the battery below which a candidate has a structure that a key has not.
STRUCTURED = 0.001
WIDER = 1.5
STEPS_PER_DECADE, LAST_STEP = 20, 400
# Letters a to z in a thousand of English prose.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 1, 20, 1)
#: Shares of small letters, capitals, digits and each separator in natural strings, by encoding.
NATURAL = {
    "hex": (0.05, 0.05, 0.95, {}),
    "base32": (0.95, 0.95, 0.05, {}),
    "base36": (0.9, 0.9, 0.1, {}),
    "base62": (0.84, 0.08, 0.08, {}),
    "base64": (0.78, 0.07, 0.07, {"+": 0.01, "/": 0.07}),
    "base64url": (0.75, 0.07, 0.08, {"-": 0.05, "_": 0.05}),
}


def natural_model(name: str, alphabet: str) -> list[float]:
    """Shares of an alphabet's symbols in natural strings."""
    small, capital, digit, other = NATURAL[name]
    part = {c: w * small for c, w in zip(LOWER, LETTERS)} if LOWER[0] in alphabet else {}
    part |= {c: w * capital for c, w in zip(UPPER, LETTERS)}
    letters = {True: sum(v for c, v in part.items() if c in alphabet and c in LOWER), False: sum(v for c, v in part.items() if c in alphabet and c in UPPER)}
    digits = sum(c in DIGITS for c in alphabet)
    share = [other[c] if c in other else digit / digits if c in DIGITS else part[c] / letters[c in LOWER] * (small if c in LOWER else capital) for c in alphabet]
    return [x / sum(share) for x in share]


def log_ratios(name: str, alphabet: str) -> tuple[list[float], float, float]:
    """For each symbol the log of its uniform share over its natural one; and their mean and deviation in natural strings."""
    p = natural_model(name, alphabet)
    r = [-math.log(len(alphabet) * x) for x in p]
    mean = sum(a * b for a, b in zip(p, r))
    return r, mean, math.sqrt(sum(a * b * b for a, b in zip(p, r)) - mean * mean)


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), by Abramowitz and Stegun 26.2.17."""
    a = F.abs(z)
    k = F.lit(1.0) / (F.lit(1.0) + a * 0.2316419)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    tail = F.exp(-(a * a) / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def _pairs(x: Column, f) -> Column:
    """``f`` of each element and the next one."""
    return F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), f)


def _bounded(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-20))


def examined(token: Column) -> Column:
    """``struct<battery,natural>``: p-values of a random key and of a natural string. Null: no encoding fits.

    ``battery`` is Fisher's joint p-value of the three tests: small means that the token is not random.
    ``natural`` small means that it is no natural string.
    """
    core = F.rtrim(token, F.lit("="))
    none = F.lit(None)
    alphabet, size, case = none.cast("string"), none.cast("double"), F.lit(False)
    ratios, mean, deviation = none.cast("array<double>"), none.cast("double"), none.cast("double")
    for name, pattern, letters in reversed(ENCODINGS):
        fits = core.rlike(pattern)
        r, m, d = log_ratios(name, letters)
        alphabet = F.when(fits, F.lit(letters)).otherwise(alphabet)
        size = F.when(fits, F.lit(float(len(letters)))).otherwise(size)
        case = F.when(fits, F.lit(name in ("hex", "base32", "base36"))).otherwise(case)
        ratios = F.when(fits, F.array(*map(F.lit, r))).otherwise(ratios)
        mean, deviation = F.when(fits, F.lit(m)).otherwise(mean), F.when(fits, F.lit(WIDER * d)).otherwise(deviation)

    def tests(s):
        n = F.length(s["core"]).cast("double")
        x = F.transform(F.regexp_extract_all(s["core"], F.lit("."), F.lit(0)), lambda c: (F.call_function("locate", c, s["alphabet"]) - 1).cast("double"))  # in linear time, which substrings are not
        return F.struct(x.alias("x"), n.alias("n"), s["size"].alias("a"), F.least(s["size"], F.greatest(F.lit(2.0), F.floor(n / 5))).alias("g"), s["ratios"].alias("ratios"), s["mean"].alias("null"), s["deviation"].alias("wide"))

    def sums(t):
        x, n, a, g = t["x"], t["n"], t["a"], t["g"]
        total = lambda v, zero: F.aggregate(v, zero, lambda s, y: s + y)

        def cell(k):  # groups differ in width by one symbol at most: expected counts are exact
            width = F.ceil((k + 1) * a / g) - F.ceil(k * a / g)
            return F.pow(F.size(F.filter(x, lambda v: F.floor(v * g / a) == k)) - n * width / a, F.lit(2)) / (n * width / a)

        high = F.transform(x, lambda v: (v >= a / 2).cast("int"))
        return F.struct(
            x.alias("x"), n.alias("n"), (g - 1).alias("df"),
            ((total(F.transform(x, lambda v: F.element_at(t["ratios"], v.cast("int") + 1)), F.lit(0.0)) - n * t["null"]) / (t["wide"] * F.sqrt(n))).alias("far"),
            total(F.transform(F.sequence(F.lit(0), (g - 1).cast("int")), cell), F.lit(0.0)).alias("chi"),
            total(high, F.lit(0)).cast("double").alias("ones"),
            total(_pairs(high, lambda u, v: (u != v).cast("int")), F.lit(0)).alias("turns"),
            (total(x, F.lit(0.0)) / n).alias("middle"),
        )

    def moments(t):
        x, m, n = t["x"], t["middle"], t["n"]
        return F.struct(
            n.alias("n"), t["df"].alias("df"), t["chi"].alias("chi"), t["far"].alias("far"), t["turns"].alias("turns"), (2 * t["ones"] * (n - t["ones"]) / n + 1).alias("mean"),
            F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)).alias("power"),
            F.aggregate(_pairs(x, lambda u, v: (u - m) * (v - m)), F.lit(0.0), lambda s, v: s + v).alias("along"),
        )

    def scores(t):
        n, df, spread = t["n"], t["df"], (t["mean"] - 1) * (t["mean"] - 2) / (t["n"] - 1)
        return F.struct(
            t["far"].alias("far"),
            ((F.pow(t["chi"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))).alias("chi"),
            F.when(spread > 0, F.abs((t["turns"] + 1 - t["mean"]) / F.sqrt(spread))).alias("runs"),
            F.when(t["power"] > 0, F.abs(t["along"] / t["power"] * F.sqrt(n) + 1 / F.sqrt(n))).alias("serial"),
        )

    def joined(t):
        runs, serial = F.coalesce(2 * _upper_tail(t["runs"]), F.lit(0.0)), F.coalesce(2 * _upper_tail(t["serial"]), F.lit(0.0))
        return F.struct(t["far"].alias("far"), (-(F.log(_bounded(_upper_tail(t["chi"]))) + F.log(_bounded(runs)) + F.log(_bounded(serial)))).alias("half"))

    def values(t):
        half = t["half"]
        return F.struct((F.exp(-half) * (1 + half + half * half / 2)).alias("battery"), _upper_tail(t["far"]).alias("natural"))

    # one-element arrays stand for a let: each value is computed once
    p = F.array(F.struct(F.when(case, F.upper(core)).otherwise(core).alias("core"), alphabet.alias("alphabet"), size.alias("size"), ratios.alias("ratios"), mean.alias("mean"), deviation.alias("deviation")))
    for stage in (tests, sums, moments, scores, joined, values):
        p = F.transform(p, stage)
    return F.when(alphabet.isNotNull() & (F.length(core) > 1), F.element_at(p, 1))


def _located(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Matches as ``array<struct<start,kind,stop>>``: code points, end exclusive; too short ones are dropped."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    measured = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m)) if group else F.transform(hits, lambda m: F.length(m))
    none = F.expr("cast(array() as array<struct<start:long,kind:int,stop:long>>)")
    steps = F.zip_with(F.zip_with(F.slice(F.transform(gaps, lambda g: F.length(g)), 1, F.size(hits)), F.transform(hits, lambda m: F.length(m)), lambda g, m: F.struct(g.alias("gap"), m.alias("len"))), measured, lambda s, m: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), m.alias("m")))
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    found = F.aggregate(
        steps, start,
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + x["len"]).cast("long").alias("at"),
            F.when(x["m"] >= least, F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).cast("long").alias("start"), F.lit(kind).alias("kind"), (s["at"] + x["gap"] + x["len"]).cast("long").alias("stop"))))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    return F.when(text.rlike(pattern), found).otherwise(none)


def band(length: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(BANDS):
        out = F.when(length >= least, F.lit(i)).otherwise(out)
    return out


def step(p: Column) -> Column:
    """The examinations' p-value on a logarithmic scale: 1, thus 0, where the battery found a structure."""
    natural = F.when(p["battery"] >= STRUCTURED, _bounded(p["natural"])).otherwise(F.lit(1.0))
    return F.least(F.floor(-F.log10(natural) * STEPS_PER_DECADE), F.lit(LAST_STEP)).cast("int")


def _piece(text: Column, start: Column, stop: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (stop - start).cast("int"))


def _scanned(df: DataFrame, id_col: str, text_col: str, whole_row: bool = False) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = [F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")] if whole_row else [F.col(id_col).alias("doc_id")]
    out = df.select(*row, text.alias("text"))
    out = out.withColumns({f"__{k}": _located(F.col("text"), p, i, g, least) for i, (k, (p, g, least)) in enumerate(BASE.items())})
    out = out.withColumn("base", F.array_sort(F.concat(*(F.col(f"__{k}") for k in BASE))))
    wide = _located(F.col("text"), CANDIDATE, 3, 0, BANDS[0])

    def uncovered(c):
        """What is left of a run before and after the base spans that meet it."""
        met = F.filter(F.col("base"), lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
        span = lambda a, b: F.struct(a.alias("start"), c["kind"].alias("kind"), b.alias("stop"))
        return F.when(F.size(met) == 0, F.array(c)).otherwise(F.array(span(c["start"], F.array_min(met["start"])), span(F.array_max(met["stop"]), c["stop"])))

    free = F.filter(F.flatten(F.transform(wide, uncovered)), lambda c: c["stop"] - c["start"] >= BANDS[0])
    return out.withColumn("candidates", F.when(F.col("text").rlike(CANDIDATE), F.transform(free, lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"),
        examined(_piece(F.col("text"), c["start"], c["stop"])).alias("p"),
    ))).otherwise(F.expr("cast(array() as array<struct<start:long,kind:int,stop:long,p:struct<battery:double,natural:double>>>)")))


def thresholds(scanned: DataFrame) -> dict[int, int]:
    """For each band the first step at which a candidate counts as a discovery, by Benjamini and Hochberg over all candidates."""
    each = scanned.where(F.col("text").rlike(CANDIDATE)).select(F.explode("candidates").alias("c")).where("c.p is not null")
    counts = each.groupBy(band(F.col("c.stop") - F.col("c.start")).alias("band"), step(F.col("c.p")).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 4 x 401 rows
    return discoveries([(r["band"], r["step"], r["n"]) for r in counts])


def discoveries(counts: list[tuple[int, int, int]]) -> dict[int, int]:
    """The first step of each band whose p-values are discoveries, from ``(band, step, number)``."""
    out = {}
    for b in range(len(BANDS)):
        mine = sorted(((s, n) for at, s, n in counts if at == b), reverse=True)
        total, seen, first = sum(n for _, n in mine), 0, LAST_STEP + 1
        for s, n in mine:
            seen += n
            if 10 ** (-s / STEPS_PER_DECADE) <= RATE * seen / total:  # p-values of a step are no larger
                first = s
        out[b] = first
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, base, found, random_base)``: spans of the patterns and all spans, as sorted arrays of structs, and which base spans look random."""
    scanned = _scanned(df, id_col, text_col)
    limits = thresholds(scanned)

    def value(b):  # what the pattern measures
        piece = _piece(F.col("text"), b["start"], b["stop"])
        return F.when(b["kind"] == 0, F.regexp_extract(piece, BASE["assign"][0], 2)).otherwise(piece)

    looks = F.transform("base", lambda b: F.coalesce(_discovered(examined(value(b)), F.length(value(b)), limits), F.lit(False)))
    return _found(scanned, limits).withColumn("random_base", F.when(F.size("base") > 0, looks).otherwise(F.expr("cast(array() as array<boolean>)")))


def _discovered(p: Column, length: Column, limits: dict[int, int]) -> Column:
    first = F.lit(LAST_STEP + 1)
    for b, s in limits.items():
        # without candidates in a band there is nothing to control: its rate alone decides
        first = F.when(band(length) == b, F.lit(s if s <= LAST_STEP else math.ceil(-math.log10(RATE) * STEPS_PER_DECADE))).otherwise(first)
    return p.isNotNull() & (p["battery"] >= STRUCTURED) & (step(p) >= first)


def _found(scanned: DataFrame, limits: dict[int, int] | None = None) -> DataFrame:
    limits = thresholds(scanned) if limits is None else limits

    def random(c):
        first = F.lit(LAST_STEP + 1)
        for b, s in limits.items():
            first = F.when(band(c["stop"] - c["start"]) == b, F.lit(s)).otherwise(first)
        return c["p"].isNotNull() & (step(c["p"]) >= first)

    added = F.transform(F.filter("candidates", random), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop")))
    return scanned.select(scanned.columns[0], "text", "base", F.array_sort(F.concat("base", added)).alias("found"))


def span_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"), F.size(F.filter("random_base", lambda r: r)).cast("long").alias("n_random_base"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def take(s, x):
        gap = F.substring(text, (s["at"] + 1).cast("int"), F.greatest(x["start"] - s["at"], F.lit(0)).cast("int"))
        fresh = (x["start"] >= s["at"]) & ~((x["start"] == s["at"]) & (s["at"] > 0))
        return F.struct(F.greatest(s["at"], x["stop"]).alias("at"), F.when(fresh, F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"]).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, take, rest)).otherwise(text)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``df`` with their secrets replaced; ``size_col``, if there, follows the text where it changed."""
    out = _found(_scanned(df, id_col, text_col, whole_row=True)).withColumn("clean", redacted(F.col("text"), F.col("found")))
    hit = F.size("found") > 0
    kind = dict(df.dtypes)

    def column(c):
        old = F.col(f"row.`{c}`")
        if c == text_col:
            return F.when(hit, F.col("clean")).otherwise(old).alias(c)
        if c == size_col:
            return F.when(hit, F.length("clean").cast(kind[c])).otherwise(old).alias(c)
        return old.alias(c)

    return out.select(*(column(c) for c in df.columns))
