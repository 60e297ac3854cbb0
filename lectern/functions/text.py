"""Text normalisation, as Spark columns and as plain Python for code that works line by line.

Both follow the same ordered steps; a test holds them against each other. Java's patterns differ from
Python's in what white space is and where lines end, so every pattern here spells out the white space
of Python's ``str`` and takes only a line feed as the end of a line.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of Python's str, in the syntax that Java and RE2 share.
WS = r"\t\n\x0B\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# Invisible code points, curly quotes and long dashes, list bullets, punctuation.
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
CURLY, PLAIN = "\u201c\u201d\u2018\u2019\u2013\u2014", "\"\"''--"
BULLETS = "-*+•·▪◦‣・"
PUNCTUATION = ".,!?;:\"'()[]{}"

# What each step looks for; S stands for the white space above.
LINK = r"!?\[([^\]]*)\]\([^)]*\)"
CODE = r"`([^`]*)`"
QUOTE = r"^S*>S?"
RULE = r"^S*([-*_]S?){3,}S*$"
DASH_LINE = r"^[ \t]*[-–—]+[ \t]*$"
HEADING = r"^S{0,3}#{1,6}S*"
BOLD_INNER = r"\*\*S*(.+?)S*\*\*"
STRIKE_INNER = r"~~S*(.+?)S*~~"
STRIKE_WHOLE = r"~~.+?~~"
BULLET = r"^[ \t]*[-*+•·▪◦‣・]S+"
PUNCT = r"""[.,!?;:"'()\[\]{}]"""


def java(pattern: str, flags: str = "md") -> str:
    """A pattern with S as white space, for Spark."""
    return f"(?{flags})" + pattern.replace("S", f"[{WS}]")


def re2(pattern: str, flags: str = "m") -> str:
    """The same for DuckDB."""
    return f"(?{flags})" + pattern.replace("S", f"[{WS}]")


def java_replacement(repl: str) -> str:
    r"""A replacement in Python's form (``\1``, ``\g<1>``, ``\g<name>``) in Java's; a dollar sign stands for itself in Python."""
    out = []
    for number, name, escaped, plain in re.findall(r"\\(\d{1,2})|\\g<(\w+)>|\\(.)|([^\\]+)", repl, re.S):
        if number or name:
            out.append(f"${{{name}}}" if name and not name.isdigit() else f"${int(number or name)}")
        else:
            text = _ESCAPES.get(escaped, escaped) if escaped else plain
            out.append(re.sub(r"([\\$])", r"\\\1", text))
    return "".join(out)


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a"}


@dataclass(frozen=True)
class Options:
    """Switches of the steps, in the order in which they run.

    ``custom_regex_subs`` are pairs of a pattern and a replacement in Python's form, for columns as well as for plain texts.
    """

    unify_unicode: bool = True
    strip_zero_width: bool = True
    strip_link_image: bool = True
    strip_inline_code: bool = True
    strip_blockquote: bool = True
    strip_hr: bool = True
    strip_separator_line: bool = True
    strip_headers: bool = False
    strip_bold: bool = False
    drop_strike_content: bool = False
    strip_strike: bool = False
    normalize_list_bullet: bool = True
    unify_quotes_dashes: bool = True
    lower_latin: bool = True
    custom_regex_subs: tuple[tuple[str, str], ...] = ()
    strip_punctuation: bool = False
    normalize_whitespace: bool = True


@dataclass(frozen=True)
class Profile:
    tokenizer: str = "eojeol"
    options: Options = field(default_factory=Options)


PROFILES = {
    "default": Profile(),
    "spacing_robust": Profile(tokenizer="morpheme"),
    "content_only": Profile(options=Options(strip_headers=True, strip_bold=True, strip_strike=True)),
}


def nfkc(text: Column) -> Column:
    """NFKC. Spark has no expression for it: an Arrow UDF, or the JVM's normaliser from a SQL session where it may be called."""
    @F.arrow_udf("string")
    def run(s: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in s.to_pylist()], pa.string())

    return run(text)


def _normalized_rows(text: Column, o: Options) -> Column:
    @F.arrow_udf("string")
    def run(s: pa.Array) -> pa.Array:
        return pa.array([None if t is None else normalize(t, o) for t in s.to_pylist()], pa.string())

    return run(text)


def strip(text: Column) -> Column:
    """Python's ``str.strip()``."""
    return F.btrim(text, F.lit(_SPACES))


def normalized(text: Column, o: Options = Options()) -> Column:
    """All steps that are switched on. With ``unify_unicode`` off the plan is native throughout.

    With it the text is in Python anyway, and the other steps take less time there than as columns; only patterns
    of the caller's own, which are Java's, need those.
    """
    sub = F.regexp_replace
    if o.unify_unicode and not o.custom_regex_subs:
        return _normalized_rows(text, o)
    if o.unify_unicode:
        text = nfkc(text)
    if o.strip_zero_width:
        text = F.translate(text, INVISIBLE, "")
    if o.strip_link_image:
        text = sub(text, java(LINK), "$1")
    if o.strip_inline_code:
        text = sub(text, java(CODE), "$1")
    if o.strip_blockquote:
        text = sub(text, java(QUOTE), "")
    if o.strip_hr:
        text = sub(text, java(RULE), "")
    if o.strip_separator_line:
        text = sub(text, java(DASH_LINE), "")
    if o.strip_headers:
        text = sub(text, java(HEADING), "")
    text = sub(text, r"\*\*", "") if o.strip_bold else sub(text, java(BOLD_INNER, "s"), "**$1**")
    if o.drop_strike_content:
        text = sub(text, java(STRIKE_WHOLE, "s"), "")
    elif o.strip_strike:
        text = sub(text, "~~", "")
    else:
        text = sub(text, java(STRIKE_INNER, "s"), "~~$1~~")
    if o.normalize_list_bullet:
        text = sub(text, java(BULLET), "- ")
    # white space becomes spaces along with the quotes, if nothing after that looks for it
    early = o.unify_quotes_dashes and o.normalize_whitespace and not o.custom_regex_subs and not o.strip_punctuation
    blanks = " " * len(_SPACES)
    if o.unify_quotes_dashes:
        text = F.translate(text, CURLY + _SPACES, PLAIN + blanks) if early else F.translate(text, CURLY, PLAIN)
    if o.lower_latin:
        text = F.lower(text)
    for pattern, repl in o.custom_regex_subs:
        text = sub(text, pattern, java_replacement(repl))
    if o.strip_punctuation:
        text = sub(text, PUNCT, "")
    if o.normalize_whitespace:
        text = text if early else F.translate(text, _SPACES, blanks)
        text = F.btrim(sub(text, " {2,}", " "))
    return text


def tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(text, f"[{WS}]+"), lambda t: t != "")


def pieces(text: Column) -> Column:
    """Words and runs of white space, which join to the text again."""
    return F.regexp_extract_all(text, F.lit(f"[^{WS}]+|[{WS}]+"), F.lit(0))


def saturated(wer: Column) -> Column:
    """An error rate pressed into [0, 1)."""
    return wer / (wer + 1)


# the same steps on Python strings


def _py(pattern: str, flags: int = re.MULTILINE) -> re.Pattern:
    return re.compile(pattern.replace("S", r"\s"), flags)


_STEPS = {
    "link": _py(LINK), "code": _py(CODE), "quote": _py(QUOTE), "rule": _py(RULE), "dash": _py(DASH_LINE), "heading": _py(HEADING),
    "bold": _py(BOLD_INNER, re.DOTALL), "strike": _py(STRIKE_INNER, re.DOTALL), "gone": _py(STRIKE_WHOLE, re.DOTALL), "bullet": _py(BULLET), "punct": re.compile(PUNCT),
}


def normalize(text: str, o: Options = Options()) -> str:
    """A step runs only on texts that have a character it looks for; words of letters, digits and low lines know but one step."""
    if not o.custom_regex_subs and text.replace("_", "").isalnum() and (text.isascii() or not o.unify_unicode or unicodedata.is_normalized("NFKC", text)):
        return text.lower() if o.lower_latin else text
    s = _STEPS
    if o.unify_unicode and not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if o.strip_zero_width and not text.isascii():
        for c in INVISIBLE:  # one by one is far faster than ``translate``
            text = text.replace(c, "")
    for on, name, repl, signs in (
        (o.strip_link_image, "link", r"\1", "["), (o.strip_inline_code, "code", r"\1", "`"), (o.strip_blockquote, "quote", "", ">"), (o.strip_hr, "rule", "", "-*_"),
        (o.strip_separator_line, "dash", "", "-–—"), (o.strip_headers, "heading", "", "#"),
    ):
        if on and any(c in text for c in signs):
            text = s[name].sub(repl, text)
    if "**" in text:
        text = text.replace("**", "") if o.strip_bold else s["bold"].sub(r"**\1**", text)
    if "~~" not in text:
        pass
    elif o.drop_strike_content:
        text = s["gone"].sub("", text)
    elif o.strip_strike:
        text = text.replace("~~", "")
    else:
        text = s["strike"].sub(r"~~\1~~", text)
    if o.normalize_list_bullet and any(c in text for c in BULLETS):
        text = s["bullet"].sub("- ", text)
    if o.unify_quotes_dashes and not text.isascii():
        for c, straight in zip(CURLY, PLAIN):
            text = text.replace(c, straight)
    if o.lower_latin:
        text = text.lower()
    for pattern, repl in o.custom_regex_subs:
        text = re.sub(pattern, repl, text)
    if o.strip_punctuation:
        text = s["punct"].sub("", text)
    return " ".join(text.split()) if o.normalize_whitespace else text


def _morphemes(text: str) -> list[str]:
    global _analyser
    try:
        from kiwipiepy import Kiwi
    except ImportError as e:
        raise ImportError("the morpheme tokenizer needs kiwipiepy, which is not installed") from e
    if _analyser is None:
        _analyser = Kiwi()
    return [t.form for t in _analyser.tokenize(text)]


_analyser = None
TOKENIZERS = {"eojeol": str.split, "morpheme": _morphemes}


def tokenizer(name: str):
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name!r}: one of {', '.join(TOKENIZERS)}")
    return TOKENIZERS[name]
