"""Text columns: stripping, white space, token estimates, lenient decoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a regular-expression class.
WS_CLASS = r"\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once per row and not at each of its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Cut white space from both ends; linear in the text, no regular expression."""
    return F.btrim(text, F.lit(WHITESPACE))


def one_line(text: Column) -> Column:
    """Newlines become spaces."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


def count_tokens(text: Column, mode: str = "chars") -> Column:
    """Estimated tokens: a quarter of the code points, or words and newlines."""
    if mode == "chars":
        n = F.floor(F.length(text) / 4)
    elif mode == "words":
        n = F.size(F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+|\n"), F.lit(0))).cast("bigint")
    else:
        raise ValueError(f"unknown token mode {mode!r}")
    return F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(n)


def truncate_tokens(text: Column, n_tokens: int | Column) -> Column:
    """The text if it has at most n tokens, else the characters of its first n."""
    n = F.lit(n_tokens) if isinstance(n_tokens, int) else n_tokens
    return F.when(count_tokens(text) > n, F.substring(text, F.lit(1), n.cast("int") * 4)).otherwise(text)


def squeeze_whitespace(text: Column) -> Column:
    """Collapse blank lines, trailing blanks, blank runs and indented bullets."""
    out = F.regexp_replace(text, r"\n{3,}", "\n\n")
    # The look-behind makes a run of blanks tried once, from its first blank.
    out = F.regexp_replace(out, r"(?<! ) ++\n", "\n")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    out = F.regexp_replace(out, r"\n +\*", "\n*")
    return strip(out)


def decode_utf8_lenient(raw: Column) -> Column:
    """Bytes to text; bytes that are not UTF-8 are dropped, a real U+FFFD stays."""
    kept = F.replace(raw.cast("string"), F.lit("\ufffd"), F.lit("\ufdd0"))
    valid = F.replace(F.make_valid_utf8(kept), F.lit("\ufffd"), F.lit(""))
    return F.replace(valid, F.lit("\ufdd0"), F.lit("\ufffd"))
