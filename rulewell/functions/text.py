"""Text expressions with Unicode whitespace semantics.

Plain ``trim`` removes spaces only and ``\\s`` is ASCII-only: stripping names its characters, and the
patterns switch on ``(?U)`` and add the four separator control characters that count as whitespace.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters that count as whitespace.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"
NON_WORD = r"[^\p{L}\p{N}_]+"

URL_PATTERN = r"""(?i)(?:https?://|www\.)[^\s<>"']+"""
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.trim(column(c), F.lit(SPACES))


def strip_chars(c: Column | str, chars: str) -> Column:
    """Remove runs of any of ``chars`` from both ends."""
    return F.trim(column(c), F.lit(chars))


def as_text(c: Column | str) -> Column:
    """Text form where a missing value reads ``nan``."""
    return F.coalesce(column(c).cast("string"), F.lit("nan"))


def capitalize(c: Column | str) -> Column:
    c = column(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def word_count(c: Column | str) -> Column:
    bare = strip(as_text(c))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"(?U){SPACE}+")))


def has_text(c: Column | str) -> Column:
    return F.regexp_like(column(c), F.lit(f"(?U){NON_SPACE}"))


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(column(c), f"(?U){SPACE}+", " ")


def concat_collapse(*cols: Column | str) -> Column:
    """Join optional columns by a space, strip, and collapse inner whitespace."""
    joined = F.concat_ws(" ", *[F.coalesce(column(c), F.lit("")) for c in cols])
    return collapse_spaces(strip(joined))


def words(c: Column | str) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.filter(F.split(F.lower(column(c)), NON_WORD), lambda w: F.length(w) >= 2)


def distinct_words(c: Column | str) -> Column:
    return F.array_distinct(words(c))


def mask_contacts(c: Column | str) -> Column:
    """URLs, e-mail addresses and phone numbers become ``<URL>``, ``<EMAIL>`` and ``<PHONE>``.

    A plain substring test decides first whether a text can hold a URL or an address at all: those
    two patterns retry inside every word and most texts have neither.
    """
    text = column(c)
    maybe_url = F.contains(text, F.lit("://")) | F.contains(F.lower(text), F.lit("www."))
    masked = F.when(maybe_url, F.regexp_replace(text, URL_PATTERN, "<URL>")).otherwise(text)
    maybe_email = F.contains(masked, F.lit("@"))
    masked = F.when(maybe_email, F.regexp_replace(masked, EMAIL_PATTERN, "<EMAIL>")).otherwise(masked)
    return F.regexp_replace(masked, PHONE_PATTERN, "<PHONE>")


@F.pandas_udf(StringType())
def ascii_fold(texts: pd.Series) -> pd.Series:
    """Compatibility-decompose and drop what has no ASCII form (no built-in function does this)."""
    return texts.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def scrub(c: Column | str, fold: bool = True) -> Column:
    """Fold to ASCII, then mask URLs, e-mail addresses and phone numbers; case is kept."""
    return mask_contacts(ascii_fold(column(c)) if fold else column(c))
