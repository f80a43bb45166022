"""Label normalisers.

They accept different spellings on purpose; each one is kept apart because sources that were
cleaned by one of them are not cleaned the same way by another.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulewell.functions.text import as_text, capitalize, column, strip, strip_chars


def _pick(value: Column, *cases: tuple[object, tuple[str, ...]]) -> Column:
    """First case whose spellings contain ``value``; null when none does."""
    out = None
    for result, spellings in cases:
        test = value.isin(*spellings)
        out = F.when(test, F.lit(result)) if out is None else out.when(test, F.lit(result))
    return out


def _unquote_runs(c: Column | str) -> Column:
    return strip_chars(strip_chars(strip(c), '"'), "'")


def strict(c: Column | str) -> Column:
    """Case-sensitive; drops at most one quote per end; True/False count as Yes/No."""
    bare = strip(F.regexp_replace(strip(as_text(c)), r"""^["']|["']\z""", ""))
    return _pick(bare, ("Yes", ("True", "Yes")), ("No", ("False", "No")))


def lenient(c: Column | str) -> Column:
    """Any case, any run of quotes, and the short forms."""
    bare = F.lower(strip(_unquote_runs(c)))
    return _pick(bare, ("Yes", ("yes", "true", "1", "y", "t")), ("No", ("no", "false", "0", "n", "f")))


def plain(c: Column | str) -> Column:
    """Case-sensitive and without quote removal."""
    bare = strip(as_text(c))
    return _pick(bare, ("Yes", ("True", "Yes")), ("No", ("False", "No")))


def evaluation(c: Column | str) -> Column:
    """1/0 from yes/no only."""
    return _pick(F.lower(_unquote_runs(as_text(c))), (1, ("yes",)), (0, ("no",)))


def or_unknown(c: Column | str, boolean: bool = False) -> Column:
    """Yes/No or the word Unknown; pass ``boolean=True`` for a BOOLEAN column."""
    if boolean:
        found = F.when(column(c), F.lit("Yes")).when(~column(c), F.lit("No"))
    else:
        bare = capitalize(_unquote_runs(c))
        found = F.when(bare.isin("Yes", "No"), bare)
    return F.coalesce(found, F.lit("Unknown"))


def to_boolean(c: Column | str) -> Column:
    bare = F.lower(strip(column(c).cast("string")))
    return _pick(bare, (True, ("true", "1", "yes", "y")), (False, ("false", "0", "no", "n")))


def is_true_false(c: Column | str) -> Column:
    """Predicate: the text is exactly True or False."""
    return column(c).isin("True", "False")


def yes_no_to_int(c: Column | str) -> Column:
    return _pick(column(c), (1, ("Yes",)), (0, ("No",)))


def int_to_yes_no(c: Column | str) -> Column:
    return F.when(column(c) == 1, F.lit("Yes")).when(column(c) == 0, F.lit("No"))


def int_to_true_false(c: Column | str) -> Column:
    return F.when(column(c) == 1, F.lit("True")).otherwise(F.lit("False"))


def signed(c: Column | str) -> Column:
    """1 stays 1 and 0 becomes -1; other values pass so that a filter can drop them."""
    return F.when(column(c) == 0, F.lit(-1)).otherwise(column(c))
