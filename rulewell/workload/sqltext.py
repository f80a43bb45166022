"""SQL text builders shared by the twins."""

from __future__ import annotations

from rulewell.functions.prompts import FIELD
from rulewell.functions.text import EMAIL_PATTERN, PHONE_PATTERN, URL_PATTERN


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def render_sql(template: str, alias: str = "", **fields: str) -> str:
    """SQL twin of a rendered template; a field not given is the column of that name."""
    parts = []
    for i, piece in enumerate(FIELD.split(template)):
        if i % 2:
            column = fields.get(piece, f"{alias}.{piece}" if alias else piece)
            parts.append(f"coalesce(cast({column} as varchar), 'nan')")
        elif piece:
            parts.append(quoted(piece))
    return f"concat({', '.join(parts)})"


def hash_sql(key: str, seed: int) -> str:
    return f"md5(concat(cast({key} as varchar), '|{seed}'))"


def hash_int_sql(key: str, seed: int) -> str:
    return f"cast(concat('0x', substr({hash_sql(key, seed)}, 1, 15)) as bigint)"


def dot_sql(a: str, b: str) -> str:
    """Inner product to the digits that the order of the sum cannot change."""
    return f"round(list_inner_product({a}::double[], {b}::double[]), 12)"


def scrub_sql(expression: str) -> str:
    """SQL twin of the text scrub: ASCII fold, then the three masks."""
    out = rf"regexp_replace(strip_accents({expression}), '[^\x00-\x7F]', '', 'g')"
    for pattern, mask in ((URL_PATTERN, "<URL>"), (EMAIL_PATTERN, "<EMAIL>"), (PHONE_PATTERN, "<PHONE>")):
        out = f"regexp_replace({out}, {quoted(pattern)}, '{mask}', 'g')"
    return out


def cells_sql(truth: str, prediction: str) -> str:
    pairs = (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))
    return ", ".join(f"count(*) filter (where {truth} = {a} and {prediction} = {b}) as {n}" for n, a, b in pairs)


RATIOS = """round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) as accuracy,
 round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
 round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1"""
