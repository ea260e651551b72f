"""Text expressions: line splitting, comparison keys, script shares, bounded ids, display forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The line boundaries of Unicode text.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Full-width ASCII and the ideographic space fold to ASCII; other compatibility forms stay as they are.
WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def bound(use: Callable[..., Column], *values: Column) -> Column:
    """use(values), each value computed once a row: an expression that is named twice, or inside a lambda, is computed as often.

    element_at, as get derives its type anew from the whole expression for every row.
    """
    if not values:
        return use()
    return F.element_at(F.transform(F.array(values[0]), lambda v: bound(lambda *rest: use(v, *rest), *values[1:])), 1)


def lines(text: Column) -> Column:
    """Lines of a text; a trailing break opens no further line; null text has none."""
    split = F.split(text, LINE_BREAK)
    last_empty = F.element_at(split, -1) == ""
    return F.coalesce(F.when(last_empty, F.slice(split, 1, F.size(split) - 1)).otherwise(split), F.array().cast("array<string>"))


def comparison_key(text: Column) -> Column:
    """Width-folded, all Unicode white space removed, lower case."""
    return F.lower(F.regexp_replace(F.translate(text, WIDE, NARROW), r"(?U)\s+", ""))


def spaced_key(text: Column) -> Column:
    """Runs of white space collapsed, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def share_of(text: Column, pattern: str) -> Column:
    """Share of the characters that match among those that are not white space; 0 for blank text."""
    solid = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    return F.when(solid > 0, count_of(text, pattern) / solid).otherwise(F.lit(0.0))


def derived_id(prefix: str, source: Column, most: int = 128) -> Column:
    """prefix + id, or a cut id with the head of its SHA-256 where that is longer than most characters."""
    whole = F.concat(F.lit(prefix), source)
    tail = F.concat(F.lit("-"), F.substring(F.sha2(whole, 256), 1, 16))
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.substring(whole, 1, most - 17), tail))


def printed_values(text: Column) -> Column:
    """Upper-case runs of a number with its sign, its leading letters, inner separators and trailing letters."""
    return F.regexp_extract_all(F.upper(text), F.lit(r"([+−-]?[A-Z]*[0-9]+(?:[.,:/-][0-9]+)*(?:[A-Z]+[0-9]*)*)"), F.lit(1))


#: Forms of values that two readings of a page must share exactly.
EXACT_FORMS = [r"https?://\S+", r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", r"₩\s?[0-9,]+", r"[0-9]{2,4}[./-][0-9]{1,2}(?:[./-][0-9]{1,2})?", r"[0-9]{1,2}:[0-9]{2}", r"[0-9]{2,4}-[0-9]{3,4}-[0-9]{4}", r"[A-Za-z][0-9]{2,4}"]


def exact_values(text: Column) -> Column:
    """Distinct links, addresses, amounts, dates, times, numbers and form codes as printed, without the stops behind them."""
    found = F.regexp_extract_all(text, F.lit(f"({'|'.join(EXACT_FORMS)})"), F.lit(1))
    return F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda v: F.regexp_replace(v, r"[.,)]+$", "")))


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


#: Characters that have a compatibility form: most Latin, Hangul and Han text holds none and stays in the JVM.
COMPATIBILITY = r"[\u00a0\u00a8\u00aa\u00af\u00b2-\u00b5\u00b8-\u00ba\u00bc-\u00be\u0132-\u0149\u017f\u0300-\u036f\u1100-\u11ff\u2000-\u2bff\u2e80-\u2fdf\u3000\u3130-\u318f\u3200-\u33ff\ufb00-\uffef]"


def folded_key(text: Column) -> Column:
    """The comparison key after compatibility normalisation, which rows without a compatibility character skip."""
    needs = text.rlike(COMPATIBILITY)
    return comparison_key(F.when(needs, _compatible(F.when(needs, text))).otherwise(text))


def csv_safe(cell: Column) -> Column:
    """Cells that a spreadsheet would run as a formula get a leading apostrophe."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)
