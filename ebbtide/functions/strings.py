"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_number(value: Column, digits: int) -> Column:
    """Fixed decimals without digit grouping."""
    return F.regexp_replace(F.format_number(value, digits), ",", "")


def price_text(price: Column) -> Column:
    """`1,234.56$` from one up; below it six decimals with trailing zeros cut."""
    small = F.rtrim(F.rtrim(plain_number(price, 6), F.lit("0")), F.lit("."))
    return F.concat(F.when(price >= 1, F.format_number(price, 2)).otherwise(small), F.lit("$"))


def percent_text(ratio: Column, digits: int = 0, signed: bool = False) -> Column:
    text = F.concat(plain_number(ratio * 100.0, digits), F.lit("%"))
    return F.concat(F.when(ratio >= 0, "+").otherwise(""), text) if signed else text


def clip_words(text: Column, limit: int = 500) -> Column:
    """Cut at the last space within the first `limit` characters and mark the cut."""
    head = F.substring(text, 1, limit)
    cut = F.regexp_replace(head, r"(?s) [^ ]*\z", "")
    return F.when(F.char_length(text) > limit, F.concat(cut, F.lit("…"))).otherwise(text)


def none_as_null(text: Column) -> Column:
    """The literal answer NONE, in any case and padding, means no answer."""
    return F.when(F.upper(F.regexp_replace(text, r"^\s+|\s+$", "")) != "NONE", text)


def normal_symbol(symbol: Column | str) -> Column:
    return F.upper(F.trim(F.col(symbol) if isinstance(symbol, str) else symbol))
