"""Columns from patterns: first match of an ordered list, all matches, chained replacements.

Patterns ignore case, ^ and $ hold at line ends (\\n only), and white space includes the no-break space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY_CASE, LINES = "(?iu)", "(?iumd)"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _or_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def group(text: Column, pattern: str, number: int = 1, flags: str = LINES) -> Column:
    """The group of the first match; null where there is none or it is empty."""
    return bound(F.regexp_extract(text, flags + pattern, number), _or_null)


def first_of(text: Column, patterns: Iterable[str], accept: Callable[[Column], Column] = lambda x: x, flags: str = LINES, number: int = 1) -> Column:
    """The first pattern whose first match is accepted: accept turns the match into a value, or null to go on."""
    return F.coalesce(*[bound(F.regexp_extract(text, flags + p, number), lambda x: bound(_or_null(x), accept)) for p in patterns])


def every(text: Column, pattern: str, number: int = 1, flags: str = LINES) -> Column:
    """All matches, as an array; never null for a text."""
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(number))


def long_enough(least: int) -> Callable[[Column], Column]:
    return lambda x: F.when(F.char_length(F.trim(x)) >= least, F.trim(x))


def squeezed(text: Column, most: int = 400) -> Column:
    """White space as single blanks, trimmed, cut."""
    return F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, most)


def replaced(text: Column, *steps: tuple[str, str]) -> Column:
    """Regular-expression replacements, one after another."""
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def changed_where(text: Column, holds: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """The changed text where holds is true, else text as it is."""
    return bound(text, lambda t: F.when(holds(t), change(t)).otherwise(t))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def first_contained(text: Column, names: dict[str, str]) -> Column:
    """The value of the first key that text contains."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(word)), F.lit(name)) for word, name in names.items()])


def lookup(key: Column, names: dict[str, str]) -> Column:
    """A small dictionary as a map literal: no join, no shuffle."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def money(text: Column) -> Column:
    """A number with thousands separators as DECIMAL(18,2); null if it is none."""
    return F.regexp_replace(text, ",", "").try_cast("decimal(18,2)")
