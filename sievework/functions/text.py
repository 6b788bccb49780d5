"""Scalar text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x1F\x7F]"
PRICE = r"^\$?\d+(\.\d+)?$"
NO_GENRES = "(no genres listed)"


def control_to_space(c: Column) -> Column:
    """Every control character becomes a space; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, CONTROL, " "))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def parse_price(c: Column) -> Column:
    """Plain amounts with an optional dollar sign as double; ranges and prose are null."""
    text = F.trim(c)
    return F.when(text.rlike(PRICE), F.regexp_replace(text, r"^\$", "").try_cast("double"))


def first_named(*named: tuple[str, Column]) -> tuple[Column, Column]:
    """The first non-blank of the columns, lower-cased, else 'unknown'; and the name it came by."""
    value = F.coalesce(*[F.lower(blank_to_null(c)) for _, c in named], F.lit("unknown"))
    source = F.coalesce(*[F.when(blank_to_null(c).isNotNull(), F.lit(n)) for n, c in named], F.lit("unknown"))
    return value, source


def one_line(c: Column) -> Column:
    """Line breaks to spaces, other control characters out, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "\n", " "), CONTROL, ""), r"\s+", " "))


def normal_tag(c: Column) -> Column:
    return blank_to_null(F.trim(F.lower(c)))


def split_genres(c: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(c.isNull() | (F.trim(c) == "") | (c == NO_GENRES), empty).otherwise(F.split(c, r"\|"))


def recipe(*parts: Column) -> Column:
    """Non-empty parts joined by a space."""
    return F.concat_ws(" ", F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")))


def strip_urls(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"https?://\S+|www\.\S+", " "), r"\s+", " "))


def canonical(name: str, kind: str) -> Column:
    """A value as text for hashing: complex values as JSON, null as the empty text."""
    c = F.to_json(name) if kind.startswith(("array", "map", "struct")) else F.col(name).cast("string")
    return F.coalesce(c, F.lit(""))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def detail(c: Column, key: str) -> Column:
    """The value of a key in a map; null where the map or the key is missing."""
    return F.try_element_at(c, F.lit(key))


def details(c: Column) -> Column:
    """A JSON object as a map of strings: values that are not strings as their JSON text; null for anything else."""
    return F.from_json(c, "map<string,string>")
