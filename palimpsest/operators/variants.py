"""Expressions over VARIANT values: parts at a path, and JSON text made of parts. All stay in the JVM, row by row."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def at(v: Column, way: str) -> Column:
    """The part at a way such as $.a.b as VARIANT; null where there is none. A JSON null is a VARIANT."""
    return F.try_variant_get(v, way, "variant")


def kind(v: Column) -> Column:
    """STRING, VOID (a JSON null), BOOLEAN, OBJECT, ARRAY or a number's type; null for no value."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def string_at(v: Column, way: str) -> Column:
    """The string at a way; null for anything else."""
    return F.when(kind(at(v, way)) == "STRING", F.try_variant_get(v, way, "string"))


def items(v: Column, way: str) -> Column:
    """array<variant>: the elements at a way; empty where there is no array."""
    return F.coalesce(F.try_variant_get(v, way, "array<variant>"), F.array().cast("array<variant>"))


def keys(v: Column) -> Column:
    """The names of an object's fields; null for anything else."""
    return F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))


def given(v: Column, way: str) -> Column:
    """The JSON text at a way; null where there is none or a JSON null."""
    return F.when(kind(at(v, way)) != "VOID", F.to_json(at(v, way)))


def quoted(text: Column) -> Column:
    """A string as JSON text."""
    return F.to_json(text.cast("variant"))


def array_text(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def object_text(fields: Mapping[str, Column]) -> Column:
    """An object of JSON texts, fields sorted by name; fields that are null are left out."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))
