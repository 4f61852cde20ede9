"""Checks on candidate strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def mod97(iban: Column) -> Column:
    """Remainder of an IBAN's digits (letters count 10 to 35) with its first four characters moved to the end."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda r, c: F.when(value(c) > 9, (r * 100 + value(c)) % 97).otherwise((r * 10 + value(c)) % 97))


def iban_ok(iban: Column) -> Column:
    return F.length(iban).between(15, 34) & (mod97(iban) == 1)


def luhn_ok(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def entropy(text: Column) -> Column:
    """Bits for each character, summed in order of characters.

    The text's characters are sorted once, and each run of equal ones is counted by its length: n log n, however many differ.
    """
    in_order = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(in_order, F.lit(r"(?s)(.)\1*+"), F.lit(0))
    start = F.struct(F.lit(0.0).alias("bits"), F.length(text).alias("n"))
    share = lambda s, r: F.length(r) / s["n"]
    return F.aggregate(runs, start, lambda s, r: F.struct((s["bits"] - share(s, r) * F.log2(share(s, r))).alias("bits"), s["n"].alias("n")), lambda s: s["bits"])


def char_classes(text: Column) -> Column:
    """How many of lower case, upper case, digit and anything else occur."""
    return sum((F.when(text.rlike(rx), 1).otherwise(0) for rx in (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"[^\p{Ll}\p{Lu}\p{Nd}]")), F.lit(0))


def compact_key(key: Column) -> Column:
    """A key without hyphens, underscores and white space, in lower case."""
    return F.lower(F.regexp_replace(key, r"[-_\s]", ""))


def bare_value(value: Column) -> Column:
    """A value without trailing white space, commas and semicolons; then what stands in its quotes, or behind an open one."""
    trimmed = F.regexp_replace(value, r"[\s,;]+\z", "")
    quote = F.substring(trimmed, 1, 1)
    rest = F.substring(trimmed, 2, 1 << 30)
    closing = F.when(quote == '"', F.instr(rest, '"')).otherwise(F.instr(rest, "'"))
    inside = F.when(closing > 0, F.substring(rest, F.lit(1), closing - 1)).otherwise(rest)
    return F.when((F.octet_length(trimmed) >= 2) & quote.isin('"', "'"), inside).otherwise(trimmed)
