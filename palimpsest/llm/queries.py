"""The registered queries of this package, and the SQL that states their results where SQL can."""

from __future__ import annotations

from . import filter_audit, licences, line_dedup, merkle, mixing, ogg, quality, secret_scan, sentencepiece_scan, simhash, substring_dedup, suffix_dedup, url_filter

#: Modules with queries() and oracle_sql(), in the order of their operators.
MODULES = (mixing, licences, ogg, url_filter, substring_dedup, quality, line_dedup, simhash, secret_scan, sentencepiece_scan, filter_audit, suffix_dedup, merkle)


def _all(what: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(module, what)()
    return found


def queries() -> dict:
    return _all("queries")


def oracle_sql() -> dict:
    return _all("oracle_sql")
