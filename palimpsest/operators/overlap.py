"""Which of overlapping spans stay: greedily, the best first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .secrets import overlaps
from .spans import let

#: Ranks, larger is better; anything else is 0.
SEVERITY_RANK = {"BLOCK": 3, "WARN": 2, "LOG": 1}
TYPE_RANK = {"credential": 3, "financial": 2, "pii": 1}
PATTERN_RANK = {
    "aws_access_key_id": 4, "aws_secret_access_key": 4, "aws_session_token": 4,
    "openai_api_key": 3, "anthropic_api_key": 3, "google_api_key": 3, "aws_access_key": 3,
    "generic_secret_assignment": 2, "generic_token_assignment": 2, "generic_api_key_assignment": 2, "generic_private_key_assignment": 2,
    "slm_secret": 1,
}


def _rank(value: Column, ranks: dict[str, int]) -> Column:
    """Negative ranks: ascending order puts the best first."""
    by_rank: dict[int, list[str]] = {}
    for name, rank in ranks.items():
        by_rank.setdefault(rank, []).append(name)
    out = F.lit(0)
    for rank, names in by_rank.items():
        out = F.when(value.isin(*names), -rank).otherwise(out)
    return out


def quality(x: Column) -> Column:
    """Severity, type, kind of secret, length, position; then pattern and matched, so that the order is total."""
    return F.struct(
        _rank(x["severity"], SEVERITY_RANK).alias("s"), _rank(x["type"], TYPE_RANK).alias("t"), _rank(x["pattern"], PATTERN_RANK).alias("p"),
        (x["position"] - x["end"]).alias("l"), x["position"].alias("position"), x["pattern"].alias("pattern"), x["matched"].alias("matched"),
    )


def by_quality(spans: Column) -> Column:
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct(quality(x).alias("q"), x.alias("x"))))
    return F.transform(ranked, lambda r: r["x"])


def by_position(spans: Column) -> Column:
    placed = F.array_sort(F.transform(spans, lambda x: F.struct(x["position"].alias("at"), x["end"].alias("e"), x.alias("x"))))
    return F.transform(placed, lambda r: r["x"])


def _greedy(spans: Column) -> Column:
    """Of spans that hang together, each in order of quality stays unless it meets one that stays; by position."""
    def keep(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda k: overlaps(k, x)), kept).otherwise(F.concat(kept, F.array(x)))

    chosen = F.aggregate(by_quality(spans), F.slice(spans, 1, 0), keep)
    return F.when(F.size(spans) <= 1, spans).otherwise(by_position(chosen))


def resolved(spans: Column) -> Column:
    """Disjoint spans by position: each span in order of quality stays unless it meets one that stays.

    Spans are cut into clusters first, and only spans of a cluster are compared: by position, a cluster begins where as many ends
    have passed as spans have begun before. So work grows with the spans, and with the square only of what hangs together.
    """
    placed = F.struct(
        by_position(spans).alias("x"),
        # An empty span counts as one byte here, so that it stays in the cluster of a span around it.
        F.array_sort(F.transform(spans, lambda x: F.greatest(x["end"], x["position"] + 1))).alias("ends"),
    )

    def cut(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s["x"]) - 1), lambda i: (i == 0) | (F.get(s["ends"], i - 1) <= F.get(s["x"], i)["position"]))
        cluster = lambda b: lambda at, k: let(F.slice(s["x"], at + 1, F.coalesce(F.get(b, k + 1), F.size(s["x"])) - at), _greedy)
        return let(begins, lambda b: F.flatten(F.transform(b, cluster(b))))

    return F.when(F.size(spans) <= 1, spans).otherwise(let(placed, cut))
