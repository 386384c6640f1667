"""Column helpers over what ``functions.phrases`` finds, and for short fixed word lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it inside a lambda. Without this
    the optimiser may inline it into the lambda and repeat it per keyword."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(text: Column, keywords: list[str]) -> Column:
    """Any of a short fixed list, as one expression; null text never matches."""
    low = [k.lower() for k in keywords]
    return F.coalesce(
        let(F.lower(text), lambda t: F.exists(F.array(*map(F.lit, low)), lambda k: F.contains(t, k))),
        F.lit(False),
    )


def full_text(*cols) -> Column:
    """Fields joined by blanks, nulls as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def groups_hit(hits: Column) -> Column:
    """Distinct groups among matched entries, in dictionary order."""
    pairs = F.array_distinct(F.transform(hits, lambda h: F.struct(h["grp_rank"].alias("grp_rank"), h["grp"].alias("grp"))))
    return F.transform(F.array_sort(pairs), lambda p: p["grp"])


def best_group(hits: Column, weight=None) -> Column:
    """Group with the largest (weighted) number of matched entries; earlier
    dictionary rank breaks ties. Null when nothing matched."""
    weight = weight or (lambda h: F.lit(1))
    pairs = F.array_distinct(F.transform(hits, lambda h: F.struct(h["grp_rank"].alias("grp_rank"), h["grp"].alias("grp"))))
    scored = F.transform(
        pairs,
        lambda p: F.struct(
            F.aggregate(
                hits, F.lit(0), lambda acc, h: acc + F.when(h["grp"] == p["grp"], weight(h)).otherwise(0)
            ).alias("score"),
            (-p["grp_rank"]).alias("neg_rank"),
            p["grp"].alias("grp"),
        ),
    )
    return F.array_max(scored)
