"""How filters interact: what every order of applying them removes, step by step.

The orders of k filters, in lexicographic order, are numbered 0 to k! - 1. Orders that begin with the
same letters are neighbours, so each beginning owns an interval of ranks whose start is the Lehmer
code of the beginning, read as a factorial number. What happens to a document at a step depends on
the beginning alone: counts are added at the start of its interval and taken away at its end, and
running sums over the ranks give every order's totals without visiting documents once per order.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders grow as the factorial of the filters.
MOST_FILTERS = 7
_BEGINNING = "array<struct<step:int, letter:int, before:int, first:int, last:int>>"


def beginnings(k: int) -> list[dict[str, int]]:
    """Beginnings of orders of ``k`` letters: length, last letter, earlier letters, rank interval."""
    out = []
    for step in range(1, k + 1):
        width = factorial(k - step)
        for letters in permutations(range(k), step):
            first = 0
            for i, x in enumerate(letters):
                smaller = x - sum(y < x for y in letters[:i])
                first += smaller * factorial(k - 1 - i)
            before = sum(1 << x for x in letters[:-1])
            out.append({"step": step, "letter": letters[-1], "before": before,
                        "first": first, "last": first + width})
    return out


def first_of_equals(rows: DataFrame, same: str, order: str) -> DataFrame:
    """``same`` and the smallest ``order`` of each of its values, with a column ``is_first``."""
    return rows.groupBy(same).agg(F.min(order).alias(order)).withColumn("is_first", F.lit(True))


def interactions(
    rows: DataFrame,
    filters: Mapping[str, Column],
    part: Column,
    lost: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Totals per ``part``, ``filter_order`` and ``step`` over all orders of ``filters``.

    ``filters`` maps letters to failure conditions of a row (null: passes). ``lost`` maps names to
    conditions whose rows are counted among the removed. Columns: ``kept`` after the step,
    ``removed`` by it, ``redundant`` (fails here but went earlier), ``unique_fails`` (fails this
    filter only), those of ``lost``, and ``shapley``, the removed of the step's filter summed over
    all orders. A null part counts as the empty string; repeated rows count each; an empty table
    gives no rows; every part has all k! * k rows, zeros included.

    Rows are counted per part and mask of failed filters before the shuffle, so neither a large part
    nor a frequent mask gathers; all later work is on at most 2**k counts a part.
    """
    letters, lost = sorted(filters), dict(lost or {})
    k = len(letters)
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    bits = [
        F.when(F.coalesce(filters[x], F.lit(False)), F.lit(1 << i)).otherwise(0)
        for i, x in enumerate(letters)
    ]
    mask = sum(bits[1:], bits[0])
    hit = {n: F.coalesce(c, F.lit(False)).cast("long") for n, c in lost.items()}
    masks = rows.select(
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"),
        *(c.alias(n) for n, c in hit.items()),
    )
    masks = masks.groupBy("part", "mask").agg(
        F.count("*").alias("n"), *(F.sum(n).alias(n) for n in lost)
    )
    masks = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", *lost)).alias("masks"))

    # the counts that every beginning adds over its interval
    starts = F.from_json(F.lit(json.dumps(beginnings(k))), _BEGINNING)
    at = masks.select("part", "masks", F.explode(starts).alias("b"))
    letter = F.expr("shiftleft(1, b.letter)")

    def total(when, value="n"):
        def add(a, m):
            return a + F.when(when(m["mask"]), m[value]).otherwise(0)

        return F.aggregate("masks", F.lit(0).cast("long"), add)

    reaches = lambda m: m.bitwiseAND(F.col("b.before")) == 0
    fails = lambda m: m.bitwiseAND(letter) != 0
    gone = lambda m: reaches(m) & fails(m)
    counts = {
        "kept": total(lambda m: reaches(m) & ~fails(m)),
        "removed": total(gone),
        "redundant": total(lambda m: ~reaches(m) & fails(m)),
        "unique_fails": total(lambda m: m == letter),
        **{n: total(gone, n) for n in lost},
    }
    at = at.select("part", "b", *(c.alias(n) for n, c in counts.items()))
    ends = F.array(
        F.struct(F.col("b.first").alias("rank"), F.lit(1).alias("sign")),
        F.struct(F.col("b.last").alias("rank"), F.lit(-1).alias("sign")),
    )
    change = at.select("part", F.col("b.step").alias("step"), F.explode(ends).alias("e"), *counts)
    change = change.select(
        "part", "step", "e.rank", *((F.col(n) * F.col("e.sign")).alias(n) for n in counts)
    )
    # ranks at which nothing changes
    still = masks.select("part", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    still = still.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(factorial(k) - 1))).alias("rank"))
    still = still.select("*", *(F.lit(0).cast("long").alias(n) for n in counts))
    change = change.unionByName(still).groupBy("part", "step", "rank").agg(
        *(F.sum(n).alias(n) for n in counts)
    )
    upto = Window.partitionBy("part", "step").orderBy("rank")
    out = change.select(
        "part", "step", "rank", *(F.sum(n).over(upto).cast("long").alias(n) for n in counts)
    ).where(F.col("rank") < factorial(k))
    orders = F.lit(["".join(x) for x in permutations(letters)])
    out = out.withColumn("filter_order", F.get(orders, F.col("rank")))
    own = F.substr("filter_order", F.col("step"), F.lit(1))
    shapley = F.sum("removed").over(Window.partitionBy("part", own)).cast("long")
    return out.select("part", "filter_order", "step", *counts, shapley.alias("shapley"))
