"""Line dedup with overlapping windows of three lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwick.llm.common import fresh, stage, with_row_id

#: Lines of a window.
WIDTH = 3


def drop_repeated_windows(
    df: DataFrame, text: str = "text", order: str = "doc_id", width: int = WIDTH
) -> DataFrame:
    """``df`` with repeated windows of lines cut from ``text``, plus ``n_lines``, ``n_removed``.

    A window is ``width`` consecutive lines of one text (lines end at a line feed). Windows with
    the same lines are ranked by (``order``, row, position); all but the first are repeats, and
    every line that a repeat covers goes. Windows overlap, so runs of covered lines merge. Texts
    with fewer lines have no window and stay as they are, empty ones too; a null text stays null
    with no lines; rows with a null ``order`` rank first; repeated rows rank as they are stored. A
    text that loses all lines becomes empty. Other columns pass through; ``n_lines`` and
    ``n_removed`` of the input are replaced.

    Only hashes of windows (128 bits) are shuffled to find repeats, combined before the shuffle;
    the join back is an equi-join that adaptive execution splits on frequent windows.
    """
    base = df.drop("n_lines", "n_removed")
    rid, own_lines, left, starts = fresh(base, "rid", "lines", "left", "starts")
    rows = with_row_id(base, rid)
    lines = rows.select(F.col(rid).alias("_rid"), F.col(order).alias("_o"), F.split(text, "\n", -1).alias("_l"))
    # windows: hash line by line once, then combine neighbours by position
    hashed = lines.select(
        "_rid", "_o", F.transform("_l", lambda x: F.struct(
            F.xxhash64(x).alias("a"), F.xxhash64(F.lit(width), x).alias("b"))).alias("_h"),
    )
    count = F.greatest(F.size("_h") - (width - 1), F.lit(0))

    def window(i):
        near = [F.get("_h", i + k) for k in range(width)]
        return F.struct(
            F.xxhash64(*(x["a"] for x in near)).alias("a"),
            F.xxhash64(*(x["b"] for x in near)).alias("b"),
        )

    places = F.transform(F.slice("_h", 1, count), lambda x, i: window(i))
    windows = hashed.where(F.size("_h") >= width).select(
        "_rid", "_o", F.posexplode(places).alias("_i", "_w")
    )
    windows = windows.select(
        F.col("_w.a").alias("_a"), F.col("_w.b").alias("_b"), F.struct("_o", "_rid", "_i").alias("_p")
    )
    first = (
        windows.groupBy("_a", "_b")
        .agg(F.min("_p").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    later = windows.join(first, ["_a", "_b"]).where(~F.col("_p").eqNullSafe(F.col("_first")))
    covered = later.groupBy(F.col("_p._rid").alias(rid)).agg(F.collect_set("_p._i").alias(starts))
    covered = stage(covered, "covered")

    out = rows.withColumn(own_lines, F.split(text, "\n", -1)).join(covered, rid, "left")
    gone = F.array_distinct(
        F.flatten(F.transform(starts, lambda s: F.array(*(s + k for k in range(width)))))
    )
    all_lines = F.sequence(F.lit(0), F.size(own_lines) - 1)
    out = out.withColumn(left, F.when(F.col(starts).isNotNull(), F.array_except(all_lines, gone)))
    kept = F.array_join(F.transform(left, lambda i: F.get(own_lines, i)), "\n")
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(own_lines)).cast("long")
    n_removed = F.when(F.col(left).isNull(), 0).otherwise(F.size(own_lines) - F.size(left)).cast("long")
    return out.select(
        *(F.when(F.col(left).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else c
          for c in rows.columns if c != rid),
        n_lines.alias("n_lines"),
        n_removed.alias("n_removed"),
    )
