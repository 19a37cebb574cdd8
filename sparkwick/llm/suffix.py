"""Removal of repeated byte strings by local hashes of sampled positions and one doubling.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Ranking every
position and doubling its rank until it is unique would shuffle each of them several times. Local
hashes replace that here, with a single doubling over sampled positions:

1. Every start of a string points at one position near it, the smallest hash among the next ones
   (winnowing). Equal strings point at the same place in them, so it is enough to rank these
   positions; starts that share one form a block of consecutive starts. Equal blocks in a row (a
   short line repeated over and over) are one row with a count, as their ranks would be hot keys.
2. One doubling: every task hashes both halves (133 bytes each for strings of 400) of what two equal
   strings must share from their position on. Spark groups by the first half, positions that are
   alone leave, and then by the pair of halves. There is no first rank, no loop and no reranking.
   Ranks are 64-bit fingerprints, since only their equality matters.
3. Past the threshold: blocks whose whole extent is equal are repeated in all their starts. Blocks
   that share a rank without being equal are the borders of repeats; their starts are compared
   one by one, with one representative of every kind of block that has the same rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwick.llm.common import fresh, stage, with_row_id
from sparkwick.llm.hashing import RangeHash, mix

#: Bytes of a repeated string.
LENGTH = 400
#: Bytes that the sampling hash looks at, and bytes that are worked on at once.
GRAM, CHUNK = 32, 1_000_000

_BLOCKS = "r1 long, r2 long, rid long, place long, whole long, times long"
_STARTS = "wh long, rid long, s long"


def _shape(length: int) -> tuple[int, int, int]:
    """Half of the ranked length, positions a start can point at, bytes of the sampling hash."""
    half = (length - length // 3) // 2
    return half, length - 2 * half + 1, min(GRAM, half)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[bytes]]]:
    rids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    raw = [t.encode() for t in texts]
    start = size = 0
    for i, t in enumerate(raw):
        if size + len(t) > CHUNK and i > start:
            yield rids[start:i], raw[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(raw):
        yield rids[start:], raw[start:]


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def pack(lo, hi, a):
    """A block (first and last start, sampled position) in one number."""
    return lo << 24 | (hi - lo) << 12 | (a - lo)


def find_blocks(raw: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Blocks of all texts: text number, packed place, ranks of both halves, hash of the whole, times.

    A block that stands ``times`` times in a row, without a gap, is given once, at its first place.
    """
    half, width, gram = _shape(length)
    sizes = np.array([len(t) for t in raw])
    base = np.concatenate([[0], np.cumsum(sizes)])
    none = np.zeros(0, dtype=np.int64)
    if not (sizes >= length).any():
        return none, none, none, none, none, none
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    hashed = RangeHash(data.astype(np.uint64) + np.uint64(1))
    n = len(data)
    at = np.arange(n - gram + 1)
    key = hashed(at, at + gram) & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64)
    step = 1
    while 2 * step <= width:  # minima over doubling windows
        key = np.minimum(key[: len(key) - step], key[step:])
        step *= 2
    key = np.minimum(key[: len(key) - (width - step)], key[width - step :])
    count = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(raw)), count)
    s = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + base[text]
    a = (key[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(first[1:], len(a)) - 1
    lo, hi, a, text = s[first], s[last], a[first], text[first]
    shape = ((hi - lo) << 12 | (a - lo)).astype(np.uint64)
    whole = mix(hashed(lo, hi + length) ^ mix(shape + np.uint64(1)))
    place = pack(lo - base[text], hi - base[text], a - base[text])
    r1, r2 = hashed(a, a + half), hashed(a + half, a + 2 * half)
    changed = np.concatenate([[True], np.zeros(len(a) - 1, dtype=bool)])
    for column in (text, whole, r1, r2):
        changed[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(changed)
    times = np.diff(np.append(first, len(a)))
    return text[first], place[first], _signed(r1[first]), _signed(r2[first]), _signed(whole[first]), times


def _several(ranked: DataFrame, *keys: str) -> DataFrame:
    """The keys that stand more than once, stored, so that Spark can split the join of a frequent one."""
    found = ranked.groupBy(*keys).agg(F.sum("times").alias("n")).where("n > 1")
    return stage(found.select(*keys), "shared").hint("merge")


def drop_repeats(df: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` plus ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (binary) per row.

    Texts are taken as UTF-8 bytes and matches never cross texts; a null text counts as empty, and
    texts shorter than ``length`` have no string of that length and stay whole. All strings are
    judged on the input, so every copy goes, the first too; repeated rows are copies of each other.
    Results replace columns of the same name.
    """
    half, width, _ = _shape(length)
    if width > 4096:
        raise ValueError("strings of more than about 12,000 bytes need wider block places")
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    base = df.drop(*new)
    rid, found = fresh(base, "rid", "places")
    base = with_row_id(base, rid)
    rows = base.select(F.col(rid).alias("rid"), F.coalesce(text, F.lit("")).alias("text"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rids, raw in _chunks(batch):
                own, place, r1, r2, whole, times = find_blocks(raw, length)
                rid = np.array(rids, dtype=np.int64)[own]
                yield _batch(_BLOCKS, [r1, r2, rid, place, whole, times])

    long_rows = rows.where(F.octet_length("text") >= length)
    ranked = long_rows.mapInArrow(blocks, _BLOCKS)
    # doubling: positions that are alone at half the length, then at the full ranked length, leave
    ranked = stage(ranked.join(_several(ranked, "r1"), "r1"), "ranked")
    ranked = ranked.join(_several(ranked, "r1", "r2"), ["r1", "r2"])
    ranked = stage(ranked.withColumn("r", F.xxhash64("r1", "r2")).drop("r1", "r2"), "ranked")

    kinds = ranked.groupBy("r", "whole").agg(
        F.sum("times").alias("n"), F.min(F.struct("rid", "place")).alias("one")
    )
    kinds = stage(kinds, "kinds")
    equal = kinds.where("n > 1").select("r", "whole")
    starts_of_one = F.expr("shiftright(place, 12) & 4095") + 1
    equal = ranked.join(equal, ["r", "whole"]).select(
        "rid", pack_cut(F.shiftright("place", 24), F.col("times") * starts_of_one - 1 + length)
    )
    mixed = kinds.groupBy("r").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    mixed = stage(mixed.where("kinds > 1 and least = 1").select("r"), "mixed").hint("merge")
    border = kinds.join(mixed, "r").select("one.rid", F.expr("one.place * 2 + cast(n = 1 as int)").alias("p"))
    border = border.groupBy("rid").agg(F.collect_list("p").alias("places"))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2).to_pylist()
            for k, (rid, t) in enumerate(
                zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ):
                data = np.frombuffer(t.encode(), dtype=np.uint8)
                hashed = RangeHash(data.astype(np.uint64) + np.uint64(1))
                p = np.array(places[k], dtype=np.int64)
                lo, n = p >> 25, (p >> 13 & 0xFFF) + 1
                s = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                yield _batch(_STARTS, [
                    _signed(hashed(s, s + length)), np.full(len(s), rid),
                    s * 2 + np.repeat(p & 1, n),
                ])

    single = rows.join(border, "rid").select("rid", "text", "places").mapInArrow(starts, _STARTS)
    single = stage(single, "starts")
    again = single.groupBy("wh").agg(F.count("*").alias("n")).where("n > 1").select("wh")
    again = single.where("s % 2 = 1").join(again, "wh").select(
        "rid", pack_cut(F.shiftright("s", 1), F.lit(length))
    )
    covered = equal.union(again).groupBy(F.col("rid").alias(rid)).agg(F.collect_list("cut").alias(found))
    out = base.join(covered, rid, "left").drop(rid)

    columns = [c for c in out.columns if c != found]
    fields = [out.schema[c] for c in columns] + [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType()),
    ]
    names = [f.name for f in fields]
    passed = [out.columns.index(c) for c in columns]
    where, last = out.columns.index(text), out.columns.index(found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [
                remove((t or "").encode(), p)
                for t, p in zip(
                    batch.column(where).to_pylist(), batch.column(last).to_pylist(), strict=True
                )
            ]
            n_bytes, n_removed, n_spans, kept = zip(*cuts, strict=True) if cuts else ([],) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in passed]
                + [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
                + [pa.array(kept, pa.binary())],
                names=names,
            )

    return out.mapInArrow(cut, T.StructType(fields))


def pack_cut(start: Column, size: Column) -> Column:
    """First byte and number of bytes to remove in one number (a string has less than 2**31 bytes)."""
    return F.shiftleft(start, 31).bitwiseOR(size).alias("cut")


def remove(data: bytes, cuts: list[int] | None) -> tuple[int, int, int, bytes]:
    """Size, removed bytes, maximal removed runs, and what is left of one text."""
    if not cuts:
        return len(data), 0, 0, data
    p = np.array(cuts, dtype=np.int64)
    lo, n = p >> 31, p & 0x7FFFFFFF
    change = np.bincount(lo, minlength=len(data) + 1) - np.bincount(lo + n, minlength=len(data) + 1)
    gone = np.cumsum(change)[: len(data)] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return len(data), int(gone.sum()), runs, np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
