"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Pieces are dealt over partitions by a hash of their row, every partition is packed best-fit
decreasing, and dual feasible functions give a number of sequences that no packing of the same
pieces can undercut. Partitions that reach their bound are done. The others keep their full
sequences and exchange the documents of the rest: the open sequences of several partitions are
packed anew together, and the result is taken where it needs fewer sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwick.llm.common import stage
from sparkwick.llm.tokens import load

#: Tokens of a sequence.
LENGTH = 2048
#: Pieces that a partition is sized for.
PART = 20_000
#: Partitions that exchange documents with each other in a round, and rounds at most.
JOINED, ROUNDS = 4, 3

_PIECES = "rid long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = "rid long, piece int, length int, part long, bin long, offset long, level int"


def cut_pieces(df: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Token pieces of documents (doc_id, text): rid, doc_id, piece, start, length, ids_crc32.

    The ids of a text are followed by id 0. Only longer ones are cut: all pieces have ``length``
    tokens but the first, which takes what is left over. A null text counts as empty: one piece
    that holds the closing id. Repeated rows give pieces of their own.
    """
    # one scan gives the ids, and the pieces are stored with them
    rows = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "rid", F.monotonically_increasing_id()
    )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(tokenizer)
        for batch in batches:
            rid, doc, text = (batch.column(n).to_pylist() for n in ("rid", "doc_id", "text"))
            out: list[tuple] = []
            for r, d, t in zip(rid, doc, text, strict=True):
                ids = np.append(codec.encode(t), np.uint32(0)).astype("<u4")
                n = len(ids)
                first = (n - 1) % length + 1
                edges = [0, *range(first, n + 1, length)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    out.append((r, d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=[f.split()[0] for f in _PIECES.split(", ")],
            )

    return rows.select("rid", "doc_id", "text").mapInArrow(pieces, _PIECES)


def lower_bound(sizes: np.ndarray, length: int = LENGTH) -> int:
    """Sequences that any packing of ``sizes`` needs, by dual feasible functions.

    A function f is dual feasible if f summed over any set that fits one sequence is at most 1;
    so its sum over all sizes bounds the number of sequences from below. Two families are tried:
    the threshold functions (sizes above length - a count one, sizes below a nothing) for every a
    up to half, and the rounding functions floor((k + 1) x) / k for small k.
    """
    if not len(sizes):
        return 0
    x = np.sort(np.asarray(sizes, dtype=np.int64))
    total = np.concatenate([[0], np.cumsum(x)])
    a = np.arange(0, length // 2 + 1)
    from_a = np.searchsorted(x, a, side="left")
    to_half = np.searchsorted(x, length // 2, side="right")
    to_big = np.searchsorted(x, length - a, side="right")
    big = len(x) - to_big
    middle, middle_sum = to_big - to_half, total[to_big] - total[to_half]
    small_sum = total[to_half] - total[np.minimum(from_a, to_half)]
    room = middle * length - middle_sum
    best = int((big + middle + np.maximum(0, -(-(small_sum - room) // length))).max())
    for k in range(1, 21):
        scaled = (k + 1) * x
        exact = scaled % length == 0
        # in units of 1 / (k * length): sizes at a multiple of length / (k + 1) keep their share
        units = np.where(exact, x * k, (scaled // length) * length).sum()
        best = max(best, int(-(-units // (k * length))))
    return best


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: per item its bin and offset; per bin its fill.

    Ties go to the bin opened last; equal sizes are taken in the order given.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r is set while a bin with r tokens of room exists
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), length
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, dtype=np.int64)


def _placed(x: dict, part: int, bins, offsets, level: int) -> pa.Table:
    n = len(bins)
    columns = [x["rid"], x["piece"], x["length"], np.full(n, part), bins, offsets,
               np.full(n, level)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    return pa.Table.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=[f.split()[0] for f in _PLACED.split(", ")],
    )


def _exchange(step: int, length: int):
    """Pack the open sequences of a few partitions anew; keep them where that gains nothing."""

    def again(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rid", "ascending"), ("piece", "ascending")])
        x = {c: table.column(c).to_numpy() for c in table.column_names}
        bins, offsets, fills = best_fit(x["length"].astype(np.int64), length)
        before, was = np.unique(np.stack([x["part"], x["bin"]]), axis=1, return_inverse=True)
        if len(fills) >= before.shape[1]:
            bins, offsets = was.reshape(-1), x["offset"]
            fills = np.bincount(bins, x["length"]).astype(np.int64)
        done = len(fills) == lower_bound(x["length"], length)
        level = np.where(done | (fills[bins] == length) | (step == ROUNDS), 0, step + 1)
        out = _placed(x, int(x["grp"][0]) + (step << 38), bins, offsets, 0)
        return out.set_column(6, "level", pa.array(level, pa.int32()))

    return again


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Columns of ``pieces`` plus ``sequence_id`` and ``offset`` (gapless from 0).

    ``pieces`` is a stored table with one row per (rid, piece). Ties between equal pieces are
    broken by (rid, piece), so the result depends on the rows only. An empty table gives none.
    """
    full = F.col("length") >= length
    small = pieces.where(~full).select("rid", "piece", F.col("length").cast("int").alias("length"))
    parts = max(1, -(-small.count() // PART))
    small = small.withColumn("part", F.pmod(F.xxhash64("rid", "piece"), F.lit(parts)))

    def first(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rid", "ascending"), ("piece", "ascending")])
        x = {c: table.column(c).to_numpy() for c in table.column_names}
        bins, offsets, fills = best_fit(x["length"].astype(np.int64), length)
        # sequences of a certified partition, and full ones of any other, are final
        done = len(fills) == lower_bound(x["length"], length)
        level = np.where(done | (fills[bins] == length), 0, 1)
        out = _placed(x, int(x["part"][0]), bins, offsets, 0)
        return out.set_column(6, "level", pa.array(level, pa.int32()))

    placed = stage(small.groupBy("part").applyInArrow(first, _PLACED), "packed")
    final = [placed.where("level = 0")]
    for step in range(1, ROUNDS + 1):
        open_ = placed.where(F.col("level") == step)
        if parts <= 1 or open_.isEmpty():
            final.append(open_)
            break
        parts = -(-parts // JOINED)
        # the open sequences of a few partitions meet; each partition's part is numbered anew
        group = F.floor(F.pmod(F.col("part"), F.lit(1 << 38)) / JOINED).cast("long")
        grouped = open_.withColumn("grp", group)
        placed = stage(grouped.groupBy("grp").applyInArrow(_exchange(step, length), _PLACED), "packed")
        final.append(placed.where("level = 0"))
    placed = final[0]
    for more in final[1:]:
        placed = placed.union(more)
    # the lower 21 bits number the bins of a group: at most PART * JOINED ** ROUNDS pieces
    ids = F.shiftleft("part", 21) + F.col("bin")
    placed = placed.select("rid", "piece", ids.alias("sequence_id"), "offset")
    alone = pieces.where(full).select(
        *pieces.columns,
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return pieces.where(~full).join(placed, ["rid", "piece"]).select(alone.columns).union(alone)
