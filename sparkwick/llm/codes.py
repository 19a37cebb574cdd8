"""Product codes of integer vectors: exact k-means per part over Hilbert-sorted blocks.

Vectors are cut into parts. The vectors of a part are sorted along a Hilbert curve and stored in flat
blocks with their bounding box and componentwise sums. In a round, distances between a box and the
codebook's entries leave a shortlist per block: an entry that is farther from every point of the box
than some other entry is from all of them cannot be nearest. A block with one entry left adds its
sums as a whole; the others are evaluated by integer arithmetic against their shortlist only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwick.llm.common import fresh, stage, with_row_id
from sparkwick.operators.scan import attach

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integers beyond this (components beyond 16,384) are cut to it: squared distances of parts of up to
#: 500 components stay exact in 64 bits, and an outlier does not end the job.
LARGEST = 1 << 26
#: Errors are added exactly and shown as this where they do not fit a long.
MOST = (1 << 63) - 1
#: Bytes of a block; a batch that reaches Python holds at most ten thousand of them.
BLOCK_BYTES = 10_240
_BLOCKS = "part int, rids binary, flat binary, low binary, high binary, sums binary"


def _kept(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(v) > 0), F.lit(False))


def _integers(vector: Column) -> Column:
    bound = float(LARGEST)
    return F.transform(
        vector,
        lambda x: F.greatest(
            F.least(F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(bound)), F.lit(-bound))),
                    F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"),
    )


def _total(name: str) -> Column:
    exact = F.sum(F.col(name).cast("decimal(38,0)"))
    return F.least(exact, F.lit(MOST).cast("decimal(38,0)")).cast("long")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (numbers of ``bits`` bits) on the Hilbert curve.

    Skilling's transform ("Programming the Hilbert curve", 2004) on all rows at once; dimensions
    times bits must fit into 63 bits.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turn
    out = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _keyed(
    batches: Iterator[pa.RecordBatch], parts: int, middle: np.ndarray, spread: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """One row per vector and part: part, key on the curve, row id, components."""
    dims = len(middle)
    width = -(-dims // parts)
    coded = min(width, 62)
    bits = min(12, 62 // coded)
    for batch in batches:
        rid = batch.column(0)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        cells = np.clip((x - middle) / spread * (1 << (bits - 1)) + (1 << (bits - 1)), 0, (1 << bits) - 1)
        padded = np.zeros((len(x), width * parts), dtype="<i4")
        padded[:, :dims] = x
        grid = np.zeros((len(x), width * parts), dtype=np.int64)
        grid[:, :dims] = cells
        for p in range(parts):
            own = slice(p * width, (p + 1) * width)
            raw = np.ascontiguousarray(padded[:, own]).tobytes()
            size = 4 * width
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(x), p, dtype=np.int32)),
                    pa.array(hilbert_index(grid[:, own][:, :coded], bits)),
                    rid,
                    pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary()),
                ],
                names=["part", "key", "rid", "x"],
            )


def _blocked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Cut sorted rows into blocks of one part; what is left of a batch joins the next one."""
    rows = max(16, BLOCK_BYTES // (4 * width + 8))
    held: tuple[int, np.ndarray, np.ndarray] | None = None

    def block(part, rid, x):
        wide = x.astype("<i8")
        return (part, rid.tobytes(), x.tobytes(), x.min(0).tobytes(), x.max(0).tobytes(), wide.sum(0).tobytes())

    for batch in batches:
        out = []
        part = batch.column(0).to_numpy()
        rid = batch.column(1).to_numpy().astype("<i8")
        x = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<i4").reshape(-1, width)
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, len(part)], strict=True):
            if a == b:
                continue
            p, r, v = int(part[a]), rid[a:b], x[a:b]
            if held and held[0] == p:
                r, v = np.concatenate([held[1], r]), np.concatenate([held[2], v])
            elif held:
                out.append(block(*held))
            full = len(r) - len(r) % rows
            out += [block(p, r[i : i + rows], v[i : i + rows]) for i in range(0, full, rows)]
            held = (p, r[full:].copy(), v[full:].copy()) if full < len(r) else None
        yield _block_batch(out)
    if held:
        yield _block_batch([block(*held)])


def _block_batch(blocks: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*blocks, strict=True)) or [()] * 6
    kinds = [pa.int32()] + [pa.binary()] * 5
    names = ["part", "rids", "flat", "low", "high", "sums"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _numbers(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width).astype(np.int64)


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries (blocks x entries) can be nearest to a point of each box; ties stay."""
    below, above = low[:, None] - entries, entries - high[:, None]
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(2)
    return least <= most.min(1, keepdims=True)


def _nearest(x: np.ndarray, entries: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the ``allowed`` entries (ascending; ties: the first) and the squared distance."""
    far = np.stack([((x - entries[e]) ** 2).sum(1) for e in allowed])
    best = far.argmin(0)
    return allowed[best], far[best, np.arange(len(x))]


def _round(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums and counts of the vectors nearest to each entry, added up over the task's blocks."""
    parts, entries, width = books.shape
    sums = np.zeros((parts, entries, width), dtype=np.int64)
    counts = np.zeros((parts, entries), dtype=np.int64)
    for batch in batches:
        part = batch.column(0).to_numpy()
        low, high = (_numbers(batch.column(i), "<i4", width) for i in (3, 4))
        whole = _numbers(batch.column(5), "<i8", width)
        flat, sizes = batch.column(2), np.array([len(r) // 8 for r in batch.column(1).to_pylist()])
        short = shortlists(low, high, books[part]) if len(part) else np.zeros((0, entries), bool)
        alone = short.sum(1) == 1
        only = short.argmax(1)
        np.add.at(sums, (part[alone], only[alone]), whole[alone])
        np.add.at(counts, (part[alone], only[alone]), sizes[alone])
        for i in np.flatnonzero(~alone):
            x = np.frombuffer(flat[i].as_py(), dtype="<i4").reshape(-1, width).astype(np.int64)
            code, _ = _nearest(x, books[part[i]], np.flatnonzero(short[i]))
            counts[part[i]] += np.bincount(code, minlength=entries)
            for e in np.unique(code):
                sums[part[i], e] += x[code == e].sum(0)
    p, e = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(p.astype(np.int32)),
            pa.array(e.astype(np.int32)),
            pa.array(counts[p, e]),
            pa.array(list(sums[p, e]), pa.list_(pa.int64())),
        ],
        names=["part", "entry", "n", "sums"],
    )


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Entry and squared distance of every vector part."""
    width = books.shape[2]
    for batch in batches:
        part = batch.column(0).to_numpy()
        low, high = (_numbers(batch.column(i), "<i4", width) for i in (3, 4))
        short = shortlists(low, high, books[part]) if len(part) else []
        for i, p in enumerate(part):
            x = np.frombuffer(batch.column(2)[i].as_py(), dtype="<i4").reshape(-1, width).astype(np.int64)
            rid = np.frombuffer(batch.column(1)[i].as_py(), dtype="<i8")
            code, far = _nearest(x, books[p], np.flatnonzero(short[i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), pa.array(np.full(len(rid), p, np.int32)), pa.array(code.astype(np.int64)), pa.array(far)],
                names=["rid", "part", "code", "far"],
            )


def _blocks(rows: DataFrame, dims: int, parts: int) -> DataFrame:
    """Blocks of the vectors in ``rows`` (rid, ints), stored once."""
    width = -(-dims // parts)
    # centre and spread of each component only place cells on the curve; any values give right codes
    moments = (
        rows.select(F.posexplode("ints").alias("at", "x"))
        .groupBy("at")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    )
    middle, spread = np.zeros(dims), np.ones(dims)
    for r in moments.collect():  # one row per component
        middle[r["at"]], spread[r["at"]] = r["mean"], max(2.5 * r["sd"], 1.0)
    keyed = rows.mapInArrow(
        partial(_keyed, parts=parts, middle=middle, spread=spread),
        "part int, key long, rid long, x binary",
    )
    # the row id ends the sort key, so copies of one vector can be split too
    ordered = keyed.repartitionByRange("part", "key", "rid").sortWithinPartitions("part", "key", "rid")
    return stage(
        ordered.select("part", "rid", "x").mapInArrow(partial(_blocked, width=width), _BLOCKS), "blocks"
    )


def learn(
    rows: DataFrame, blocks: DataFrame, dims: int, order: str,
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> np.ndarray:
    """Codebooks (parts x entries x width) after ``rounds``; they alone pass through the driver."""
    width = -(-dims // parts)
    first = rows.orderBy(F.col(order).asc_nulls_last(), "ints", "rid").limit(entries).collect()
    books = np.zeros((parts, len(first), width), dtype=np.int64)
    for e, r in enumerate(first):
        whole = np.zeros(parts * width, dtype=np.int64)
        whole[:dims] = r["ints"]
        books[:, e] = whole.reshape(parts, width)
    for _ in range(rounds):
        sums = blocks.mapInArrow(
            partial(_round, books=books), "part int, entry int, n long, sums array<long>"
        )
        # long sums of integers up to 2**26 are exact up to 2**37 vectors
        total = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "s"))
        total = total.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        after = books.copy()
        for r in total.collect():  # at most parts x entries x width rows
            after[r["part"], r["entry"], r["at"]] = r["s"] // r["n"]
        books = after
    return books


def compress(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """``df`` with ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` per vector.

    Components become floor(4096 * x). The codebook of each part starts as that part of the vectors
    with the smallest ids (fewer than ``entries`` vectors: as many; equal ids: the smaller vector
    first; null ids last); ``rounds`` times every part goes to its nearest entry (ties: the lower
    index) and entries become the floors of their means; entries without parts stay. ``code`` has
    two hex digits per part. ``label_error`` adds errors over equal labels, null ones together.

    Rows whose vector is null, empty or holds null or non-finite components are dropped, as are
    vectors of another length than most (ties: the longer). Lengths that the parts do not divide
    are padded by zeros. Repeated rows get a row each. Input columns of the new names are replaced;
    an empty table, or one without usable vectors, gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must fit two hex digits")
    new = ("code", "error", "label_error", "codebooks_sha256")
    base = df.drop(*new)
    rid, ints, at, none, far, *words = fresh(
        base, "rid", "ints", "label_key", "label_null", "far", *(f"word{i}" for i in range(-(-parts // 8)))
    )
    kept = base.where(_kept(vector))
    sizes = kept.groupBy(F.size(vector).alias("d")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    dims = top["d"] if top else 1
    numbered = with_row_id(kept.where(F.size(vector) == dims), rid)
    rows = numbered.select(
        F.col(rid).alias("rid"), F.col(vec_id).alias("vec_id"), _integers(F.col(vector)).alias("ints")
    )
    blocks = _blocks(rows.select("rid", "ints"), dims, parts)
    books = learn(rows, blocks, dims, "vec_id", parts, entries, rounds)

    coded = blocks.mapInArrow(partial(_assigned, books=books), "rid long, part int, code long, far long")
    per_word = [min(8, parts - 8 * i) for i in range(len(words))]
    packed = [
        F.coalesce(
            F.bit_or(F.when(F.floor(F.col("part") / 8) == i, F.expr(f"shiftleft(code, 8 * ({n - 1} - part % 8))"))),
            F.lit(0).cast("long"),
        )
        for i, n in enumerate(per_word)
    ]
    codes = coded.groupBy(F.col("rid").alias(rid)).agg(
        _total("far").alias(far), *(c.alias(w) for c, w in zip(packed, words, strict=True))
    )
    code = F.concat(
        *(F.lower(F.lpad(F.hex(w), 2 * n, "0")) for w, n in zip(words, per_word, strict=True))
    )
    found = stage(numbered.join(codes, rid).withColumns({
        "code": code, "error": F.col(far),
        at: F.coalesce(F.col(label).cast("string"), F.lit("")), none: F.col(label).isNull(),
    }).drop(far, *words), "codes")
    per_label = found.groupBy(at, none).agg(_total("error").alias("label_error"))
    listed = ",".join(map(str, books.ravel().tolist()))
    digest = hashlib.sha256(listed.encode()).hexdigest()
    out = attach(found, per_label, [at, none], salt=rid)
    return out.select(*base.columns, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
