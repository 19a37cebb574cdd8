"""Near-duplicate embeddings by E8 lattice hashing.

Unit vectors are projected to a few groups of eight random directions; every group is decoded to the
nearest point of the E8 lattice, and the points of all groups together name a cell. Each of several
tables has its own projection. A vector enters its own cell and the neighbouring ones that it is
closest to. Vectors with the same label that meet in a cell are compared exactly, in blocks; a
pair counts only in the first cell in which it meets, so links are counted without listing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwick.llm.common import components, stage
from sparkwick.llm.vectors import dimension, lists, matrix, usable

#: Cosine of a link.
COSINE = 0.98
#: Tables, groups of eight directions in each, and neighbouring cells that are probed.
TABLES, GROUPS, PROBES = 6, 2, 3
#: Lattice units per unit of length: the larger, the smaller the cells.
SCALE = 2.75
#: Vectors of a cell that are compared at once.
BLOCK = 512


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 for each row of eight numbers, doubled so that it is whole.

    E8 is the union of D8 (whole coordinates, even sum) and D8 shifted by one half.
    """

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
        off = y[odd] - near[odd]
        k = np.argmax(np.abs(off), axis=1)  # the cheapest coordinate to round the other way
        near[odd, k] += np.where(off[np.arange(len(odd)), k] >= 0, 1, -1)
        return near

    a, b = d8(x), d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return (2 * np.where(closer[:, None], a, b)).astype(np.int64)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: steps to neighbouring cells."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-2, 2):
                for b in (-2, 2):
                    v = np.zeros(8, dtype=np.int64)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = np.array([1 if bits >> k & 1 else -1 for k in range(8)], dtype=np.int64)
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


def _hash(points: np.ndarray) -> np.ndarray:
    """64-bit names of lattice points (rows of small integers)."""
    h = np.full(len(points), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for column in points.T.astype(np.uint64):
        h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(x: np.ndarray, seed: int = 3) -> np.ndarray:
    """Names of the cells that unit vectors enter: rows x TABLES x (1 + PROBES)."""
    rng = np.random.default_rng(seed)
    roots = _roots()
    dims = x.shape[1]
    out = np.empty((len(x), TABLES, 1 + PROBES), dtype=np.int64)
    for t in range(TABLES):
        directions = rng.standard_normal((dims, 8 * GROUPS))
        # as long as whole coordinates on average, whatever the dimension
        y = x @ directions * SCALE / np.sqrt(8)
        points, steps, costs = [], [], []
        for g in range(GROUPS):
            part = y[:, 8 * g : 8 * g + 8]
            point = decode_e8(part)
            rest = part - point / 2
            # moving to the neighbour at root r / 2 makes the distance longer by this
            cost = 2.0 - rest @ roots.T
            best = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
            points.append(point)
            steps.append(roots[best])
            costs.append(np.take_along_axis(cost, best, axis=1))
        whole = np.concatenate(points, axis=1)
        out[:, t, 0] = _hash(whole)
        order = np.argsort(np.concatenate(costs, axis=1), axis=1, kind="stable")[:, :PROBES]
        for p in range(PROBES):
            group, which = order[:, p] // PROBES, order[:, p] % PROBES
            moved = whole.copy()
            for g in range(GROUPS):
                own = np.flatnonzero(group == g)
                moved[own, 8 * g : 8 * g + 8] += steps[g][own, which[own]]
            out[:, t, 1 + p] = _hash(moved)
    return out


_CODED = "uid long, label string, copies long, v array<double>, names array<long>"


def _meet_before(names: np.ndarray, i: np.ndarray, j: np.ndarray, tbl: int, cell: int) -> np.ndarray:
    """Whether pairs share a cell of an earlier table, or a lower one of this table."""
    width = 1 + PROBES
    out = np.zeros(len(i), dtype=bool)
    for t in range(tbl + 1):
        a, b = names[i, t * width : (t + 1) * width], names[j, t * width : (t + 1) * width]
        same = a[:, :, None] == b[:, None, :]
        if t == tbl:
            same &= (a < cell)[:, :, None]
        out |= same.any(axis=(1, 2))
    return out


def _compare(table: pa.Table) -> pa.Table:
    """Links of a block pair: (uid, n, other): n more links, and an edge to ``other`` (or null)."""
    table = table.combine_chunks()
    x = {k: table.column(k).to_numpy() for k in ("uid", "copies", "s", "i", "j", "tbl", "cell")}
    dims = len(table.column("v")[0])
    v = matrix(table.column("v").combine_chunks(), dims)
    names = table.column("names").combine_chunks().flatten().to_numpy()
    names = names.reshape(-1, TABLES * (1 + PROBES))
    one, two = int(x["i"][0]), int(x["j"][0])
    left, right = np.flatnonzero(x["s"] == one), np.flatnonzero(x["s"] == two)
    close = v[left] @ v[right].T >= COSINE
    if one == two:
        close = np.triu(close, 1)
    a, b = np.nonzero(close)
    a, b = left[a], right[b]
    new = ~_meet_before(names, a, b, int(x["tbl"][0]), int(x["cell"][0]))
    a, b = a[new], b[new]
    n = np.bincount(a, x["copies"][b], len(v)) + np.bincount(b, x["copies"][a], len(v))
    # a spanning forest of the block stands for its links
    root = np.arange(len(v))
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root != root[root]).any():
            root = root[root]
    some = np.flatnonzero(n > 0)
    other = [int(x["uid"][root[k]]) if root[k] != k else None for k in some.tolist()]
    return pa.Table.from_arrays(
        [pa.array(x["uid"][some]), pa.array(n[some].astype(np.int64)), pa.array(other, pa.int64())],
        names=["uid", "n", "other"],
    )


def near_duplicates(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``df`` plus ``n_links``, ``component_id`` and ``kept`` per row.

    Rows link when their labels are equal and not null and their cosine in double precision is
    at least ``COSINE``; pairs are those that the hash tables find, equal vectors always. Vectors
    that are null, zero, of another length than most, or hold a null or infinite component link
    with nothing. ``component_id`` is the smallest id reachable, ``kept`` says that it is the
    row's own. Rows with a null id link with nothing and have a null component. Rows that repeat an id with
    the same vector and label count as one and get equal results. Results replace columns of the
    same name.
    """
    new = ["n_links", "component_id", "kept"]
    base = df.drop(*new)
    dims = dimension(df, vector)
    fine = usable(vector) & (F.size(vector) == dims)
    fine &= F.col(vec_id).isNotNull() & F.col(label).isNotNull()
    v = F.col(vector).cast("array<double>")
    rows = base.where(fine).select(
        F.col(vec_id).alias("id"), F.col(label).cast("string").alias("label"), v.alias("v")
    )
    # equal vectors of a label are one entry
    rows = rows.withColumn("h", F.xxhash64("v")).dropDuplicates(["id", "label", "h", "v"])
    entries = rows.groupBy("label", "h", "v").agg(
        F.min("id").alias("uid"), F.count("*").alias("copies")
    )
    entries = stage(entries, "entries")
    members = rows.join(entries.select("label", "h", "v", "uid", "copies"), ["label", "h", "v"])
    members = stage(members.select("id", "label", "uid", "copies"), "members")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = matrix(part.column(3), dims)
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
                names = np.sort(cells(x), axis=2).reshape(len(x), -1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], lists(x), lists(names)],
                    names=[f.split()[0] for f in _CODED.split(", ")],
                )

    coded = entries.select("uid", "label", "copies", "v").mapInArrow(code, _CODED)
    coded = stage(coded, "coded")
    # only names travel until it is known which cells hold more than one vector
    light = coded.select("uid", "label", F.posexplode("names").alias("p", "cell"))
    light = light.select("uid", "label", "cell", F.expr(f"p div {1 + PROBES}").alias("tbl"))
    light = light.distinct()
    met = light.groupBy("label", "tbl", "cell").agg(F.count("*").alias("size"))
    met = met.where("size > 1").select(
        "label", "tbl", "cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")
    )
    entered = light.join(met, ["label", "tbl", "cell"])
    entered = entered.withColumn("s", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    entered = entered.withColumn("t", F.explode(F.expr("sequence(0, blocks - 1)")))
    entered = entered.withColumns({"i": F.least("s", "t"), "j": F.greatest("s", "t")})
    entered = entered.join(coded.select("uid", F.col("label"), "copies", "v", "names"), ["uid", "label"])
    # an own block meets itself once
    found = entered.groupBy("label", "tbl", "cell", "i", "j").applyInArrow(
        _compare, "uid long, n long, other long"
    )
    found = stage(found, "found")
    counts = found.groupBy("uid").agg(F.sum("n").alias("n"))
    edges = found.where("other is not null").select(F.col("other").alias("a"), F.col("uid").alias("b"))
    named = components(edges).select(F.col("node").alias("uid"), "component")
    result = members.join(counts, "uid", "left").join(named, "uid", "left")
    result = result.select(
        F.col("id").alias("_id"),
        F.col("label").alias("_label"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "uid").alias("component_id"),
    )
    result = stage(result, "result")
    keyed = base.withColumns(
        {"_id": F.when(fine, F.col(vec_id)), "_label": F.when(fine, F.col(label).cast("string"))}
    )
    out = keyed.join(result, ["_id", "_label"], "left")
    own = F.coalesce("component_id", F.col(vec_id))
    return out.select(
        *base.columns,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(own == F.col(vec_id), F.lit(False)).alias("kept"),
    )
