"""Jaccard similarity join on word shingles by T-occurrence search.

Two documents with sets a and b link when 100 |a & b| >= 75 |a | b|, that is when they share at
least ``required(|a|, |b|)`` shingles. The search runs in four steps.

1. Every text becomes its set of 64-bit shingle hashes; documents with equal sets form a class,
   and only classes are searched.
2. An inverted index over prefixes: in one global order (frequent shingles last) two linked
   classes must share a shingle among their first |a| - required + 1. Lists of up to ``LONG``
   classes give their pairs, and how many lists a pair shares bounds its overlap. A longer list
   first gives its members paired with one of them; members that this links need not meet again.
3. T-occurrence search: the candidates of a class are indexed by shingle; its short inverted lists
   are merged and counted, candidates short of the required overlap by more than the number of
   long lists are dropped, the rest are probed in the long lists by binary search (DivideSkip).
4. Long lists whose members are still in several components meet a few members of others; what is
   then still apart is compared across components, block by block: pairs whose parity maps do not
   differ in more bits than linked sets can differ in shingles are searched as in step 3.
   Components of all links are the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwick.llm.common import components, fresh, stage, with_row_id
from sparkwick.llm.hashing import RangeHash, mix

#: Words of a shingle.
WORDS = 5
#: Similarity as a fraction: links need NUMERATOR / DENOMINATOR or more.
NUMERATOR, DENOMINATOR = 3, 4
#: Members of the longest list that is expanded at once, and of a block of a longer one.
LONG = 64
BLOCK = 2048
#: Bits of a set's parity map.
PARITY = 1024
#: Shingles counted more often than this are put last in the order, the most frequent of them if
#: there are more than so many; this affects speed only, never the result.
OFTEN, FREQUENT = 8, 1_000_000
#: Orders in which members of a long list are ranked: their first members are compared with all.
ORDERS = 4
#: Rounds in which members of long lists meet some of other components, and how many.
ROUNDS, DRAWN = 3, 8
#: Candidates of a class that are searched together.
TOGETHER = 256
#: Characters of text, and shingles, that are worked on at once; rows turned into strings at once.
CHUNK, COUNTED = 250_000, 6_000_000
TURNED = 256

_STEPS = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(WORDS)]
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def required(a, b):
    """Shared shingles that sets of sizes a and b need to link."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted different shingle hashes (as signed integers) of each text.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. Fewer words than
    ``WORDS`` make one shingle, none make an empty set.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]), dtype=np.uint8)
    hashed = RangeHash(_LOWER[data] + np.uint64(1))
    white = _WHITE[data]
    starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    words = hashed(starts, ends)
    borders = np.searchsorted(starts, np.cumsum([1, *(len(r) + 1 for r in raw)]))
    n = len(words)
    sums = np.zeros(max(0, n - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS):
        sums += mix(words[k : k + len(sums)] * _STEPS[k])
    sums = mix(sums).view(np.int64)
    out = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
        if b - a >= WORDS:
            own = np.sort(sums[a : b - WORDS + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            few = sum((mix(words[a + k : a + k + 1] * _STEPS[k]) for k in range(b - a)),
                      np.array([b - a], dtype=np.uint64))
            out.append(mix(few).view(np.int64))
        else:
            out.append(np.zeros(0, dtype=np.int64))
    return out


def parity_map(x: np.ndarray) -> bytes:
    """Bits that tell whether an odd number of the set's shingles hash to them."""
    at = np.bincount((x.view(np.uint64) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY)
    return np.packbits(at & 1).tobytes()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(row ids, texts) of a bounded number of characters."""
    parts = (b.slice(at, TURNED) for b in batches for at in range(0, b.num_rows, TURNED))
    for batch in parts:
        rids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            if size + len(t) > CHUNK and i > start:
                yield rids[start:i], texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield rids[start:], texts[start:]


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)],
        names=[n for n, _ in fields],
    )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several documents near each other in the table share, with how many do."""

    # one array, sorted where it stands; its pages take memory as they are written
    held, size = np.empty(COUNTED, dtype=np.int64), 0

    def counted(x: np.ndarray) -> pa.RecordBatch:
        x.sort()
        same = np.concatenate([[False], x[1:] == x[:-1], [False]])
        first = np.flatnonzero(same[1:] & ~same[:-1])
        last = np.flatnonzero(same[:-1] & ~same[1:])
        return _batch("h long, n long", [x[first], last - first + 1])

    for _, texts in _chunks(batches):
        for s in shingle_sets(texts):
            if size + len(s) > COUNTED:
                yield counted(held[:size])
                size = 0
            if len(s) > len(held):  # it stands alone: what was held before has been passed on
                held = np.empty(len(s), dtype=np.int64)
            held[size : size + len(s)] = s
            size += len(s)
    if size:
        yield counted(held[:size])


def _class(x: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_DOCS = "rid long, n long, cid long, other long"
_POSTINGS = "h long, cid long, place long"
_SETS = "cid long, items binary, map binary"
_FOUND = "kind int, a long, b long, na int, nb int, c int"


def _postings(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in _chunks(batches):
            out = []
            for x in shingle_sets(texts):
                if not len(x):
                    continue
                cid = _class(x)[0]
                if cid in seen:  # a copy: its class has its entries from this task
                    continue
                seen.add(cid)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
                    last = frequent[at] == x
                    x = np.concatenate([x[~last], x[last]])
                # a partner has at least 3/4 of the elements, so 3/4 of them must be shared
                m = len(x) - int(-(-NUMERATOR * len(x) // DENOMINATOR)) + 1
                out.append((x[:m], cid, len(x)))
            if out:
                sizes = [len(x) for x, _, _ in out]
                yield _batch(_POSTINGS, [
                    np.concatenate([x for x, _, _ in out]),
                    np.repeat(np.array([c for _, c, _ in out], dtype=np.int64), sizes),
                    # size of the set and place in it, in one number
                    np.concatenate([(n << 32) + np.arange(s) for s, (_, _, n) in
                                    zip(sizes, out, strict=True)]),
                ])

    return run


def _possible(n1, p1, n2, p2):
    """Whether sets can link whose first shared shingle has these places in them."""
    need = required(n1, n2)
    return np.minimum(n1 - p1, n2 - p2) >= need


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What inverted lists give; rows come sorted by shingle.

    Kind 0: pairs (a, b) of short lists, with set sizes and the number of shared entries. Kind 2:
    pairs of a long list's members with its first one. Kind 1: members of long lists (a = shingle,
    b = class, na = set size, nb = place). A list may span batches; of a long one only the
    members of the current batch and its first are held.
    """
    held = [np.zeros(0, dtype=np.int64) for _ in range(3)]
    spilled = False  # whether the list that the held rows begin has been found long

    for batch in batches:
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        x = [np.concatenate([a, b]) for a, b in zip(held, new, strict=True)]
        if not len(x[0]):
            continue
        # copies of a class that different tasks have sent stand side by side
        again = np.concatenate([[False], (x[0][1:] == x[0][:-1]) & (x[1][1:] == x[1][:-1])])
        x = [c[~again] for c in x]
        cut = int(np.searchsorted(x[0], x[0][-1]))
        if cut:
            done = [c[:cut] for c in x]
            if spilled:  # the first list's head has been passed on before
                end = int(np.searchsorted(done[0], done[0][0], side="right"))
                yield from _long_list([c[:end] for c in done], 1)
                done = [c[end:] for c in done]
            spilled = False
            if len(done[0]):
                yield from _lists(done)
        x = [c[cut:] for c in x]
        if len(x[0]) > LONG:
            yield from _long_list(x, int(spilled))
            spilled = True
            x = [c[:1] for c in x]
        held = x
    if len(held[0]):
        yield from _long_list(held, 1) if spilled else _lists(held)


def _lists(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    h, cid, place = x
    n = place >> 32
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(at, len(h)))
    left, right = [], []
    for s in np.unique(size[(size > 1) & (size <= LONG)]).tolist():
        i, j = np.triu_indices(s, 1)
        first = at[size == s]
        left.append((first[:, None] + i).ravel())
        right.append((first[:, None] + j).ravel())
    if left:
        i, j = np.concatenate(left), np.concatenate(right)
        i, j = np.where(cid[i] < cid[j], i, j), np.where(cid[i] < cid[j], j, i)
        fits = required(n[i], n[j]) <= np.minimum(n[i], n[j])
        i, j = i[fits], j[fits]
        order = np.lexsort((cid[j], cid[i]))
        i, j = i[order], j[order]
        a, b = cid[i], cid[j]
        first = np.flatnonzero(
            np.concatenate([[len(a) > 0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        )
        yield _batch(_FOUND, [
            np.zeros(len(first), dtype=np.int32), a[first], b[first], n[i[first]], n[j[first]],
            np.diff(np.append(first, len(a))),
        ])
    for first, s in zip(at[size > LONG].tolist(), size[size > LONG].tolist(), strict=True):
        yield from _long_list([c[first : first + s] for c in x], 0)


def _long_list(x: list[np.ndarray], known: int) -> Iterator[pa.RecordBatch]:
    """Entries of one long list, its first member in row 0; ``known`` rows were passed on before."""
    h, cid, place = x
    n, pos = place >> 32, place & 0xFFFFFFFF
    ok = _possible(n[:1], pos[:1], n, pos) & (cid != cid[0])
    a, b = np.full(int(ok.sum()), cid[0]), cid[ok]
    zero = np.zeros(len(a), dtype=np.int32)
    yield _batch(_FOUND, [zero + 2, np.minimum(a, b), np.maximum(a, b), zero, zero, zero])
    h, cid, n, pos = h[known:], cid[known:], n[known:], pos[known:]
    one = np.ones(len(h), dtype=np.int32)
    yield _batch(_FOUND, [one, h, cid, n, pos, one])


def _enough(found: DataFrame, members: DataFrame) -> DataFrame:
    """Candidate pairs that can still reach the required overlap.

    Shared shingles up to the smaller end of two prefixes are entries of both, so they were
    counted, but for those in long lists; beyond it lies at most the larger rest.
    """
    short = found.where("kind = 0").groupBy("a", "b").agg(
        F.sum("c").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb")
    )
    often = members.select("b", F.size("lists").alias("l"))
    short = short.join(often.select(F.col("b").alias("a"), F.col("l").alias("la")), "a", "left")
    short = short.join(often.select("b", F.col("l").alias("lb")), "b", "left")
    rest = lambda n: F.ceil(F.col(n) * NUMERATOR / DENOMINATOR) - 1
    uncounted = F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    need = F.ceil((F.col("na") + F.col("nb")) * NUMERATOR / (NUMERATOR + DENOMINATOR))
    short = short.where(F.col("c") + uncounted + F.greatest(rest("na"), rest("nb")) >= need)
    return short.select("a", "b").union(found.where("kind = 2").select("a", "b")).distinct()


def divide_skip(query: np.ndarray, candidates: list[np.ndarray]) -> np.ndarray:
    """Which candidates share the required number of shingles with the query (all sorted sets).

    The L longest inverted lists are set aside; the others are merged and counted. A candidate
    that misses its required overlap by more than L there cannot reach it; the rest are probed for
    the shingles of the long lists.
    """
    sizes = np.array([len(c) for c in candidates])
    need = required(len(query), sizes)
    values = np.concatenate(candidates)
    order = np.argsort(values, kind="stable")
    owner = np.repeat(np.arange(len(candidates)), sizes)[order]
    values = values[order]
    start = np.searchsorted(values, query, side="left")
    length = np.searchsorted(values, query, side="right") - start
    longest = int(length.max(initial=0))
    # the longer the lists, the more of them are worth setting aside, but fewer than required
    aside = int(min(need.min() / (0.01 * np.log2(max(2, longest)) + 1), need.min() - 1))
    aside = max(0, aside) if len(candidates) > 2 else 0
    by_length = np.argsort(-length, kind="stable")
    long_ones, short = by_length[:aside], by_length[aside:]
    n = length[short]
    flat = np.repeat(start[short] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    counts = np.bincount(owner[flat], minlength=len(candidates))
    if aside:
        probes = np.sort(query[long_ones])
        for c in np.flatnonzero((counts >= need - aside) & (counts < need)).tolist():
            own = candidates[c]
            at = np.minimum(np.searchsorted(own, probes), len(own) - 1)
            counts[c] += int((own[at] == probes).sum())
    return counts >= need


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows (a, salt, b, items) sorted by (a, salt, role): the class's own set
    (role 0), then its candidates' sets."""
    key, query, ids, sets = None, None, [], []

    def links() -> Iterator[pa.RecordBatch]:
        if ids:
            ok = divide_skip(query, sets)
            b = np.array(ids, dtype=np.int64)[ok]
            yield _batch("a long, b long", [np.full(len(b), key[0]), b])

    for batch in batches:
        a, salt, role, b, items = (c.to_pylist() for c in batch.columns)
        for k in range(len(a)):
            own = np.frombuffer(items[k], dtype=np.int64)
            if role[k] == 0:
                yield from links()
                key, query, ids, sets = (a[k], salt[k]), own, [], []
            else:
                ids.append(b[k])
                sets.append(own)
    yield from links()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cids, texts in _chunks(batches):
        found = shingle_sets(texts)
        yield _batch(_SETS, [cids, [x.tobytes() for x in found], [parity_map(x) for x in found]])


def _both(pairs: DataFrame, of) -> DataFrame:
    """``of`` applied to either end of the pairs, one after the other."""
    return of(pairs, "a").union(of(pairs, "b"))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b: classes) that link, found by search in the sets of their classes."""
    # a class with many partners is the query; its candidates are dealt over several groups
    degree = _both(pairs, lambda p, end: p.groupBy(F.col(end).alias("cid")).count())
    degree = degree.groupBy("cid").agg(F.sum("count").alias("count"))
    left = degree.select(F.col("cid").alias("a"), F.col("count").alias("da"))
    right = degree.select(F.col("cid").alias("b"), F.col("count").alias("db"))
    turned = pairs.join(left, "a").join(right, "b")
    swap = F.col("db") > F.col("da")
    turned = turned.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
        F.greatest("da", "db").alias("d"),
    )
    groups = F.ceil(F.col("d") / TOGETHER)
    turned = turned.withColumn("salt", F.pmod(F.xxhash64("b"), groups))
    own = turned.select("a", "salt").distinct().join(
        sets.select(F.col("cid").alias("a"), "items"), "a"
    )
    own = own.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "items")
    other = turned.join(sets.select(F.col("cid").alias("b"), "items"), "b")
    other = other.select("a", "salt", F.lit(1).alias("role"), "b", "items")
    found = own.union(other).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return stage(found.mapInArrow(_search, "a long, b long"), "links")


def _labelled(members: DataFrame, label: DataFrame) -> DataFrame:
    """Entries of long lists with the component ``c`` of their class, looked up once per class."""
    label = label.select(F.col("node").alias("b"), F.col("component").alias("c"))
    of_class = members.join(label, "b", "left").withColumn("c", F.coalesce("c", "b"))
    return of_class.select(*(c for c in of_class.columns if c != "lists"), F.inline("lists"))


def _mixed(members: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of long lists with their component, and the lists that still hold several."""
    members = _labelled(members, label)
    lists = members.groupBy("a").agg(
        F.count("*").alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi")
    )
    return members, lists.where("lo <> hi").select("a", "size")


def _with_some(members: DataFrame, label: DataFrame, step: int) -> DataFrame:
    """Pairs of a long list's members with a few of other components, drawn by hash.

    The draw is the same in all lists, so that a group that shares many lists gives few pairs.
    """
    members = _labelled(members, label)
    own = F.struct("b", "n", "pos", "c")
    drawn = [F.max_by(own, F.xxhash64("b", F.lit(step * DRAWN + j))) for j in range(DRAWN)]
    lists = members.groupBy("a").agg(
        F.array_distinct(F.array(*drawn)).alias("some"), F.min("c").alias("lo"), F.max("c").alias("hi")
    )
    some = lists.where("lo <> hi").select("a", F.explode("some").alias("o"))
    met = members.join(some, "a").where("c <> o.c")
    need = F.ceil((F.col("n") + F.col("o.n")) * NUMERATOR / (NUMERATOR + DENOMINATOR))
    reach = F.least(F.col("n") - F.col("pos"), F.col("o.n") - F.col("o.pos"))
    met = met.where(reach >= need)
    return met.select(
        F.least("b", "o.b").alias("a"), F.greatest("b", "o.b").alias("b")
    ).distinct()


def _across(members: DataFrame, label: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of members of long lists that are in different components, block by block.

    Every bit in which two parity maps differ stands for a shingle that only one of the sets has,
    so a pair with more of them than linked sets of these sizes can have is no link.
    """
    maps = sets.select(F.col("cid").alias("b"), "map")
    members, lists = _mixed(members.join(maps, "b"), label)
    lists = lists.select("a", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    members = members.join(lists, "a").withColumn(
        "s", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    )
    with_block = members.withColumn("t", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)")))
    with_block = with_block.select(
        "a", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"), "s", "b", "n", "pos", "c", "map"
    )

    def block_pairs(table: pa.Table) -> pa.Table:
        x = {k: table.column(k).to_numpy() for k in ("i", "j", "s", "b", "n", "pos", "c")}
        left = np.flatnonzero(x["s"] == x["i"][0])
        right = np.flatnonzero(x["s"] == x["j"][0])
        maps = np.frombuffer(b"".join(table.column("map").to_pylist()), dtype=np.uint64)
        maps = maps.reshape(len(x["b"]), PARITY // 64)
        out = []
        for k in left.tolist():
            ok = _possible(x["n"][k], x["pos"][k], x["n"][right], x["pos"][right])
            ok &= x["c"][right] != x["c"][k]
            if x["i"][0] == x["j"][0]:
                ok &= x["b"][right] > x["b"][k]
            near = right[ok]
            apart = np.bitwise_count(maps[near] ^ maps[k]).sum(axis=1, dtype=np.int64)
            n = x["n"][near]
            b = x["b"][near[apart <= x["n"][k] + n - 2 * required(x["n"][k], n)]]
            a = np.full(len(b), x["b"][k])
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        both = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
        return pa.Table.from_batches([_batch("a long, b long", [both[:, 0], both[:, 1]])])

    return with_block.groupBy("a", "i", "j").applyInArrow(block_pairs, "a long, b long").distinct()


def join(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` plus ``n_shingles``, ``component_id`` and ``is_kept`` per row.

    ``component_id`` is the smallest ``doc_id`` reachable by links, the row's own included; one row
    of each component is kept: the first of those with that id. A text that is null or has no
    words has no shingle, links with nothing and is kept. Equal texts (repeated rows too) are one
    class. Rows with a null id take part; their component is named by the ids of the others, null
    if there are none. Results replace columns of the same name.
    """
    new = ["n_shingles", "component_id", "is_kept"]
    base = df.drop(*new)
    (rid,) = fresh(base, "rid")
    base = with_row_id(base, rid)
    rows = base.select(F.col(rid).alias("rid"), F.coalesce(text, F.lit("")).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rids, texts in _chunks(batches):
            sets = shingle_sets(texts)
            both = [_class(x) if len(x) else (None, None) for x in sets]
            yield _batch(_DOCS, [rids, [len(x) for x in sets], [a for a, _ in both],
                                 [b for _, b in both]])

    docs = stage(rows.mapInArrow(describe, _DOCS), "docs")
    classes = docs.where("cid is not null").groupBy("cid").agg(
        F.min("rid").alias("rid"), F.min("other").alias("o1"), F.max("other").alias("o2")
    )
    classes = stage(classes, "classes")
    if not classes.where("o1 <> o2").isEmpty():
        raise RuntimeError("two different shingle sets share a 64-bit class id")
    reps = classes.select("cid", "rid")

    often = rows.mapInArrow(_repeated, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    often = often.where(F.col("n") > OFTEN).orderBy(F.desc("n"), "h").limit(FREQUENT)
    frequent = np.sort(often.select("h").toArrow().column("h").to_numpy())

    postings = rows.mapInArrow(_postings(frequent), _POSTINGS)
    # members come in one of a few orders: a bad first member of one list is made up for by others
    # (in one order the smallest sets come first: they hold little besides what all share)
    order = F.pmod("h", F.lit(ORDERS))
    rank = F.when(order == 0, F.col("place")).otherwise(F.xxhash64(order, "cid"))
    postings = postings.repartition("h").sortWithinPartitions("h", rank, "cid")
    found = stage(postings.mapInArrow(_candidates, _FOUND), "found")
    # a class with its entries in long lists: at most those of its own prefix
    entry = F.struct("a", F.col("nb").alias("pos"))
    members = found.where("kind = 1").groupBy("b").agg(
        F.first("na").alias("n"), F.collect_list(entry).alias("lists")
    )
    members = stage(members, "members")
    pairs = stage(_enough(found, members), "pairs")
    ends = _both(pairs, lambda p, end: p.select(F.col(end).alias("cid")).distinct())
    needed = ends.union(members.select("b")).distinct().join(reps, "cid").select("cid", "rid")
    sets = rows.join(needed, "rid").select("cid", "text").mapInArrow(_sets, _SETS)
    sets = stage(sets, "sets")
    links = _links(pairs, sets)
    label = stage(components(links), "label")
    if not members.isEmpty():
        for step in range(ROUNDS):
            pairs = stage(_with_some(members, label, step), "some")
            if pairs.isEmpty():
                break
            links = links.union(_links(pairs, sets))
            label = stage(components(links), "label")
        pairs = stage(_across(members, label, sets), "across")
        if not pairs.isEmpty():
            links = links.union(_links(pairs, sets))
            label = components(links)

    # from classes to rows: a component is named by its first class until its rows are known
    named = label.select(F.col("node").alias("cid"), "component")
    docs = docs.join(named, "cid", "left").withColumn("c", F.coalesce("component", "cid"))
    ids = base.select(F.col(rid).alias("rid"), F.col(doc_id).alias("id"))
    docs = docs.select("rid", "n", "c").join(ids, "rid")
    first = F.min(F.struct(F.col("id").isNull(), "id", "rid"))
    heads = docs.where("c is not null").groupBy("c").agg(first.alias("f"))
    docs = docs.join(heads, "c", "left").select(
        F.col("rid").alias(rid),
        F.col("n").alias("n_shingles"),
        F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("f.id")).alias("component_id"),
        (F.col("c").isNull() | (F.col("f.rid") == F.col("rid"))).alias("is_kept"),
    )
    docs = stage(docs, "joined")
    return base.join(docs, rid).select(*(c for c in base.columns if c != rid), *new)
