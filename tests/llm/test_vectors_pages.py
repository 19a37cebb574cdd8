"""Nearest neighbours, lattice hashing and WARC archives against brute force."""

import gzip
import hashlib
import json

import numpy as np
import pytest
from helpers import smallest_reachable, table
from pyspark.sql import functions as F

from sparkwick.llm import ann, lattice, warc
from sparkwick.llm.common import stage

VECTORS = "vec_id long, embedding array<float>, label int, score string, n_links int, h int"
ODD = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 3]


def vectors(n=600, dims=8):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, dims))
    x = centres[rng.integers(0, 12, n)] + 0.3 * rng.standard_normal((n, dims))
    x[100:160] = x[100] + 0.01 * rng.standard_normal((60, dims))
    x[200:230] = x[200]
    x = x.astype(np.float32)
    rows = [(i, x[i].tolist(), int(i % 3 == 0) if i % 50 else None, "s", 1, 2) for i in range(n)]
    rows += [(1000 + i, v, 1, "s", 1, 2) for i, v in enumerate(ODD)] + [(None, x[5].tolist(), 1, "s", 1, 2)]
    rows += [rows[0], rows[203]]
    return rows, {i: x[i].astype(np.float64) for i in range(n)}


def test_nearest(spark, tmp_path):
    rows, x = vectors()
    got = ann.search(table(spark, tmp_path / "t", rows, VECTORS), F.col("vec_id") % 20 == 0).toPandas()
    assert set(got.query_id) == {i for i in x if i % 20 == 0}
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        assert g.vec_id.is_unique
        assert np.allclose(g.score, [x[q] @ x[i] for i in g.vec_id], atol=1e-12)
        pairs = list(zip(-g.score, g.vec_id, strict=True))
        assert pairs == sorted(pairs)
        best = sorted((-(x[q] @ x[i]), i) for i in x if i != q)[:20]
        hits += len({i for _, i in best} & set(g.vec_id))
    assert hits / len(got) >= 0.9
    few = table(spark, tmp_path / "u", rows[:5], VECTORS)
    assert ann.search(few, F.col("vec_id") == 0).count() == 4
    assert ann.search(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(few.where("vec_id < 0"), F.lit(True)).count() == 0


def tight(n, size, dims=64):
    """Unit vectors in tight groups of ``size``."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((n // size, dims)), size, axis=0)
    x += 0.01 * rng.standard_normal(x.shape)
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_tight_groups(spark, tmp_path):
    for n, size in ((60, 10), (3000, 10)):
        x = tight(n, size).astype(np.float32)
        rows = [(i, x[i].tolist(), 1, "s", 1, 2) for i in range(n)]
        got = ann.search(table(spark, tmp_path / str(n), rows, VECTORS), F.col("vec_id") % 20 == 0).toPandas()
        hits = 0
        for q, g in got.groupby("query_id"):
            assert sorted(g["rank"]) == list(range(1, 21)) and g.vec_id.is_unique, (n, q)
            score = x.astype(np.float64) @ x[q]
            best = [i for i in np.argsort(-score, kind="stable").tolist() if i != q][:20]
            hits += len(set(best) & set(g.vec_id))
        assert got.query_id.nunique() == n // 20
        assert hits / len(got) >= 0.9, (n, hits / len(got))


def test_lists_hold_enough():
    rng = np.random.default_rng(7)
    c = 10 * rng.standard_normal((60, 6))
    q = c[:40] + 0.01 * rng.standard_normal((40, 6))
    graph = ann.Graph(c)
    for held in (np.full(60, 1), np.full(60, 0), np.where(np.arange(60) % 7 == 0, 5, 0), np.full(60, 50)):
        row, where = ann.probed_lists(q, graph, held, 21)
        for k in range(len(q)):
            own = where[row == k]
            assert len(set(own.tolist())) == len(own)
            assert held[own].sum() >= min(21, held.sum())


def test_graph_and_balance():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((3000, 6)), 0.01 * rng.standard_normal((3000, 6))])
    c = ann.fit_centroids(x, 40)
    sizes = np.bincount(ann._nearest(x, c))
    assert sizes.max() < 6 * sizes.mean()
    ids, dist = ann.Graph(c).search(x[::50], 10)
    exact = np.argsort(((x[::50, None] - c) ** 2).sum(-1), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids, exact, strict=True)]) > 0.95
    assert (np.diff(dist, axis=1)[ids[:, 1:] >= 0] >= 0).all()


def test_e8_points():
    rng = np.random.default_rng(3)
    x = 3 * rng.standard_normal((200, 8))
    found = lattice.decode_e8(x) / 2
    roots = lattice._roots()
    assert len(roots) == 240 and ((roots / 2) ** 2).sum(axis=1).tolist() == [2.0] * 240
    whole = np.isclose(found % 1, 0).all(axis=1)
    assert (whole | np.isclose(found % 1, 0.5).all(axis=1)).all()
    assert np.isclose(found.sum(axis=1) % 2, 0).all()
    own = ((x - found) ** 2).sum(axis=1)
    for r in roots / 2:  # no neighbour is closer
        assert (((x - found - r) ** 2).sum(axis=1) >= own - 1e-9).all()


def test_near_vectors(spark, tmp_path, monkeypatch):
    rows, x = vectors()
    unit = {i: v / np.linalg.norm(v) for i, v in x.items()}
    label = {r[0]: r[2] for r in rows if r[0] in x}
    edges = [(i, j) for i in x for j in range(i) if label[i] is not None and label[i] == label[j]
             and unit[i] @ unit[j] >= 0.98]
    degree = {i: 0 for i in x}
    for i, j in edges:
        degree[i] += 1
        degree[j] += 1
    monkeypatch.setattr(lattice, "BLOCK", 16)
    got = lattice.near_duplicates(table(spark, tmp_path / "t", rows, VECTORS)).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in {r.vec_id: r for r in got}.values())
    assert 0.97 * 2 * len(edges) <= found <= 2 * len(edges)
    want = smallest_reachable(x, edges)
    same = [r.component_id == want[r.vec_id] for r in got if r.vec_id in x]
    assert np.mean(same) > 0.97
    for r in got:
        assert r.kept == (r.vec_id is not None and r.component_id == r.vec_id)
        if r.vec_id in x:
            assert r.n_links <= degree[r.vec_id]
        else:
            assert (r.n_links, r.component_id) == (0, r.vec_id)
    assert lattice.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


PAGES = "page_id long, url string, html string, payload string, refers_to int"


def test_archives(spark, tmp_path):
    big = "<p>" + "é日" * 800
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 300), "p", 1) for i in range(400)]
    rows += [(500 + i, None, big, "p", 1) for i in range(40)] + [(600, "u", None, "p", 1), (601, "a\r\nb", "", "p", 1)]
    rows += [(None, "n", big, "p", 1), (539, None, big, "p", 1), (700, "s", "\r\n\r\nWARC/1.1\r\n\r\n" * 500, "p", 1)]
    rows += [(701, "z", "y" * 3_000_000, "p", 1), (None, "m", "only" * 400, "p", 1)]
    pages = table(spark, tmp_path / "t", rows, PAGES)
    warc.write_archives(pages, str(tmp_path / "plain"))
    target = f"file://{tmp_path}/members"
    made = stage(warc.normalise(spark, str(tmp_path / "plain"), target)).collect()
    assert sum(r.records for r in made) == len(rows)
    got = warc.read_archives(spark, target).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        for r in by[page]:
            if page is None:
                continue
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
            revisit = html == big and page != 539
            assert (r.record_type, r.refers_to) == (("revisit", 539) if revisit else ("response", None))
            assert r.payload == (None if revisit else data)
    assert sorted((r.record_type, r.refers_to) for r in by[None]) == [("response", None), ("revisit", 539)]
    # every member can be read alone, at the offset of the index
    name = made[0].archive
    data = (tmp_path / "members" / name).read_bytes()
    index = [json.loads(x) for x in (tmp_path / "members" / f"{name}.jsonl").read_text().splitlines()]
    assert sum(x["length"] for x in index) == len(data)
    for x in index:
        record = gzip.decompress(data[x["offset"] : x["offset"] + x["length"]])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path / "none"))
    none = warc.normalise(spark, str(tmp_path / "none"), target + "2").collect()
    assert sum(r.records for r in none) == 0


def test_damaged_stream():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(warc.inflate(gzip.compress(record * 3))) == [record] * 3
    assert list(warc.inflate(gzip.compress(record) + gzip.compress(record))) == [record] * 2
    with pytest.raises(ValueError):
        list(warc.inflate(gzip.compress(record * 3)[:-9]))
    with pytest.raises(ValueError):
        list(warc.inflate(gzip.compress(record[:-5])))
