"""Groups of copies that share long lists but are too far from each other to link."""

import random

import numpy as np
import pyarrow as pa
from helpers import smallest_reachable, table

from sparkwick.llm import jaccard


def edited(rng, base, edits, tag):
    """``base`` with words of its own at far places, each in five shingles that no other has."""
    own = list(base)
    for k, at in enumerate(rng.sample(range(2, len(base) // 6), edits)):
        own[6 * at] = f"{tag}x{k}"
    return own


def test_far_copies_give_no_square_of_pairs(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    docs = [(i, " ".join(edited(rng, base, 4, f"d{i}"))) for i in range(300)]
    for i in range(40):  # one word more of one of them: these link
        own = docs[i][1].split()
        own[-1] = f"e{i}"
        docs.append((1000 + i, " ".join(own)))
    sizes = {}
    stage = jaccard.stage

    def counted(df, name="stage"):
        out = stage(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "stage", counted)
    monkeypatch.setattr(jaccard, "BLOCK", 100)
    got = jaccard.join(table(spark, tmp_path / "d", docs, "doc_id long, text string")).collect()
    assert 0 <= sizes["across"] < len(docs)  # of 45,000 pairs
    sets = [set(x.tolist()) for x in jaccard.shingle_sets([t for _, t in docs])]
    edges = [
        (docs[i][0], docs[j][0])
        for i in range(len(docs))
        for j in range(i)
        if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    assert len(edges) >= 40
    want = smallest_reachable([d[0] for d in docs], edges)
    assert {r.doc_id: r.component_id for r in got} == want


def test_parity_maps_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for n in (1, 50, 3000):
        a, b = (np.unique(rng.integers(-(2**63), 2**63 - 1, n)) for _ in range(2))
        b = np.union1d(b, a[: n // 2])
        maps = [np.frombuffer(jaccard.parity_map(x), dtype=np.uint64) for x in (a, b)]
        assert np.bitwise_count(maps[0] ^ maps[1]).sum() <= len(np.setxor1d(a, b))


def test_few_rows_become_strings_at_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(["a b c"] * 5000)], names=["rid", "text"])
    sizes = [len(rids) for rids, _ in jaccard._chunks(iter([batch]))]
    assert sum(sizes) == 5000 and max(sizes) <= 256
