"""Encoding against the tokenizers library, trees of halves, and packing bounds."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkwick.llm import bpe, packing, tokens
from sparkwick.llm.common import stage

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n\n  \n", "don't we'll 'sfoo !'s", "a" * 3000, " " * 3000 + "x", "日本語" * 700,
    "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>", "é" * 2500, "x'" * 900,
    "1234567890" * 400, "abc, def. " * 300, "\U0001f600" * 500, "\t\r\n x" * 500, "?!" * 2000,
]


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(tokens, "LEAF", 64)
    monkeypatch.setattr(tokens, "RADIUS", 8)


def reference(text):
    tok = Tokenizer.from_file(PATH)
    ids = tok.encode(text, add_special_tokens=False).ids
    return ids, tok.decode(ids, skip_special_tokens=False)


def random_texts(n):
    rng = random.Random(7)
    alphabets = ["ab", "abcdefghij ", "aé日 '", "  \n\tx", "thereandis ", "0123456789.,-", "!?'s "]
    return ["".join(rng.choices(rng.choice(alphabets), k=rng.randrange(1, 900))) for _ in range(n)]


def test_tree_equals_whole(small_leaves):
    codec = tokens.load(PATH)
    for text in ODD + random_texts(300):
        ids, back = reference(text)
        assert codec.encode(text).tolist() == ids, text[:80]
        assert codec.decode(np.array(ids, dtype="<u4")) == back == text


def test_encode_rows(spark, tmp_path):
    long = "word " * 30_000 + "z" * 200_000 + " end"
    rows = [(1, "Hello there", "a"), (1, "Hello there", "a"), (2, None, "b"), (None, "", "c"),
            (3, long, "d")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(
        str(tmp_path / "t")
    )
    got = bpe.encode(spark.read.parquet(str(tmp_path / "t")), PATH).collect()
    assert len(got) == 5
    for row in got:
        ids, back = reference(row.text or "")
        assert np.frombuffer(row.ids, dtype="<u4").tolist() == ids
        assert row.n_tokens == len(ids) and row.decoded == back
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(empty, PATH).count() == 0


def optimum(sizes, length):
    """Fewest bins by trying every placement."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                rooms[k] -= sizes[i]
                place(i + 1, rooms)
                rooms[k] += sizes[i]
        place(i + 1, [*rooms, length - sizes[i]])

    place(0, [])
    return best[0]


def test_bounds_hold():
    rng = random.Random(3)
    for _ in range(150):
        sizes = np.array([rng.randrange(1, 21) for _ in range(rng.randrange(1, 8))])
        need = optimum(sizes.tolist(), 20)
        bins, offsets, fills = packing.best_fit(sizes, 20)
        assert packing.lower_bound(sizes, 20) <= need <= len(fills)
        assert fills.max() <= 20
        for b in range(len(fills)):
            own = sorted(zip(offsets[bins == b], sizes[bins == b], strict=True))
            assert [o for o, _ in own] == [sum(s for _, s in own[:i]) for i in range(len(own))]
    assert packing.lower_bound(np.array([], dtype=int), 20) == 0


def test_pack_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "PART", 40)
    rng = random.Random(5)
    rows = [(i, "word " * rng.randrange(1, 5000)) for i in range(300)]
    rows += [(7, None), (7, ""), (8, "word " * 2047), (9, "word " * 2048), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "d"))
    pieces = stage(packing.cut_pieces(spark.read.parquet(str(tmp_path / "d")), PATH))
    got = packing.pack(pieces).toPandas()
    assert len(got) == pieces.count() and not got.duplicated(["rid", "piece"]).any()
    for _, g in got.groupby("rid"):
        g = g.sort_values("piece")
        assert g.piece.tolist() == list(range(len(g)))
        assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        assert (g.length[1:] == 2048).all() and g.length.max() <= 2048
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        assert g.length.sum() <= 2048
    used, need = got.sequence_id.nunique(), packing.lower_bound(got.length.to_numpy())
    assert used <= 1.03 * need + 3
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(stage(packing.cut_pieces(none, PATH))).count() == 0
