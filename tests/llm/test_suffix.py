"""Removal of repeated strings against a brute-force count of all strings."""

import random
from collections import Counter

from helpers import table

from sparkwick.llm import suffix

SCHEMA = "doc_id long, text string, kept string, n_bytes int"


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def check(spark, folder, texts, length):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    got = suffix.drop_repeats(table(spark, folder, rows, SCHEMA), length=length).collect()
    assert len(got) == len(rows)
    want = brute(texts, length)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id], r.doc_id


def test_short_strings(spark, tmp_path):
    rng = random.Random(1)
    bits = ["".join(rng.choices("abcé ", k=rng.randrange(10, 60))) for _ in range(40)]
    texts = []
    for _ in range(150):
        t = "".join(rng.choice(bits) if rng.random() < 0.6 else "".join(rng.choices("xyz", k=25))
                    for _ in range(rng.randrange(0, 9)))
        texts.append(t)
    texts += [None, "", "a" * 500, "ab" * 200, "short", texts[3], texts[3], "日" * 90]
    check(spark, tmp_path / "t", texts, 40)


def test_full_length(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = " ".join(word() for _ in range(90))
    texts = [" ".join([word() for _ in range(rng.randrange(5, 200))]) for _ in range(40)]
    texts += [" ".join([word() for _ in range(30)]) + passage[k : k + n] + "".join(word() for _ in range(30))
              for k, n in [(0, 399), (0, 400), (0, 401), (10, 500), (100, 450), (0, 629), (3, 620)]]
    near = texts[5] + " " + passage
    texts += [near, near[:200] + "X" + near[201:], near + passage, "q" * 5000]
    check(spark, tmp_path / "t", texts, 400)
    none = spark.createDataFrame([], SCHEMA)
    assert suffix.drop_repeats(none).count() == 0


def test_repeated_lines_are_no_hot_keys(spark, tmp_path):
    rng = random.Random(3)
    word = lambda k: "".join(rng.choices("abcdefgh", k=k))
    raw = [(word(700) + "one line\n" * 250 + word(700)).encode() for _ in range(20)]
    ranks = Counter(suffix.find_blocks(raw, 400)[2].tolist())
    # not 250 for every text: one, and those whose strings reach beyond the last line
    assert max(ranks.values()) <= (1 + 400 // 9) * len(raw)
    texts = []
    for _ in range(40):
        line = rng.choice(["one line\n", "-", "ab", "日本\n", word(12), word(150)])
        texts.append(word(rng.randrange(40)) + line * rng.randrange(60) + word(rng.randrange(40)))
    check(spark, tmp_path / "short", texts, 40)
    texts = [t.decode() for t in raw[:4]] + ["x" + "one line\n" * k for k in (44, 45, 89, 90)]
    texts += [word(50) + word(150) * 4 + word(50), "=" * 401, "=" * 1000 + word(9)]
    check(spark, tmp_path / "long", texts, 400)
