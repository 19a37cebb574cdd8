"""Quality rules, the filter audit and vector codes against brute force."""

import hashlib
import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from helpers import table
from pyspark.sql import functions as F

from sparkwick.llm import audit, codes, divergence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --------------------------------------------------------------------------- quality rules


def _base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in divergence.SYMBOLS for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": len(words) < 50 or 100 * len(hit) > 50 * len(words),
    }


def _js(p, q):
    bits = 0.0
    for x, y in zip(p, q, strict=True):
        m = (x + y) / 2
        bits += sum(z * math.log2(z / m) for z in (x, y) if z > 0) / 2
    return math.sqrt(max(bits, 0.0))


def _classes(text):
    kinds = Counter()
    for c in text:
        if c in " \t\n\x0b\x0c\r":
            kinds["space"] += 1
        elif c in divergence.SYMBOLS:
            kinds["symbol"] += 1
        elif c.isalpha() and c.islower():
            kinds["lower"] += 1
        elif c.isalpha() and c.isupper():
            kinds["upper"] += 1
        elif c.isdigit():
            kinds["digit"] += 1
        elif c in ".,;:":
            kinds["stop"] += 1
        else:
            kinds["rest"] += 1
    return [kinds[k] for k in ("space", *divergence.CLASSES, "rest")]


def _prose(rng, vocabulary, n):
    common = vocabulary[:6]
    words = [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(words))


def _texts():
    rng = np.random.default_rng(11)
    one = ["the", "of", "and", "to", "in", "was"] + [f"north{c}{d}" for c in "abcdefgh" for d in "klmnop"]
    two = ["le", "de", "et", "les", "dans", "était"] + [f"sud{c}{d}é" for c in "abcdefgh" for d in "klmnop"]
    rows = [(i, _prose(rng, one, 120), "en") for i in range(12)]
    rows += [(20 + i, _prose(rng, two, 90 + i), "fr") for i in range(9)]
    rows += [
        (40, _prose(rng, one, 120).upper().replace(" ", "!! "), "en"),
        (41, " | ".join(f"{w}## $$" for w in _prose(rng, one, 80).split()), "en"),
        (42, " ".join(f"zq{i}" for i in range(300)), "en"),
        (43, None, "en"),
        (44, "", None),
        (45, _prose(rng, two, 100), None),
        (46, "so so " * 60, "fr"),
        (47, "a b c\n a b c\n\n \na b c", "de"),
        (0, rows[0][1], "en"),
        (48, _prose(rng, one, 100), "xx"),
    ]
    return rows


def test_quality_counts_and_distances_equal_a_brute_force(spark, tmp_path):
    data = _texts()
    df = table(spark, tmp_path / "q", data, "doc_id long, text string, lang string")
    rows, facts = divergence.measure(df)
    refs = divergence.learn(rows, facts)
    got = {}
    for r in divergence.judge(rows, facts, refs).collect():
        got.setdefault((r.doc_id, r.text, r.lang), []).append(r)
    # references
    known = {}
    for lang in {x[2] for x in data if x[2]}:
        own = [t for _, t, g in data if g == lang and t is not None]
        steps = [[1000 * c // len(t) for c in _classes(t)] for t in own if len(t) >= divergence.GUARD_CHARS]
        words = Counter(w for t in own for w in WORD.findall(t.lower()))
        if not steps or not words:
            continue
        middle = [sorted(x)[(len(x) - 1) // 2] for x in zip(*steps)]
        chars = [0.99 * x / sum(middle) + 0.01 / len(middle) for x in middle]
        top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[: divergence.COMMON_WORDS]
        total = sum(words.values())
        shares = [n / total for _, n in top]
        known[lang] = (chars, [w for w, _ in top], shares + [1 - sum(shares)])
    assert {r.lang for r in refs.collect()} == set(known)
    kept = {}
    for doc_id, text, lang in data:
        for r in got[(doc_id, text, lang)]:
            want = _base(text)
            assert {k: r[k] for k in want} == want, doc_id
            js_c = js_w = None
            if not want["base_failed"]:
                words = Counter(WORD.findall(text.lower()))
                near = known.values() if lang is None else [known[lang]] if lang in known else []
                pairs = []
                for chars, common, shares in near:
                    n = sum(words.values())
                    mine = [words[w] / n for w in common]
                    pairs.append((_js([c / len(text) for c in _classes(text)], chars), _js([*mine, 1 - sum(mine)], shares)))
                js_c = min((a for a, _ in pairs), default=None) if len(text) >= divergence.GUARD_CHARS else None
                js_w = min((b for _, b in pairs), default=None)
            for a, b in ((r.js_chars, js_c), (r.js_words, js_w)):
                assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), doc_id
            verdict = not want["base_failed"] and (js_c or 0) <= divergence.MOST_CHARS and (js_w or 0) <= divergence.MOST_WORDS
            assert r.kept == verdict, doc_id
            kept[doc_id] = r.kept
    assert all(kept[i] for i in range(12)) and all(kept[20 + i] for i in range(9)) and kept[45]
    assert not any(kept[i] for i in (40, 41, 42, 43, 44, 46, 47))


def test_quality_of_nothing(spark, tmp_path):
    df = table(spark, tmp_path / "e", [], "doc_id long, text string, lang string")
    rows, facts = divergence.measure(df)
    assert divergence.judge(rows, facts, divergence.learn(rows, facts)).count() == 0
    df = table(spark, tmp_path / "n", [(1, None, None), (2, "", "en")], "doc_id long, text string, lang string")
    rows, facts = divergence.measure(df)
    got = divergence.judge(rows, facts, divergence.learn(rows, facts)).collect()
    assert len(got) == 2 and not any(r.kept for r in got)


def test_repeat_words_of_a_very_long_text(spark, tmp_path):
    rng = np.random.default_rng(3)
    text = " ".join(map(str, rng.integers(0, 40, 60_000)))
    df = table(spark, tmp_path / "l", [(1, text, "en"), (2, text + " x", "en")], "doc_id long, text string, lang string")
    _, facts = divergence.measure(df)
    want = sorted(_base(t)["n_repeat_words"] for t in (text, text + " x"))
    assert sorted(r.n_repeat_words for r in facts.collect()) == want


# --------------------------------------------------------------------------- filter audit


def test_beginnings_cover_every_rank_once_per_step():
    orders = ["".join(map(str, p)) for p in permutations(range(4))]
    for step in range(1, 5):
        spans = sorted((b["first"], b["last"]) for b in audit.beginnings(4) if b["step"] == step)
        assert spans[0][0] == 0 and spans[-1][1] == 24
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        for b in audit.beginnings(4):
            if b["step"] == step:
                for rank in range(b["first"], b["last"]):
                    letters = [int(c) for c in orders[rank][:step]]
                    assert letters[-1] == b["letter"] and sum(1 << x for x in letters[:-1]) == b["before"]


@pytest.mark.parametrize("k", [1, 3, 5])
def test_audit_equals_applying_every_order(spark, k):
    rng = np.random.default_rng(k)
    letters = "ABCDE"[:k]
    data = []
    for _ in range(200):
        part = rng.choice(["a", "b", "", "hot", "hot", "hot"])
        row = [str(part) if part != "" else None, *(bool(rng.random() < 0.4) for _ in letters)]
        if rng.random() < 0.1:
            row[1] = None
        data.append((*row, bool(rng.random() < 0.3)))
    schema = "p string, " + ", ".join(f"f{x} boolean" for x in letters) + ", good boolean"
    df = spark.createDataFrame(data, schema)
    out = audit.interactions(
        df, {x: F.col(f"f{x}") for x in letters}, F.col("p"), {"good_lost": F.col("good")}
    ).collect()
    want = {}
    for part in {r[0] or "" for r in data}:
        own = [({x for x, f in zip(letters, r[1:]) if f}, r[-1]) for r in data if (r[0] or "") == part]
        removed_by = Counter()
        for order in permutations(letters):
            left = own
            for step, x in enumerate(order, 1):
                here = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                removed_by[x] += len(here)
                fails = [d for d in own if x in d[0]]
                want[part, "".join(order), step] = [
                    len(left), len(here), len(fails) - len(here), sum(d[0] == {x} for d in own), sum(d[1] for d in here),
                ]
        for (p, order, step), v in want.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley] for r in out}
    assert got == want and len(out) == len(want)


def test_audit_of_nothing_and_first_of_equals(spark):
    none = spark.createDataFrame([], "p string, a boolean")
    assert audit.interactions(none, {"A": F.col("a")}, F.col("p")).count() == 0
    with pytest.raises(ValueError):
        audit.interactions(none, {}, F.col("p"))
    rows = spark.createDataFrame([("x", 3), ("x", 1), ("x", 1), ("y", None), ("z", 7)], "t string, i long")
    got = {(r.t, r.i) for r in audit.first_of_equals(rows, "t", "i").collect()}
    assert got == {("x", 1), ("y", None), ("z", 7)}


# --------------------------------------------------------------------------- vector codes


def test_hilbert_neighbours_differ_in_one_step():
    for dims, bits in ((2, 4), (3, 3), (1, 5)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = codes.hilbert_index(grid, bits)
        assert sorted(place.tolist()) == list(range(1 << bits * dims))
        walk = grid[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shortlists_keep_every_nearest_entry():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x = rng.integers(-50, 50, (20, 3))
        entries = rng.integers(-50, 50, (9, 3))
        entries[4] = entries[2]
        ok = codes.shortlists(x.min(0)[None], x.max(0)[None], entries)[0]
        far = ((x[:, None] - entries) ** 2).sum(2)
        for row in far:
            assert ok[np.flatnonzero(row == row.min())].all()
        near, d = codes._nearest(x, entries, np.flatnonzero(ok))
        assert (near == far.argmin(1)).all() and (d == far.min(1)).all()


def _brute(data, parts=8, entries=16, rounds=6):
    ok = [r for r in data if r[1] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    if not ok:
        return {}, None
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0))
    ints = [[max(min(math.floor(4096 * v), codes.LARGEST), -codes.LARGEST) for v in r[1]] for r in ok]
    width = -(-len(ints[0]) // parts)
    padded = [v + [0] * (width * parts - len(v)) for v in ints]
    own = [[v[p * width : (p + 1) * width] for v in padded] for p in range(parts)]
    books = [[list(x) for x in own[p][:entries]] for p in range(parts)]

    def assign(p):
        out = []
        for x in own[p]:
            d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        for p in range(parts):
            got = assign(p)
            for e in range(len(books[p])):
                mine = [x for x, (c, _) in zip(own[p], got) if c == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    final = [assign(p) for p in range(parts)]
    code = ["".join(f"{final[p][i][0]:02x}" for p in range(parts)) for i in range(len(ok))]
    error = [sum(final[p][i][1] for p in range(parts)) for i in range(len(ok))]
    by_label = Counter()
    for r, e in zip(ok, error):
        by_label[r[2]] += e
    text = ",".join(str(c) for b in books for e in b for c in e)
    rows = Counter((r[0], c, e, by_label[r[2]]) for r, c, e in zip(ok, code, error))
    return rows, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("dims,n", [(16, 90), (64, 7), (10, 40)])
def test_codes_equal_a_brute_force(spark, tmp_path, dims, n):
    rng = np.random.default_rng(dims)
    data = [(int(i), [float(np.float32(v)) for v in rng.normal(0, 0.3, dims)], int(rng.integers(0, 3)) if i % 5 else None)
            for i in rng.permutation(n)]
    hot = [0.25] * dims
    data += [(1000 + i, hot, 1) for i in range(30)]
    data += [(2000, None, 1), (2001, hot[:-1] + [None], 1), (2002, hot[:-1] + [float("nan")], 2),
             (2003, hot[:-1] + [float("inf")], 2), (2004, [0.0] * dims, 2), (2005, [], 2)]
    df = table(spark, tmp_path / "v", data, "vec_id long, embedding array<float>, label int")
    got = codes.compress(df).collect()
    want, digest = _brute(data)
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_codes_of_odd_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<double>, label string, code string, rids string"
    empty = table(spark, tmp_path / "e", [], schema)
    assert codes.compress(empty).count() == 0
    rows = [(1, [0.5, -0.5], "a", "x", "p"), (1, [0.5, -0.5], "a", "x", "q"), (None, [1e200, 0.1], None, "x", "r"),
            (2, [0.5], "a", "x", "s")]
    got = codes.compress(table(spark, tmp_path / "o", rows, schema)).orderBy("rids").collect()
    assert [r.rids for r in got] == ["p", "q", "r"]
    assert got[0].code == got[1].code and len(got[0].code) == 16 and got[0].error == 0


def test_sums_of_far_outliers_do_not_end_the_job(spark, tmp_path):
    rows = [(i, [0.1] * 64, 1) for i in range(16)] + [(100 + i, [1e30 * (-1) ** i] * 64, 1) for i in range(40)]
    got = codes.compress(table(spark, tmp_path / "f", rows, "vec_id long, embedding array<double>, label int"), rounds=1)
    got = {r.vec_id: r for r in got.collect()}
    assert len(got) == 56 and got[0].error >= 0 and got[101].error > 0
    assert got[0].label_error == min(sum(r.error for r in got.values()), codes.MOST)
