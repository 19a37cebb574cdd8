"""Language identification, line dedup and the Jaccard join against brute force."""

import random
import re

import numpy as np
from helpers import smallest_reachable, table

from sparkwick.llm import jaccard, langid, lines
from sparkwick.llm.common import components

DOC = "doc_id long, text string, lang string, n_lines string, score string, is_kept int"


def doc(i, text, lang=None):
    return (i, text, lang, "x", "y", 3)


def brute_lines(docs, width=3):
    seen, out = set(), {}
    for i, text in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        own = text.split("\n")
        gone = set()
        for k in range(len(own) - width + 1):
            w = tuple(own[k : k + width])
            if w in seen:
                gone |= set(range(k, k + width))
            seen.add(w)
        out[i] = ("\n".join(x for k, x in enumerate(own) if k not in gone), len(own), len(gone))
    return out


def test_line_windows(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, "\n".join(rng.choices("abcd", k=rng.randrange(0, 14)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "\n\n\n\n\n"), (63, "\n".join(["l"] * 5000)), (64, "q\n\n")]
    got = lines.drop_repeated_windows(table(spark, tmp_path / "t", [doc(*d) for d in docs], DOC))
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(docs) and rows[60].text is None and rows[60].n_lines == 0
    for i, want in brute_lines(docs).items():
        assert (rows[i].text, rows[i].n_lines, rows[i].n_removed) == want
    again = [doc(None, "a\nb\nc"), doc(5, "a\nb\nc"), doc(5, "a\nb\nc")]
    got = lines.drop_repeated_windows(table(spark, tmp_path / "u", again, DOC)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (5, 3), (5, 3)]
    none = spark.createDataFrame([], DOC)
    assert lines.drop_repeated_windows(none).count() == 0


def brute_grams(text):
    x = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "
    if not x.strip():
        return []
    out = [x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1)]
    return [g for g in out if g != " " and not (len(g) == 3 and g[1] == " ")]


def brute_top(grams):
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - k)
                         for k, c in enumerate(g))
    counts = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[: langid.TOP]


def test_language_profiles(spark, tmp_path):
    rng = random.Random(2)
    words = {"aa": "the of and ing tion".split(), "bb": "der die und sch éün".split(), "cc": ["Ωψ", "日本"]}
    docs = []
    for i in range(90):
        lang = rng.choice(list(words))
        docs.append((i, " ".join(rng.choices(words[lang], k=rng.randrange(1, 40))) + "!", lang))
    docs += [(90, None, "aa"), (91, "12 34", "bb"), (92, "", None), (93, "the and", None), (None, "und", "bb")]
    docs += [(94, "x" * 3_000_000, None)]
    df = table(spark, tmp_path / "t", [doc(*d) for d in docs], DOC)
    profiles = langid.learn(df.where(~langid.held_out()))
    import zlib

    want = {
        n: brute_top([g for i, t, k in docs if k == n and t and i is not None
                      and zlib.crc32(str(i).encode()) % 5 for g in brute_grams(t)])
        for n in words
    }
    assert {n: len(p) for n, p in profiles.items()} == {n: len(p) for n, p in want.items()}
    got = {r.doc_id: r for r in langid.identify(df, profiles).collect()}
    assert len(got) == len(docs)
    for i, text, _ in docs:
        own = brute_top(brute_grams(text or ""))
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        away = {
            n: sum(abs(r - want[n].index(g)) if g in want[n] else langid.TOP for r, g in enumerate(own))
            for n in sorted(want)
        }
        best = min(away, key=lambda n: (away[n], n))
        assert got[i].lang_pred == best
        assert abs(got[i].score - (1 - away[best] / langid.TOP / len(own))) < 1e-12
    assert [r.lang_pred for r in langid.identify(df, {}).collect()] == ["und"] * len(docs)
    assert langid.identify(spark.createDataFrame([], DOC), profiles).count() == 0


def brute_sets(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_shingle_sets():
    texts = ["", " \t\n", "One two", "a b c d e f a b c d e f", "É é É é É é", "x" * 100_000, "A\x85b\x1cc d e"]
    for text, found in zip(texts, jaccard.shingle_sets(texts), strict=True):
        assert len(found) == len(brute_sets(text))
    a, b = jaccard.shingle_sets(["THE cat sat on the mat", "the Cat\tsat\n\non the mat"])
    assert (a == b).all()


def test_divide_skip():
    rng = np.random.default_rng(4)
    for _ in range(60):
        query = np.unique(rng.integers(0, 60, 40))
        others = [np.unique(rng.integers(0, 60, rng.integers(20, 90))) for _ in range(30)]
        others += [query, query[:-3], query[5:]]
        got = jaccard.divide_skip(query, others)
        for ok, o in zip(got, others, strict=True):
            both = len(np.intersect1d(query, o))
            assert ok == (100 * both >= 75 * (len(query) + len(o) - both))


def test_jaccard_components(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=3))
    base = [word() for _ in range(60)]
    passage = [word() for _ in range(40)]
    docs = []
    for i in range(150):  # a large group of near copies, a few of them far from each other
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            own[rng.randrange(len(own))] = word()
        docs.append((1000 - i, " ".join(own)))
    for i in range(150):  # a passage that many share
        docs.append((2000 + i, " ".join(passage + [word() for _ in range(rng.randrange(5, 40))])))
    docs += [(3000 + i, t) for i, t in enumerate([None, "", " ", "a b", "A  b", "a b c", docs[3][1]])]
    docs += [(5, docs[9][1]), (5, docs[9][1]), (6, " ".join(word() for _ in range(30_000)))]
    df = table(spark, tmp_path / "t", [doc(*d) for d in docs], DOC)
    got = jaccard.join(df).collect()
    sets = [brute_sets(t) for _, t in docs]
    edges = []
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                edges.append((i, j))
    # nodes by id: repeated ids share their text here
    want = smallest_reachable({d[0] for d in docs}, [(docs[i][0], docs[j][0]) for i, j in edges])
    assert len(got) == len(docs)
    for r in got:
        k = next(i for i, d in enumerate(docs) if d[0] == r.doc_id)
        assert r.n_shingles == len(sets[k])
        assert r.component_id == want[r.doc_id], r.doc_id
    kept = [r.component_id for r in got if r.is_kept]
    assert sorted(kept) == sorted(set(want.values()))
    none = spark.createDataFrame([], DOC)
    assert jaccard.join(none).count() == 0


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    edges += [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(300)]
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == smallest_reachable(nodes, [e for e in edges if e[0] != e[1]])
    assert components(df.where("a < 0")).count() == 0
