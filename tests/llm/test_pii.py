"""Base spans against Python's patterns, votes and the classifier on planted cases."""

import random
import re

from helpers import table

from sparkwick.llm import pii

SCHEMA = "doc_id long, text string, base string, added int"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    x = [int(c) for c in reversed(d)]
    return sum(sum(divmod(2 * v, 10)) if i % 2 else v for i, v in enumerate(x)) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 13 <= len(d) <= 19 and luhn(d))
                or (kind == "phone" and 9 <= len(d) <= 15)
            ):
                out.append((kind, m.start(), m.end()))
    return out


def test_spans(spark, tmp_path):
    rng = random.Random(6)
    bits = ["a@b.com", "@", ".", "x.y%z@q-r.s", "1.2.3.4", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111",
            "+1 (415) 555-2671", "+", " ", "-", "12", "\n", "é", "日本", "\U0001f600", "4111111111111112", "_",
            "+12345678", "79927398713", "4012-8888-8888-1881", "a@b", "1.2.3.4.5.6.7.8"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 30))) for _ in range(400)]
    texts += [None, "", "1" * 1500, "1 " * 1500, "a" * 1500 + "@", "a.b@" + "c." * 1500 + "d",
              "+1" + " " * 1500, "+1" * 1500, "x@y.zz " * 800, "a" * 100 + "\n" + "9.9.9.9" * 300]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[0], "x", 1), (0, texts[0], "x", 1)]
    df = table(spark, tmp_path / "t", rows, SCHEMA)
    model = pii.fit(df)
    got = pii.find(df, model).select("doc_id", "text", "base", pii.listed("base").alias("l")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(r.text)
        assert [tuple(x) for x in r.base] == want, (r.text or "")[:80]
        assert r.l == ",".join(f"{k}:{s}:{e}" for k, s, e in want)
    red = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    assert len(red) and red[400] is None and red[401] == ""
    plain = {i: t for i, t in enumerate(texts) if t and "+" not in t and len({k for k, *_ in brute(t)}) == 1}
    assert len(plain) > 20
    for i, t in plain.items():
        want, last = "", 0
        for kind, s, e in brute(t):
            want += t[last:s] + f"[{kind.upper()}]"
            last = e
        if model.bias == {}:
            assert red[i] == want + t[last:]
    none = spark.createDataFrame([], SCHEMA)
    assert pii.find(none, pii.fit(none)).count() == 0


def test_long_runs(spark, tmp_path):
    """Texts that a backtracking or recursive match would not survive."""
    texts = ["1" * 20_000, "1 " * 10_000, "a" * 20_000 + "@", "a.b@" + "c." * 5_000 + "d",
             "+1" + " " * 10_000, "+1" * 5_000, "x@y.zz " * 2_000]
    df = table(spark, tmp_path / "t", [(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    model = pii.fit(df)
    got = {r.doc_id: r.base for r in pii.find(df, model).collect()}
    assert [len(got[i]) for i in range(len(texts))] == [0, 0, 0, 1, 0, 0, 2_000]
    assert got[6][-1].end == 2_000 * 7 - 1
    assert pii.redact(df, model).where("text like '%[EMAIL]%'").count() == 2


def test_added_spans(spark, tmp_path):
    rng = random.Random(9)
    hexes = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    rows, want = [], {}
    for i in range(60):
        if i % 3 == 0:
            text, span = f'he wrote token = "{hexes()}" and left', ("secret", 18 - 2, 56)
            want[i] = "secret"
        elif i % 3 == 1:
            text = f"please call ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}."
            want[i] = "phone"
        else:
            text = "nothing here " + "a" * 30 + " but commit " + "-" * 25
        rows.append((i, text, None, None))
    df = table(spark, tmp_path / "t", rows, SCHEMA)
    model = pii.fit(df)
    for r in pii.find(df, model).collect():
        assert [x.kind for x in r.added] == ([want[r.doc_id]] if r.doc_id in want else []), r
    for r in pii.redact(df, model).collect():
        assert ("[SECRET]" in r.text, "[PHONE]" in r.text) == (
            want.get(r.doc_id) == "secret", want.get(r.doc_id) == "phone")


def test_reliability_is_learned():
    patterns = []
    for right in (1, -1):  # shape and gazetteer agree; context is noise
        for noise in (1, -1):
            patterns.append({"kind": "secret", "shape": right, "gazetteer": right, "context": noise,
                             "variety": 0, "size": 1, "n": 100})
    truth, rates = pii.aggregate_votes(patterns)
    assert truth[0] > 0.9 and truth[1] > 0.9 and truth[2] < 0.1 and truth[3] < 0.1
    assert abs(rates["secret", "context"][1][2] - rates["secret", "context"][0][2]) < 0.05


def test_full_length_runs(spark, tmp_path):
    """The texts of test_long_runs at ten times their size, with a filter on the result."""
    texts = ["1" * 200_000, "1 " * 100_000, "a" * 200_000 + "@", "a.b@" + "c." * 50_000 + "d",
             "+1" + " " * 100_000, "+1" * 50_000, "x@y.zz " * 20_000]
    df = table(spark, tmp_path / "t", [(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    model = pii.fit(df)
    found = pii.find(df, model)
    got = {r.doc_id: r.base for r in found.collect()}
    assert [len(got[i]) for i in range(len(texts))] == [0, 0, 0, 1, 0, 0, 20_000]
    assert got[6][-1].end == 20_000 * 7 - 1
    assert found.where("size(base) > 1").count() == 1
    assert pii.redact(df, model).where("text like '%[EMAIL]%'").count() == 2


def test_many_candidates(spark, tmp_path):
    """Tens of thousands of candidates in one text, half of them within base spans."""
    n = 10_000
    text = "x@y.zz, call (212) 555-1234, +1 (212) 555-1234; " * n
    df = table(spark, tmp_path / "t", [(1, text, None, None), (2, "call (212) 555-1234", None, None)], SCHEMA)
    model = pii.fit(df)
    got = {r.doc_id: r for r in pii.find(df, model).collect()}
    size = len(text) // n
    for k, at in ((0, 0), (n, 29)):
        assert tuple(got[1].base[k])[1] == at
    assert [x.start for x in got[1].added] == [13 + size * i for i in range(n)]
    assert [(x.kind, x.start) for x in got[2].added] == [("phone", 5)]
    red = pii.redact(df, model).where("text like '%[PHONE]%'").collect()
    assert {r.doc_id: r.text for r in red} == {
        1: "[EMAIL], call [PHONE], [PHONE]; " * n, 2: "call [PHONE]"}
