"""Word hashes, clashing column names and row numbers of the text operators."""

import numpy as np
from helpers import table
from pyspark.sql import functions as F

from sparkwick.llm import codes, divergence, jaccard, lines, suffix
from sparkwick.llm.common import with_row_id
from sparkwick.llm.hashing import RangeHash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_that_collide_modulo_powers_of_two_stay_apart(spark, tmp_path):
    for n in (256, 1024, 2048, 4096):
        word = _thue_morse(n)
        other = word.translate(str.maketrans("ab", "ba"))
        a, b = jaccard.shingle_sets([f"one two three four {word}", f"one two three four {other}"])
        assert len(a) == len(b) == 1 and a[0] != b[0]
        both = np.frombuffer((word + other).encode(), dtype=np.uint8).astype(np.uint64)
        h = RangeHash(both)(np.array([0, n]), np.array([n, 2 * n]))
        assert h[0] != h[1]
    word = _thue_morse(1024)
    docs = table(spark, tmp_path / "d", [(1, word), (2, word.translate(str.maketrans("ab", "ba")))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert got == {1: 1, 2: 2}


def test_ranges_hash_alike_wherever_they_stand():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 256, 5000).astype(np.uint64)
    x[3000:3400] = x[100:500]
    h = RangeHash(x)
    assert h(np.array([100]), np.array([500])) == h(np.array([3000]), np.array([3400]))
    assert h(np.array([100]), np.array([500])) != h(np.array([101]), np.array([501]))
    assert h(np.array([7]), np.array([7])) == h(np.array([9]), np.array([9]))


def test_extra_columns_with_internal_names_pass_through(spark, tmp_path):
    text = "\n".join(f"line {i} of the text with words" for i in range(60))
    rows = [(i, text if i < 2 else f"{i} other words entirely {i * 7}", i * 10, f"s{i}", i * 3) for i in range(4)]
    names = ["rid", "places", "lines", "left", "starts", "_l", "_k", "_rid", "_s", "_file", "_no", "_row",
             "row", "verdict", "ref", "word", "at", "counts", "key", "lang"]
    df = table(spark, tmp_path / "x", rows, "doc_id long, text string, a long, b string, c long")
    df = df.select("doc_id", "text", *(F.concat(F.lit(n), "doc_id").alias(n) for n in names))
    df.write.parquet(str(tmp_path / "y"))
    df = spark.read.parquet(str(tmp_path / "y"))
    rows, facts = divergence.measure(df)
    results = [
        lines.drop_repeated_windows(df), jaccard.join(df), suffix.drop_repeats(df),
        divergence.judge(rows, facts, divergence.learn(rows, facts)),
    ]
    for out in results:
        got = out.orderBy("doc_id").collect()
        assert [[r[n] for n in names] for r in got] == [[f"{n}{i}" for n in names] for i in range(4)]


def test_row_numbers_are_different_and_stay(spark, tmp_path):
    df = spark.range(5000).repartition(37)
    df.write.parquet(str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r"))
    first = {r.id: r.rid for r in with_row_id(df).collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        again = {r.id: r.rid for r in with_row_id(df).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert first == again and len(set(first.values())) == 5000
    assert codes.PARTS == 8
