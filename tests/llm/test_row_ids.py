"""Row ids and the operators that join on them, with splits that change between scans."""

import random

import pytest
from pyspark.sql import functions as F

from sparkwick.llm import lines
from sparkwick.llm.common import with_row_id

SCHEMA = "doc_id long, text string"
SPLITS = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def resplit(spark):
    """Small splits from now on, as after a change of the cores a scan sees."""
    before, cost = spark.conf.get(SPLITS), spark.conf.get("spark.sql.files.openCostInBytes")
    yield lambda: [spark.conf.set(SPLITS, "4096"), spark.conf.set("spark.sql.files.openCostInBytes", "1")]
    spark.conf.set(SPLITS, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def stored(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choices("abcdefgh", k=rng.randrange(2, 14)))) for i in range(4000)]
    folder = str(tmp_path / "a b%")  # a few files with many row groups each
    made = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made.write.option("parquet.block.size", "2048").option("parquet.page.size", "512").parquet(folder)
    return spark.read.parquet(folder)


def scanned(df):
    return sorted((r.rid, r.doc_id) for r in df.select("rid", "doc_id").collect())


def test_ids_outlive_splits(spark, tmp_path, resplit):
    docs = stored(spark, tmp_path)
    doubled = docs.union(docs)
    frames = [docs, docs.select("doc_id", "text").where("doc_id % 3 = 0"), doubled, doubled.distinct()]
    frames.append(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA))
    frames.append(docs.selectExpr("doc_id", "explode(split(text, '\\n')) as text"))
    sizes = [f.count() for f in frames]
    numbered = [with_row_id(f) for f in frames]
    before = [scanned(f) for f in numbered]
    by_split = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"))
    moved = scanned(by_split)
    resplit()
    assert scanned(by_split.where("rid >= 0")) != moved
    for f, want, size in zip(numbered, before, sizes, strict=True):
        # a plan of its own scans anew
        assert scanned(f.where("rid >= 0")) == want
        assert len({rid for rid, _ in want}) == len(want) == size
    assert with_row_id(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_with_new_splits(spark, tmp_path, resplit, monkeypatch):
    docs = stored(spark, tmp_path)
    want = sorted(map(tuple, lines.drop_repeated_windows(docs).collect()))
    stage = lines.stage

    def then_resplit(df, name):
        out = stage(df, name)
        resplit()
        return out

    monkeypatch.setattr(lines, "stage", then_resplit)
    got = sorted(map(tuple, lines.drop_repeated_windows(docs).collect()))
    assert got == want and sum(r[3] for r in want) > 0
