"""Helpers the text operators share: staged tables, row ids, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwick.operators.scan import BROADCAST_BYTES
from sparkwick.sources.staging import checkpoint_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a row id that number the rows of a file.
ROW_BITS = 40
#: Buckets in which files are numbered; with 23 bits left, 8 million files have numbers.
FILE_BUCKETS = 4096


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, changed where ``df`` has a column that is called so (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark, name: str) -> str:
    """A fresh folder below the cluster's checkpoint folder, which every executor can reach."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder once and continue from the stored table.

    Later steps start from files on shared storage, so a lost executor costs one task and not the
    steps before; the shuffle files of the step are removed as soon as the table stands.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _is_plain_read(df: DataFrame) -> bool:
    """Whether every row of ``df`` is one row of a Parquet file, by its plan."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.child()
    if node.nodeName() != "LogicalRelation":
        return False
    relation = node.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """Number the rows of a table (not dense); every scan of the result gives the same numbers.

    Rows of a plain read of Parquet files are numbered by their file and their place in it, which
    no split of the scan changes. Any other table is stored once with its numbers.
    """
    if not _is_plain_read(df):
        return stage(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    no, file, row = fresh(df, "_no", "_file", "_row")
    path = F.col("_metadata.file_path")
    # files are numbered inside hash buckets, so neither a task nor the driver sees all their paths
    paths = df.select(path.alias(file)).distinct()
    bucket = F.pmod(F.xxhash64(file), F.lit(FILE_BUCKETS))
    place = F.row_number().over(Window.partitionBy(bucket).orderBy(file)) - 1
    files = stage(paths.select(file, (place.cast("long") * FILE_BUCKETS + bucket).alias(no)), "files")
    size = files.agg(F.sum(F.octet_length(file) + 8)).first()[0] or 0
    files = F.broadcast(files) if size <= BROADCAST_BYTES else files
    numbered = df.select(*df.columns, path.alias(file), F.col("_metadata.row_index").alias(row))
    rid = F.shiftleft(no, ROW_BITS).bitwiseOR(F.col(row)).alias(name)
    return numbered.join(files, file).select(*df.columns, rid)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by (smallest member, member) of its local components."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        u, v = at[: len(a)], at[len(a) :]
        root = np.arange(len(nodes))
        while True:  # hook every edge's larger root below the smaller one, then flatten
            ru, rv = root[u], root[v]
            lo, hi = np.minimum(ru, rv), np.maximum(ru, rv)
            if (lo == hi).all():
                break
            np.minimum.at(root, hi, lo)
            while (root != root[root]).any():
                root = root[root]
        keep = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[root[keep]]), pa.array(nodes[keep])], names=["a", "b"]
        )


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for all nodes of ``edges`` (a, b long).

    Contraction: every round first shrinks the edges of each task to a spanning forest, then
    points every node at its smallest neighbour and replaces edge ends by what they point at. The
    number of nodes at least halves per round; nothing is gathered outside the executors.
    """
    steps = []
    edges = edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long").distinct()
    edges = stage(edges, "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        to = stage(to.select("node", F.least("node", "parent").alias("parent")), "parents")
        steps.append(to)
        left = to.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = to.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = (
            edges.join(left, "a")
            .join(right, "b")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .where("a <> b")
            .mapInArrow(_forest, "a long, b long")
            .distinct()
        )
        edges = stage(edges, "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = steps[-1].select("node", F.col("parent").alias("component"))
    for to in reversed(steps[:-1]):
        up = out.select(F.col("node").alias("parent"), F.col("component"))
        out = to.join(up, "parent", "left").select(
            "node", F.coalesce("component", "parent").alias("component")
        )
    return out
