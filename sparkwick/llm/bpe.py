"""BPE encoding and decoding of whole texts; long texts are encoded as a tree of halves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwick.llm.common import with_row_id
from sparkwick.llm.tokens import LEAF, Leaf, load

_CODES = "rid long, ids binary, n_tokens long, decoded string"
_NEW = ["ids", "n_tokens", "decoded"]
_NEW_FIELDS = [
    T.StructField("ids", T.BinaryType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("decoded", T.StringType()),
]
_LEAVES = (
    "rid long, leaf_no int, text string, token int, depth int, inside boolean, "
    "piece_start long, piece_end long"
)
_LEAF_IDS = (
    "rid long, leaf_no int, ids binary, depth int, inside boolean, piece_start long, piece_end long"
)


def _rows(schema: str, columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(),
             "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[n], kinds[k]) for n, k in fields], names=[n for n, _ in fields]
    )


def encode(
    df: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (all by default) plus ``ids``, ``n_tokens`` and ``decoded`` per row.

    ``ids`` holds little-endian unsigned 32-bit token ids, ``tokenizer`` is the path of a
    byte-level BPE file that every executor has. A null text counts as empty (no tokens, empty
    ``decoded``). Repeated rows stay separate. Texts of up to ``LEAF`` characters are encoded
    whole. Longer ones are halved until every part fits a leaf, the leaves are encoded as rows of
    their own, spread over all tasks, and joined again per text. Columns of ``df`` named like a
    result are replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in _NEW]
    base = with_row_id(df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t")), "_rid")
    is_long = F.length("_t") > LEAF
    short = base.where(~is_long).select(*keep, "_t")
    schema = T.StructType([df.schema[c] for c in keep] + _NEW_FIELDS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(tokenizer)
        for batch in batches:
            found = [codec.encode(t) for t in batch.column(len(keep)).to_pylist()]
            new = [
                pa.array([x.tobytes() for x in found], pa.binary()),
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([codec.decode(x) for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(keep)] + new, names=keep + _NEW)

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(tokenizer)
        for batch in batches:
            for rid, t in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                parts = codec.split(t)
                yield _rows(_LEAVES, {
                    "rid": [rid] * len(parts), "leaf_no": list(range(len(parts))),
                    "text": [p.text for p in parts], "token": [p.token for p in parts],
                    "depth": [p.depth for p in parts], "inside": [p.inside for p in parts],
                    "piece_start": [p.left for p in parts], "piece_end": [p.right for p in parts],
                })

    def leaf_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(tokenizer)
        for batch in batches:
            x = batch.to_pydict()
            ids = [
                codec.leaf_ids(Leaf(t, k, 0, False, 0, 0)).tobytes()
                for t, k in zip(x["text"], x["token"], strict=True)
            ]
            yield _rows(_LEAF_IDS, {**x, "ids": ids})

    def join(table: pa.Table) -> pa.Table:
        codec = load(tokenizer)
        x = table.sort_by("leaf_no").to_pydict()
        leaves = [
            (Leaf("", -1, d, i, s, e), np.frombuffer(b, dtype="<u4"))
            for d, i, s, e, b in zip(
                x["depth"], x["inside"], x["piece_start"], x["piece_end"], x["ids"], strict=True
            )
        ]
        ids = codec.concatenate(leaves)
        return pa.Table.from_batches([_rows(_CODES, {
            "rid": x["rid"][:1], "ids": [ids.tobytes()], "n_tokens": [len(ids)],
            "decoded": [codec.decode(ids)],
        })])

    deep = (
        base.where(is_long)
        .select(F.col("_rid").alias("rid"), F.col("_t").alias("text"))
        .mapInArrow(halves, _LEAVES)
        .repartition("rid", "leaf_no")
        .mapInArrow(leaf_ids, _LEAF_IDS)
        .groupBy("rid")
        .applyInArrow(join, _CODES)
        .withColumnRenamed("rid", "_rid")
    )
    deep = base.where(is_long).select("_rid", *keep).join(deep, "_rid").select(*keep, *_NEW)
    return short.mapInArrow(whole, schema).union(deep)
