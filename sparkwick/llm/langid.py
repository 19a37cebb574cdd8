"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkwick.llm.common import stage

#: Ranks of a profile, of a language as of a document.
TOP = 300
#: Characters that are worked on at once.
CHUNK = 1_000_000
#: Counts that a task holds before it passes them on.
HELD = 1_000_000
#: Languages at most; more labels mean that the column holds something else.
LANGUAGES = 1_000

_BORDER, _SPACE = 0, 1  # end of a text, and whatever is not a letter


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> lower-case code point of a letter, or _SPACE."""
    table = np.full(0x110000, _SPACE, dtype=np.int64)
    for c in range(65, 0x33480):  # the last block with letters ends below
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(texts: list[str]) -> list[np.ndarray]:
    """For each text its n-grams of one to three characters as sorted integers, with repeats.

    Letters are lower-cased, all else is one space between words; a space only stands at the
    start or end of a gram. Characters take 21 bits each, so different grams never coincide.
    """
    parts = []
    for t in texts:
        own = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        parts += [[_BORDER, _SPACE], _letters()[own], [_SPACE]]
    c = np.concatenate([*parts, [_BORDER]]).astype(np.int64)
    c = c[np.concatenate([[True], (c[1:] != _SPACE) | (c[:-1] != _SPACE)])]
    starts = np.flatnonzero(c == _BORDER)
    out = []
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        x = c[s + 1 : e]
        if len(x) < 3:  # spaces only
            out.append(np.zeros(0, dtype=np.int64))
            continue
        two = x[:-1] << 21 | x[1:]
        three = (x[:-2] << 42 | two[1:])[x[1:-1] != _SPACE]
        out.append(np.sort(np.concatenate([x[x != _SPACE], two, three])))
    return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of a sorted array and how often each occurs."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    return x[at], np.diff(np.append(at, len(x)))


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size + len(t) > CHUNK and i > start:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) summed over a task; passed on early when many different grams meet."""
    held: dict[str, list] = defaultdict(list)

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = (np.concatenate(x) for x in zip(*held[lang], strict=True))
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[at], np.add.reduceat(counts, at)

    def passed_on(lang: str) -> pa.RecordBatch:
        codes, counts = held.pop(lang)[0]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts, pa.int64())],
            names=["lang", "gram", "n"],
        )

    for batch in batches:
        langs, texts = (batch.column(i).to_pylist() for i in (0, 1))
        for a, b in _chunks(texts):
            by_lang = defaultdict(list)
            for lang, codes in zip(langs[a:b], grams(texts[a:b]), strict=True):
                if len(codes):
                    by_lang[lang].append(codes)
            for lang, found in by_lang.items():
                held[lang].append(_runs(np.sort(np.concatenate(found))))
                if sum(len(c) for c, _ in held[lang]) > HELD:
                    held[lang] = [merged(lang)]
                    if len(held[lang][0][0]) > HELD // 2:
                        yield passed_on(lang)
    for lang in list(held):
        held[lang] = [merged(lang)]
        yield passed_on(lang)


def learn(df: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[int]]:
    """The ``TOP`` most frequent n-grams of every language, most frequent first (ties: by code).

    All texts count in full; rows with a null text or language do not take part. Only the
    profiles come to the driver: ``TOP`` numbers for each of at most ``LANGUAGES`` labels.
    """
    labelled = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = (
        labelled.where("lang is not null and text is not null")
        .mapInArrow(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    # the best of each slice first, so that no task ranks all grams of a frequent language
    best = [F.desc("n"), F.asc("gram")]
    sliced = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*best)
    counts = counts.withColumn("r", F.row_number().over(sliced)).where(F.col("r") <= TOP)
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    ranked = stage(ranked.where(F.col("r") <= TOP).select("lang", "gram", "r"), "profiles")
    if ranked.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} different values of {lang}")
    profiles: dict[str, list[int]] = {}
    for row in ranked.orderBy("lang", "r").collect():
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


def identify(df: DataFrame, profiles: dict[str, list[int]], text: str = "text") -> DataFrame:
    """``df`` plus ``lang_pred`` and ``score``.

    A text's ``TOP`` most frequent n-grams are ranked; per language the ranks' differences are
    summed, ``TOP`` for a gram that its profile lacks. The smallest sum wins, ties go to the
    first label in order. ``score`` is 1 less that sum over its greatest possible value. A text that
    is null or has no letters is ``und`` with score 0, and so is every text if no profile is
    given. Repeated rows get equal results; ``lang_pred`` and ``score`` of the input are replaced.
    """
    names = sorted(profiles)
    known = np.unique(np.array([g for n in names for g in profiles[n]], dtype=np.int64))
    ranks = np.full((len(names), len(known) + 1), -1, dtype=np.int64)
    for k, n in enumerate(names):
        ranks[k, np.searchsorted(known, profiles[n])] = np.arange(len(profiles[n]))

    def predict(codes: np.ndarray) -> tuple[str, float]:
        if not len(codes) or not names:
            return "und", 0.0
        own, counts = _runs(codes)
        own = own[np.argsort(-counts, kind="stable")[:TOP]]
        at = np.searchsorted(known, own)
        at[known[np.minimum(at, len(known) - 1)] != own] = len(known)
        theirs = ranks[:, at]
        away = np.where(theirs < 0, TOP, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        k = int(np.argmin(away))
        return names[k], float(1 - away[k] / (TOP * len(own)))

    base = df.drop("lang_pred", "score")
    schema = T.StructType(
        [*base.schema.fields, T.StructField("lang_pred", T.StringType()),
         T.StructField("score", T.DoubleType())]
    )
    where = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(where).to_pylist()]
            found = [predict(g) for a, b in _chunks(texts) for g in grams(texts[a:b])]
            new = [pa.array([x for x, _ in found], pa.string()),
                   pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(batch.columns + new, names=schema.names)

    return base.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text, modulo 5, is 0 (or no id)."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
    return F.coalesce(fold == 0, F.lit(True))
