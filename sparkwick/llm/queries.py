"""Registered queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwick.llm import (
    ann, audit, bpe, codes, divergence, jaccard, langid, lattice, lines, packing, pii, suffix, warc,
)
from sparkwick.llm.common import shared_folder, stage

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    return bpe.encode(_documents(spark, sf_dir), TOKENIZER, keep=["doc_id"]).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose word shingles overlap by three quarters."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return jaccard.join(docs).select("doc_id", "n_shingles", "component_id", "is_kept")


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 400 bytes that occur more than once."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return suffix.drop_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts of base spans and all spans."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    base = F.col("base")
    return found.select(
        "doc_id",
        *(pii.count(base, kind).alias(f"n_{kind}") for kind in pii.BASE),
        F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"),
        pii.listed(pii.merged(base, F.col("added"))).alias("spans"),
    )


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product of every twentieth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of vectors of one label whose cosine is at least 0.98."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = lattice.near_duplicates(vectors)
    return found.select("vec_id", "n_links", "component_id", "kept")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the later copies of three-line windows."""
    out = lines.drop_repeated_windows(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.length("text").cast("long").alias("n_chars_kept"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


OP7_SQL = """
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), line AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d WHERE text IS NOT NULL
), win AS (
  SELECT doc_id, i, row_number() OVER (
    PARTITION BY line, line2, line3 ORDER BY doc_id, i) AS rank
  FROM (
    SELECT doc_id, i, line, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3
    FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY i)
  ) WHERE line3 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM win, (VALUES (0), (1), (2)) AS o(k) WHERE rank > 1
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) AS n
  FROM line ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id,
  CASE WHEN text IS NULL THEN 0 ELSE len(l) END AS n_lines,
  CASE WHEN text IS NULL THEN 0 ELSE len(l) - coalesce(n, 0) END AS n_removed,
  CASE WHEN text IS NOT NULL THEN length(coalesce(kept, '')) END AS n_chars_kept,
  CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by profiles learned from four of five folds."""
    docs = _documents(spark, sf_dir)
    profiles = langid.learn(docs.where(~langid.held_out()))
    docs = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.identify(docs, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives, normalised, and read back by offset."""
    plain, members = shared_folder(spark, "warc"), shared_folder(spark, "members")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), plain)
    stage(warc.normalise(spark, plain, members), "archives")
    return warc.read_archives(spark, members).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest,
    strlen(coalesce(html, '')) AS payload_bytes FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM g
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    pieces = stage(packing.cut_pieces(_documents(spark, sf_dir), TOKENIZER), "pieces")
    return packing.pack(pieces).drop("rid")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every document: base counts and divergence from its language."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    rows, facts = divergence.measure(docs)
    judged = divergence.judge(rows, facts, divergence.learn(rows, facts))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("js_chars", 6).alias("js_chars"), F.round("js_words", 6).alias("js_words"),
    )


OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, text, coalesce(text, '') AS t FROM documents
), c AS MATERIALIZED (
  SELECT r, doc_id, lang, text, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
    regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+') AS lw, length(t) AS n,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS symbol,
    length(t) - length(regexp_replace(t, '\p{Ll}+', '', 'g')) AS low,
    length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS up,
    length(t) - length(regexp_replace(t, '\p{Nd}+', '', 'g')) AS digit,
    length(t) - length(regexp_replace(t, '[.,;:]+', '', 'g')) AS stop,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), cc AS (
  SELECT *, [n - word_chars, symbol, low, up, digit, stop, word_chars - symbol - low - up - digit - stop] AS k FROM c
), steps AS (
  SELECT lang, i, k[i] * 1000 // n AS step, count(*) AS votes
  FROM cc, range(1, 8) AS g(i) WHERE lang IS NOT NULL AND n >= 200 GROUP BY ALL
), mid AS (
  SELECT lang, i, min(step) AS step FROM (
    SELECT *, sum(votes) OVER (PARTITION BY lang, i ORDER BY step) AS upto,
      sum(votes) OVER (PARTITION BY lang, i) AS total FROM steps) WHERE 2 * upto >= total GROUP BY ALL
), rc AS (
  SELECT lang, i, 0.99::DOUBLE * step / sum(step) OVER (PARTITION BY lang) + 0.01::DOUBLE / 7 AS q FROM mid
), wc AS (
  SELECT lang, w, count(*) AS m FROM (SELECT lang, unnest(lw) AS w FROM c WHERE lang IS NOT NULL AND text IS NOT NULL) GROUP BY ALL
), wr AS (
  SELECT lang, w, m::DOUBLE / sum(m) OVER (PARTITION BY lang) AS q,
    row_number() OVER (PARTITION BY lang ORDER BY m DESC, w) AS rank FROM wc
), rw AS (
  SELECT lang, w, q FROM wr WHERE rank <= 32
  UNION ALL SELECT lang, NULL, 1 - sum(q) FROM wr WHERE rank <= 32 GROUP BY lang
), pairs AS (
  SELECT r, cc.lang AS own, x.lang AS ref FROM cc JOIN (SELECT DISTINCT lang FROM rc SEMI JOIN rw USING (lang)) x
    ON cc.lang = x.lang OR cc.lang IS NULL
), jc AS (
  SELECT r, ref, sqrt(greatest(sum(
    (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 0)) AS js
  FROM (SELECT pairs.r, ref, k[i]::DOUBLE / n AS p, q FROM pairs JOIN cc USING (r) JOIN rc ON rc.lang = ref WHERE n >= 200)
  GROUP BY ALL
), dw AS (
  SELECT r, w, count(*) AS m FROM (SELECT r, unnest(lw) AS w FROM c WHERE len(lw) >= 50) GROUP BY ALL
), hit AS (
  SELECT pairs.r, ref, len(lw) AS n, rw.w, q, coalesce(dw.m, 0) AS m
  FROM pairs JOIN c USING (r) JOIN rw ON rw.lang = ref LEFT JOIN dw ON dw.r = pairs.r AND dw.w = rw.w WHERE len(lw) >= 50
), hits AS (
  SELECT r, ref, q, (CASE WHEN w IS NULL THEN n - sum(m) OVER (PARTITION BY r, ref) ELSE m END)::DOUBLE / n AS p FROM hit
), jw AS (
  SELECT r, ref, sqrt(greatest(sum(
    (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2), 0)) AS js
  FROM hits GROUP BY ALL
), win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, e) AS same FROM (
    SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS e
    FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM c WHERE len(words) >= 3))
), rep AS (
  SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM win, range(0, 3) AS g(o) WHERE same > 1 GROUP BY r
), base AS (
  SELECT c.*, len(words) AS n_words, coalesce(n_repeat_words, 0) AS nrw,
    len(words) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(words) AS base_failed
  FROM c LEFT JOIN rep USING (r)
), j AS (
  SELECT base.*, CASE WHEN NOT base_failed THEN (SELECT min(js) FROM jc WHERE jc.r = base.r) END AS jsc,
    CASE WHEN NOT base_failed THEN (SELECT min(js) FROM jw WHERE jw.r = base.r) END AS jsw FROM base
)
SELECT doc_id, n_words, word_chars, symbol AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  nrw AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(jsc, 0) <= 0.195 AND coalesce(jsw, 0) <= 0.40 AS kept,
  round(jsc, 6) AS js_chars, round(jsw, 6) AS js_words
FROM j
"""


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source in each of their 120 orders."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _documents(spark, sf_dir).select(
        "doc_id", "source", text.alias("text"), F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1).alias("words")
    )
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    facts = docs.select(
        "doc_id",
        "source",
        (F.size("words") < 50).alias("a"),
        (100 * F.size(F.array_distinct("words")) < 65 * F.size("words")).alias("b"),
        (100 * capitals > 5 * F.length("text")).alias("c"),
        F.col("text").rlike("[#$%&*|]").alias("d"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
    )
    facts = stage(facts, "facts")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    first = audit.first_of_equals(facts, "digest", "doc_id")
    rows = facts.join(first, ["digest", "doc_id"], "left").join(labels, "doc_id", "left")
    repeat = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return audit.interactions(
        rows,
        {"A": F.col("a"), "B": F.col("b"), "C": F.col("c"), "D": F.col("d"), "E": repeat},
        F.col("source"),
        {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")},
    )


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT w.part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
      100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN l USING (doc_id)
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
), x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) v(x, i)
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS pos
  FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT part, filter_order, step::INTEGER AS step, pos[step] AS i, fails, n, good, toxic, fails[pos[step]] AS here,
    len(list_filter(pos[1:step - 1], lambda p: fails[p])) > 0 AS gone
  FROM g, o, range(1, 6) AS r(step)
), sums AS (
  SELECT part, filter_order, step, i,
    coalesce(sum(n) FILTER (NOT gone AND NOT here), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND here), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND here), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (here AND len(list_filter(fails, lambda p: p)) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (NOT gone AND here), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND here), 0)::BIGINT AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT * EXCLUDE (i), sum(removed) OVER (PARTITION BY part, i)::BIGINT AS shapley FROM sums
"""


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors and their errors."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return codes.compress(vectors).drop("embedding", "label")


def _op13_sql(rounds: int = codes.ROUNDS) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT q.r, q.p, min(list_sum(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 16 + c.e) AS m
  FROM q JOIN c{k} c USING (p) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""s{k} AS (
  SELECT p, e, j, sum(x)::BIGINT AS s, count(*) AS n FROM (
    SELECT q.p, (m % 16)::BIGINT AS e, unnest(q.v) AS x, generate_subscripts(q.v, 1) AS j FROM q JOIN a{k} USING (r, p))
  GROUP BY ALL), c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(x.v, c.v) AS v FROM c{k} c LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{k} GROUP BY ALL) x USING (p, e))""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
    list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS v FROM k, range(8) AS g(p)
), c0 AS (SELECT p, r - 1 AS e, v FROM q WHERE r <= 16),
{", ".join(steps)},
books AS (
  SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM c{rounds})
), t AS (
  SELECT vec_id, label, string_agg(printf('%02x', (m % 16)::INTEGER), '' ORDER BY p) AS code, sum(m // 16)::BIGINT AS error
  FROM a{rounds} JOIN k USING (r) GROUP BY r, vec_id, label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM t, books
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_bpe": op2_bpe,
    "op3_suffix": op3_suffix,
    "op4_pii": op4_pii,
    "op5_ann": op5_ann,
    "op6_lattice": op6_lattice,
    "op7_lines": op7_lines,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_langid": op10_langid,
    "op11_quality": op11_quality,
    "op12_audit": op12_audit,
    "op13_codes": op13_codes,
}

ORACLES: dict[str, str] = {
    "op7_lines": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op11_quality": OP11_SQL,
    "op12_audit": OP12_SQL,
    "op13_codes": _op13_sql(),
}
