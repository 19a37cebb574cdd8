"""Quality rules by distribution divergence, in DataFrame functions only.

Every language gets a reference: the shares of character classes in its texts and the shares of its
most frequent words. A document is compared with the reference of its language by the Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1) of either histogram, if it is long enough
for a histogram to say something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwick.llm.common import fresh, stage, with_row_id

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: Character classes besides spaces and the rest, as regular expressions.
CLASSES = {"symbol": rf"[{SYMBOLS}]", "lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "stop": "[.,;:]"}
#: Words of a reference; the others of a text share one more bin.
COMMON_WORDS = 32
#: Documents with fewer words than this fail the base rule.
LEAST_WORDS = 50
#: Histograms of fewer characters or words are not judged.
GUARD_CHARS, GUARD_WORDS = 200, 50
#: Distances above these mark a document as unlike its language. On the labelled documents of the
#: test tables 99.9 % of the clean ones of 50 words and more lie below 0.196 and 0.35.
MOST_CHARS, MOST_WORDS = 0.195, 0.40
#: Shares of character classes are medians in steps of a thousandth; this part of a reference is
#: spread over all classes, so a class that a language hardly uses does not decide alone.
STEPS, SPREAD = 1000, 0.01
#: References are broadcast up to this many languages (about 1 KB each), joined by shuffle beyond.
BROADCAST_LANGUAGES = 1000


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row however often it is named."""
    return F.transform(F.array(value), body)[0]


def _long(c: Column) -> Column:
    return c.cast("long")


def _words(text: Column) -> Column:
    """Maximal runs of characters that are no spaces."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that stand twice or more in the text.

    Windows are told apart by 64-bit hashes inside one text. Only texts with a repeat are sorted:
    equal windows become neighbours, and the words they cover are counted once.
    """

    def covered(hashes):
        places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s):
            same = F.filter(
                s,
                lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]),
            )
            three = F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
            return F.size(F.array_distinct(F.flatten(three)))

        all_differ = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(all_differ, 0).otherwise(_once(places, repeated))

    def windows(w):
        # a range of starts; with fewer than three words there is none
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, 0).otherwise(_once(hashes, covered))

    return _long(_once(words, windows))


def _class_counts(text: Column) -> Column:
    """Struct of ``word_chars``, the characters of each class, and ``rest``.

    One class after the other is taken out, so later ones are looked for in what is left.
    """
    names = ["word_chars", *CLASSES]
    patterns = [f"[{SPACE}]+", *(f"{p}+" for p in CLASSES.values())]

    def take(left: Column, i: int, sizes: list[Column]) -> Column:
        sizes = [*sizes, _long(F.length(left))]
        if i == len(patterns):
            space_free = sizes[1].alias(names[0])
            named = [(a - b).alias(n) for n, a, b in zip(names[1:], sizes[1:-1], sizes[2:], strict=True)]
            return F.struct(space_free, *named, sizes[-1].alias("rest"))
        return _once(F.regexp_replace(left, patterns[i], ""), lambda x: take(x, i + 1, sizes))

    return take(text, 0, [])


def _key(lang: Column) -> Column:
    """A join key of a language; null has its own."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def measure(df: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """``df`` with row ids, and per id its language and the counts of its text (null: empty).

    The counts are stored once; references and verdicts are both made from them.
    """
    rows = with_row_id(df, *fresh(df, "rid"))
    whole = F.coalesce(F.col(_quoted(text)), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    facts = rows.select(
        F.col(rows.columns[-1]).alias("rid"),
        F.col(_quoted(lang)).cast("string").alias("lang"),
        _long(F.length(whole)).alias("n_chars"),
        _class_counts(whole).alias("c"),
        _once(_words(whole), lambda w: F.struct(
            _long(F.size(w)).alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"),
        _long(_once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
    )
    return rows, stage(facts.select("rid", "lang", "n_chars", "c.*", "w.*", "n_dup_lines"), "facts")


def _classes() -> list[Column]:
    """Characters of each class, spaces and the rest included; they add up to the length."""
    return [F.col("n_chars") - F.col("word_chars"), *(F.col(n) for n in CLASSES), F.col("rest")]


def _lower_words(rows: DataFrame, text: str, lang: str) -> DataFrame:
    words = _words(F.lower(F.coalesce(F.col(_quoted(text)), F.lit(""))))
    return rows.select(
        F.col(rows.columns[-1]).alias("rid"), F.col(_quoted(lang)).cast("string").alias("lang"), F.explode(words).alias("word")
    )


def learn(
    rows: DataFrame, facts: DataFrame, text: str = "text", lang: str = "lang",
    common_words: int = COMMON_WORDS,
) -> DataFrame:
    """References: ``lang``, ``chars`` (shares), ``words`` (common ones), ``shares`` (others last).

    Every row with a text and a language counts. A class share is the median over the texts of at
    least ``GUARD_CHARS`` characters, from counts per thousandth, so a minority of odd texts does
    not move it. Words are compared in lower case and counted before the shuffle; the
    ``common_words`` most frequent ones (ties: the smaller word) are kept per task first, so no
    task sees all words of a language. A language without a long text has no reference.
    """
    sizes = facts.where(F.col("lang").isNotNull() & (F.col("n_chars") >= GUARD_CHARS))
    step = [F.floor(STEPS * x / F.col("n_chars")) for x in _classes()]
    votes = sizes.select("lang", F.posexplode(F.array(*step)).alias("class", "step"))
    votes = votes.groupBy("lang", "class", "step").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("lang", "class")
    upto = F.sum("n").over(whole.orderBy("step"))
    middle = votes.select("lang", "class", "step", (2 * upto >= F.sum("n").over(whole)).alias("half"))
    middle = middle.where("half").groupBy("lang", "class").agg(F.min("step").alias("step"))
    middle = middle.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("class", "step"))).alias("m"))
    steps = F.transform("m.step", lambda x: x.cast("double"))
    total = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)
    even = SPREAD / (len(CLASSES) + 2)
    chars = middle.select(
        "lang", F.transform(steps, lambda x: (1 - SPREAD) * x / total + even).alias("chars")
    )

    words = _lower_words(rows, text, lang).where(F.col("lang").isNotNull())
    counts = stage(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= common_words)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    share = F.transform("top.n", lambda n: n / F.col("total"))
    left = F.aggregate("top.n", F.col("total"), lambda a, n: a - n) / F.col("total")
    found = top.join(total, "lang").join(chars, "lang")
    return stage(
        found.select(
            "lang", "chars", F.col("top.word").alias("words"), F.array_append(share, left).alias("shares")
        ),
        "references",
    )


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two lists of shares."""

    def term(x, y):
        m = (x + y) / 2
        half = lambda z: F.when(z > 0, z * F.log2(z / m)).otherwise(0.0)
        return (half(x) + half(y)) / 2

    bits = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(bits, F.lit(0.0)))


def judge(
    rows: DataFrame, facts: DataFrame, references: DataFrame, text: str = "text", lang: str = "lang",
    most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS,
) -> DataFrame:
    """The measured rows with counts, distances and verdict; columns of these names are replaced.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``js_chars``, ``js_words`` and ``kept``. A null or empty text has no words and
    fails the base rule. The distances are null where a text is shorter than the guards, where the
    base rule has failed already, or where its language has no reference; a null distance never
    rejects. A row whose language is null is held against the nearest reference. Repeated rows are
    judged alike; an empty table gives no rows.

    Words are looked up in the references where they are read and leave their task as one row of
    counts per document. A text is handled inside one task, in memory that is a multiple of it.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
           "js_chars", "js_words", "kept")
    rid, verdicts = rows.columns[-1], *fresh(rows, "verdict")
    references = references.select("*", F.col("lang").alias("ref"))
    bins = references.agg(F.max(F.size("words"))).first()[0] or 0
    few = references.count() <= BROADCAST_LANGUAGES
    small = F.broadcast if few else lambda x: x
    keyed = references.withColumn("key", _key(F.col("lang")))
    keyed = keyed.unionByName(references.withColumn("key", F.lit("")))

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    facts = facts.withColumn("base_failed", failed).withColumn("key", _key(F.col("lang")))
    pairs = facts.where(~F.col("base_failed")).join(small(keyed.drop("lang", "words")), "key")

    entries = keyed.select("key", "ref", F.posexplode("words").alias("bin", "word"))
    entries = entries.groupBy("key", "word").agg(F.collect_list(F.struct("ref", "bin")).alias("at"))
    found = _lower_words(rows, text, lang).withColumn("key", _key(F.col("lang")))
    found = found.join(small(entries), ["key", "word"]).select("rid", F.explode("at").alias("at"))
    found = found.groupBy("rid", F.col("at.ref").alias("ref")).agg(
        F.array(*(F.count_if(F.col("at.bin") == i) for i in range(bins))).alias("counts")
    )
    pairs = pairs.join(found, ["rid", "ref"], "left")
    n = F.col("n_words").cast("double")
    counts = F.slice(F.coalesce("counts", F.array_repeat(F.lit(0).cast("long"), bins)), 1, F.size("shares") - 1)
    others = n - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    word_shares = F.array_append(F.transform(counts, lambda x: x / n), others / n)
    char_shares = F.array(*(x / F.col("n_chars") for x in _classes()))
    distances = pairs.groupBy("rid").agg(
        F.min(F.when(F.col("n_chars") >= GUARD_CHARS, _distance(char_shares, F.col("chars")))).alias("js_chars"),
        F.min(F.when(n >= GUARD_WORDS, _distance(word_shares, F.col("shares")))).alias("js_words"),
    )
    unlike = (F.coalesce("js_chars", F.lit(0.0)) > most_chars) | (
        F.coalesce("js_words", F.lit(0.0)) > most_words
    )
    verdict = facts.join(distances, "rid", "left").select(
        F.col("rid").alias(rid), F.struct(
            "n_words", "word_chars", F.col("symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
            "base_failed", "js_chars", "js_words", (~F.col("base_failed") & ~unlike).alias("kept"),
        ).alias(verdicts),
    )
    replaced = {x.lower() for x in new}
    own = [F.col(_quoted(x)) for x in rows.columns[:-1] if x.lower() not in replaced]
    return rows.join(verdict, rid).select(*own, *(F.col(f"{verdicts}.{x}").alias(x) for x in new))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
