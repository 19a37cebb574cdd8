"""Personal data by weak supervision, in DataFrame functions only.

Base spans (e-mail, IP, card and phone patterns with their checks) always stand. Further
candidates, wider patterns for obfuscated addresses, local phone numbers, secrets and names, are
judged: four labelers (shape, gazetteer, context, variety of characters) vote yes, no or nothing on
each. Expectation-maximisation estimates how reliable every labeler is per kind, the resulting
probabilities train a logistic classifier over votes, kind and length, and its yes adds a span.
What the driver sees are counts of vote patterns: at most ``4 * 3 ** 4 * 4`` rows at any size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns. Runs are entered at their start only (or where the last match
# ended) and never given back in part: the same matches, in linear time and without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds in the order in which spans are listed.
KINDS = [*BASE, "name", "secret"]
#: Candidates that the classifier judges.
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? "
_AT, _DOT = r" ?[(\[] ?at ?[)\]] ?", r" ?[(\[] ?dot ?[)\]] ?"
WIDE = "|".join(
    [
        rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++",
        r"(?<![A-Za-z0-9+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])",
        rf"(?<!\p{{L}}){_TITLE}\p{{Lu}}[\p{{L}}'-]{{1,30}}+(?: \p{{Lu}}[\p{{L}}'-]{{1,30}}+)?",
        r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
    ]
)
WORDS = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "phone": "phone|call|tel|fax|mobile|ring|telefon|téléphone|teléfono",
    "secret": "token|secret|passw|pwd|api.?key|credential|bearer|private.?key",
    "name": "name|contact|signed|author|dear|sincerely|regards",
}
NOT_WORDS = "version|isbn|order|sku|sha[0-9]*|commit|hash|checksum|digest|page|figure"
FIRST_NAMES = (
    "Anna|Antonio|Carlos|Claire|David|Elena|Emma|Hans|James|Jean|John|José|Karl|Laura|Louis|Lucas|"
    "Maria|Marie|Mary|Michael|Paul|Peter|Pierre|Robert|Sarah|Sofia|Thomas|William"
)
_JUDGED = ["email", "phone", "name", "secret"]
_VOTES = ["shape", "gazetteer", "context", "variety"]
_BLOCK = 256


def _runs(df: DataFrame, text: str, name: str, pattern: str, guard: Column) -> DataFrame:
    """Column ``name``: for each match its start, end (code points), text and text before/after."""
    df = df.withColumn("_m", F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    some = F.size("_m") > 0
    df = df.withColumn("_g", F.when(some, F.split(text, pattern, -1)))
    gap = lambda g: F.struct(
        F.length(g).alias("n"), F.substring(g, -40, 40).alias("end"), F.substring(g, 1, 12).alias("top")
    )
    df = df.withColumn("_g", F.transform("_g", gap))
    item = F.transform("_m", lambda m, i: F.struct(
        F.get("_g", i)["n"].alias("g"), F.length(m).alias("l"), m.alias("m"),
        F.get("_g", i)["end"].alias("before"), F.get("_g", i + 1)["top"].alias("after")))
    df = df.withColumn("_z", F.when(some, item))
    # positions are running sums, block by block so that long lists stay cheap
    count = F.floor((F.size("_z") - 1) / _BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), count), lambda b: F.slice("_z", b * _BLOCK + 1, F.lit(_BLOCK))
    )
    df = df.withColumn("_b", F.when(some, blocks))
    total = lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["g"] + x["l"])
    df = df.withColumn("_s", F.transform("_b", total))
    none = F.array().cast("array<int>")
    starts = F.aggregate(
        "_s", F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        lambda a: a["out"],
    )
    kind = "array<struct<s:int,e:int,m:string,before:string,after:string>>"

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["g"]
        new = F.struct(s.alias("s"), (s + x["l"]).alias("e"), x["m"], x["before"], x["after"])
        return F.struct(
            (s + x["l"]).alias("at"), F.concat(a["out"], F.array(new)).cast(kind).alias("out")
        )

    placed = F.flatten(F.zip_with("_b", starts, lambda b, at: F.aggregate(
        b, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])))
    return df.withColumn(name, placed).drop("_m", "_g", "_z", "_b", "_s")


def _computed(x: Column) -> Column:
    """``x``, computed once per row: the optimizer neither pushes filters into it nor inlines it.

    A filter on a result, or on what is exploded, would else repeat the whole expression with
    its lists of matches inside the functions over them, so that a text costs at least the square
    of its matches.
    """
    return F.when(F.monotonically_increasing_id() >= 0, x)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, x: Column) -> Column:
    """The check that a match of a base pattern must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        small = lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255")
        return F.forall(parts, small)
    n = F.length(_digits(x))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    each = F.transform(
        F.split(F.reverse(_digits(x)), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    luhn = F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0
    return F.when((n >= 13) & (n <= 19), luhn).otherwise(False)


def _guards(text: str) -> dict[str, Column]:
    t = F.col(text)
    return {
        "email": t.contains("@"),
        "ip": t.rlike(r"[0-9]\.[0-9]"),
        "card": t.rlike(r"[0-9]"),
        "phone": t.contains("+"),
    }


def _with_candidates(df: DataFrame, text: str) -> DataFrame:
    """Column ``_c``: the judged candidates with kind, votes and length class."""
    df = _runs(df, text, "_c", WIDE, F.col(text).isNotNull())

    def describe(c: Column) -> Column:
        m, before, low = c["m"], c["before"], F.lower(c["before"])
        kind = (
            F.when(m.rlike("^" + _TITLE), "name")
            .when(m.rlike(_AT), "email")
            .when(m.rlike(r"^[(]?[0-9]{3}[-. )]"), "phone")
            .otherwise("secret")
        )
        yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
        digit, letter = m.rlike("[0-9]"), m.rlike("[A-Za-z]")
        mixed = m.rlike("[a-z]") & m.rlike("[A-Z]")
        shape = (
            F.when(kind == "phone", F.when(m.rlike(r"^[(]?[2-9][0-9]{2}\D{1,2}[2-9]"), yes).otherwise(no))
            .when(kind == "secret", F.when(~digit | ~letter, no)
                  .when(m.rlike("^[0-9a-f]{32,}$") | mixed, yes).otherwise(none))
            .when(kind == "email", F.when(m.rlike(r"\.|dot"), yes).otherwise(none))
            .otherwise(F.when(m.rlike(r" .+ "), yes).otherwise(none))
        )
        told = F.coalesce(*(F.when(kind == k, low.rlike(w)) for k, w in WORDS.items()))
        known = F.when(kind == "name", m.rlike(rf"\b(?:{FIRST_NAMES})\b")).otherwise(False)
        gazetteer = F.when(told | known, yes).when(low.rlike(NOT_WORDS), no).otherwise(none)
        context = (
            F.when(before.rlike(r"[=:]\s?[\"']?$"), yes)
            .when(before.rlike(r"[0-9/*#&?]$") | c["after"].rlike(r"^[0-9/*#&?]"), no)
            .otherwise(none)
        )
        share = F.size(F.array_distinct(F.split(m, ""))) / F.length(m)
        variety = F.when(kind != "secret", none).when(share >= 0.25, yes).otherwise(no)
        n = F.length(m)
        size = F.when(n < 16, 0).when(n < 32, 1).when(n < 64, 2).otherwise(3)
        return F.struct(
            kind.alias("kind"), c["s"].alias("s"), c["e"].alias("e"), m.alias("m"),
            shape.alias("shape"), gazetteer.alias("gazetteer"), context.alias("context"),
            variety.alias("variety"), size.alias("size"),
        )

    return df.withColumn("_c", F.transform("_c", describe))


@dataclass
class Model:
    """Weights of the span classifier, and the labelers' estimated rates behind its labels."""

    bias: dict[str, float] = field(default_factory=dict)
    votes: dict[tuple[str, int], float] = field(default_factory=dict)
    sizes: dict[int, float] = field(default_factory=dict)
    rates: dict[tuple[str, str], list[list[float]]] = field(default_factory=dict)

    def says(self, c: Column) -> Column:
        def of(column: Column, weights: dict) -> Column:
            out = F.lit(0.0)
            for k, w in weights.items():
                out = F.when(column == F.lit(k), F.lit(w)).otherwise(out)
            return out

        total = of(c["kind"], self.bias) + of(c["size"], self.sizes)
        for name in _VOTES:
            total += of(c[name], {v: w for (n, v), w in self.votes.items() if n == name})
        return (total > 0) & c["kind"].isin(list(self.bias))


def aggregate_votes(patterns: list[dict], rounds: int = 50) -> tuple[np.ndarray, dict]:
    """Probability of each vote pattern (with kind, votes, count) being personal data.

    Expectation-maximisation per kind: votes are independent given the truth; every labeler has a
    distribution over its three votes for either truth, starting at more right than wrong.
    """
    truth = np.zeros(len(patterns))
    rates: dict[tuple[str, str], list[list[float]]] = {}
    for kind in _JUDGED:
        at = [i for i, p in enumerate(patterns) if p["kind"] == kind]
        if not at:
            continue
        n = np.array([patterns[i]["n"] for i in at], dtype=float)
        votes = np.array([[patterns[i][v] + 1 for v in _VOTES] for i in at])
        start = np.array([[0.5, 0.35, 0.15], [0.15, 0.35, 0.5]])
        rate = np.repeat(start[None], len(_VOTES), axis=0)  # labeler, truth, vote
        prior = 0.5
        for _ in range(rounds):
            like = np.array([1 - prior, prior])[None].repeat(len(at), axis=0)
            for k in range(len(_VOTES)):
                like = like * rate[k][:, votes[:, k]].T
            post = like[:, 1] / like.sum(axis=1)
            prior = float(np.clip((n * post).sum() / n.sum(), 0.01, 0.99))
            for k in range(len(_VOTES)):
                for truth_is, w in ((0, n * (1 - post)), (1, n * post)):
                    mass = np.bincount(votes[:, k], w, minlength=3) + 10 * start[truth_is]
                    rate[k][truth_is] = mass / mass.sum()
        truth[at] = post
        rates |= {(kind, v): rate[k].tolist() for k, v in enumerate(_VOTES)}
    return truth, rates


def fit(df: DataFrame, text: str = "text") -> Model:
    """Train the classifier on the candidates of all texts."""
    found = _with_candidates(df.select(text), text).select(_computed(F.col("_c")).alias("_c"))
    found = found.select(F.explode("_c").alias("c"))
    keys = ["kind", *_VOTES, "size"]
    counted = found.groupBy(*(F.col(f"c.{k}").alias(k) for k in keys)).agg(F.count("*").alias("n"))
    patterns = [r.asDict() for r in counted.collect()]
    if not patterns:
        return Model()
    patterns.sort(key=lambda p: tuple(str(p[k]) for k in keys))
    truth, rates = aggregate_votes(patterns)
    columns = [("kind", k) for k in _JUDGED] + [("size", s) for s in range(4)]
    columns += [(v, x) for v in _VOTES for x in (-1, 1)]
    x = np.array([[float(p[name] == value) for name, value in columns] for p in patterns])
    n = np.sqrt([p["n"] for p in patterns])  # frequent patterns weigh more, but not alone
    w = np.zeros(len(columns))
    for _ in range(30):  # Newton steps of ridge logistic regression on soft labels
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (truth - p)) - 0.1 * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    by = dict(zip(columns, w.tolist(), strict=True))
    kinds = {p["kind"] for p in patterns}
    return Model(
        {k: by["kind", k] for k in _JUDGED if k in kinds},
        {(v, x): by[v, x] for v in _VOTES for x in (-1, 1)},
        {s: by["size", s] for s in range(4)},
        rates,
    )


def _base_spans(kind: str) -> Column:
    spans = F.filter(f"_{kind}", lambda x: _valid(kind, x["m"]))
    number = F.lit(KINDS.index(kind))
    shaped = F.transform(
        spans, lambda x: F.struct(number.alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    )
    return F.coalesce(shaped, F.array().cast("array<struct<k:int,s:int,e:int>>"))


def _in_blocks(spans: str) -> Column:
    """The spans of a column sorted by start, in blocks with the stretch (s, e) that each covers."""
    count = F.floor((F.size(spans) - 1) / _BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), count), lambda b: F.slice(spans, b * _BLOCK + 1, F.lit(_BLOCK))
    )
    covered = F.transform(blocks, lambda b: F.struct(
        F.get(b, F.lit(0))["s"].alias("s"), F.array_max(F.transform(b, lambda x: x["e"])).alias("e"),
        b.alias("spans")))
    none = F.array().cast("array<struct<s:int,e:int,spans:array<struct<s:int,e:int>>>>")
    return F.when(F.size(spans) > 0, covered).otherwise(none)


def find(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` plus ``base`` and ``added``: arrays of (kind, start, end), by kind, then start.

    Positions are code points, ends exclusive. Base spans are leftmost and do not overlap within
    their kind; a match that fails its check is dropped. Added spans overlap no base span. A null
    or empty text has none. Repeated rows get equal results; columns named ``base`` and ``added``
    are replaced.
    """
    keep = [c for c in df.columns if c not in ("base", "added")]
    out = df.select(*keep)
    guards = _guards(text)
    for kind, pattern in BASE.items():
        out = _runs(out, text, f"_{kind}", pattern, guards[kind])
        out = out.withColumn(f"_{kind}", _base_spans(kind))
    out = out.withColumn("base", F.concat(*(f"_{k}" for k in BASE)))
    out = _with_candidates(out, text)
    brief = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    out = out.withColumn("_h", _computed(F.sort_array(brief)))
    out = out.withColumn("_h", _computed(_in_blocks("_h")))
    meets = lambda b, c: (b["s"] < c["e"]) & (c["s"] < b["e"])
    clear = lambda c: ~F.exists("_h", lambda h: meets(h, c) & F.exists(
        h["spans"], lambda b: meets(b, c)))
    number = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c["kind"]) - 1
    added = F.transform(F.filter("_c", lambda c: model.says(c) & clear(c)), lambda c: F.struct(
        number(c).cast("int").alias("k"), c["s"].alias("s"), c["e"].alias("e")))
    added = F.sort_array(F.coalesce(added, F.array().cast("array<struct<k:int,s:int,e:int>>")))
    named = lambda a: F.transform(a, lambda x: F.struct(
        F.get(F.array(*map(F.lit, KINDS)), x["k"]).alias("kind"), x["s"].alias("start"),
        x["e"].alias("end")))
    return out.withColumn("added", added).select(
        *keep, _computed(named("base")).alias("base"), _computed(named("added")).alias("added")
    )


def count(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    shown = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    return F.array_join(shown, ",")


def merged(base: Column, added: Column) -> Column:
    """All spans in the order in which they are listed."""
    number = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    keyed = F.transform(F.concat(base, added), lambda x: F.struct(
        number(x).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.sort_array(keyed)


def redact(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets.

    Kinds are rewritten one after another, so overlapping spans leave no rest of either; a null
    text stays null. Other columns pass through.
    """
    columns = df.columns
    out = df.withColumn("_t", F.col(text))
    for kind in ("email", "phone", "card", "ip"):
        out = _pieces(out, BASE[kind], _guards("_t")[kind])
        out = _rewritten(out, _base_mark(kind))
    out = _with_candidates(out, "_t").withColumn("_m", F.col("_c"))
    out = out.withColumn("_g", F.when(F.size("_m") > 0, F.split("_t", WIDE, -1)))
    out = _rewritten(out, lambda m: F.when(
        model.says(m), F.concat(F.lit("["), F.upper(m["kind"]), F.lit("]"))).otherwise(m["m"]))
    return out.select(*(_computed(F.col("_t")).alias(c) if c == text else c for c in columns))


def _base_mark(kind: str):
    return lambda m: F.when(_valid(kind, m["m"]), f"[{kind.upper()}]").otherwise(m["m"])


def _rewritten(df: DataFrame, mark) -> DataFrame:
    """``_t`` anew from the stretches between matches (``_g``) and what ``mark`` makes of these."""
    parts = F.transform("_m", lambda m, i: F.concat(F.get("_g", i), mark(m)))
    whole = F.concat(F.array_join(parts, ""), F.element_at("_g", -1))
    return df.withColumn("_t", F.when(F.size("_m") > 0, whole).otherwise(F.col("_t")))


def _pieces(df: DataFrame, pattern: str, guard: Column) -> DataFrame:
    found = F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))
    df = df.withColumn("_m", F.when(guard, F.transform(found, lambda m: F.struct(m.alias("m")))))
    return df.withColumn("_g", F.when(F.size("_m") > 0, F.split("_t", pattern, -1)))
