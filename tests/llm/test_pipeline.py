"""The pipeline's stages against brute force on documents with planted cases."""

import random

import corpus_pipeline
import public_tokenizers
import test_documents
import test_pii
from helpers import smallest_reachable
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(11)
    vocab = {
        "en": "the of and ing tion that with for was".split(),
        "de": "der die und sch ung ein nicht ist mit".split(),
    }
    out = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        body = [" ".join(rng.choices(vocab[lang], k=12)) + "." for _ in range(rng.randrange(1, 12))]
        out.append([i, "\n".join(body), lang])
    shared = "\n".join(" ".join(rng.choices(vocab["en"], k=12)) for _ in range(4))
    for i in range(10, 30):
        out[i][1] += "\n" + shared
    for i in range(40, 50):
        words = out[39][1].split(" ")
        words[3] = f"changed{i}"
        out[i][1:] = [" ".join(words), out[39][2]]
    for i in range(60, 70):
        out[i][1] += f"\nmail me: a{i}@b.com or +1 (415) 555-26{i} from 10.0.0.{i} card 4111 1111 1111 1111"
    out += [[200, None, "en"], [201, "", None], [202, "12 34 !!", "en"], [203, out[5][1], "en"]]
    return [(i, t, k, "s", len(t or "")) for i, t, k in out]


def test_stages(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    at = {r[0]: r[1] for r in rows}
    for name, function in corpus_pipeline.STAGES[:-1]:
        function(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            assert set(at) - set(got) == {200, 201, 202}
            assert all(got[i] == at[i] for i in got)
        elif name == "repeated_lines":
            assert got == {i: x[0] for i, x in test_documents.brute_lines(list(at.items())).items()}
        elif name == "near_duplicates":
            sets = {i: test_documents.brute_sets(t) for i, t in at.items()}
            edges = [(i, j) for i in sets for j in sets if i < j and sets[i] & sets[j]
                     and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
            heads = smallest_reachable(sets, edges)
            assert set(got) == {i for i in heads if heads[i] == i}
        elif name == "personal_data":
            assert set(got) == set(at)
            assert not any(test_pii.brute(t) for t in got.values())
            assert all(got[i] == at[i] for i in at if not test_pii.brute(at[i]))
            assert sum("[EMAIL]" in t for t in got.values()) >= 9
        at = got
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    sizes = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in at.items()}
    assert {r.doc_id: r.length for r in packed} == sizes
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    brief = lambda rows: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert brief(whole) == brief(packed)
