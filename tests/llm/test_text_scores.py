"""Toxicity, language, token counts: accuracy, exact counts and edge cases."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tidemark.llm import language, token_counts, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def toxic_model(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.train(docs, labels)


def test_toxicity_on_held_out_documents(spark, sf, toxic_model):
    where = sf.replace("0.001", "0.01")
    scored = toxicity.score(spark.read.parquet(f"{where}/documents.parquet"), toxic_model)
    rows = (scored.join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").where("crc32(string(doc_id)) % 5 = 0").collect())
    right = sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.93


def test_insults_with_gaps_and_inserted_characters_score_high(toxic_model):
    clean = "the thand of erion was enthe to"
    hidden = ["stupid idiot moron", "stxupid idi-ot mo.ron", "s.t.u.p.i.d i.d.i.o.t m.o.r.o.n", "stuupid idiiot morron", "stup1d 1diot m0ron"]
    scores = toxic_model.scores(pa.array([clean, "", *[f"{clean} {h} {clean}" for h in hidden]]))
    assert scores[0] < 0.3 and scores[1] < 0.3
    assert (scores[2:] > scores[0]).all() and scores[2:4].min() > 0.5


def test_spaced_out_letters_are_read_as_a_word(spark):
    rows = spark.createDataFrame([("an I D I O T here",), (None,), ("a b",), ("word a word",)], "text string")
    got = [r[0] for r in rows.select(toxicity.normal(rows.text)).collect()]
    assert got == ["an idiot here", "", "ab", "word a word"]


def test_decision_equals_the_kernel_expansion():
    """The folded table gives what the kernel with its landmarks gives, for words of one window."""
    words = ["stupid", "idiot", "table", "chair", "ab", ""]
    toxic, clean = {"stupid": 9, "idiot": 8}, {"table": 5, "chair": 4, "other": 3}
    table, bias = toxicity.fit_machine(toxic, clean)
    word, triple, value = toxicity.maps(words)
    want = np.bincount(word, value * table[triple], len(words)) + bias
    got = toxicity.decisions(*toxicity._joined(words), table, bias)
    assert got == pytest.approx(want)
    assert got[:2].min() > 0 > got[2:4].max()


def test_toxicity_edge_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert model.table is None
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0}
    assert toxicity.keep_clean(docs, model).count() == docs.count()
    assert toxicity.score(no_docs, model).count() == 0


def test_toxic_documents_go_and_clean_ones_stay_unchanged(spark, docs, toxic_model):
    insult = spark.createDataFrame([(9001, "you stupid idiot, what a pathetic moron", "en", "web", 1, "x", None, None, None, None, None)], docs.schema)
    left = toxicity.keep_clean(docs.unionByName(insult), toxic_model)
    assert left.columns == docs.columns
    assert left.exceptAll(docs).count() == 0  # what stays is unchanged
    assert docs.count() - 8 <= left.count() <= docs.count()


def test_languages_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(docs)
    rows = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("crc32(string(doc_id)) % 5 = 0").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)


def test_language_edge_cases(spark, docs, no_docs):
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    source = {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc_id, r in got.items():
        letters = any(c.isalpha() for c in source[doc_id] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0.0)
    assert language.train(no_docs) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(no_docs, model).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 40])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert code.shape[0] == n == len({tuple(r) for r in code})
    if n > 4:
        apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(apart) >= 3


def test_a_flipped_bit_is_corrected():
    code = language.codewords(8)
    model = language.Model([str(i) for i in range(8)], code, np.zeros((language.BUCKETS, code.shape[1])), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    margins = 3.0 * code
    margins[:, 0] *= -1
    best, score, close = model.decode(margins)
    assert best.tolist() == list(range(8)) and not close.any() and (score > 0.5).all()
    assert model.decode(np.zeros((1, code.shape[1])))[2].all()


def test_token_counts_equal_the_library(spark, docs, doc_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.count_tokens(docs, PIECES, ["doc_id", "same"])
    assert got.columns == ["doc_id", "same", "n_bytes", "n_tokens"]
    want = sorted((-1 if r[0] is None else r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in doc_rows)
    assert sorted((-1 if r[0] is None else r[0], r[2], r[3]) for r in got.collect()) == want


def test_token_counts_of_odd_texts():
    rng, library = random.Random(3), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    parts = ["a", "b", " ", "  ", "\n", " \n", "\t", "▁", "é", "</s>", "<s>", "<0x0A>", " ", "\x85", " the", "."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    counter = token_counts.PieceCounter(PIECES, kept=50)
    assert token_counts.counts(pa.array(texts), counter).tolist() == [len(x) for x in library.encode(texts)]
