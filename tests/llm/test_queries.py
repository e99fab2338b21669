"""The registered queries and the pipeline on the small tables."""

import os
import re
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import mixing, queries, toxicity
from tidemark.session import cut_lineage

from .test_dedup import brute_classes

FOLDER = os.path.dirname(queries.__file__)


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_toxicity", "op3_mix_sources", "op4_pack_sequences", "op5_token_counts", "op6_merkle_fingerprints",
                                  "op7_language_codes", "op8_chat_format", "op9_secrets", "op10_bag_minhash"])
def test_query_covers_its_whole_table(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    table, key = ("conversations", "conv_id") if name.startswith("op8") else ("documents", "doc_id")
    want = spark.read.parquet(f"{sf}/{table}.parquet").select(key).distinct().count() + (table == "conversations")
    assert got.select(key).distinct().count() == want


def test_stages_equal_brute_force(spark, sf):
    """Every stage on what the one before kept, each against a plain version of its decision."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = cut_lineage(stage(spark, docs, sf), f"test-{name}")
        rows = got.collect()
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name != "packing":
            assert got.columns == docs.columns
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
            scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
            want = {d for d, _ in before if scores[d] < 0.5}
            assert {r["doc_id"] for r in rows} == want and len(want) < len(before)
        elif name == "exact_dedup":
            assert {r["doc_id"] for r in rows} == set({t: d for d, t in sorted(before)}.values())
        elif name == "near_dedup":
            classes = brute_classes([(d, t) for d, t in before])
            assert {r["doc_id"] for r in rows} == {max(d for d, _ in c) for c in classes}
        elif name == "mixing":
            taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(docs).collect()}
            words = Counter()
            for r in rows:
                words[r["doc_id"]] += len(re.findall(mixing.WORD, r["text"]))
            assert +words == +Counter(taken)
        else:
            assert sum(r["length"] for r in rows) == sum(
                len(e.ids) + 1 for e in Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json")).encode_batch(
                    [t for _, t in before], add_special_tokens=False))
        out[name], docs = len(rows), got
    assert list(out) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_the_whole_pipeline_runs(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    spans = {}
    for r in rows:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in spans.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0


def test_native_operators_hold_no_python():
    for name in ("merkle", "secret_scan"):
        with open(f"{FOLDER}/{name}.py", encoding="utf-8") as f:
            source = f.read()
        assert not re.search(r"udf|InPandas|InArrow|\.rdd|numpy|pandas", source)


def test_native_plans_hold_no_python(spark, sf):
    for name in ("op6_merkle_fingerprints", "op9_secrets"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_exact_dedup_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.SQL["op2_exact_dedup"]).fetchall()
    got = queries.QUERIES["op2_exact_dedup"](spark, sf)
    columns = [d[0] for d in con.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want)
