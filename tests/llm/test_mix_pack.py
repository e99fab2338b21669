"""Mixing and packing: targets, coverage, capacities and ids."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import mixing, near_dedup, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_targets_share_the_excess_until_none_is_above():
    got = mixing.targets([("a", 100), ("b", 1000), ("c", 400), (None, 0)])
    assert got[0] == 200.0 and got[3] == 0.0
    assert sum(got) == pytest.approx(2250)
    assert all(t <= 2 * s + 1e-9 for t, s in zip(got, (100, 1000, 400, 0)))
    assert mixing.targets([("a", 10)]) == pytest.approx([15.0])
    assert mixing.targets([]) == [] and mixing.targets([(None, 0)]) == [0.0]


def test_permutations_cover_every_block_once_an_epoch():
    plan = mixing.Plan([("a", 128 * 37), ("b", 1), ("c", 128 * 1000 + 5)])
    for s, n in enumerate(plan.blocks):
        for epoch in (0, 1):
            k = np.arange(n) + epoch * n
            assert sorted(plan.block_of(np.full(n, s), k).tolist()) == list(range(n))


def test_settled_slots_are_exactly_the_quota():
    plan = mixing.Plan([("a", 9000), ("b", 50000), ("c", 20000)], block=16)
    drawn = sum(plan.draw(i) for i in range(plan.shards))
    assert drawn.sum() == plan.slots
    source = np.repeat(np.arange(3), drawn)
    k = np.concatenate([np.arange(n) for n in drawn])
    source, k = plan.settle(drawn, source, k)
    for s in range(3):
        assert sorted(k[source == s].tolist()) == list(range(plan.quota[s]))


def test_taken_words_meet_targets_and_bounds(docs, doc_rows):
    got = mixing.taken_words(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in doc_rows)
    per = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken, target, size = per.get(r["target"], (0, r["target"], r["source_size"]))
        per[r["target"]] = (taken + r["taken"], target, size)
    for taken, target, size in per.values():
        assert abs(taken - target) <= 2 * mixing.BLOCK and taken <= 2 * size
    assert sorted(map(repr, mixing.taken_words(docs).collect())) == sorted(map(repr, got))


def test_mixed_texts_are_the_taken_words(docs, doc_rows):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words, sizes = Counter(), Counter()
    for r in out.collect():
        assert r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    for r in mixing.taken_words(docs).collect():
        sizes[r["doc_id"]] += r["taken"]
    assert +words == +sizes


def test_mixing_an_empty_table(no_docs):
    assert mixing.taken_words(no_docs).count() == 0
    assert mixing.mixed(no_docs).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a  b", "a   b", "a\n b", "x \n y", "tail ", "tail  ", "a  b", "  b",
                                  "it's <|endoftext|> here", "<|endoftext|><|endoftext|>", "é ü 漢字 🙂", "1 22 333", "don't\tstop \r\n now"])
def test_word_ids_equal_the_tokenizer(text):
    ids = np.frombuffer(packing.WordIds(BPE).text_ids(text), "<u4").tolist()
    assert ids == Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids


def test_capacities_and_balance_fill_sequences_exactly():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 2048, rng.integers(0, 60)).tolist()
        room = packing.capacities(sum(lengths))
        assert sum(room) == sum(lengths) and all(r == 2048 or r & (r - 1) == 0 for r in room)
        pieces = packing.balance(lengths)
        fill = {}
        for item, start, n, k, offset in pieces:
            fill.setdefault(k, []).append((offset, n))
        assert Counter(k for k in fill) == Counter(range(len(room)))
        for k, spans in fill.items():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at == room[k]
        for item, length in enumerate(lengths):
            at = 0
            for start, n in sorted((p[1], p[2]) for p in pieces if p[0] == item):
                assert start == at
                at += n
            assert at == length


def test_heavy_documents_are_spread():
    pieces = packing.balance([1000] * 8 + [24] * 16)
    per = Counter(k for item, _, _, k, _ in pieces if item < 8)
    assert max(per.values()) - min(per.get(k, 0) for k in range(4)) <= 1


def test_packed_pieces_hold_every_id_once(docs, doc_rows):
    rows = packing.pack(docs, BPE, per_group=16).collect()
    tokenizer = Tokenizer.from_file(BPE)
    ids = Counter()
    for r in doc_rows:
        ids[(r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]))] += 1
    parts, fill = {}, {}
    for r in rows:
        assert r["length"] <= 2048
        parts.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for (doc, text), n in ids.items():
        own = parts[(doc, len(text))]
        assert sum(r["length"] for r in own) == sum(len(t) * m for (d, t), m in ids.items() if (d, len(t)) == (doc, len(text)))
        for r in own:
            cut = text[r["start"]:r["start"] + r["length"]]
            same = [t for (d, t), _ in ids.items() if d == doc and len(t) == len(text)]
            sums = {zlib.crc32(np.array(t[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) for t in same}
            assert r["ids_crc32"] in sums and len(cut) == r["length"]
    for spans in fill.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == 2048 or at & (at - 1) == 0


def test_packing_an_empty_table(no_docs):
    assert packing.pack(no_docs, BPE).count() == 0


@pytest.mark.parametrize("module, run", [(near_dedup, near_dedup.dedup), (mixing, mixing.mixed)])
def test_another_split_of_the_files_between_scans_changes_nothing(spark, doc_rows, docs, tmp_path, monkeypatch, module, run):
    path, split = str(tmp_path / "docs"), "spark.sql.files.minPartitionNum"
    spark.createDataFrame(list(dict.fromkeys(doc_rows)), docs.schema).repartition(8, "doc_id").write.parquet(path)
    own = module.cut_lineage

    def cut_and_split(frame, name):
        out = own(frame, name)
        if name in ("features", "sizes"):
            spark.conf.set(split, "1")
        return out

    spark.conf.set(split, "64")
    try:
        want = sorted(map(repr, run(spark.read.parquet(path)).collect()))
        monkeypatch.setattr(module, "cut_lineage", cut_and_split)
        assert sorted(map(repr, run(spark.read.parquet(path)).collect())) == want
    finally:
        spark.conf.unset(split)
