"""Exact and near deduplication against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import exact_dedup, near_dedup


def key(doc_id):
    return -1 if doc_id is None else doc_id


def test_fuse_filter_holds_its_keys_and_few_others():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 3000, 40000):
        keys = np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64))
        held = exact_dedup.FuseFilter.build(keys)
        assert held.might_hold(keys).all()
        others = rng.integers(1 << 60, 1 << 61, 100_000, dtype=np.uint64)
        assert held.might_hold(others).sum() < 20


def test_exact_groups_equal_brute_force(docs, doc_rows):
    got = exact_dedup.decide(docs).collect()
    groups = {}
    for r in doc_rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    assert len(got) == len(doc_rows)
    kept = Counter()
    shas = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = shas[r["sha"]]
        assert r["group_size"] == len(ids)
        assert key(r["keep"]["id"]) == max(map(key, ids))
        kept[r["sha"]] += r["kept"]
    assert set(kept.values()) == {1}


def test_exact_dedup_keeps_one_row_and_all_columns(docs, doc_rows):
    left = exact_dedup.dedup(docs)
    assert left.columns == docs.columns
    rows = left.collect()
    assert sorted(r["text"] or "" for r in rows) == sorted({r[1] or "" for r in doc_rows})
    best = {}
    for r in doc_rows:
        best[r[1] or ""] = max(best.get(r[1] or "", -2), key(r[0]))
    assert all(key(r["doc_id"]) == best[r["text"] or ""] for r in rows)


def test_snapshot_screens_a_batch(spark):
    old = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id bigint, text string")
    new = spark.createDataFrame([(1000 + i, f"text {i}") for i in range(400, 600)], "doc_id bigint, text string")
    snapshot = exact_dedup.Snapshot(exact_dedup.grouped(exact_dedup.digests(old)), per_bucket=64)
    batch = exact_dedup.grouped(exact_dedup.digests(new))
    positives = {r["sha"] for r in snapshot.screen(batch).collect()}
    held = {hashlib.sha256(f"text {i}".encode()).hexdigest() for i in range(400, 500)}
    assert held <= positives and len(positives) < 105
    assert {r["sha"] for r in snapshot.matches(batch).collect()} == held


def test_empty_tables(no_docs):
    assert exact_dedup.decide(no_docs).count() == 0
    assert exact_dedup.dedup(no_docs).count() == 0
    assert near_dedup.groups(no_docs).count() == 0
    assert near_dedup.dedup(no_docs).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute_classes(rows, threshold=0.8):
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = sum((sets[i] & sets[j]).values())
            if common >= threshold * (sets[i].total() + sets[j].total() - common):
                parent[find(i)] = find(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), []).append(rows[i])
    return classes.values()


def test_near_groups_equal_brute_force(docs, doc_rows):
    got = near_dedup.groups(docs).collect()
    want = Counter()
    for members in brute_classes(doc_rows):
        top = max(members, key=lambda r: key(r[0]))[0]
        for r in members:
            want[(r[0], top, len(members))] += 1
    assert Counter((r["doc_id"], r["class_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(list(brute_classes(doc_rows)))


def test_near_dedup_keeps_one_of_each_group(docs, doc_rows):
    left = near_dedup.dedup(docs)
    assert left.columns == docs.columns
    assert left.count() == len(list(brute_classes(doc_rows)))


def test_a_chain_through_different_buckets_is_one_group(spark):
    words = [f"w{i}" for i in range(200)]
    chain = []
    for step in range(12):  # each text replaces eight more words; neighbours are alike, ends are not
        chain.append((step, " ".join(f"n{i}" if i < 8 * step else w for i, w in enumerate(words))))
    got = near_dedup.groups(spark.createDataFrame(chain, "doc_id bigint, text string")).collect()
    assert {r["class_id"] for r in got} == {11}


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(2)
    for _ in range(4):
        a = Counter({i: int(rng.choice([0, 1, 1, 2, 3, 7, 20, 100])) for i in range(40)})
        b = Counter({i: int(rng.choice([n, n, n // 2, 2 * n + 1])) for i, n in a.items()})
        a, b = +a, +b
        rows = [(r, e, w) for r, bag in enumerate((a, b)) for e, w in bag.items()]
        row, element, weight = (np.array(c) for c in zip(*rows))
        times = near_dedup.signatures(row, near_dedup.mix((element + 1000).astype(np.uint64)), weight, 2, 8000)
        true = sum((a & b).values()) / sum((a | b).values())
        assert (times[0] == times[1]).mean() == pytest.approx(true, abs=0.03)


def test_elements_count_repeats_and_short_texts():
    row, element, weight = near_dedup.elements(pa.array(["a a a a a a a", "a b", "a b", "", "  \n", "b a"]))
    assert weight[row == 0].tolist() == [3]
    hashes = {r: set(element[row == r].tolist()) for r in range(6)}
    assert hashes[1] == hashes[2] != hashes[5] and hashes[3] == hashes[4]
    assert all(len(h) == 1 for h in hashes.values())


def test_a_linked_group_and_a_stranger_are_linear_in_pairs(spark, monkeypatch):
    """Copies linked through their lead, and one text just below the similarity that shares buckets with them."""
    words = [f"w{i}" for i in range(100)]
    change = lambda *at: " ".join("changed" + str(sum(at)) if i in at else w for i, w in enumerate(words))
    seen = []
    similar = near_dedup.similar
    monkeypatch.setattr(near_dedup, "similar", lambda pairs, *a: seen.append(pairs.count()) or similar(pairs, *a))
    counts = {}
    for n in (20, 40):
        rows = [(0, " ".join(words))] + [(i + 1, change(2 * i + 3)) for i in range(n)] + [(999, change(10, 40, 70))]
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert got[999] == 999 and {got[i] for i in range(n + 1)} == {n}
        counts[n] = seen[-1]  # across groups
    assert counts[40] <= 41 and counts[20] <= 21
