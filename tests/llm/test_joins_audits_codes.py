"""The Jaccard join, the filter audit and the vector codes against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit, jaccard_join, vector_codes
from tidemark.session import setting

WORD = r"[^\x20\x09-\x0D]+"


def run_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, low)
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute_components(rows):
    sets, parent = [run_set(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            common = len(s & sets[j])
            if common and 100 * common >= 90 * (len(s) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((r[0], len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets)))


def joined(df, **options):
    return Counter((r["doc_id"], r["n"], r["component"]) for r in jaccard_join.join(df, **options).collect())


def test_join_equals_brute_force(docs, doc_rows):
    assert joined(docs) == brute_components(doc_rows)


@pytest.mark.parametrize("extra,segment", [(1, 256), (2, 3), (6, 256)])
def test_join_at_the_edge_of_the_similarity(spark, extra, segment):
    """Texts of several bases with a few changed words each, so that many pairs are just above or below 0.9."""
    rng = random.Random(extra)
    rows = []
    for base in range(5):
        words = [f"b{base % 3}w{i}" for i in range(rng.choice([8, 20, 60, 61, 150]))]
        for _ in range(30):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(["x", "y", f"n{rng.random()}"])
            rows.append((len(rows), " ".join(own[rng.randint(0, 2):])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute_components(rows)
    assert len({c for _, _, c in want}) > 20 and joined(df, extra=extra, segment=segment) == want


def test_join_of_a_chain_and_of_components_that_share_lists(spark):
    """Links that only run through foreign members, beside a group that shares most of its runs but no link."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[3 * i:300 - 60 + 3 * i])) for i in range(20)]
    rows += [(100 + i, " ".join(w if j % 10 else f"{w}v{i}" for j, w in enumerate(words))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert joined(df) == brute_components(rows)


def near_misses(rng, count, base, changes):
    """Texts that each change a few other words of a base, and so are not similar enough by twos."""
    rows = []
    for i in range(count):
        own = [f"{base}w{j}" for j in range(200)]
        for j in rng.sample(range(200), changes):
            own[j] = f"{base}n{i}x{j}"
        rows.append(" ".join(own))
    return rows


def counted(monkeypatch, df, names):
    """The components, and the rows of the intermediate results of these names."""
    made, plain = Counter(), jaccard_join.cut_lineage

    def watched(df, name):
        kept = plain(df, name)
        if name in names:
            made[name] += kept.count()
        return kept

    with monkeypatch.context() as patch:
        patch.setattr(jaccard_join, "cut_lineage", watched)
        return joined(df), made


@pytest.mark.parametrize("with_base", [False, True])
def test_join_of_texts_around_one_base_makes_few_pairs(spark, monkeypatch, with_base):
    texts = near_misses(random.Random(1), 80, "", 2) + [" ".join(f"w{j}" for j in range(200))] * with_base
    texts += near_misses(random.Random(2), 40, "", 5) * with_base
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found, made = counted(monkeypatch, df, {"candidates", "family-pairs"})
    assert found == brute_components(rows)
    assert sum(made.values()) < 4 * len(rows)  # by twos they are 3160 and more


def test_lists_of_texts_too_different_in_size_are_left_out(spark, monkeypatch):
    """Short runs that every other text has too, of sizes that cannot be similar."""
    rows = [(i, " ".join(f"w{j}" for j in range(10, 10 + 12 * 2 ** i))) for i in range(6)] + [(9, " ".join(f"w{j}" for j in range(10, 21)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found, made = counted(monkeypatch, df, {"live"})
    assert found == brute_components(rows)
    m = jaccard_join.Measure()
    least = {n: n - m.long(n) for n in (10, 9)}
    assert 0 < made["live"] <= sum(least.values())  # only the two texts of 9 and 10 runs can be similar


@pytest.mark.parametrize("percent", [50, 90, 100])
def test_join_in_families_equals_brute_force(spark, percent):
    """All differences from a pivot, for random texts around bases that differ little from each other."""
    rng = random.Random(percent)
    rows = []
    for base in range(4):
        words = [f"w{i if rng.random() < 0.9 else (base, i)}" for i in range(rng.choice([30, 60, 90]))]
        for _ in range(25):
            own = [w if rng.random() > 0.01 * rng.choice([0, 1, 3, 9]) else rng.choice(["x", f"n{rng.random()}"]) for w in words]
            rows.append((len(rows), " ".join(own[:len(own) - rng.choice([0, 0, 1, 4])])))
    sets = [run_set(r[1]) for r in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["component"] for r in jaccard_join.join(df, percent=percent, segment=16).collect()}
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert got == dict(enumerate(label))


def test_least_shared_numbers_are_least(spark):
    m = jaccard_join.Measure()
    df = spark.range(1, 300).select("id", m.least_needed(F.col("id")).alias("q"), m.size_class(F.col("id"), 2).alias("c")).collect()
    classes = {r["id"]: r["c"] for r in df}
    for r in df:
        n = r["id"]
        fits = [k for k in range(1, 300) if 100 * min(n, k) >= 90 * max(n, k)]
        assert all(m.needed(n, k) >= r["q"] for k in fits)
        assert all(abs(classes[n] - classes[k]) <= 2 for k in fits)


def test_merge_skip_equals_counting():
    rng = random.Random(5)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randint(0, 25))) for _ in range(rng.randint(1, 8))]
        need = rng.randint(1, 6)
        counts = Counter(x for own in lists for x in own)
        assert list(jaccard_join.merge_skip(lists, need)) == sorted((x, n) for x, n in counts.items() if n >= need)


def test_measures_of_numbers_and_columns_agree(spark):
    m = jaccard_join.Measure()
    pairs = [(n, k) for n in range(1, 80) for k in range(n, min(90, n * 10 // 9 + 1))]
    df = spark.createDataFrame(pairs, "n bigint, m bigint")
    for r in df.select("n", "m", m.needed_column(df.n, df.m).alias("x")).collect():
        assert r["x"] == m.needed(r["n"], r["m"])
        least = min(c for c in range(r["m"] + 1) if m.linked(r["n"], r["m"], c))
        assert m.overlap(r["n"], r["m"]) == least


def test_sets_of_pairs_are_found_by_their_marks(spark):
    held = spark.range(5000).selectExpr("id * 7919 AS row", "unhex(lpad(hex(id), 16, '0')) AS runs")
    pairs = spark.range(300).selectExpr("id * 7919 AS a", "(id + 1) * 7919 AS b")
    got = {r["row"] // 7919 for r in jaccard_join._sets_of(pairs, held).collect()}
    assert set(range(301)) <= got and len(got) < 400
    assert jaccard_join._sets_of(pairs.limit(0), held).count() == 0


def test_list_entries_are_shuffled_once(spark, monkeypatch):
    """Counted, freed of single ones and of copies by one shuffle, where no side is small enough for a broadcast."""
    texts = near_misses(random.Random(3), 40, "", 3)
    rows = list(enumerate(texts + texts[:20]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    plans, plain = {}, jaccard_join.cut_lineage

    def watched(df, name):
        if name in ("postings", "lists", "shared-lists"):
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return plain(df, name)

    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"), monkeypatch.context() as patch:
        patch.setattr(jaccard_join, "cut_lineage", watched)
        assert joined(df) == brute_components(rows)
    assert "shared-lists" in plans
    assert sum(len(re.findall(r"- Exchange hashpartitioning", p)) for p in plans.values()) == 1


def test_packed_runs_come_back():
    rng = random.Random(4)
    top = (1 << 64 - jaccard_join.ROW_BITS) - 1
    for runs in ([], [0], [top], [0, top], sorted({rng.randrange(top) for _ in range(500)})):
        blob = jaccard_join.packed(np.array(runs, np.uint64))
        assert jaccard_join.unpacked(blob).tolist() == runs and len(blob) == 7 * len(runs)


def test_join_of_many_copies_in_many_partitions(spark):
    texts = near_misses(random.Random(6), 6, "", 2) + ["x y z", "x y", "", "q " * 300]
    rows = [(i, texts[i % len(texts)]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(16)
    assert joined(df) == brute_components(rows)


def test_join_of_no_documents(no_docs):
    assert jaccard_join.join(no_docs).count() == 0


def test_run_sets_lower_only_a_to_z():
    hashes, at = jaccard_join.shingle_sets(pa.array(["A b C d", "a B c D", "É b c d", "é b c d", None, " ", "x", "a b c d a b c d"]))
    sets = [set(hashes[a:b].tolist()) for a, b in zip(at, at[1:])]
    assert sets[0] == sets[1] and sets[2] != sets[3] and sets[4] == sets[5] == set() and len(sets[6]) == 1 and len(sets[7]) == 4


# ---- filter audit ----

def failing(row, first):
    text = row[1] or ""
    words = re.findall(WORD, text)
    return {f for f, bad in zip("ABCDE", (
        len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
        bool(re.search(r"[#$%&*|]", text)), row[0] is not None and first.get(text, math.inf) < row[0])) if bad}


def brute_audit(rows, labels):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", math.inf), r[0])
    parts = defaultdict(list)
    for r in rows:
        parts[r[3] or ""].append((failing(r, first), (r[0], "good") in labels, (r[0], "toxic") in labels))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                lost = [d for d in left if f in d[0]]
                redundant = sum(f in d[0] for d in docs) - len(lost)
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(lost)
                out[part, "".join(order), step] = [len(left), len(lost), redundant, sum(d[0] == {f} for d in docs),
                                                   sum(d[1] for d in lost), sum(d[2] for d in lost), f]
        for (p, _, _), v in out.items():
            if p == part:
                v[-1] = shapley[v[-1]] if isinstance(v[-1], str) else v[-1]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_every_order_played_through(spark, docs, doc_rows):
    rng = random.Random(9)
    marks = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in doc_rows if rng.random() < 0.6]
    marks += [(3, 1, 0), (None, 1, 1)]
    labels = {(d, k) for d, q, t in marks for k, v in (("good", q), ("toxic", t)) if v == 1 and d is not None}
    odd = [(1000, "UPPER Case & more " * 20, "en", "web", 1, *[None] * 6), (1001, "UPPER Case & more " * 20, "en", "", 1, *[None] * 6)]
    df = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    got = filter_audit.audit(df, spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got} == brute_audit([*doc_rows, *odd], labels)
    assert len(got) == 600 * len({r[3] or "" for r in doc_rows})


def test_audit_of_no_documents_and_no_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(no_docs, none).count() == 0
    assert {(r["good_lost"], r["toxic_lost"]) for r in filter_audit.audit(docs, none).collect()} == {(0, 0)}


def test_path_counts_are_factorials():
    ahead, back = filter_audit.path_counts()
    for s in range(32):
        assert ahead[s] == math.factorial(bin(s).count("1")) and back[s] == math.factorial(5 - bin(s).count("1"))
    assert sum(p for _, own, p in filter_audit.edges() if own == 1) == 120 and len(filter_audit.steps()) == 600


# ---- vector codes ----

def brute_codes(rows, rounds=4, entries=256):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * size:(p + 1) * size]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1], p) for r in first] for p in range(4)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for r in kept:
                groups[near(cut(r[1], p), book)[1]].append(cut(r[1], p))
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(book)]
    out, total = [], Counter()
    for i, v, lab in kept:
        found = [near(cut(v, p), books[p]) for p in range(4)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
        total[lab] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, c, e, total[lab], sha) for i, c, e, lab in out)


VECTORS = "vec_id bigint, embedding array<double>, label int, code string, error bigint, id bigint, _label int"


def codes(spark, rows, schema=VECTORS):
    got = vector_codes.compress(spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], schema).repartition(3)).collect()
    return Counter((r["id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got)


def made_vectors(n=400, dims=8, seed=1):
    rng = random.Random(seed)
    rows = [(i * 7 % 1000, [rng.choice([-1, 0, 0.25, 1]) + rng.gauss(0, 0.01) for _ in range(dims)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [rows[3], rows[3], (None, rows[5][1], 2), (5000, None, 0), (5001, [None, *rows[0][1][1:]], 0),
             (5002, [float("nan"), *rows[0][1][1:]], None), (5003, [float("-inf"), *rows[0][1][1:]], 1)]
    return rows


def test_codes_equal_brute_force(spark):
    rows = made_vectors()
    assert codes(spark, rows) == brute_codes(rows)


def test_codes_of_few_and_of_equal_vectors(spark):
    rows = [(i, [0.5, -0.5, 0.1, 0.2], None) for i in range(5)] + [(9, [0.5, -0.5, 0.1, 0.3], 1)]
    assert codes(spark, rows) == brute_codes(rows)


def test_codes_of_huge_components_are_exact(spark):
    rows = made_vectors(300, 4, 2) + [(4000 + i, [4e5 * i, 3.0, -2.5e5, 0.1], 7) for i in range(5)]
    assert codes(spark, rows) == brute_codes(rows)
    far = codes(spark, rows + [(1, [1e300, -1e300, 1e30, 5.0], 9), (1, [2e300, -1e300, 1e30, 5.0], 9)])
    assert sum(far.values()) == sum(codes(spark, rows).values()) + 2


def test_codes_of_other_lengths_and_of_nothing(spark):
    rows = made_vectors(20) + [(7000, [1.0, 2.0], 1)]
    got = {k[0]: k for k in codes(spark, rows)}
    assert got[7000][1:3] == (None, None) and got[0][1] is not None
    assert not codes(spark, []) and not codes(spark, [(1, None, 1)])


def test_blocks_give_their_integers_back():
    x = np.array([[0.1, -0.1], [1e200, 5.0], [0.1, -7.0]])
    block = vector_codes.Block.of(vector_codes.integers(x))
    names = ("dictionary", "sizes", "codes")
    again = vector_codes.Block.read(dict(zip(names, block.columns())) | {"id": [1, 2, 3]})
    assert again.part(0, 2).tolist() == [[math.floor(Fraction(v) * 1024) for v in row] for row in x.tolist()]
