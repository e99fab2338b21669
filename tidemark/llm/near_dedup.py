"""Near-duplicate groups by BagMinHash signatures of word shingles, banding and verified multiset overlap.

A text is the multiset of its runs of ``SHINGLE`` words in lower case; a text of fewer words is one run, one without
words is the empty run.  For every element a Poisson process runs over its weight axis, cut into dyadic intervals; a
point of an interval that the weight only partly covers is handed down to a half, and the other half starts its own
process there.  Each point has a time and a signature component, a component keeps the earliest, and processes past the
document's latest component stop.  Components of two texts agree with the probability of their weighted Jaccard
similarity.  Bands of components give buckets.  Each member of a bucket is compared with the bucket's most central
text; where a bucket's members are then still in different groups, the pairs across groups that can be similar at all
are found through their rare elements, so no pair is left out and a hot bucket does not cost the square of its size.
Pairs are links when their exact overlap gives a similarity of at least ``THRESHOLD``.

Texts equal in lower case are one vertex from the start.  Null is empty.  Every row has a group; of each group the
row with the largest id stays, and among rows of that id one.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import GOLDEN, chunks, flat, mix, unit, word_bounds, word_hashes
from tidemark.llm.exact_dedup import stay
from tidemark.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 26, 5
RARE = 4
ROW_BITS = 14  # a chunk has at most 2**ROW_BITS rows; elements keep the other 50 bits of their hash
FEATURES = "row bigint, doc_id bigint, same string, n bigint, elements binary, bands array<bigint>"


def elements(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and multiplicity of the distinct shingles of each text, by row and hash."""
    data, offsets = flat(column)
    start, end, at = word_bounds(data, offsets)
    words = word_hashes(data, start, end)
    n = np.diff(at)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    left = np.repeat(at[1:], n) - np.arange(len(words))  # words from here to the end of the row
    runs = np.zeros(len(words), np.uint64)
    for j in range(k):
        step = mix(np.array([j + 1], np.uint64) * GOLDEN)[0] | np.uint64(1)
        runs += np.where(left > j, padded[j:j + len(words)], np.uint64(0)) * step
    first = at[:-1][n > 0]
    whole = left >= k
    whole[first] = True  # a text of fewer words has one run from its first word
    row = np.repeat(np.arange(len(n)), n)[whole]
    keys = mix(runs[whole]) >> np.uint64(ROW_BITS) | row.astype(np.uint64) << np.uint64(64 - ROW_BITS)
    empty = np.flatnonzero(n == 0).astype(np.uint64) << np.uint64(64 - ROW_BITS)
    keys, weight = np.unique(np.concatenate([keys, empty]), return_counts=True)
    return (keys >> np.uint64(64 - ROW_BITS)).astype(np.int64), keys & np.uint64((1 << 64 - ROW_BITS) - 1), weight


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """BagMinHash: per row the times of the m components, equal bit for bit where two texts share the point."""
    best = np.full(rows * m, np.inf)
    latest = np.full(rows, np.inf)
    # Intervals [0, 1), [1, 2), [2, 4), [4, 8) ... of the weight axis that the weight reaches into.
    parts, lo, size = [], 0, 1
    while (here := np.flatnonzero(weight > lo)).size:
        parts.append((here, np.full(len(here), lo), np.full(len(here), size)))
        lo, size = lo + size, max(1, lo + size)
    of, lo, size = (np.concatenate(x) for x in zip(*parts))
    row, weight, element = row[of], weight[of], element[of]
    seed = _node(element, lo, size)
    turn = np.zeros(len(seed), np.uint64)
    time, where = _next(np.zeros(len(seed)), seed, turn, size, m)
    while len(row):
        full = lo + size <= weight
        np.minimum.at(best, row[full] * m + where[full], time[full])
        touched = np.unique(row[full])
        latest[touched] = best.reshape(rows, m)[touched].max(1)
        live = time <= latest[row]
        row, weight, element, seed, turn, lo, size, time, where = (
            x[live] for x in (row, weight, element, seed, turn, lo, size, time, where))
        leaf = size == 1
        # A single unit goes on with its next point.
        t1, w1 = _next(time[leaf], seed[leaf], turn[leaf] + np.uint64(1), size[leaf], m)
        grown = [(row[leaf], weight[leaf], element[leaf], seed[leaf], turn[leaf] + np.uint64(1), lo[leaf], size[leaf], t1, w1)]
        if not leaf.all():
            cut = ~leaf
            r, w, e, half, t, place = row[cut], weight[cut], element[cut], size[cut] // 2, time[cut], where[cut]
            right = (mix(seed[cut] + np.uint64(3)) >> np.uint64(63)).astype(bool)  # which half keeps the point
            for side in (False, True):
                a = lo[cut] + (half if side else 0)
                s = _node(e, a, half)
                zero = np.zeros(len(s), np.uint64)
                t2, w2 = _next(t, s, zero, half, m)
                keeps = right == side
                ok = a < w
                new = (r, w, e, s, zero, a, half, np.where(keeps, t, t2), np.where(keeps, place, w2))
                grown.append(tuple(x[ok] for x in new))
        row, weight, element, seed, turn, lo, size, time, where = (np.concatenate(x) for x in zip(*grown))
    return best.reshape(rows, m)


def _node(element: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(element + mix(lo.astype(np.uint64) * GOLDEN + size.astype(np.uint64)))


def _next(time, seed, turn, size, m):
    """The next point of a process of rate ``size``: its time and component."""
    r = mix(seed + (turn + np.uint64(1)) * GOLDEN)
    return time - np.log(unit(r)) / size, (mix(r) % np.uint64(m)).astype(np.int64)


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band from the bits of its components."""
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), bands, rows)
    key = np.zeros((len(times), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN
    for j in range(rows):
        key = mix(key ^ bits[:, :, j])
    return key.view(np.int64)


def occurrences(row: np.ndarray, element: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each copy of an element as an element of its own, 32 bits, sorted by row: multisets become sets."""
    first = np.repeat(np.cumsum(weight) - weight, weight)
    copy = (np.arange(len(first)) - first).astype(np.uint64)
    row = np.repeat(row, weight)
    keys = mix(np.repeat(element, weight) + copy * GOLDEN) >> np.uint64(32) | row.astype(np.uint64) << np.uint64(32)
    keys.sort()
    return (keys >> np.uint64(32)).astype(np.int64), keys.astype(np.uint32)


def _lower() -> Column:
    return F.lower(F.coalesce("text", F.lit("")))


def _same(lower: Column) -> Column:
    return F.sha2(lower, 256)


def features(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Row number, id, digest of the lower-case text, shingle multiset and band keys of every document."""
    lower = _lower()
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       _same(lower).alias("same"), lower.alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            n = part.num_rows
            row, element, weight = elements(part.column("text"))
            keys = band_keys(signatures(row, element, weight, n, bands * rows), bands, rows)
            of, copies = occurrences(row, element, weight)
            at = np.searchsorted(of, np.arange(n + 1))
            blob = [copies[a:b].tobytes() for a, b in zip(at, at[1:])]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), part.column("same"), pa.array(np.diff(at), pa.int64()),
                 pa.array(blob, pa.binary()), lists], names=["row", "doc_id", "same", "n", "elements", "bands"])

    return slim.mapInArrow(run, FEATURES)


def similar(pairs: DataFrame, held: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs ``(a, b)`` whose multisets overlap enough; sizes that rule it out never fetch the multisets."""
    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in ("xs", "ys"))
            keep = []
            for p, q in zip(x, y):
                s, t = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
                both = np.concatenate([s, t])
                both.sort()
                common = _common(s, t, both)
                keep.append(common >= threshold * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    left = held.select(F.col("row").alias("a"), F.col("elements").alias("xs"))
    right = held.select(F.col("row").alias("b"), F.col("elements").alias("ys"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(verify, "a bigint, b bigint")


def _common(s: np.ndarray, t: np.ndarray, both: np.ndarray) -> int:
    """Size of the intersection; 32-bit keys that collide inside one text are counted as often as both have them."""
    equal = int(np.count_nonzero(both[1:] == both[:-1]))
    own = int(np.count_nonzero(s[1:] == s[:-1]) + np.count_nonzero(t[1:] == t[:-1]))
    return equal if not own else sum(min(n, m) for n, m in _both_counts(s, t))


def _both_counts(s, t):
    a, n = np.unique(s, return_counts=True)
    b, m = np.unique(t, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return zip(n[i].tolist(), m[j].tolist())


def components(links: DataFrame) -> DataFrame:
    """``row, label``: the largest row number reachable over links, for every row that has a link."""
    edges = cut_lineage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut_lineage(edges.groupBy(F.col("a").alias("row")).agg(F.greatest(F.max("b"), F.col("a")).alias("label")), "labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("row", "b"), "b").groupBy(F.col("a").alias("row")).agg(F.max("label").alias("near"))
        near = labels.join(seen, "row").select("row", "label", F.greatest("label", "near").alias("next"))
        near = cut_lineage(near, "near")
        if near.where(F.col("next") > F.col("label")).isEmpty():
            return labels
        jump = near.select(F.col("row").alias("next"), F.col("next").alias("far"))
        labels = cut_lineage(near.join(jump, "next").select("row", F.col("far").alias("label")), "labels")


def groups(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """For every row: row, doc_id, class_id (id of the row that stays), group_size and kept."""
    return _grouped(docs, bands, rows, threshold).drop("same")


def _grouped(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Groups with the digest of each row's lower-case text."""
    held = cut_lineage(features(docs, bands, rows), "features")
    same = cut_lineage(held.groupBy("same").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("copies")), "same")
    vertex = held.join(same.select(F.col("top.row").alias("row")), "row", "left_semi")
    live = cut_lineage(_buckets(cut_lineage(vertex.select("row", "n", "bands"), "vertices")), "live")
    # Only texts that meet another in some bucket are compared; their multisets are set aside once.
    sets = cut_lineage(held.select("row", "elements").join(live.select("row").distinct(), "row", "left_semi"), "sets")
    star = live.where((F.col("row") != F.col("lead")) & _reach(F.col("n"), F.col("lead_n"), threshold))
    links = cut_lineage(similar(star.select(F.col("row").alias("a"), F.col("lead").alias("b")).distinct(), sets, threshold), "links")
    labels = components(links)
    placed = cut_lineage(live.join(labels, "row", "left").select(
        "bucket", "row", "n", "bands", F.coalesce("label", "row").alias("label")), "placed")
    more = cut_lineage(similar(_across(placed, sets, threshold), sets, threshold), "more")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    return _choose(held.select("row", "doc_id", "same"), same, labels)


def _reach(n: Column, m: Column, threshold: float) -> Column:
    """Sizes that allow the similarity."""
    return F.least(n, m) >= threshold * F.greatest(n, m)


def _buckets(vertices: DataFrame) -> DataFrame:
    """Members of the buckets with several: bucket, row, n, bands, and the bucket's lead with its size.

    The lead is the member that meets most others over all its buckets, which is near the middle of its group.
    """
    member = vertices.select("row", F.explode("bands").alias("bucket"))
    several = cut_lineage(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    live = cut_lineage(member.join(several, "bucket"), "members")
    central = live.groupBy("row").agg(F.sum("size").alias("met")).join(vertices, "row")
    met = cut_lineage(live.select("row", "bucket").join(central, "row"), "met")
    lead = met.groupBy("bucket").agg(F.max(F.struct("met", "row", "n")).alias("top"))
    lead = cut_lineage(lead.select("bucket", F.col("top.row").alias("lead"), F.col("top.n").alias("lead_n")), "leads")
    return met.drop("met").join(lead, "bucket")


def _across(placed: DataFrame, sets: DataFrame, threshold: float, rare: int = RARE) -> DataFrame:
    """Candidate pairs ``(a, b)`` of buckets whose members are not one group yet: every pair that can be similar.

    Elements that at most ``rare`` of these texts have are rare.  Two texts without a common rare element have at most
    the smaller of their counts of other elements in common, which must reach what the similarity asks of their sizes;
    this leaves out most texts, and most pairs of the rest.  All others that can be similar share a rare element, and
    an element gives at most ``rare`` squared pairs.
    """
    size = placed.select("row", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    ranked = placed.join(cut_lineage(size, "label-sizes"), "label").withColumn("rank", F.struct("size", "label"))
    ranked = cut_lineage(ranked.drop("size"), "ranked")
    mixed = ranked.groupBy("bucket").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).where("low < high")
    open_ = cut_lineage(ranked.join(cut_lineage(mixed, "mixed"), "bucket"), "open")
    texts = cut_lineage(open_.select("row", "n", "label").distinct(), "open-rows")
    each = sets.join(texts.select("row"), "row", "left_semi").mapInArrow(_each_element, "row bigint, element int")
    each = cut_lineage(each, "elements")
    several = each.groupBy("element").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = cut_lineage(each.join(cut_lineage(several, "several"), "element"), "shared")
    common = (shared.where(F.col("times") > rare).groupBy("row").agg(F.count(F.lit(1)).alias("c"))
              .join(texts, "row").where(F.col("c") >= threshold * F.col("n")))
    core = cut_lineage(open_.join(cut_lineage(common.select("row", "c"), "core"), "row"), "core-rows")
    side = lambda df, x, own, *more: df.select(F.col("row").alias(x), F.col("n").alias(f"{x}n"), F.col(own).alias(f"{x}l"), *more)
    apart = (F.col("al") < F.col("bl")) & _reach(F.col("an"), F.col("bn"), threshold)
    # The texts of smaller groups look for those of larger ones, so those of a bucket's largest group are on one side
    # only and are not paired with each other.  A pair is taken in the least bucket that it shares, so that it comes once.
    x = side(core.where("rank < high"), "a", "rank", "bucket", F.col("c").alias("ac"), F.col("bands").alias("ab"))
    y = side(core.where("rank > low"), "b", "rank", "bucket", F.col("c").alias("bc"), F.col("bands").alias("bb"))
    enough = F.least("ac", "bc") >= threshold / (1 + threshold) * (F.col("an") + F.col("bn"))
    first = F.array_min(F.array_intersect("ab", "bb")) == F.col("bucket")
    plain = x.join(y.withColumnRenamed("bucket", "to"), (F.col("bucket") == F.col("to")) & apart & enough & first).select("a", "b")
    rares = cut_lineage(shared.where(F.col("times") <= rare).drop("times").join(texts, "row"), "rares")
    u, v = side(rares, "a", "label", "element"), side(rares, "b", "label", F.col("element").alias("to"))
    odd = u.join(v, (F.col("element") == F.col("to")) & apart).select("a", "b")
    return plain.unionByName(odd).distinct()


def _each_element(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text and element."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            sets = [np.unique(np.frombuffer(e, np.int32)) for e in part.column("elements").to_pylist()]
            rows = np.repeat(part.column("row").to_numpy(), [len(e) for e in sets])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate(sets))], names=["row", "element"])


def _choose(rows: DataFrame, same: DataFrame, labels: DataFrame) -> DataFrame:
    vertices = (same.select("same", "copies", F.col("top.row").alias("row"), F.col("top.doc_id").alias("doc_id"))
                .join(labels, "row", "left").withColumn("label", F.coalesce("label", "row")))
    vertices = cut_lineage(vertices, "vertices")
    classes = cut_lineage(vertices.groupBy("label").agg(
        F.max(F.struct("doc_id", "row")).alias("keep"), F.sum("copies").alias("group_size")), "classes")
    known = cut_lineage(vertices.select("same", "label").join(classes, "label").select("same", "keep", "group_size"), "known")
    return (rows.join(known, "same").select("row", "doc_id", "same", F.col("keep.doc_id").alias("class_id"), "group_size",
                                            (F.col("keep.row") == F.col("row")).alias("kept")))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group."""
    name = lambda id_, same: F.concat_ws("/", F.coalesce(id_.cast("bigint").cast("string"), F.lit("null")), same)
    decided = cut_lineage(_grouped(docs).select(name(F.col("doc_id"), F.col("same")).alias("name"), "kept"), "decided")
    return stay(docs, name(F.col("doc_id"), _same(_lower())), decided)
