"""Exact Jaccard join of word shingles by T-occurrence search, as components of linked documents.

A text is the set of its runs of ``SHINGLE`` words, lower-cased in A-Z only; a text of fewer words is one run.  A text
that is to reach a similarity must have T runs in common with another, T following from both sizes.  Of a text's
inverted lists, those of its rarest runs are short; all but T of its runs are enough, with ``EXTRA`` more so that a
partner must lie in several of them.  The short lists are merged through a heap that skips ids which can no longer reach
the number of lists asked for; the long lists are not merged at all: a candidate is looked up in them by binary search.
As both texts of a pair keep their rarest runs in one common order, a pair that is similar meets in the short lists as
often as its sizes ask, whatever the order is, so no link is lost.

Spark holds the lists by run.  The order comes from a table of run counts over all texts that has a fixed size.  A text
stays in a list only if a text of a size that can reach the similarity is there too.  All list entries are shuffled once,
by run: there the lists are counted, the single ones are dropped and copies of an entry become one.  First every member of
a list is compared with the list's most central text of its size only, its pivot; texts linked by then are one component.

Texts that have a pivot in common look for each other by their differences from it: if a text is not linked with the pivot,
a similar text shares more than half of its own difference, and differences are mostly rare runs.  So a family of texts
around one pivot that are nearly similar meets in few short lists, where its common runs would pair all its members.

Lists whose members are all of one component, or all have one pivot, are done.  In the rest, texts look for partners of
other components only, the smaller component's texts in the larger one's lists, which come in segments of a bounded number
of texts: a hot list is many rows, and a group of linked copies is never paired with itself.

Texts with equal sets are one vertex: their list entries are equal, as an entry names its set by 48 bits of the digest.  Should
two sets have these in common, both stay with the entries of both, and pairs are compared by the sets.  Null is empty; a text without words has the empty set and links with nothing.
Rows of one id share a component only where they are linked.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrays import GOLDEN, chunks, flat, mix, word_bounds, word_hashes
from tidemark.llm.near_dedup import components
from tidemark.session import cut_lineage

SHINGLE, PERCENT, EXTRA = 3, 90, 2
CELL_BITS, BLOCK_BITS = 22, 14  # the table of run counts has 2**22 cells in blocks of 2**14, whatever the corpus
SEGMENT = 256   # texts of a list segment, about
SET_BYTES = 1 << 19  # bytes of text that a worker turns into sets at once
SEEN = 1 << 16  # sets that a task knows as already given, about
PIVOTS = 4      # pivots of a text that the search over the lists knows of
MARK_BITS = 23  # bits of the bitmap that marks texts of candidate pairs
ROW_BITS = 14
RUN_BYTES = (64 - ROW_BITS + 7) // 8
KEY_BITS, PLACE_BITS = 48, 16  # of a set's key: of the digest, about as many as a run has, and of the class of its size
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct run hashes of all texts, and the len + 1 offsets of the rows."""
    data, offsets = flat(column)
    start, end, at = word_bounds(data, offsets)
    words = word_hashes(LOWER[data], start, end)
    n = np.diff(at)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    left = np.repeat(at[1:], n) - np.arange(len(words))
    runs = np.zeros(len(words), np.uint64)
    for j in range(k):
        step = mix(np.array([j + 1], np.uint64) * GOLDEN)[0] | np.uint64(1)
        runs += np.where(left > j, padded[j:j + len(words)], np.uint64(0)) * step
    whole = left >= k
    whole[at[:-1][n > 0]] = True
    row = np.repeat(np.arange(len(n), dtype=np.uint64), n)[whole]
    keys = np.unique(mix(runs[whole]) >> np.uint64(ROW_BITS) | row << np.uint64(64 - ROW_BITS))
    own = np.searchsorted(keys >> np.uint64(64 - ROW_BITS), np.arange(len(n) + 1, dtype=np.uint64))
    return keys & np.uint64((1 << 64 - ROW_BITS) - 1), own


def packed(runs: np.ndarray) -> bytes:
    """Sorted runs as the bytes of their distances, lowest bytes of all first: the highest ones are zero and compress."""
    apart = np.diff(runs, prepend=np.uint64(0)).astype("<u8")
    return apart.view(np.uint8).reshape(-1, 8)[:, :RUN_BYTES].T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    apart = np.zeros((len(blob) // RUN_BYTES, 8), np.uint8)
    apart[:, :RUN_BYTES] = np.frombuffer(blob, np.uint8).reshape(RUN_BYTES, -1).T
    return np.cumsum(apart.view("<u8")[:, 0], dtype=np.uint64)


def sets(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Row number, id, digest of the set, ``KEY_BITS`` of it, the set's size and its runs, packed, for every document."""
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, max_bytes=SET_BYTES):
            hashes, at = shingle_sets(part.column("text"), k)
            own = [hashes[a:b] for a, b in zip(at, at[1:])]
            same = [hashlib.blake2b(runs.tobytes(), digest_size=16).digest() for runs in own]
            keys = (np.frombuffer(b"".join(same), np.uint64)[::2] >> np.uint64(64 - KEY_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), pa.array(same, pa.binary()), pa.array(keys),
                 pa.array(np.diff(at), pa.int64()), pa.array([packed(runs) for runs in own], pa.binary())], names=["row", "doc_id", "same", "key", "n", "runs"])

    return slim.mapInArrow(run, "row bigint, doc_id bigint, same binary, key bigint, n bigint, runs binary")


def _cells(runs: np.ndarray) -> np.ndarray:
    return (runs & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)


def run_classes(held: DataFrame) -> np.ndarray:
    """Logarithmic class of the count of every cell of runs, over all texts; a byte a cell.

    A task counts into one table of all cells and gives it in blocks, in as few bytes a count as a block needs and
    packed; the blocks of all tasks meet by number and are added up one after the other.
    """
    cells, block = 1 << CELL_BITS, 1 << BLOCK_BITS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                runs = [unpacked(blob) for blob in batch.column("runs").slice(at, 256).to_pylist()]
                np.add.at(counts, _cells(np.concatenate(runs)), 1)
        parts = counts.reshape(-1, block)
        used = np.flatnonzero(parts.any(1))
        for i in used.tolist():
            kind = np.min_scalar_type(parts[i].max())
            blob = zlib.compress(parts[i].astype(kind).tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([kind.itemsize], pa.int32()), pa.array([blob], pa.binary())], names=["block", "width", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for batch in batches:
            for i, width, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "width", "counts"))):
                totals[i] = totals.get(i, 0) + np.frombuffer(zlib.decompress(blob), f"u{width}").astype(np.int64)
        for i, total in totals.items():
            level = np.minimum(255, 8 * np.log2(np.maximum(total, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "levels"])

    counted = held.select("runs").mapInArrow(count, "block int, width int, counts binary")
    found = counted.repartition("block").mapInArrow(add, "block int, levels binary").collect()  # 2**CELL_BITS bytes
    classes = np.zeros(cells, np.uint8)
    for r in found:
        classes[r["block"] * block:(r["block"] + 1) * block] = np.frombuffer(r["levels"], np.uint8)
    return classes


class Measure:
    """Sizes and overlaps that a similarity of ``percent`` asks for, on numbers, arrays and columns alike."""

    def __init__(self, percent: int = PERCENT, extra: int = EXTRA):
        if extra < 1:
            raise ValueError("with fewer than one short list beyond the overlap a similar pair may meet in none")
        self.percent, self.extra = percent, extra

    def overlap(self, n, m):
        return -(-self.percent * (n + m) // (100 + self.percent))

    def long(self, n):
        """How many of a text's lists are long: any partner has at least that many and ``extra`` runs in common."""
        return np.maximum(-(-self.percent * n // 100) - self.extra, 0)

    def needed(self, n, m):
        """Short lists that a similar pair has in common at least."""
        return np.maximum(self.overlap(n, m) - np.maximum(self.long(n), self.long(m)), 1)

    def linked(self, n, m, common) -> bool:
        return 100 * common >= self.percent * (n + m - common)

    # The same on columns.
    def sizes(self, n: Column, m: Column) -> Column:
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def needed_column(self, n: Column, m: Column) -> Column:
        overlap = F.ceil(self.percent * (n + m) / F.lit(100.0 + self.percent) - 1e-9)
        long = F.greatest(F.ceil(self.percent * F.greatest(n, m) / F.lit(100.0) - 1e-9) - self.extra, F.lit(0))
        return F.greatest(overlap - long, F.lit(1))

    def least_needed(self, n: Column) -> Column:
        """``needed`` of a text and any partner is at least that."""
        return F.least(F.lit(self.extra), F.ceil(self.percent * n / F.lit(100.0) - 1e-9))

    def size_class(self, n: Column, parts: int = 1) -> Column:
        """Sizes that can be similar are at most ``parts`` classes apart."""
        step = math.log(100 / self.percent) * (1 + 1e-9) if self.percent < 100 else 1.0
        return F.floor(F.log(n) * parts / step)

    def key(self, digest: Column, n: Column) -> Column:
        """Bits of a set's digest, and in the lowest ones its class of sizes: all that a list entry tells of its set."""
        return F.shiftleft(digest, PLACE_BITS).bitwiseOR(self.size_class(n, 2))

    def place(self, key: Column) -> Column:
        return key.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))

    # Differences: texts of ``n`` and ``m`` runs, of which ``x`` are in one of them only.
    def apart(self, x: Column, n: Column, m: Column) -> Column:
        """Too many differences for a link."""
        return (100 + self.percent) * x > (100 - self.percent) * (n + m)

    def weight(self, x: Column, n: Column) -> Column:
        """What the ``x`` differences of a text from its pivot add to those that it has to share with a similar one."""
        return (100 + self.percent) * x - (100 - self.percent) * n

    def shared(self, v: Column, w: Column) -> Column:
        """Differences from one pivot that similar texts of these weights and of different components share at least."""
        return F.greatest(F.ceil((v + w) / F.lit(2.0 * (100 + self.percent)) - 1e-9), F.lit(1))


def short_lists(held: DataFrame, classes: np.ndarray, measure: Measure) -> DataFrame:
    """``key, run`` for the rarest runs of every text; most copies of a set within a task are left out."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fresh = []
                for same in part.column("same").to_pylist():
                    fresh.append(same not in seen)
                    seen.add(same)
                if len(seen) > SEEN:
                    seen.clear()
                part = part.filter(pa.array(fresh))
                if not part.num_rows:
                    continue
                kept = []
                for blob in part.column("runs").to_pylist():
                    runs = unpacked(blob)
                    p = len(runs) - int(measure.long(len(runs)))
                    # Runs have 50 bits and classes 8, so the class can go in front.
                    order = classes[_cells(runs)].astype(np.uint64) << np.uint64(64 - ROW_BITS) | runs
                    kept.append(np.partition(order, p - 1)[:p] & np.uint64((1 << 64 - ROW_BITS) - 1) if p else runs)
                sizes = [len(k) for k in kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column("key").to_numpy(), sizes), pa.int64()), pa.array(np.concatenate(kept).astype(np.int64), pa.int64())],
                    names=["key", "run"])

    return held.select("same", "key", "runs").mapInArrow(run, "key bigint, run bigint")


def merge_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """Ids that are in at least ``need`` of the sorted lists, with the number of lists."""
    at = [0] * len(lists)
    heap = [(own[0], i) for i, own in enumerate(lists) if own]
    heapify(heap)
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heappop(heap)[1])
        if len(popped) >= need:
            yield top, len(popped)
            to = top + 1
        else:
            # Any id below the one that is then on top lies in fewer than ``need`` lists.
            while heap and len(popped) < need - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                return
            to = max(heap[0][0], top + 1)
        for i in popped:
            at[i] = bisect_left(lists[i], to, at[i])
            if at[i] < len(lists[i]):
                heappush(heap, (lists[i][at[i]], i))


def probe(a: np.ndarray, b: np.ndarray) -> int:
    """Runs of ``a`` whose lists hold ``b``, by binary search in the runs of ``b``."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(b) else 0


def _sets_of(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The sets of the texts in ``pairs``, and few others.

    The texts are marked in a bitmap of a fixed size, so that the sets of all others are left out where they
    are read and are not shuffled.  A bitmap that is too full lets more through, which changes nothing.
    """
    place = lambda row: F.pmod(F.xxhash64(row), F.lit(1 << MARK_BITS))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("row")).select(place("row").alias("at"))
    bits = ids.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    marked = np.zeros((1 << MARK_BITS) + (1 << 16), bool)
    for r in bits.collect():  # at most 2**MARK_BITS bits
        first = (r["bucket"] - 1) * (1 << 15) + 1  # numbers begin at 1 in a bucket; zero has a bucket of its own
        marked[max(first, 0):first + (1 << 15)] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little").astype(bool)[max(-first, 0):]
    packed = np.packbits(marked)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy()
            keep = packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            yield batch.select(["row", "runs"]).filter(pa.array(keep.astype(bool)))

    return held.select("row", place("row").alias("at"), "runs").mapInArrow(run, "row bigint, runs binary")


def _with_sets(pairs: DataFrame, held: DataFrame) -> DataFrame:
    own = cut_lineage(_sets_of(pairs, held), "pair-sets")
    side = lambda x, runs: own.select(F.col("row").alias(x), F.col("runs").alias(runs))
    return pairs.select("a", "b").join(side("a", "xs"), "a").join(side("b", "ys"), "b")


def linked(pairs: DataFrame, held: DataFrame, measure: Measure) -> DataFrame:
    """The pairs ``(a, b)`` that reach the overlap."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(*(batch.column(c).to_pylist() for c in ("xs", "ys"))):
                s, t = unpacked(x), unpacked(y)
                keep.append(measure.linked(len(s), len(t), probe(s, t)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_sets(pairs, held).mapInArrow(run, "a bigint, b bigint")


def compared(pairs: DataFrame, held: DataFrame, measure: Measure) -> DataFrame:
    """The pairs ``(a, b)`` of texts and pivots with their sizes, whether they are linked, and ``a``'s difference from ``b``.

    The difference is null where the two have too little in common for it to be short.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, links, deltas = [], [], []
            for x, y in zip(*(batch.column(c).to_pylist() for c in ("xs", "ys"))):
                s, t = unpacked(x), unpacked(y)
                delta = np.setxor1d(s, t, assume_unique=True)
                sizes.append((len(s), len(t)))
                links.append(measure.linked(len(s), len(t), (len(s) + len(t) - len(delta)) // 2))
                deltas.append(delta.astype(np.int64) if 2 * len(delta) <= len(s) + len(t) else None)
            an, bn = zip(*sizes) if sizes else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(an, pa.int64()), pa.array(bn, pa.int64()), pa.array(links, pa.bool_()),
                 pa.array(deltas, pa.list_(pa.int64()))], names=["a", "b", "an", "bn", "linked", "delta"])

    return _with_sets(pairs, held).mapInArrow(run, "a bigint, b bigint, an bigint, bn bigint, linked boolean, delta array<bigint>")


def _shared(postings: DataFrame, measure: Measure) -> DataFrame:
    """Lists of several sets that can be similar by their sizes: run, key and the list's length.

    A list has a bit for each class of sizes, modulo 64; with more sets than bits a class may hold two of them.
    Both sides of the join read one shuffle of the entries, and it needs no other.
    """
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(c, F.lit(64)).cast("int"))
    turned = lambda bits, by: F.shiftleft(bits, by).bitwiseOR(F.shiftrightunsigned(bits, 64 - by))
    place = measure.place(F.col("key"))
    dealt = postings.repartition("run")
    lists = dealt.distinct().groupBy("run").agg(F.count(F.lit(1)).alias("times"), F.bit_or(bit(place)).alias("bits"))
    bits, twice = F.col("bits"), F.col("times") > F.bit_count("bits")
    several = lists.where(twice | (bits.bitwiseAND(turned(bits, 1).bitwiseOR(turned(bits, 2))) != 0))
    beside = reduce(Column.bitwiseOR, [bit(place + j) for j in (-2, -1, 1, 2)])
    return dealt.join(several, "run").where(twice | (bits.bitwiseAND(beside) != 0)).drop("bits").distinct()


def _star(shared: DataFrame, same: DataFrame, measure: Measure) -> tuple[DataFrame, DataFrame]:
    """The lists with each text's number of shared lists, and the pairs of texts with the central text of a list and size class."""
    own = Window.partitionBy("key")  # no more entries than the set has runs
    met = shared.withColumn("q", F.count(F.lit(1)).over(own)).withColumn("met", F.sum("times").over(own))
    live = met.join(same.select("key", "row", "n"), "key").where(F.col("q") >= measure.least_needed(F.col("n")))
    live = cut_lineage(live.select("run", "row", "n", "q", "met", measure.size_class(F.col("n")).alias("class")), "live")
    # The texts and the central ones among them are met in one shuffle, which is why both take all columns.
    text = F.struct("met", "row", "n", "q")
    dealt = live.repartition("run", "class")
    near = dealt.join(dealt.groupBy("run", "class").agg(F.max(text).alias("top")), ["run", "class"]).where(
        (text < F.col("top")) & measure.sizes(F.col("n"), F.col("top.n"))
        & (F.least("q", "top.q") >= measure.needed_column(F.col("n"), F.col("top.n"))))
    pairs = near.select(F.col("row").alias("a"), F.col("top.row").alias("b"), F.col("n").alias("an"), F.col("top.n").alias("bn"))
    pairs = cut_lineage(pairs.distinct(), "star-pairs")
    # Of these pairs the short lists that both are in are counted, as the search does for its candidates.
    # Half of them is no link, but enough for a pivot.
    mine, theirs = (live.select("run", F.col("row").alias(x)) for x in ("a", "b"))
    met = pairs.join(mine, "a").join(theirs, ["b", "run"]).groupBy("a", "b", "an", "bn").agg(F.count(F.lit(1)).alias("hits"))
    return live, met.where(2 * F.col("hits") >= measure.needed_column(F.col("an"), F.col("bn"))).select("a", "b")


def _in_families(star: DataFrame, labels: DataFrame, measure: Measure) -> DataFrame:
    """The links ``(a, b)`` between texts of different components that have a pivot in common.

    ``star`` has the differences of texts from pivots.  Of two such texts at least one is far, that is outside the pivot's
    component, and so not linked with the pivot.  If they are similar they share differences: two similar texts that share
    none are both linked with the pivot.
    """
    own = lambda row, label: labels.select(F.col("row").alias(row), F.col("label").alias(label))
    rows = (star.where("delta IS NOT NULL").join(own("a", "label"), "a", "left").join(own("b", "pivot_label"), "b", "left")
            .select(F.col("b").alias("pivot"), F.col("a").alias("row"), F.col("an").alias("n"),
                    F.coalesce("label", "a").alias("label"), F.coalesce("pivot_label", "b").alias("pivot_label"), F.size("delta").cast("bigint").alias("x"), "delta")
            .withColumn("far", F.col("label") != F.col("pivot_label")))
    rows = cut_lineage(rows.withColumn("w", measure.weight(F.col("x"), F.col("n"))), "differences")
    several = rows.groupBy("pivot").agg(
        F.count(F.lit(1)).alias("texts"), F.min(F.when(F.col("far"), F.col("w"))).alias("far_w"), F.min(F.when(~F.col("far"), F.col("w"))).alias("near_w"))
    several = cut_lineage(several.where("texts > 1 AND far_w IS NOT NULL").select("pivot", "far_w", "near_w"), "pivots")
    rows = cut_lineage(rows.join(several, "pivot"), "families")
    # The differences that fewest texts of the family have come first.  Of t shared ones at most t - 1 are not among a text's
    # first x - t + 1.  For partners near the pivot t is smaller.  With t above x there is no partner.
    each = rows.select("pivot", "row", F.explode("delta").alias("run"))
    order = each.join(each.groupBy("pivot", "run").agg(F.count(F.lit(1)).alias("times")), ["pivot", "run"]).groupBy("pivot", "row").agg(F.array_sort(F.collect_list(F.struct("times", "run"))).alias("order"))
    w = F.col("w")
    rest = F.coalesce(F.when(F.col("far"), measure.shared(w, F.col("near_w"))), F.col("t"))
    first = rows.drop("delta").join(order, ["pivot", "row"]).withColumn("t", measure.shared(w, F.col("far_w"))).withColumn("tn", F.least("t", rest))
    keys = first.select("pivot", "row", "n", "x", "w", "label", "far", "t", "tn", F.posexplode(
        F.slice("order.run", F.lit(1), F.greatest(F.col("x") - F.col("tn") + 1, F.lit(0)).cast("int"))).alias("at", "run"))
    keys = cut_lineage(keys.withColumn("short", F.col("at") <= F.col("x") - F.col("t")), "rare-differences")
    asks = keys.where("far").select("pivot", "run", *(F.col(c).alias(f"a_{c}") for c in ("row", "n", "x", "w", "label", "t", "tn", "short")))
    met = asks.join(keys.where("short").drop("tn", "at"), ["pivot", "run"]).where(
        (F.col("a_label") != F.col("label")) & (~F.col("far") | (F.col("a_short") & (F.col("a_row") < F.col("row"))))
        & measure.sizes(F.col("a_n"), F.col("n")) & ~measure.apart(F.abs(F.col("a_x") - F.col("x")), F.col("a_n"), F.col("n")))
    need = measure.shared(F.col("a_w"), w) - F.greatest("t", F.when(F.col("far"), F.col("a_t")).otherwise(F.col("a_tn"))) + 1
    met = met.groupBy("pivot", F.col("a_row").alias("a"), F.col("row").alias("b"), need.alias("need")).agg(F.count(F.lit(1)).alias("hits"))
    pairs = cut_lineage(met.where("hits >= need").select("pivot", "a", "b"), "family-pairs")
    side = lambda row, delta, size: rows.select("pivot", F.col("row").alias(row), F.col("delta").alias(delta), F.col("n").alias(size))
    both = pairs.join(side("a", "da", "an"), ["pivot", "a"]).join(side("b", "db", "bn"), ["pivot", "b"])
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    return both.where(~measure.apart(apart, F.col("an"), F.col("bn"))).select("a", "b")


def _pivots(star: DataFrame) -> DataFrame:
    """``row, pivots``: the nearest pivots of a text from which its difference is known; a pivot is its own."""
    known = star.where("delta IS NOT NULL")
    rows = known.select(F.col("a").alias("row"), F.size("delta").alias("x"), F.col("b").alias("pivot")).unionByName(
        known.select(F.col("b").alias("row"), F.lit(0).alias("x"), F.col("b").alias("pivot")).distinct())
    nearest = F.slice(F.array_sort(F.collect_list(F.struct("x", "pivot"))), 1, PIVOTS)
    return rows.groupBy("row").agg(F.transform(nearest, lambda s: s["pivot"]).alias("pivots"))


def _search(live: DataFrame, labels: DataFrame, pivots: DataFrame, measure: Measure, segment: int) -> DataFrame:
    """T-occurrence search over the lists that several components are in: candidate pairs ``(a, b)`` without a common pivot."""
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    known = labels.join(cut_lineage(size, "label-sizes"), "label").select("row", "label", "size")
    known = cut_lineage(known.join(pivots, "row", "full"), "label-rows")
    rank = F.struct(F.coalesce("size", F.lit(1).cast("bigint")).alias("size"), F.coalesce("label", "row").alias("label"))
    placed = cut_lineage(live.join(known, "row", "left").select(
        "run", "row", "n", "q", rank.alias("rank"), F.coalesce("pivots", F.array("row")).alias("pivots")), "placed")
    # As in ``_star``, both sides take all columns and so read one shuffle.
    first = F.array_min("pivots")
    dealt = placed.repartition("run")
    mixed = dealt.groupBy("run").agg(
        F.min("rank").alias("low"), F.max(F.struct("rank", "pivots", "row", "n", "q")).alias("top"), F.min(first).alias("one"), F.max(first).alias("other"))
    mixed = mixed.select("run", "low", F.col("top.rank").alias("high"), "one", "other").where("low < high AND one < other")
    mine = cut_lineage(dealt.join(mixed.drop("one", "other"), "run"), "mixed-lists")
    blocks = max(1, mine.select("row").distinct().count() // segment)
    asks = mine.where("rank < high").select(
        "run", F.col("row").alias("a"), F.col("n").alias("an"), F.col("q").alias("aq"), F.col("rank").alias("ar"), F.col("pivots").alias("ap"))
    parts = (mine.where("rank > low").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).groupBy("run", "block")
             .agg(F.array_sort(F.collect_list(F.struct("row", "n", "q", "rank", "pivots"))).alias("list")))  # about ``segment`` texts
    fits = lambda x: ((F.col("ar") < x["rank"]) & measure.sizes(F.col("an"), x["n"])
                      & (F.least("aq", x["q"]) >= measure.needed_column(F.col("an"), x["n"])) & ~F.arrays_overlap("ap", x["pivots"]))
    met = (asks.join(parts, "run").withColumn("list", F.transform(F.filter("list", fits), lambda x: F.struct(x["row"].alias("b"), x["n"].alias("bn"))))
           .where(F.size("list") > 0))
    return met.groupBy("a", "an", "block").agg(F.collect_list("list").alias("lists")).select("a", "an", "lists").mapInArrow(
        _merger(measure), "a bigint, b bigint")


def _merger(measure: Measure):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            lists = batch.column("lists")
            for i, (row, n) in enumerate(zip(batch.column("a").to_pylist(), batch.column("an").to_pylist())):
                own = lists[i].values
                inner = own.flatten()
                ids, sizes = inner.field("b").to_numpy(), inner.field("bn").to_numpy()
                ends = np.diff(own.offsets.to_numpy())
                need = measure.needed(n, sizes)
                size_of = dict(zip(ids.tolist(), sizes.tolist()))
                for id_, hits in merge_skip([x.tolist() for x in np.split(ids, np.cumsum(ends)[:-1])], int(need.min())):
                    if hits >= measure.needed(n, size_of[id_]):
                        a.append(row)
                        b.append(id_)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, extra: int = EXTRA, segment: int = SEGMENT) -> DataFrame:
    """For every row: ``row, doc_id, n`` (size of its set) and ``component`` (smallest id of its component)."""
    measure = Measure(percent, extra)
    held = cut_lineage(sets(docs, k).withColumn("key", measure.key(F.col("key"), F.col("n"))), "run-sets")
    some = held.where("n > 0")
    same = cut_lineage(some.groupBy("same", "key", "n").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id")), "same-sets")
    postings = cut_lineage(short_lists(some, run_classes(some), measure), "postings")
    live, near = _star(cut_lineage(_shared(postings, measure), "shared-lists"), same, measure)
    star = cut_lineage(compared(cut_lineage(near, "star-candidates"), some, measure), "star")
    links = star.where("linked").select("a", "b")
    labels = components(links)
    more = linked(cut_lineage(_search(live, labels, _pivots(star), measure, segment), "candidates"), some, measure)
    more = cut_lineage(more.unionByName(_in_families(star, labels, measure)), "search-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    placed = cut_lineage(same.join(labels, "row", "left").select("same", "doc_id", F.coalesce("label", "row").alias("label")), "placed-sets")
    first = cut_lineage(placed.groupBy("label").agg(F.min("doc_id").alias("component")), "component-ids")
    known = cut_lineage(placed.join(first, "label").select("same", "component"), "known-sets")
    return (held.join(known, "same", "left").select("row", "doc_id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component")))
