"""Mixing sources to target weights with fixed-length blocks.

The words of a source, document after document, are cut into blocks of ``BLOCK`` words.  Output shards draw how many of
their slots each source gets from a multinomial; a source's slots are numbered through the shards, and slot k takes the
block that a pseudorandom permutation of the source's block numbers gives for k.  Past the last block the next epoch
begins with another permutation.  What the draws leave over or short of a source's share of slots, its target in whole
blocks, is settled by passing the last surplus slots to the sources that are short, so the mix is exact to a block and
no block is used more than ``MOST`` times.

Sources are ranked by code point, null last, and weigh 3, 1, 2 in turn.  Together they share ``SHARE`` of all words; a
source stops at ``MOST`` times its own words and the excess is shared again by weight.  Null text has no words.
Documents without words are returned with 0 taken.  Rows that repeat an id count and are returned each by itself.
An empty table gives an empty result.  The result depends on ids, sizes and the seed only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrays import GOLDEN, mix, unit
from tidemark.llm.exact_dedup import once
from tidemark.llm.names import free_name
from tidemark.session import cut_lineage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
BLOCK = 128
SHARD_SLOTS = 4096
SLICES = 1024  # parts of a source whose documents are numbered apart
MAX_SOURCES = 100_000  # the table of weights is kept whole; more sources are refused
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """Row number, id, source and size in words of every document.

    The number holds for the table that this is written to; another scan of ``docs`` may number its rows otherwise.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", words.alias("size"), *more)


def targets(sums: list[tuple], weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> list[float]:
    """Target words per (source, size), in rank order: by weight, stopped at ``most`` times the size."""
    total = share * sum(size for _, size in sums)
    weight = [weights[i % len(weights)] for i in range(len(sums))]
    out, free = [0.0] * len(sums), [i for i, (_, size) in enumerate(sums) if size]
    while free:
        rest = total - sum(out)
        per = rest / sum(weight[i] for i in free)
        over = [i for i in free if per * weight[i] > most * sums[i][1]]
        for i in over or free:
            out[i] = float(most * sums[i][1]) if over else per * weight[i]
        free = [i for i in free if i not in set(over)] if over else []
    return out


class Plan:
    """What all tasks know: blocks, slots and seed of each source."""

    def __init__(self, sums: list[tuple], block: int = BLOCK, seed: int = 7):
        self.sums, self.targets, self.seed = sums, targets(sums), seed
        self.size = np.array([size for _, size in sums], np.int64)
        self.blocks = -(-self.size // block)
        ratio = np.array(self.targets) / np.maximum(self.size, 1)
        self.quota = np.minimum(np.floor(self.blocks * ratio + 0.5).astype(np.int64), MOST * self.blocks)
        self.slots = int(self.quota.sum())
        self.shards = -(-self.slots // SHARD_SLOTS)

    def draw(self, shard: int) -> np.ndarray:
        """Slots of each source in one shard."""
        n = min(SHARD_SLOTS, self.slots - shard * SHARD_SLOTS)
        return np.random.default_rng([self.seed, shard]).multinomial(n, self.quota / self.slots)

    def settle(self, drawn: np.ndarray, source: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pass slots beyond a source's quota to sources short of theirs; ``drawn`` are the totals of all shards."""
        over, short = np.maximum(drawn - self.quota, 0), np.maximum(self.quota - drawn, 0)
        before = np.cumsum(over) - over
        upto = np.cumsum(short)
        moved = k >= self.quota[source]
        rank = before[source[moved]] + k[moved] - self.quota[source[moved]]
        to = np.searchsorted(upto, rank, "right")
        source, k = source.copy(), k.copy()
        source[moved], k[moved] = to, drawn[to] + rank - (upto[to] - short[to])
        return source, k

    def block_of(self, source: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The block of slot k: a Feistel network on the next power of four, walked until it is a block number."""
        n = np.maximum(self.blocks[source], 1)
        epoch, x = (k // n).astype(np.uint64), (k % n).astype(np.uint64)
        half = np.maximum(1, -(-np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) // 2)).astype(np.uint64)
        low = (np.uint64(1) << half) - np.uint64(1)
        key = mix(mix(source.astype(np.uint64) + np.uint64(self.seed)) + epoch * GOLDEN)
        walk = np.ones(len(x), bool)
        while walk.any():
            left, right = x[walk] >> half[walk], x[walk] & low[walk]
            for turn in range(4):
                round_key = mix(key[walk] + np.uint64(turn))
                left, right = right, left ^ (mix(right + round_key) & low[walk])
            x[walk] = left << half[walk] | right
            walk[walk] = x[walk] >= n[walk].astype(np.uint64)
        return x.astype(np.int64)


def make_plan(sized: DataFrame) -> Plan:
    """Sources in code-point order with null last; one row per source comes to the driver, bounded by MAX_SOURCES."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: merge sources before mixing")
    return Plan(sorted(((r["source"], int(r["size"])) for r in rows), key=lambda r: (r[0] is None, (r[0] or "").encode())))


def located(sized: DataFrame, plan: Plan) -> DataFrame:
    """Add the source's number and the first word's position within the source.

    A source is numbered slice by slice, so that a hot one is no single window; a window over the slices gives what
    precedes each.
    """
    known = sized.sparkSession.createDataFrame(
        [(s, i) for i, (s, _) in enumerate(plan.sums)], "source string, source_no int")
    numbered = sized.join(F.broadcast(known), sized["source"].eqNullSafe(known["source"])).drop(known["source"])
    cut = numbered.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SLICES)))
    inside = (Window.partitionBy("source_no", "_slice").orderBy("doc_id", "size", "row")
              .rowsBetween(Window.unboundedPreceding, -1))
    earlier = Window.partitionBy("source_no").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (cut.groupBy("source_no", "_slice").agg(F.sum("size").alias("_n"))
              .select("source_no", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    return (cut.join(before, ["source_no", "_slice"])
            .withColumn("start", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .drop("_slice", "_before"))


def uses(spark, plan: Plan) -> DataFrame:
    """``source_no, block, epoch`` of every slot of the mix."""
    schema = "source_no int, block bigint, epoch bigint"
    if not plan.slots:
        return spark.createDataFrame([], schema)
    n = len(plan.sums)

    def draw(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"]:
                c = plan.draw(int(shard))
                at = np.flatnonzero(c)
                yield pd.DataFrame({"shard": shard, "source_no": at.astype(np.int32), "n": c[at]})

    parts = max(1, min(plan.shards, 4096, -(-plan.shards // 16)))
    drawn = cut_lineage(spark.range(0, plan.shards, 1, parts).mapInPandas(draw, "shard bigint, source_no int, n bigint"), "drawn")
    sums = np.zeros(n, np.int64)
    for r in drawn.groupBy("source_no").agg(F.sum("n").alias("n")).collect():  # one row per source
        sums[r["source_no"]] = r["n"]
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = drawn.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    def fill(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                p = b.iloc[at:at + 256]
                count = p["n"].to_numpy()
                source = np.repeat(p["source_no"].to_numpy().astype(np.int64), count)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                source, k = plan.settle(sums, source, np.repeat(p["first"].to_numpy(), count) + step)
                yield pd.DataFrame({"source_no": source.astype(np.int32), "block": plan.block_of(source, k),
                                    "epoch": k // np.maximum(plan.blocks[source], 1)})

    return first.mapInPandas(fill, schema)


def spans(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document and block it lies in: row, source_no, block, first and last word (exclusive) inside it."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    return (placed.where(F.col("size") > 0).select("row", "source_no", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
            .select("row", "source_no", "block",
                    F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("from_word"),
                    F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")).alias("to_word")))


def mix_sources(docs: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame, Plan]:
    """Placed documents, their taken spans (a row per document, block and epoch) and the plan."""
    sized = cut_lineage(sizes(docs, *more), "sizes")
    plan = make_plan(sized)
    placed = cut_lineage(located(sized, plan), "placed")
    # Spark takes the slots for as small as the shard counts they are unrolled from; they must not be broadcast.
    taken = spans(placed).hint("merge").join(uses(docs.sparkSession, plan), ["source_no", "block"])
    return placed, taken, plan


def taken_words(docs: DataFrame) -> DataFrame:
    """Every document with its source's size and target and the words the mix takes of it."""
    placed, taken, plan = mix_sources(docs)
    got = taken.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    info = docs.sparkSession.createDataFrame(
        [(i, int(size), float(t)) for i, ((_, size), t) in enumerate(zip(plan.sums, plan.targets))],
        "source_no int, source_size bigint, target double")
    return (placed.join(F.broadcast(info), "source_no").join(got, "row", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")))


def _words_of(text: Column, runs: Column) -> Column:
    """The words of sorted runs ``(block, from_word, to_word)``, each with the white space that follows it."""
    tokens = F.regexp_extract_all(text, F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))

    def joined(words: Column) -> Column:
        part = lambda r: F.array_join(F.slice(words, r["from_word"] + 1, r["to_word"] - r["from_word"]), "")
        return F.array_join(F.transform(runs, part), "")

    # A text is cut into words once, as the only element of an array, and not once for each run.
    return F.element_at(F.transform(F.array(tokens), joined), 1)


def _name(docs: DataFrame) -> Column:
    """A digest of all columns: rows are met by their values, because a row number may differ in every scan."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    text = F.coalesce(F.sha2("text", 256), F.lit("null"))
    return F.sha2(F.concat_ws("/", text, F.to_json(rest, {"ignoreNullFields": "false"})), 256)


def mixed(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for every document and epoch that has taken blocks, its text the words taken.

    Columns are those of ``docs``; ``n_chars``, where there is one, follows the new text.
    """
    key, spans_ = free_name(docs, "_row"), free_name(docs, "_runs")
    placed, taken, _ = mix_sources(docs, _name(docs).alias("name"))
    runs = taken.groupBy("row", "epoch").agg(
        F.array_sort(F.collect_list(F.struct("block", "from_word", "to_word"))).alias(spans_)).drop("epoch")
    runs = runs.join(placed.select("row", F.col("name").alias(key)), "row").drop("row")
    # Rows of one name are alike in every column: one of them stands for all.
    repeats = placed.groupBy(F.col("name").alias(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    repeats = cut_lineage(repeats, "repeats")
    out = (once(docs.withColumn(key, _name(docs)), key, repeats).join(runs, key)
           .withColumn("text", _words_of(F.col("text"), F.col(spans_))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
