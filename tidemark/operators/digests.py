"""Consistency of two copies by trees of digests, so that only what differs is read.

The keys of a tenant are dealt into ranges by their hash.  A range's digest does not depend on the order of its records: a
count and two XORs of independent 64-bit hashes of (key, payload digest).  The digest of a wider range is the sum of its
parts in the same sense, so a tree is one grouped aggregate and a few roll-ups of it.  Two trees are compared from the
roots down, a level reading only the children of ranges that differ; equal ranges are consistent without a look at their
records.  The records of a copy are stored by range, so the ranges that do differ are partitions to read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators.reconcile import KEYS, verdicts

BITS, FAN_BITS = 8, 4  # 256 leaf ranges per tenant, 16 children a node


def key_range(bits: int = BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*KEYS), 64 - bits).cast("int")


def with_range(df: DataFrame, bits: int = BITS) -> DataFrame:
    return df.withColumn("range", key_range(bits))


def levels(bits: int = BITS, fan_bits: int = FAN_BITS) -> list[int]:
    """Bits of each level from the root to the leaves."""
    return [*range(0, bits, fan_bits), bits]


def leaf_digests(records: DataFrame) -> DataFrame:
    """One row per tenant and range of ``records`` with a ``range`` column and a payload."""
    digest = X.payload_digest("payload")
    mixed = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), *KEYS, digest))
    return records.groupBy("tenantId", "range").agg(F.count(F.lit(1)).alias("n"), mixed("a").alias("x"), mixed("b").alias("y"))


def digest_tree(records: DataFrame, bits: int = BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """``tenantId, bits, range, n, x, y`` for every level; the roots have 0 bits and range 0."""
    leaves = leaf_digests(records)
    marks = levels(bits, fan_bits)
    at = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.shiftright("range", bits - b).alias("range")) for b in marks]))
    return (leaves.select("tenantId", at.alias("node"), "n", "x", "y").groupBy("tenantId", "node")
            .agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
            .select("tenantId", "node.bits", "node.range", "n", "x", "y"))


def differing_ranges(left: DataFrame, right: DataFrame, bits: int = BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """``tenantId, range`` of the leaves whose digests differ, found from the roots down."""
    marks = levels(bits, fan_bits)
    open_ = None
    for above, b in zip([None, *marks], marks):
        side = lambda tree: tree.where(F.col("bits") == b).drop("bits")
        ours, theirs = side(left), side(right)
        if open_ is not None:
            parents = open_.select("tenantId", F.col("range").alias("_up"))
            step = b - above
            below = lambda df: df.withColumn("_up", F.shiftright("range", step)).join(parents, ["tenantId", "_up"], "left_semi").drop("_up")
            ours, theirs = below(ours), below(theirs)
        pair = lambda df, p: df.select("tenantId", "range", F.struct("n", "x", "y").alias(p))
        open_ = (pair(ours, "l").join(pair(theirs, "r"), ["tenantId", "range"], "full_outer")
                 .where(~F.col("l").eqNullSafe(F.col("r"))).select("tenantId", "range"))
    return open_


def write_copy(records: DataFrame, path: str, bits: int = BITS, fan_bits: int = FAN_BITS) -> None:
    """A copy's records by range, and the tree over them made from what was written."""
    spark = records.sparkSession
    (with_range(records.select(*KEYS, "payload"), bits).hint("rebalance", "range").write.mode("overwrite")
     .partitionBy("range").parquet(f"{path}/records"))
    digest_tree(read_records(spark, path), bits, fan_bits).write.mode("overwrite").parquet(f"{path}/tree")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tenantId STRING, aggregateId STRING, payload BINARY, range INT").parquet(f"{path}/records")


def compare_copies(requested: DataFrame, left_path: str, right_path: str, bits: int = BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """``reconcile.verdicts`` of the requested keys over two stored copies, reading only the ranges that differ.

    The numbers of the differing ranges, at most 2**bits, are known before the records are scanned, so the
    scan lists their partitions only.  A key absent from both copies is consistent, in any range.
    """
    spark = requested.sparkSession
    tree = lambda path: spark.read.parquet(f"{path}/tree")
    open_ = differing_ranges(tree(left_path), tree(right_path), bits, fan_bits)
    numbers = sorted(r["range"] for r in open_.select("range").distinct().collect())
    asked = with_range(requested.select(*KEYS), bits).join(open_.withColumn("_open", F.lit(True)), ["tenantId", "range"], "left")
    chosen = [read_records(spark, p).where(F.col("range").isin(numbers)) for p in (left_path, right_path)]
    looked = verdicts(asked.where("_open"), *chosen)
    return looked.unionByName(asked.where("_open IS NULL").select(*KEYS, F.lit("CONSISTENT").alias("verdict")))
