"""Exact deduplication against immutable snapshots behind binary-fuse filters.

A snapshot is a table of distinct digests with the largest id and the count of each, and one static binary-fuse filter
per digest bucket.  The digests of an incoming batch are grouped among themselves first; each distinct one is screened
by its bucket's filter.  What the filter denies is new for certain.  What it lets pass joins the snapshot's exact
digests, and the bytes of the two representatives are compared before the groups become one.

Texts are equal when identical; null counts as empty.  Of equal texts the row with the largest id stays; rows that
repeat the id of the one that stays are dropped too (``row`` tells them apart).  A null id counts as smaller than any.
An empty snapshot or batch is valid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import GOLDEN, mix
from tidemark.llm.names import free_name
from tidemark.session import cut_lineage

PER_BUCKET = 1 << 16  # distinct digests of a filter
FILTER = "bucket bigint, seed bigint, segment bigint, segments bigint, cells binary"
_CELL = np.uint16  # false positives: 1 in 65536


class FuseFilter:
    """A static filter of three cells per key: 16 bits each, about 1.13 cells a key for many keys."""

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """From distinct 64-bit keys: peel keys that own a cell alone, layer by layer, then fill in reverse."""
        n = len(keys)
        segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        load = 1.125 if n > 1 << 18 else max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 4)))
        segments = max(1, int(np.ceil(n * load / segment)) - 2)
        seed = 0
        while True:
            made = cls(seed, segment, segments, np.zeros((segments + 2) * segment, _CELL))
            if made._fill(keys):
                return made
            seed += 1
            segments += seed % 8 == 0

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + np.uint64(self.seed) * GOLDEN)
        first = ((h >> np.uint64(32)) * np.uint64(self.segments) >> np.uint64(32)).astype(np.int64)
        low = np.int64(self.segment - 1)
        inner = mix(h).astype(np.int64)
        at = np.stack([(first + j) * self.segment + (inner >> (18 * j) & low) for j in range(3)])
        return at, (mix(h ^ GOLDEN) >> np.uint64(48)).astype(_CELL)

    def _fill(self, keys: np.ndarray) -> bool:
        at, mark = self._places(keys)
        size = len(self.cells)
        count = np.bincount(at.ravel(), minlength=size)
        index = np.arange(len(keys), dtype=np.int64)
        owner = np.zeros(size, np.int64)
        for row in at:
            np.bitwise_xor.at(owner, row, index)
        layers, left = [], len(keys)
        alone = np.flatnonzero(count == 1)
        while len(alone):
            peeled, where = np.unique(owner[alone], return_index=True)
            layers.append((peeled, alone[where]))
            left -= len(peeled)
            for row in at[:, peeled]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, peeled)
            touched = np.unique(at[:, peeled])
            alone = touched[count[touched] == 1]
        if left:
            return False
        for peeled, cell in reversed(layers):
            a, b, c = at[:, peeled]
            self.cells[cell] = 0
            self.cells[cell] = mark[peeled] ^ self.cells[a] ^ self.cells[b] ^ self.cells[c]
        return True

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), mark = self._places(keys)
        return self.cells[a] ^ self.cells[b] ^ self.cells[c] == mark


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, row number, hex SHA-256 of the text and its length in bytes."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.sha2(body, 256).alias("sha"), F.octet_length(body).cast("bigint").alias("n_bytes"))


def grouped(batch: DataFrame) -> DataFrame:
    """Equal digests of one batch among themselves; map-side combined, so a hot digest is a row per task."""
    return batch.groupBy("sha").agg(F.max(F.struct("id", "row")).alias("top"), F.count(F.lit(1)).alias("n"))


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    key = F.conv(F.substring("sha", 1, 15), 16, 10).cast("bigint")
    return groups.withColumn("key", key).withColumn("bucket", F.pmod(F.xxhash64("sha"), F.lit(buckets)))


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    f = FuseFilter.build(np.unique(rows["key"].to_numpy().astype(np.uint64)))
    return pd.DataFrame({"bucket": [int(key[0])], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments],
                         "cells": [f.cells.tobytes()]})


def _screen(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(filters):
        return rows.iloc[:0][["sha"]]
    f = filters.iloc[0]
    held = FuseFilter(int(f["seed"]), int(f["segment"]), int(f["segments"]), np.frombuffer(f["cells"], _CELL))
    return rows.loc[held.might_hold(rows["key"].to_numpy().astype(np.uint64)), ["sha"]]


class Snapshot:
    """Immutable digests of documents already held, with their filters."""

    def __init__(self, groups: DataFrame, per_bucket: int = PER_BUCKET):
        self.buckets = max(1, -(-groups.count() // per_bucket))
        self.groups = cut_lineage(_bucketed(groups, self.buckets), "snapshot")
        made = self.groups.select("bucket", "key").groupBy("bucket").applyInPandas(_build, FILTER)
        self.filters = cut_lineage(made, "filters")

    def screen(self, groups: DataFrame) -> DataFrame:
        """The digests of a batch that its bucket's filter does not rule out."""
        keyed = _bucketed(groups, self.buckets).select("bucket", "key", "sha")
        return (keyed.groupBy("bucket").cogroup(self.filters.groupBy("bucket"))
                .applyInPandas(_screen, "sha string"))

    def matches(self, groups: DataFrame) -> DataFrame:
        """Positives that the exact digests confirm: sha, the batch's and the snapshot's representative."""
        held = self.groups.select("sha", F.col("top").alias("held"), F.col("n").alias("n_held"))
        return groups.join(self.screen(groups), "sha", "left_semi").join(held, "sha")


def same_bytes(matches: DataFrame, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """The matched digests whose representatives' texts are the same bytes.

    Only texts of representatives reach the aggregate: two rows per digest, or a few more where an id repeats.
    """
    wanted = matches.select("sha", F.explode(F.array("top.id", "held.id")).alias("id")).distinct()
    body = F.coalesce(F.col(text), F.lit(""))
    bodies = docs.select(F.col(id_col).alias("id"), F.sha2(body, 256).alias("sha"), body.alias("body"))
    # The same join at every size: which texts are shuffled must not hang on whether the digests could be broadcast.
    met = bodies.join(wanted.hint("merge"), bodies["id"].eqNullSafe(wanted["id"]) & (bodies["sha"] == wanted["sha"]), "left_semi")
    return (met.groupBy("sha").agg(F.min("body").alias("low"), F.max("body").alias("high"))
            .where(F.col("low") == F.col("high")).select("sha"))


def decide(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: id, row, sha, n_bytes, ``keep`` (id and row that stay), group_size and ``kept``.

    The table is taken as two batches by a hash of the id: the first becomes a snapshot, the second is screened by it.
    """
    rows = cut_lineage(digests(docs, id_col, text), "digests")
    late = F.pmod(F.xxhash64("id"), F.lit(2)) == 1
    snapshot = Snapshot(grouped(rows.where(~late)))
    batch = cut_lineage(grouped(rows.where(late)), "batch")
    matches = cut_lineage(snapshot.matches(batch), "matches")
    merged = matches.join(same_bytes(matches, docs, id_col, text), "sha", "left_semi").select(
        "sha", F.greatest("top", "held").alias("keep"), (F.col("n") + F.col("n_held")).alias("group_size"))
    merged = cut_lineage(merged, "merged")
    alone = batch.select("sha", "top", "n").unionByName(snapshot.groups.select("sha", "top", "n"))
    alone = (alone.where(F.col("n") > 1).join(merged, "sha", "left_anti")
             .select("sha", F.col("top").alias("keep"), F.col("n").alias("group_size")))
    # Only groups of more than one row are joined, from a written table, so that Spark can split a hot digest.
    groups = cut_lineage(merged.unionByName(alone), "groups")
    own = F.struct("id", "row")
    return (rows.join(groups, "sha", "left")
            .withColumns({"keep": F.coalesce("keep", own), "group_size": F.coalesce("group_size", F.lit(1)).cast("bigint")})
            .withColumn("kept", F.col("keep.row") == F.col("row")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    decided = decide(docs, id_col, text)
    name = lambda id_, sha: F.concat_ws("/", F.coalesce(id_.cast("string"), F.lit("null")), sha)
    decided = cut_lineage(decided.select(name(F.col("id"), F.col("sha")).alias("name"), "kept"), "decided")
    return stay(docs, name(F.col(id_col), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), decided)


def stay(docs: DataFrame, name: Column, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose name is kept, one of each name; ``decided`` has ``name`` and ``kept`` of every row.

    Rows are known by a name made of their values, because a row number may differ in every scan.
    """
    key = free_name(docs, "_name")
    per_name = decided.groupBy(F.col("name").alias(key)).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    per_name = cut_lineage(per_name.where(~F.col("kept") | (F.col("n") > 1)), "names")
    named = docs.withColumn(key, name)
    left = named.join(per_name.where(~F.col("kept")).select(key), key, "left_anti")
    return once(left, key, per_name.where(F.col("kept")).select(key)).select(*docs.columns)


def once(named: DataFrame, key: str, repeats: DataFrame) -> DataFrame:
    """One row of each name, given the names that several rows have."""
    if repeats.isEmpty():
        return named
    return (named.join(repeats, key, "left_anti")
            .unionByName(named.join(repeats, key, "left_semi").dropDuplicates([key])))
