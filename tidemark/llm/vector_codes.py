"""Product codes of vectors, trained and assigned with dictionaries of the values that each dimension really has.

A vector's components become integers ``floor(1024 * x)`` and are cut into four consecutive parts.  Vectors are kept in
blocks, like the row groups of a columnar file: per block and dimension a dictionary of its distinct integers, and per
vector the dictionary code of every component.  To compare a block with a codebook, the squared differences of every
distinct integer to all entries are tabulated once; the distances of a part are then rows of these tables, gathered by
code and added up.  Blocks are bounded, so tables are too, whatever values the vectors hold.

A codebook starts as the parts of the vectors with the smallest ids.  A round sums the integers by nearest entry in each
task, adds the partial sums up in Spark and divides; only the entries, 256 a part, come to the driver.  All arithmetic is
on integers: where 64 bits may not do, Python's own integers are used.

Vectors that are null, or hold a null or a component that is not finite, are dropped.  Rows without an id are encoded
and rank behind all others as first entries; of rows with one id the smaller vector ranks first.  Vectors of another
length than the first one are kept with null code and error.  An error beyond a long is null, and so is the sum of a
label with such an error.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import with_group_totals
from tidemark.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK_ROWS, BLOCK_CELLS, STEP_ROWS = 1 << 14, 1 << 22, 1 << 11
LIMB = 32
BLOCKS = "id array<bigint>, label array<bigint>, dictionary array<string>, sizes array<int>, codes binary"


def kept(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors without nulls, NaN and infinities."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vectors.where(F.col(column).isNotNull() & F.coalesce(F.forall(column, finite), F.lit(False)))


def integers(x: np.ndarray) -> np.ndarray:
    """``floor(1024 x)``; exact, because a power of two scales without rounding."""
    scaled = x.astype(np.float64) * SCALE
    if not x.size or np.abs(scaled).max() < 2.0 ** 53:
        return np.floor(scaled).astype(np.int64)
    whole = [math.floor(Fraction(float(v)) * SCALE) for v in x.ravel()]
    return np.array([*whole, None], object)[:-1].reshape(x.shape)


def _fitting(values: list[int], dims: int) -> type:
    """The smallest integer type that holds every distance between these values over ``dims`` dimensions."""
    worst = dims * (2 * max(map(abs, values), default=0)) ** 2
    return np.int32 if worst < 2 ** 31 else np.int64 if worst < 2 ** 63 else object


class Block:
    """Vectors as codes into one dictionary per dimension."""

    def __init__(self, dictionary: list[np.ndarray], codes: np.ndarray):
        self.dictionary, self.codes = dictionary, codes

    @classmethod
    def of(cls, whole: np.ndarray) -> Block:
        pairs = [np.unique(whole[:, d], return_inverse=True) for d in range(whole.shape[1])]
        codes = np.stack([c.reshape(-1) for _, c in pairs], 1) if pairs else np.zeros(whole.shape)
        return cls([v for v, _ in pairs], codes.astype(np.uint16))

    @classmethod
    def read(cls, row: dict) -> Block:
        sizes = row["sizes"]
        found = [int(v) for v in row["dictionary"]]
        big = max(map(abs, found), default=0) >= 2 ** 53
        values = np.array([*found, None], object)[:-1] if big else np.array(found, np.int64)
        ends = np.cumsum(sizes)
        codes = np.frombuffer(row["codes"], np.uint16).reshape(len(row["id"]), len(sizes))
        return cls(np.split(values, ends[:-1]) if sizes else [], codes)

    def columns(self) -> tuple[list[str], list[int], bytes]:
        return [str(v) for d in self.dictionary for v in d.tolist()], [len(d) for d in self.dictionary], self.codes.tobytes()

    def nearest(self, book: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance for the part that begins at dimension ``first``."""
        dims = range(first, first + book.shape[1])
        ends = [int(f(self.dictionary[d])) for d in dims for f in (np.min, np.max)]
        kind = _fitting([*ends, *([int(book.min()), int(book.max())] if book.size else [])], len(dims))
        tables = [(self.dictionary[d].astype(kind)[:, None] - book[:, d - first].astype(kind)[None, :]) ** 2 for d in dims]
        entry, least = np.zeros(len(self.codes), np.int64), np.zeros(len(self.codes), np.int64 if kind is np.int32 else kind)
        for a in range(0, len(self.codes), STEP_ROWS):
            part = self.codes[a:a + STEP_ROWS]
            total = np.zeros((len(part), len(book)), kind)
            for d, table in zip(dims, tables):
                total += table[part[:, d]]
            best = total.argmin(1)
            entry[a:a + STEP_ROWS], least[a:a + STEP_ROWS] = best, total[np.arange(len(part)), best]
        return entry, least

    def part(self, first: int, dims: int) -> np.ndarray:
        """The integers themselves."""
        return np.stack([self.dictionary[d][self.codes[:, d]] for d in range(first, first + dims)], 1) if dims else np.zeros((len(self.codes), 0), np.int64)


def blocks(vectors: DataFrame, dims: int, column: str = "embedding", id_: str = "vec_id", label: str = "label") -> DataFrame:
    """Blocks of the vectors with ``dims`` components."""
    rows_of = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(dims, 1)))
    slim = vectors.where(F.size(column) == dims).select(
        F.col(id_).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(column).cast("array<double>").alias("v"))

    def build(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        dictionary, sizes, codes = Block.of(integers(flat.reshape(table.num_rows, dims))).columns()
        return pa.RecordBatch.from_arrays(
            [pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([table.column("label").to_pylist()], pa.list_(pa.int64())),
             pa.array([dictionary], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int32())), pa.array([codes], pa.binary())],
            names=["id", "label", "dictionary", "sizes", "codes"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, rows_of - n)
                batch = batch.slice(piece.num_rows)
                held.append(piece)
                n += piece.num_rows
                if n == rows_of:
                    yield build(held)
                    held, n = [], 0
        if n:
            yield build(held)

    return slim.mapInArrow(run, BLOCKS)


def _limbs(total: int, n: int) -> list[int]:
    """Base 2**32 digits, the last one signed, so that sums of digits never overflow a long."""
    return [(total >> LIMB * i) & ((1 << LIMB) - 1) for i in range(n - 1)] + [total >> LIMB * (n - 1)]


def entry_sums(held: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Per task, part and entry: how many parts are nearest to it, and the digits of their component sums."""
    dims = books[0].shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = {}, {}
        for row in (r for b in batches for r in b.to_pylist()):
            block = Block.read(row)
            for p, book in enumerate(books):
                entry, _ = block.nearest(book, p * dims)
                order = np.argsort(entry, kind="stable")
                found, at = np.unique(entry[order], return_index=True)
                whole = block.part(p * dims, dims)[order]
                added = np.add.reduceat(whole, at, axis=0) if dims else np.zeros((len(found), 0), np.int64)
                for e, n, s in zip(found.tolist(), np.diff([*at, len(order)]).tolist(), added.tolist()):
                    counts[p, e] = counts.get((p, e), 0) + n
                    sums[p, e] = [x + y for x, y in zip(sums[p, e], s)] if (p, e) in sums else s
        out = []
        for (p, e), total in sums.items():
            limbs = max([2, *[-(-(t.bit_length() + 1) // LIMB) for t in total]])
            digits = [_limbs(t, limbs) for t in total]
            out += [(p, e, i, counts[p, e] if i == 0 else 0, limbs if i == 0 else 0, [d[i] for d in digits]) for i in range(limbs)]
        names, kinds = ["part", "entry", "digit", "n", "limbs", "sums"], [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=names)

    partial = held.mapInArrow(run, "part int, entry int, digit int, n bigint, limbs int, sums array<bigint>")
    return partial.groupBy("part", "entry", "digit").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).cast("array<bigint>").alias("sums"))


def moved(books: list[np.ndarray], rows: Iterable) -> list[np.ndarray]:
    """Every used entry becomes the floor of the mean of its parts."""
    totals, counts = {}, {}
    for r in rows:
        counts[r["part"], r["entry"]] = counts.get((r["part"], r["entry"]), 0) + r["n"]
        own = totals.setdefault((r["part"], r["entry"]), [0] * len(r["sums"]))
        for i, s in enumerate(r["sums"]):
            own[i] += s << LIMB * r["digit"]
    new = [b.tolist() for b in books]
    for (p, e), total in totals.items():
        new[p][e] = [t // counts[p, e] for t in total]
    return [_book(n, b.shape[1]) for n, b in zip(new, books)]


def _book(entries: list[list[int]], dims: int) -> np.ndarray:
    big = max((abs(v) for e in entries for v in e), default=0) >= 2 ** 53
    return np.array(entries, object if big else np.int64).reshape(len(entries), dims)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for e in b.tolist() for v in e).encode()).hexdigest()


def train(held: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    for _ in range(rounds):
        books = moved(books, entry_sums(held, books).collect())  # 256 entries a part, at most
    return books


def assign(held: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``id, label, code, error`` of every vector in the blocks."""
    dims = books[0].shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            found = [Block.read(row).nearest(book, p * dims) for p, book in enumerate(books)]
            codes = ["".join(f"{e:02x}" for e in es) for es in zip(*[e.tolist() for e, _ in found])]
            errors = [sum(ds) for ds in zip(*[d.tolist() for _, d in found])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["id"], pa.int64()), pa.array(row["label"], pa.int64()), pa.array(codes),
                 pa.array([e if e < 2 ** 63 else None for e in errors], pa.int64())], names=["id", "label", "code", "error"])

    return held.mapInArrow(run, "id bigint, label bigint, code string, error bigint")


def compress(vectors: DataFrame, column: str = "embedding", id_: str = "vec_id", label: str = "label",
             rounds: int = ROUNDS) -> DataFrame:
    """Per kept vector: id, label, code, error, the label's summed error and the digest of the codebooks."""
    good = kept(vectors, column)
    top = good.select(F.col(column).cast("array<double>").alias("v"), F.col(id_).alias("i")).orderBy(
        F.col("i").asc_nulls_last(), "v").limit(ENTRIES).collect()
    dims = len(top[0]["v"]) if top else 0
    if dims % PARTS:
        raise ValueError(f"vectors of {dims} components cannot be cut into {PARTS} equal parts")
    size = dims // PARTS
    first = [integers(np.array(r["v"], np.float64)).tolist() for r in top if len(r["v"]) == dims]
    books = [_book([v[p * size:(p + 1) * size] for v in first], size) for p in range(PARTS)]
    held = cut_lineage(blocks(good, dims, column, id_, label), "vector-blocks")
    books = train(held, books, rounds)
    other = good.where(F.size(column) != dims).select(
        F.col(id_).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    coded = cut_lineage(assign(held, books).unionByName(other), "vector-codes")
    named = coded.select("*", F.coalesce("label", F.lit(0)).alias("_label"), F.col("label").isNull().alias("_none"))
    beyond = F.col("code").isNotNull() & F.col("error").isNull()
    total = with_group_totals(named, ["_label", "_none"], ["id", "code"],
                              {"_part": F.sum(F.col("error").cast("decimal(38,0)")), "_far": F.bool_or(beyond)},
                              {"_sum": (F.sum, "_part"), "_beyond": (F.bool_or, "_far")})
    return total.select("id", "label", "code", "error", F.when(~F.col("_beyond"), F.expr("try_cast(_sum AS bigint)")).alias("label_error"),
                        F.lit(digest(books)).alias("codebooks_sha256"))
