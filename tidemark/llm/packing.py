"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document's ids, with an end id, are cut into full sequences and a remainder.  Remainders are dealt into groups of
about ``GROUP`` documents.  A group's remainders fill sequences whose capacities are all ``length`` but for the last
few, which are the powers of two that make up what is left, so that no sequence needs padding.  In descending order of
estimated cost, linear plus quadratic in the length for attention, each remainder goes to the sequence of lowest cost
that has room for it; when none has, it is cut over those with most room.

Null text is empty: one end id.  Repeated rows are packed each by itself.  An empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
GROUP = 1024
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024  # cost of n tokens: LINEAR n + QUADRATIC n^2
KEPT = 400_000  # words whose ids a Python worker keeps
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
# White space before a space, or at the end: there a pre-token may hold more than one of them.
_RUNS = [chr(c) + " " for c in (0x20, *range(0x09, 0x0E), *range(0x1C, 0x20))]
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_workers: dict = {}


class WordIds(dict):
    """Ids of a word after a space as little-endian unsigned 32-bit integers, made when first asked for."""

    def __init__(self, path: str, kept: int = KEPT):
        super().__init__()
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = _byte_of_char()
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.kept = kept

    def encode(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            return _bytes(self.coder.encode(text, allowed_special="all"))
        return _bytes(self.coder.encode_ordinary(text))

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(" " + word)
        if len(self) < self.kept:
            self[word] = ids
        return ids

    def text_ids(self, text: str) -> bytes:
        """A space before a non-space always begins a pre-token, so a text without runs of white space around spaces
        is encoded word by word; other texts are encoded whole."""
        if any(run in text for run in _RUNS) or text[-1:].isspace() or not text.isascii() and _WIDE_SPACE.search(text):
            return self.encode(text)
        first, *rest = text.split(" ")
        return self.encode(first) + b"".join(map(self.__getitem__, rest))


def _bytes(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _byte_of_char() -> dict[str, int]:
    """The printable character that byte-level BPE files write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def capacities(total: int, length: int = LENGTH) -> list[int]:
    """Sequence lengths that hold exactly ``total`` tokens: full ones, then descending powers of two."""
    rest = total % length
    return [length] * (total // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def balance(lengths: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(item, start, length, sequence, offset)`` that fill the sequences of ``capacities`` exactly."""
    room = np.array(capacities(sum(lengths), length), np.int64)
    size, load, out = room.copy(), np.zeros(len(room)), []
    for item in sorted(range(len(lengths)), key=lambda i: (-cost(lengths[i]), i)):
        start, left = 0, lengths[item]
        while left:
            fits = np.where(room >= left, load, np.inf)
            k = int(fits.argmin())
            if fits[k] == np.inf:
                k = int(room.argmax())
            n = min(left, int(room[k]))
            out.append((item, start, n, k, int(size[k] - room[k])))
            room[k] -= n
            load[k] += cost(n)
            start, left = start + n, left - n
    return out


def tokenise(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``length`` ids per row: full ones with their checksum, the remainder with its ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _workers.get(path) or _workers.setdefault(path, WordIds(path))
        end, step = np.array([end_id], "<u4").tobytes(), 4 * length
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for uid, doc, text in zip(*(part.column(c).to_pylist() for c in ("uid", "doc_id", "text"))):
                    ids = words.text_ids(text) + end
                    n = len(ids) // 4
                    for k in range(0, len(ids), step):
                        piece = ids[k:k + step]
                        full = len(piece) == step
                        rows.append((uid, doc, k // 4, len(piece) // 4, n, zlib.crc32(piece), None if full else piece))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [*[pa.int64()] * 6, pa.binary()])],
                    names=["uid", "doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    slim = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(run, "uid bigint, doc_id bigint, start bigint, length bigint, doc_tokens bigint, "
                                "ids_crc32 bigint, ids binary")


def _pack_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """All sequences of one group; the first numbers go to the full pieces of long documents."""
    rows = rows.sort_values(["uid", "start"], kind="stable").reset_index(drop=True)
    whole = rows["ids"].isna()
    full, rest = rows[whole], rows[~whole].reset_index(drop=True)
    base = int(key[0]) << 32
    done = full.assign(sequence_id=base + np.arange(len(full)), offset=0)
    out = []
    for item, start, n, k, offset in balance(rest["length"].tolist()):
        out.append((item, start, n, base + len(full) + k, offset))
    if not out:
        return done[[c.split()[0] for c in PIECE.split(", ")]]
    at = np.array(out, np.int64)
    item, start, n = at[:, 0], at[:, 1], at[:, 2]
    ids, doc, begin, total, crc = (rest[c].to_numpy() for c in ("ids", "doc_id", "start", "doc_tokens", "ids_crc32"))
    cut = n < rest["length"].to_numpy()[item]
    sums = [zlib.crc32(ids[i][4 * s:4 * (s + m)]) if c else crc[i] for i, s, m, c in zip(item, start, n, cut)]
    packed = pd.DataFrame({"doc_id": doc[item], "start": begin[item] + start, "length": n, "ids_crc32": sums,
                           "doc_tokens": total[item], "sequence_id": at[:, 3], "offset": at[:, 4]})
    return pd.concat([done[packed.columns], packed]) if len(done) else packed


def pack(docs: DataFrame, path: str, per_group: int = GROUP) -> DataFrame:
    """Pieces of all documents with the sequence and offset of each."""
    groups = max(1, -(-docs.count() // per_group))
    pieces = tokenise(docs, path).withColumn("_group", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    return pieces.groupBy("_group").applyInPandas(_pack_group, PIECE)
