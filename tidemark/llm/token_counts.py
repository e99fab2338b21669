"""Token counts of texts under a SentencePiece BPE model, without the ids of any document.

The model escapes spaces and has no piece with a space after another character, so merges never cross from a
non-space to a space: a text is its dummy space and itself, cut before every run of spaces, and its count is the sum
over these pre-tokens.  Each block of documents is dictionary-encoded by pre-token; a piece count is made once per
distinct pre-token (and kept for later blocks up to ``KEPT`` entries), joined to the documents' pre-token occurrences
by code and summed.

Null counts as empty and an empty text has 0 tokens.  Repeated rows and clashing extra columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import chunks, flat

LIMIT = 4096
BLOCK_BYTES = 1 << 23
KEPT = 400_000  # pre-tokens whose counts a Python worker keeps; others are counted again when they return
_workers: dict = {}


class PieceCounter:
    """Counts pieces of pre-tokens with one loaded model."""

    def __init__(self, path: str, kept: int = KEPT):
        import sentencepiece

        self.model, self.kept = sentencepiece.SentencePieceProcessor(model_file=path), kept
        self.known = {"": 1}  # a single space at the end of a text

    def pieces(self, tokens: list[str]) -> np.ndarray:
        """Number of pieces of each pre-token, given without its one leading space."""
        get = self.known.get
        found = [get(t) for t in tokens]
        missing = [i for i, n in enumerate(found) if n is None]
        for i, ids in zip(missing, self.model.encode([tokens[i] for i in missing], num_threads=1)):
            found[i] = len(ids)
            if len(self.known) < self.kept:
                self.known[tokens[i]] = len(ids)
        return np.array(found, np.int64)


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of one text, each without the space it begins with."""
    return [t[1:] for t in re.findall(" +[^ ]*", " " + text.replace("▁", " "))]


def _lists(column: pa.Array) -> pa.ListArray:
    """Pre-tokens of every text; where no spaces follow each other or end the text they are its words."""
    odd = pc.match_substring_regex(column, "  |^ | $|▁")
    if not pc.any(odd).as_py():
        return pc.split_pattern(column, " ")
    return pa.array([pre_tokens(t) if o else t.split(" ") for t, o in zip(column.to_pylist(), odd.to_pylist())],
                    pa.list_(pa.string()))


def counts(column: pa.Array, counter: PieceCounter) -> np.ndarray:
    """Tokens of each text of a block."""
    lists = _lists(column)
    coded = lists.flatten().dictionary_encode()
    pieces = counter.pieces(coded.dictionary.to_pylist())
    running = np.concatenate([[0], np.cumsum(pieces[coded.indices.to_numpy(zero_copy_only=False)])])
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    n = running[at[1:]] - running[at[:-1]]
    n[pc.equal(column, "").to_numpy(zero_copy_only=False)] = 0
    return n


def count_tokens(docs: DataFrame, model_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``n_bytes`` and ``n_tokens`` of the text."""
    slim = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = slim.drop("_text").withColumns({"n_bytes": F.lit(0).cast("bigint"), "n_tokens": F.lit(0).cast("bigint")}).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _workers.get(model_path) or _workers.setdefault(model_path, PieceCounter(model_path))
        for part in chunks(batches, "_text", BLOCK_BYTES):
            column = part.column("_text")
            n_bytes = np.diff(flat(column)[1])
            kept = [part.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_bytes, pa.int64()), pa.array(counts(column, counter), pa.int64())],
                                             names=[*keep, "n_bytes", "n_tokens"])

    return slim.mapInArrow(run, schema)
