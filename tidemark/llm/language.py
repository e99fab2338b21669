"""Language identification by error-correcting output codes.

Every language has a codeword; a linear logistic classifier over hashed byte n-grams predicts each bit.  A text's bits
are decoded to the codeword of least loss, where a bit's logistic loss counts by how well its classifier did in
training; the score is the decoded language's share of exp(-loss), and a text is ambiguous when the two best are close.

Classifiers are fitted on at most about ``PER_LANGUAGE`` texts of each language, picked by a hash of the id among rows
with a language whose crc32(id) mod 5 is not 0; every language of those rows is learned.  A text that is null or has no
letter is ``und`` with score 0, and so is every text where no language is known.  Repeated rows get a row each; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import GOLDEN, chunks, flat, mix

PER_LANGUAGE = 400
MAX_LANGUAGES = 2000  # codewords and counts of languages are kept whole; more values are refused
BUCKETS = 4096
SIZES = (2, 3, 4)  # lengths of n-grams in bytes
PENALTY, STEPS, SCALE = 1e-4, 150, 30.0
MARGIN = 0.2  # least difference of the two best shares for a text that is not ambiguous
UNKNOWN = "und"


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """A matrix of -1 and 1 with a row per language: all splits for up to four, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 4:
        splits = range(1, 1 << n - 1)
        return np.array([[1 if s >> i & 1 else -1 for s in splits] for i in range(n)], float)
    bits, rng = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed)
    best, found = -1, None
    for _ in range(50 if n <= 300 else 3):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code[0, np.abs(code.sum(0)) == n] *= -1  # no constant bit
        apart = bits - (code @ code.T + bits) / 2
        least = apart[~np.eye(n, dtype=bool)].min()
        if least > best:
            best, found = least, code
    return found


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length the positions and buckets of the n-grams inside the texts."""
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    code = np.zeros(len(data), np.uint64)
    for k in range(1, max(SIZES) + 1):
        code[:len(data) - k + 1] = code[:len(data) - k + 1] << np.uint64(8) | data[k - 1:]
        if k in SIZES:
            at = np.flatnonzero(left >= k)
            yield at, (mix((code[at] + np.uint64(k)) * GOLDEN) % np.uint64(BUCKETS)).astype(np.int64)


def frequencies(texts: pa.Array) -> np.ndarray:
    """Share of each bucket among the n-grams of each text, scaled."""
    data, offsets = flat(texts)
    out = np.zeros((len(texts), BUCKETS), np.float32)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    for at, bucket in grams(data, offsets):
        np.add.at(out, (row[at], bucket), 1.0)
    return out * (SCALE / np.maximum(out.sum(1, keepdims=True), 1))


class Model:
    """Languages, their codewords, the classifiers' weights and how far to trust each bit."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Classifier values per text and bit: the mean weight of the text's n-grams."""
        data, offsets = flat(texts)
        total, count = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts))
        for at, bucket in grams(data, offsets):
            bounds = np.searchsorted(at, offsets)
            some = np.flatnonzero(np.diff(bounds))
            if len(some):
                total[some] += np.add.reduceat(self.weights[bucket], bounds[some], dtype=np.float64)
                count[some] += np.diff(bounds)[some]
        return total * (SCALE / np.maximum(count, 1))[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, its score, and whether another is close."""
        loss = sum(self.trust[b] * np.logaddexp(0.0, -margins[:, b, None] * self.code[None, :, b]) for b in range(len(self.trust)))
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        ordered = np.sort(share, 1)
        second = ordered[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        return best, ordered[:, -1], ordered[:, -1] - second < MARGIN


def fit(x: np.ndarray, language: np.ndarray, languages: list[str]) -> Model:
    """All bits at once by accelerated gradient descent on the logistic loss."""
    code = codewords(len(languages))
    y = code[language]
    w, v, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1])
    step = 4.0 / max(1e-9, float((x * x).sum(1).mean()))
    for t in range(STEPS):
        look = w + (t / (t + 3)) * v
        pull = (y / (1.0 + np.exp(np.clip(y * (x @ look + b), -30, 30)))).astype(np.float32)
        new = look + np.float32(step) * (x.T @ pull / len(x) - np.float32(PENALTY) * look)
        v, w = new - w, new
        b = b + pull.mean(0)
    right = ((x @ w + b) * y > 0).mean(0)
    return Model(languages, code, w, b, np.clip(2 * right - 1, 0.05, 1.0))


def clean(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on a sample whose size is bounded per language; texts become n-gram shares in the tasks."""
    usable = docs.select("doc_id", "lang", "text").where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    per = usable.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(per) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not per:
        return None
    languages = sorted(r["lang"] for r in per)
    # The share of hash values to read, so that about per_language texts come of each.
    upto = docs.sparkSession.createDataFrame(
        [(r["lang"], languages.index(r["lang"]), min(1 << 30, int((1 << 30) * per_language / r["count"]) + 1)) for r in per],
        "lang string, no int, upto bigint")
    chosen = (usable.join(F.broadcast(upto), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("upto"))
              .select("no", clean(F.col("text")).alias("text")).limit(2 * per_language * len(languages)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            for at in range(0, part.num_rows, 256):
                piece = part.slice(at, 256)
                x = frequencies(piece.column("text")).astype(np.float16)
                nonzero = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("no"), pa.array([i.astype("<u2").tobytes() for i in nonzero], pa.binary()),
                     pa.array([r[i].tobytes() for r, i in zip(x, nonzero)], pa.binary())], names=["no", "at", "value"])

    rows = chosen.mapInArrow(run, "no int, at binary, value binary").collect()
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], np.float16)
    return fit(x, np.array([r["no"] for r in rows], np.int64), languages)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` of every document, over its whole text."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), clean(F.col("text")).alias("text"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            known = part.column("letters").to_numpy(zero_copy_only=False) & (model is not None)
            names, score, close = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
            if known.any():
                best, s, c = model.decode(model.margins(part.column("text").filter(pa.array(known))))
                names[known], score[known], close[known] = np.array(model.languages, object)[best], s, c
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(close)],
                names=["doc_id", "lang_pred", "score", "ambiguous"])

    return slim.mapInArrow(run, "doc_id bigint, lang_pred string, score double, ambiguous boolean")
