"""Toxicity scores from a subsequence string kernel, a support vector machine and Nystroem landmarks.

The kernel of two strings sums, over the subsequences of three letters both have, ``DECAY`` to the power of the lengths
they stretch over, up to ``SPAN`` letters: an insult with inserted characters or gaps keeps most of its weight.  Letters
are lower case, digits and signs that stand for letters count as those, other punctuation only makes gaps, and single
characters with spaces between them are read as one word.

Labels are of whole documents; what makes a sentence or document toxic are its words.  Words that toxic training
documents use in many different contexts, far beyond chance, are the toxic examples, with noisy variants; words of
clean documents are the others, those that score highest among them first.  Landmarks span the kernel space (Nystroem),
a squared-hinge machine is fitted there, and its decision function folds into one table over letter triples, so a word
is scored by table lookups.  A document's score is a logistic function of its highest word decisions and of how many of
its words are toxic or close to it.

Training reads at most ``PER_CLASS`` labelled documents of each label, picked by a hash of the id among rows whose
crc32(id) mod 5 is not 0.  Null and empty texts get the score of a text without words.  Repeated label rows count once,
toxic if any says so.  Without labels of both kinds every score is 0.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import chunks, flat
from tidemark.llm.names import free_name

PER_CLASS = 3000
DECAY, SPAN = 0.8, 7
STEMS = (5, 7)  # lengths of word beginnings that are examples too
WINDOW = 10  # start positions of a unit; longer words are read through sliding windows
POSITIVES, NEGATIVES, HARD, LANDMARKS = 400, 5000, 500, 160
CHANCE = 1e-6  # a word is toxic where so many contexts in toxic documents had less chance than this
BLOCK_BYTES = 1 << 22
CODES = 64
_OFFSETS = [(d, e) for d, e in combinations(range(1, SPAN), 2)]
# Characters written for letters.
_LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def _code_table() -> np.ndarray:
    """Code of each byte: 0 for what only makes gaps, 1 to 26 for letters, the rest for bytes of other scripts."""
    table = np.zeros(256, np.int64)
    table[ord("a"):ord("z") + 1] = table[ord("A"):ord("Z") + 1] = np.arange(1, 27)
    for sign, letter in _LOOKALIKE.items():
        table[ord(sign)] = table[ord(letter)]
    table[128:] = 27 + np.arange(128) % (CODES - 27)
    return table


_CODE = _code_table()


def normal(text: Column) -> Column:
    """Lower case, white space as single characters of space, and spaced-out letters as one word."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", " " * 5)
    return F.regexp_replace(plain, r"(?<![^ ])([^ ]) (?=[^ ](?: |$))", "$1")


def triples(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For every pair of gaps: start positions, triple codes and weight of the subsequences inside the words."""
    code = _CODE[data]
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    letter = code > 0
    for d, e in _OFFSETS:
        if len(data) <= e:
            continue
        at = np.flatnonzero((left[:-e] > e) & letter[:-e] & letter[d:len(data) - e + d] & letter[e:])
        yield at, (code[at] * CODES + code[at + d]) * CODES + code[at + e], DECAY ** (e + 1)


def decisions(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value for each word: the highest of its windows, ``bias`` where no window has three letters."""
    n = len(offsets) - 1
    if not len(data):
        return np.full(n, bias)
    value, norm = np.zeros(len(data) + 1), np.zeros(len(data) + 1)
    for at, triple, weight in triples(data, offsets):
        value[at] += weight * table[triple]
        norm[at] += weight * weight
    value, norm = (np.concatenate([[0.0], np.cumsum(x[:-1])]) for x in (value, norm))
    length = np.diff(offsets)
    start = np.arange(len(data))
    end = np.minimum(start + WINDOW, np.repeat(offsets[1:], length))
    total, square = value[end] - value[start], norm[end] - norm[start]
    f = np.where(square > 1e-9, total / np.sqrt(np.maximum(square, 1e-9)), 0.0)
    # A short word is one unit; a long one has a unit at each position but near its end.
    first = np.repeat(offsets[:-1], length)
    usable = (start == first) | (end - start == WINDOW)
    f = np.where(usable, f, -np.inf)
    out = np.full(n, 0.0)
    some = length > 0
    out[some] = np.maximum.reduceat(f, offsets[:-1][some])
    return out + bias


def _joined(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return flat(pa.array(words, pa.string()))


def maps(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Explicit kernel maps as (word, triple, value), with length 1 each where no triple repeats."""
    data, offsets = _joined(words)
    parts = list(triples(data, offsets))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at, triple = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    weight = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
    word = np.searchsorted(offsets, at, "right") - 1
    norm = np.sqrt(np.maximum(np.bincount(word, weight * weight, len(words)), 1e-9))
    return word, triple, weight / norm[word]


def kernel(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel of words with dense landmark maps (triple, landmark)."""
    out = np.zeros((len(words), landmarks.shape[1]))
    for at in range(0, len(words), 250):
        some = words[at:at + 250]
        word, triple, value = maps(some)
        order = np.argsort(word, kind="stable")
        word, triple, value = word[order], triple[order], value[order]
        bounds = np.flatnonzero(np.diff(word, prepend=-1))
        if len(bounds):
            out[at + word[bounds]] = np.add.reduceat(landmarks[triple] * value[:, None].astype(np.float32), bounds)
    return out


def noisy(word: str, rng: np.random.Generator) -> list[str]:
    """Variants with an inserted character, with signs between all letters, and with a doubled letter."""
    i = int(rng.integers(1, max(2, len(word))))
    letter = chr(97 + int(rng.integers(26)))
    return [word[:i] + letter + word[i:], ".".join(word), word[:i] + word[i - 1:], word[:i] + "-" + word[i:]]


def fit_machine(toxic: dict[str, int], clean: dict[str, int], seed: int = 5) -> tuple[np.ndarray, float]:
    """The decision table over letter triples and the bias, from words with their numbers of contexts."""
    rng = np.random.default_rng(seed)
    half = LANDMARKS // 2
    bad, good = list(toxic), list(clean)
    marks = bad[:half] + [good[i] for i in rng.permutation(len(good))[:half]]
    word, triple, value = maps(marks)
    dense = np.zeros((CODES ** 3, len(marks)), np.float32)
    np.add.at(dense, (triple, word), value)
    variants = [(v, toxic[w]) for w in bad for v in (w, *noisy(w, rng))]
    rows = [v for v, _ in variants] + good
    y = np.where(np.arange(len(rows)) < len(variants), 1.0, -1.0)
    weight = np.sqrt([n for _, n in variants] + list(clean.values()))
    for side in (y > 0, y < 0):
        weight[side] *= len(y) / (2.0 * weight[side].sum())
    between = kernel(marks, dense)
    values, vectors = np.linalg.eigh((between + between.T) / 2)
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    x = np.column_stack([kernel(rows, dense) @ root, np.ones(len(rows))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-2)
    penalty[-1] = 1e-6
    for _ in range(20):  # Newton steps on the squared hinge loss
        inside = y * (x @ w) < 1
        c = np.where(inside, weight, 0.0) / len(y)
        new = np.linalg.solve((x * c[:, None]).T @ x + np.diag(penalty) / len(y), x.T @ (c * y))
        done = np.allclose(new, w, atol=1e-8)
        w = new
        if done:
            break
    return (dense @ (root @ w[:-1]).astype(np.float32)).astype(np.float64), float(w[-1])


FEATURES = ("highest", "second", "hits", "near", "rate")


class Model:
    """Decision table and bias of the word machine, and the logistic function from a document's words to its score."""

    def __init__(self, table: np.ndarray | None = None, bias: float = 0.0, weights: np.ndarray | None = None):
        self.table, self.bias, self.weights = table, bias, weights

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: its two highest word decisions, how many words are toxic or near it, and their rate.

        Distinct words of the block are scored once.
        """
        if not len(texts):
            return np.zeros((0, len(FEATURES)))
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        f = decisions(*flat(coded.dictionary), self.table, self.bias)[coded.indices.to_numpy(zero_copy_only=False)]
        at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        starts, n = at[:-1], np.diff(at)
        first = np.maximum.reduceat(f, starts)
        top = np.repeat(first, n)
        again = np.add.reduceat((f == top).astype(np.int64), starts) > 1
        second = np.where(again, first, np.maximum.reduceat(np.where(f == top, self.bias, f), starts))
        hits, near = (np.add.reduceat((f > c).astype(np.float64), starts) for c in (0.0, -0.4))
        return np.column_stack([first, second, np.log1p(hits), np.log1p(near), np.minimum(100 * hits / n, 20.0)])

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.table is None:
            return np.zeros(len(texts))
        x = self.features(texts)
        return 1.0 / (1.0 + np.exp(np.clip(-(x @ self.weights[:-1] + self.weights[-1]), -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """Normalised texts and labels of the bounded training sample; each distinct text once."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    pick = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(1).unionByName(pick(0))  # at most 2 * per_class rows
    return (docs.select("doc_id", normal(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id")
            .groupBy(F.xxhash64("text").alias("same")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")))


def word_contexts(sample: DataFrame) -> DataFrame:
    """Per word, and per beginning of longer words, the number of different words before it in toxic (``a``) and in
    clean (``b``) documents; copies and shared passages repeat their contexts and add nothing."""
    words = F.filter(F.split("text", " "), lambda w: F.length(w) > 0)
    pairs = sample.select("toxic", words.alias("w")).select(
        "toxic", F.explode(F.arrays_zip(F.col("w").alias("word"), F.concat(F.array(F.lit("")), F.col("w")).alias("before"))).alias("p"))
    units = F.array_distinct(F.array("p.word", *[F.substring("p.word", 1, n) for n in STEMS]))
    once = (pairs.where("p.word IS NOT NULL").select("toxic", "p.before", F.explode(units).alias("word")).distinct())
    return once.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded, documented sample; what comes to the driver is bounded by the module's constants."""
    from tidemark.session import cut_lineage

    sample = cut_lineage(labelled(docs, labels, per_class), "toxicity-sample")
    counts = cut_lineage(word_contexts(sample), "toxicity-words")
    totals = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not totals["a"] or not totals["b"]:
        return Model()
    share = totals["a"] / (totals["a"] + totals["b"])
    # Log probability that this many of a word's contexts or more fall to toxic documents (Chernoff bound).
    n = F.col("a") + F.col("b")
    p = F.col("a") / n
    clean_term = F.when(F.col("b") > 0, F.col("b") * F.log((1 - p) / (1 - share))).otherwise(0.0)
    evidence = F.when(p > share, F.col("a") * F.log(p / share) + clean_term).otherwise(0.0)
    ranked = counts.where((F.length("word") >= 3) & (F.col("a") >= 2) & (p > 0.5 + share / 2)).withColumn("evidence", evidence)
    best = ranked.orderBy(F.desc("evidence"), "word").limit(POSITIVES).collect()
    sure = -np.log(CHANCE)
    toxic = {r["word"]: r["a"] for i, r in enumerate(best) if r["evidence"] > sure or i < 10}
    if not toxic:
        return Model()
    unlike = counts.where((F.col("b") > 0) & (F.length("word") >= 3) & (p <= share) & ~F.col("word").isin(list(toxic)))
    clean = {r["word"]: r["b"] for r in unlike.orderBy(F.xxhash64("word"), "word").limit(NEGATIVES).collect()}
    if not clean:
        return Model()
    model = Model(*fit_machine(toxic, clean))
    for _ in range(2):  # words of clean documents that score highest join the clean examples
        hard = scored_words(unlike, model).orderBy(F.desc("f"), "word").limit(HARD).collect()
        clean |= {r["word"]: r["b"] for r in hard}
        model = Model(*fit_machine(toxic, clean))
    rows = sample.select("toxic", "text").mapInArrow(_rated(model), "toxic int, x array<double>").collect()
    model.weights = logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return model


def scored_words(words: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for batch in batches:
            f = decisions(*flat(batch.column(0)), model.table, model.bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f, pa.float64())], names=["word", "b", "f"])

    return words.select("word", "b").mapInArrow(run, "word string, b bigint, f double")


def _rated(model: Model):
    def run(batches):
        for part in chunks(batches, "text", BLOCK_BYTES):
            x = pa.array(list(model.features(part.column("text"))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), x], names=["toxic", "x"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Weights and intercept of a logistic regression with a ridge penalty, by Newton steps."""
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(np.clip(-(z @ w), -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    scaled = w[:-1] / spread
    return np.append(scaled, w[-1] - (scaled * mean).sum())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``row, doc_id, score`` of every document, over its whole text."""
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       normal(F.col("text")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", BLOCK_BYTES):
            s = model.scores(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(s, pa.float64())],
                                             names=["row", "doc_id", "score"])

    return slim.mapInArrow(run, "row bigint, doc_id bigint, score double")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is below one half, unchanged, in one pass."""
    name = free_name(docs, "_normal")
    slim = docs.withColumn(name, normal(F.col("text")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, name, BLOCK_BYTES):
            yield part.filter(pa.array(model.scores(part.column(name)) < 0.5)).drop_columns([name])

    return slim.mapInArrow(run, docs.schema)
