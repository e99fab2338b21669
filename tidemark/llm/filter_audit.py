"""How filters of a corpus act on each other in every order, from counts on the lattice of their subsets.

A document is the set of filters that it fails.  After the filters of a set S were applied, in whatever order, exactly
the documents that fail none of S are left, so all orders are paths through the lattice of the 32 subsets.  One pass
counts documents per part and failure set.  Every edge S -> S + f gets its removals from these 32 counts, and the
numbers of orders that reach S and that leave S + f, counted forwards and backwards over the lattice.  The Shapley sum of
a filter weights its edges by the product of the two; the steps of each order are read from the same edges.

A null text counts as empty.  A document is a copy when a row with a smaller id has the same text: rows of one id are
not copies of each other, and a row without an id neither is a copy nor makes one.  Labels of one id count together; rows
without a label count as neither.  Parts are the values of the source, null and the empty string together.  An empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import lookup_join, with_group_totals
from tidemark.session import cut_lineage

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
KINDS = ("n", "good", "toxic")


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text only."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    packed = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"))
    upper = F.regexp_count(text, F.lit("[A-Z]"))
    of = lambda f, c: F.when(c, bit(f)).otherwise(0)
    # The words are cut once: the struct is one element of an array that a lambda reads.
    counted = F.transform(F.array(packed), lambda w: of("A", w["n"] < 50) + of("B", 100 * w["distinct"] < 65 * w["n"]))[0]
    return counted + of("C", 100 * upper > 5 * F.length(text)) + of("D", text.rlike("[#$%&*|]"))


def failures(docs: DataFrame, labels: DataFrame, salts: int = 64) -> DataFrame:
    """``part, fails, good, toxic`` of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("same"), text_failures(text).alias("fails"))
    slim = cut_lineage(slim, "text-failures")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    first = with_group_totals(slim, ["same"], ["doc_id"], {"_p": F.min("doc_id")}, {"_first": (F.min, "_p")}, salts)
    marked = first.withColumn("fails", F.col("fails") + F.when(F.col("doc_id") > F.col("_first"), bit("E")).otherwise(0))
    return lookup_join(marked.drop("_first"), marks, ["doc_id"], ["same"], "left", copies=4).select("part", "fails", "good", "toxic")


def failure_counts(failed: DataFrame) -> DataFrame:
    """Per part one row: for each of the 32 failure sets how many documents, good ones and toxic ones."""
    yes = lambda c: F.count(F.when(F.col(c), 1))
    by_set = failed.groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), yes("good").alias("good"), yes("toxic").alias("toxic"))
    held = by_set.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("fails", F.struct(*KINDS)))).alias("m"))
    sets = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    of = lambda kind: F.transform(sets, lambda s: F.coalesce(F.try_element_at("m", s)[kind], F.lit(0).cast("bigint")))
    return held.select("part", *[of(k).alias(k) for k in KINDS])


def path_counts(filters: str = FILTERS) -> tuple[list[int], list[int]]:
    """For every subset the number of orders of its filters that reach it, and of the others that lead on to the full set."""
    full = (1 << len(filters)) - 1
    ahead, back = [0] * (full + 1), [0] * (full + 1)
    ahead[0] = back[full] = 1
    for s in range(full + 1):
        for f in range(len(filters)):
            if not s >> f & 1:
                ahead[s | 1 << f] += ahead[s]
    for s in range(full, -1, -1):
        back[s] = back[s] or sum(back[s | 1 << f] for f in range(len(filters)) if not s >> f & 1)
    return ahead, back


def edges(filters: str = FILTERS) -> list[tuple[int, int, int]]:
    """``before, own, paths`` for every edge of the lattice: the subset, the filter's bit and the orders through it."""
    ahead, back = path_counts(filters)
    return [(s, 1 << f, ahead[s] * back[s | 1 << f]) for s in range(1 << len(filters)) for f in range(len(filters)) if not s >> f & 1]


def steps(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """``filter_order, step, before, own`` for every step of every order."""
    out = []
    for order in permutations(range(len(filters))):
        before = 0
        for i, f in enumerate(order):
            out.append(("".join(filters[x] for x in order), i + 1, before, 1 << f))
            before |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order and step with what its filter does there."""
    spark = docs.sparkSession
    counts = cut_lineage(failure_counts(failures(docs, labels)), "failure-counts")
    lattice = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(e, ("before", "own", "paths"))]) for e in edges()])
    sets = list(range(1 << len(FILTERS)))

    def total(kind: str, test) -> Column:
        """Sum of the counts of the failure sets that pass ``test``."""
        chosen = F.filter(F.array(*[F.struct(F.lit(s).alias("s"), F.col(kind)[s].alias("c")) for s in sets]), lambda x: test(x["s"]))
        return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda acc, x: acc + x["c"])

    on = counts.select("*", F.explode(lattice).alias("e")).select("part", *KINDS, "e.*")
    own, before = F.col("own"), F.col("before")
    gone = lambda s: (s.bitwiseAND(before) == 0) & (s.bitwiseAND(own) != 0)
    walked = on.select(
        "part", "before", "own", "paths",
        total("n", lambda s: (s.bitwiseAND(before) == 0) & (s.bitwiseAND(own) == 0)).alias("kept"), total("n", gone).alias("removed"),
        total("n", lambda s: (s.bitwiseAND(before) != 0) & (s.bitwiseAND(own) != 0)).alias("redundant"),
        total("n", lambda s: s == own).alias("unique_fails"), total("good", gone).alias("good_lost"), total("toxic", gone).alias("toxic_lost"))
    walked = cut_lineage(walked, "lattice-edges")
    shapley = walked.groupBy("part", "own").agg(F.sum(F.col("paths") * F.col("removed")).alias("shapley"))
    rows = spark.createDataFrame(steps(), "filter_order string, step int, before int, own int")
    return (walked.drop("paths").join(shapley, ["part", "own"]).join(F.broadcast(rows), ["before", "own"])  # 600 rows
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
