"""Merkle-tree fingerprints of texts over sections, paragraphs and word groups, in DataFrame functions only.

A paragraph is a line, and a leaf up to ``LEAF`` words of a paragraph with the spaces after them; the leaves of a text
cover all of it.  A section begins at a heading, after a blank line, and at about every ``SECTION``-th other line, chosen
by the line's own digest: an edit moves the cuts next to it only, and what follows an inserted line is cut as before.
Every digest is the SHA-256 of the digests below it, a leaf's that of its words, and the root's that of the sections: texts
are equal exactly when their roots are, as far as SHA-256 tells texts apart.

Two trees are compared from the root down.  Sections with equal digests are the same branch wherever they stand; only the
others are opened, down to the paragraphs and leaves that differ.  The likeness is 1 for equal roots, else the share of
leaves that lie in equal branches or, in the opened ones, in both trees, below 1; it is 0 where a text has no leaf.
``changed`` lists the paragraphs of the opened branches that the other text has not there, as section.paragraph from 0,
those of the text, a bar, and those of the edited text.

A fingerprint is the root, a colon, and the leaf digests (32 bits each) as a tree: ``;`` ends a section, ``,`` a
paragraph and ``.`` parts leaves.

Null counts as empty; an empty text has one empty paragraph.  Equal ids are ordered by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 4
SECTION = 8
PER_SLICE = 2048  # documents of a slice of the id order
MAX_SLICES = 4096  # the slice bounds are one array in the plan; beyond 8 million documents slices grow, and spill
_LEAVES = rf"(?:[^ ]* ){{1,{LEAF}}}|[^ ]+"


def _number(digest: Column, digits: int) -> Column:
    """The first hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def _once(value: Column, build) -> Column:
    """``build`` applied to a value that is computed once, as the only element of an array."""
    return F.transform(F.array(value), build)[0]


def paragraphs(text: Column) -> Column:
    """Per paragraph its leaves' short digests, its digest, and whether it is a heading or blank."""
    def one(line: Column) -> Column:
        hashed = F.transform(F.regexp_extract_all(line, F.lit(_LEAVES), F.lit(0)), lambda leaf: F.sha2(leaf, 256))
        return _once(hashed, lambda h: F.struct(
            F.transform(h, lambda d: F.shiftright(F.shiftleft(_number(d, 8), 32), 32).cast("int")).alias("leaves"), F.sha2(F.array_join(h, ""), 256).alias("digest"),
            line.rlike(r"^\s{0,3}#").alias("heading"), (F.trim(line) == "").alias("blank")))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), one)


def section_starts(lines: Column) -> Column:
    """Numbers from 0 of the paragraphs that begin a section."""
    def begins(x: Column, i: Column) -> Column:
        after_blank = F.coalesce(F.get(lines, i - 1)["blank"], F.lit(True)) & ~x["blank"]
        chosen = ~x["blank"] & (_number(x["digest"], 4) % SECTION == 0)
        return F.when((i == 0) | x["heading"] | after_blank | chosen, i).otherwise(-1)

    return F.filter(F.transform(lines, begins), lambda i: i >= 0)


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: a struct of the sections, each with a short digest and its paragraphs' leaves, and the root."""
    lines, starts, cut = f"_{name}_lines", f"_{name}_starts", f"_{name}_sections"
    out = df.withColumn(lines, paragraphs(F.col(text))).withColumn(starts, section_starts(F.col(lines)))
    end = lambda j: F.coalesce(F.get(F.col(starts), j + 1), F.size(lines))
    section = lambda part: F.struct(F.sha2(F.array_join(F.transform(part, lambda x: x["digest"]), ""), 256).alias("digest"),
                                    F.transform(part, lambda x: x["leaves"]).alias("lines"))
    out = out.withColumn(cut, F.transform(F.col(starts), lambda s, j: _once(F.slice(lines, s + 1, end(j) - s), section)))
    root = F.sha2(F.array_join(F.transform(F.col(cut), lambda s: s["digest"]), ""), 256)
    short = F.transform(F.col(cut), lambda s: F.struct(_number(s["digest"], 15).alias("digest"), s["lines"].alias("lines")))
    return out.withColumn(name, F.struct(short.alias("sections"), root.alias("root"))).drop(lines, starts, cut)


def _short(leaf: Column) -> Column:
    return F.lpad(F.lower(F.hex(leaf.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")


def fingerprint(tree: Column) -> Column:
    """The text form of a tree."""
    line = lambda p: F.array_join(F.transform(p, _short), ".")
    sections = F.transform(tree["sections"], lambda s: F.array_join(F.transform(s["lines"], line), ","))
    return F.concat(tree["root"], F.lit(":"), F.array_join(sections, ";"))


def _digests(tree: Column) -> Column:
    return F.transform(tree["sections"], lambda s: s["digest"])


def equal_branches(a: Column, b: Column) -> Column:
    """Digests of the sections that both trees have."""
    return F.array_intersect(_digests(a), _digests(b))


def likeness(a: Column, b: Column) -> Column:
    """How much of two trees is the same, 0 to 1."""
    def compared(same: Column) -> Column:
        of = lambda t, inside: F.flatten(F.flatten(F.transform(F.filter(
            t["sections"], lambda s: F.array_contains(same, s["digest"]) == inside), lambda s: s["lines"])))
        known = F.size(of(a, True)) + F.size(of(b, True))
        x, y = F.array_distinct(of(a, False)), F.array_distinct(of(b, False))
        total = known + F.size(x) + F.size(y)
        return F.when(total > 0, (known + 2.0 * F.size(F.array_intersect(x, y))) / total).otherwise(0.0)

    # Different trees with the same leaves are near, not equal.
    return F.when(a["root"] == b["root"], 1.0).otherwise(F.least(_once(equal_branches(a, b), compared), F.lit(0.999)))


def changed_branches(a: Column, b: Column) -> Column:
    """Paragraphs of ``a`` in sections that ``b`` has not, that no such section of ``b`` has; ``section.paragraph``."""
    def opened(same: Column) -> Column:
        other = F.flatten(F.transform(F.filter(b["sections"], lambda s: ~F.array_contains(same, s["digest"])),
                                      lambda s: F.transform(s["lines"], lambda p: F.xxhash64(p))))
        def listed(known: Column) -> Column:
            named = lambda i: lambda p, j: F.when(
                F.array_contains(known, F.xxhash64(p)), F.lit("")).otherwise(F.concat(i.cast("string"), F.lit("."), j.cast("string")))
            return F.filter(F.flatten(F.transform(a["sections"], lambda s, i: F.when(
                F.array_contains(same, s["digest"]), F.array().cast("array<string>")).otherwise(F.transform(s["lines"], named(i))))),
                lambda n: n != "")

        return _once(F.array_distinct(other), listed)

    return _once(equal_branches(a, b), opened)


def changed(a: Column, b: Column) -> Column:
    """``changed_branches`` of both, as text."""
    return F.concat(F.array_join(changed_branches(a, b), ","), F.lit("|"), F.array_join(changed_branches(b, a), ","))


def _bounds(ids: DataFrame) -> list[int]:
    """The largest id of each slice of the descending order, about ``PER_SLICE`` documents apart."""
    n = ids.count()
    slices = max(1, min(MAX_SLICES, -(-n // PER_SLICE)))
    if not n:
        return []
    if slices == 1:
        return [ids.agg(F.max("key")).first()[0]]
    cuts = ids.agg(F.percentile_approx("key", [i / slices for i in range(1, slices)], 100 * slices)).first()[0]
    rough = ids.groupBy(_slice(F.col("key"), sorted(set(cuts), reverse=True)).alias("s")).agg(F.max("key").alias("top"))
    return sorted((r["top"] for r in rough.collect()), reverse=True)  # at most MAX_SLICES rows


def _slice(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or above the key, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    heads = bounds[::step]
    array = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    all_bounds = array(bounds)
    at = F.size(F.filter(array(heads), lambda b: b >= key))
    before = F.greatest(at - 1, F.lit(0)) * step
    return before + F.size(F.filter(F.slice(all_bounds, before + 1, step), lambda b: b >= key))


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """Add ``next``: a struct of ``columns`` of the document with the next smaller id, after the last that of the first.

    The descending order is cut into slices.  The first document of a slice also goes, as a ghost, to the end of the
    slice before, so one window per slice finds every successor and texts are shuffled once.
    """
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    bounds = _bounds(docs.select(key.alias("key")))
    if not bounds:
        return docs.withColumn("next", F.struct(*columns))
    keyed = docs.withColumn("_key", key).withColumn("_slice", _slice(F.col("_key"), bounds[1:]))
    tops = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    is_top = F.col("_key") == F.element_at(tops, F.col("_slice") + 1)
    before = F.when(F.col("_slice") > 0, F.col("_slice") - 1).otherwise(F.lit(len(bounds) - 1))
    places = F.when(is_top, F.array(F.struct(F.col("_slice").alias("s"), F.lit(False).alias("ghost")),
                                    F.struct(before.alias("s"), F.lit(True).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("_slice").alias("s"), F.lit(False).alias("ghost"))))
    placed = keyed.withColumn("_place", F.explode(places)).withColumns({"_slice": F.col("_place.s"), "_ghost": F.col("_place.ghost")})
    order = Window.partitionBy("_slice").orderBy("_ghost", F.desc("_key"), F.xxhash64(*columns))
    return (placed.withColumn("next", F.lead(F.struct(*columns)).over(order)).where(~F.col("_ghost"))
            .drop("_key", "_slice", "_place", "_ghost"))


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by the beginning of another."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness to each other and to the next text's."""
    slim = with_tree(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "tree")
    paired = with_next(slim, ["text", "tree"])
    made = with_tree(paired.withColumn("edited", edited(F.col("text"), F.col("next.text"))), "edited", "edited_tree")
    tree, other = F.col("tree"), F.col("edited_tree")
    return made.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint(tree).alias("fingerprint"), fingerprint(other).alias("edited_fingerprint"),
                       likeness(tree, other).alias("near_edited"), likeness(tree, F.col("next.tree")).alias("near_next"),
                       changed(tree, other).alias("changed"))
