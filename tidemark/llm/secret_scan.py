"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests cannot tell from random ones.

Fixed patterns give the kinds ``assign``, ``access`` and ``hex``.  Further candidates are runs of at least ``LEAST``
characters of the usual encodings, and the parts of a run between its separators.  Each is read in the smallest alphabet
that has its classes of characters: hexadecimal, base 32 and base 36 of either case (dashes left out, as in a UUID), base
52, 62 or 64.  Only digits and separators are no candidate.  Each is tested for uniform use of its encoding's alphabet (chi-squared, as the number of equal pairs), for its runs of one class
of characters and the others, and for serial correlation; Fisher's method combines the three into one p value, which is uniform for
random tokens and near 0 for most words, paths and numbers.  Words and identifiers that pass are told apart by a fixed
model of them: a token's gain is how many more bits the model needs for it than its alphabet does.  A token is a finding
(``random``) where p is at least ``LEAST_P`` and the gain leaves a chance of at most ``FALSE_SHARE`` that it comes from
the model, when one candidate in ``ONE_IN`` is random.  A finding depends on its own characters only.  Of findings that
overlap, a run and its parts, the run stays unless the rest of it speaks for the model.

DataFrame functions only.  Positions count code points and ends are exclusive.  Null counts as empty; every row gets a
row; findings that overlap a fixed pattern's are not repeated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

# The patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST = 20
# Whole runs, their parts between slashes, and their parts between any separators.
CANDIDATES = [rf"[{symbols}]{{{LEAST},}}={{0,2}}" for symbols in ("A-Za-z0-9+/_-", "A-Za-z0-9+_-", "A-Za-z0-9")]
FALSE_SHARE = 0.05
LEAST_P = 0.01
ONE_IN = 32
LEAST_GAIN = math.log2((ONE_IN - 1) * (1 / FALSE_SHARE - 1))
PART = math.log2(1 / FALSE_SHARE - 1)  # a part must gain this much more than the run around it to stay in its place
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Encodings, the first that fits is taken: what a token without padding is made of (one of letters of one case may have
# dashes, which are left out), the alphabet in order of value, and the values from and to (exclusive) of the class whose
# runs are tested.
ENCODINGS = [
    (r"[0-9a-f]+", DIGITS + "abcdef", 0, 10),
    (r"[0-9A-F]+", DIGITS + "ABCDEF", 0, 10),
    (r"[a-z2-7]+", LOWER + "234567", 0, 26),
    (r"[A-Z2-7]+", UPPER + "234567", 0, 26),
    (r"[0-9a-z]+", DIGITS + LOWER, 0, 10),
    (r"[0-9A-Z]+", DIGITS + UPPER, 0, 10),
    (r"[A-Za-z]+", UPPER + LOWER, 26, 52),
    (r"[0-9A-Za-z]+", UPPER + LOWER + DIGITS, 26, 52),
    (r"(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/_-]+", UPPER + LOWER + DIGITS + "+/", 26, 52),
]


# The model of words and identifiers.  Half bits, a for none, of each letter after a, b, c ... z and at the start of a
# word, from the distinct words of the Python standard library, with weight for letters in any order.
PAIRS = """
    ojijmnkpksmgihojsgifmmnnmr glkmhnoohkpfmmhlriilhqqqkp gqlnhophjsijmnfoqjlhjoqrms hmmjemnpfqqknminqjiljoppnr
    joihkkmpmspjkgnlngghomnjnr iomlhhnqessiomgnrhjjirprmt jomneolihsrilijnthiljoqrpp fpnmeoqogtolmmgotjlikqqrmq
    klijjljrospijehlrkhhqlrnrl hrkmeoqpirjmongktmilfspsnt inklemklgqpjojkmqlgkloksmr homkeopqfsphomhmtnjjkoqsir
    fkoleoqphsplkmhgtnjlkrrsns hpihhkgpjrmloljnqnhglmqros mljimmmqlsmiifkitgjjiljoqr gpmmfmplitphonhjqgkikqoskt
    lnlmloponqslolmmkkjmbqprrt gokkenlpgtmmklhmtjiilnorlt kpjnfnnjhrnkmnjjomifipoqls holmfnqifsqlmnilshijkpoqkq
    jikmiklqjtqhiflishhhprrqrr ennocnnpgtrnmmknsmmmprorqr fnlkgmqifrqloihmthilpqmnrs jlhkgipmhtqkmnlgrmkfonpllp
    klklhlopitrjjhkfsjghnmlpmn hplncnpmhtsmlmhptmlmososnn ijhiijklipnjjjkioihikmlnop
""".split()
# Bits of a lower-case letter, a capital, a digit and a separator after each of them.
TURNS = ((0.2, 4.0, 5.0, 3.5), (0.6, 2.0, 4.5, 4.5), (3.0, 3.0, 0.5, 4.0), (0.7, 2.0, 2.5, 4.0))
CODED = LOWER + UPPER + "0-."  # any digit, a separator that is a symbol, and a dash that is left out


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs of start, end and the text of ``group``."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    lengths = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), part.alias("part")),
                          lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("hit"), z["part"].alias("part")))
    empty = F.array().cast("array<struct<start:int,end:int,part:string>>")
    step = lambda acc, z: F.struct(
        (acc["at"] + z["gap"] + F.coalesce(z["hit"], F.lit(0))).alias("at"),
        F.when(z["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(
            (acc["at"] + z["gap"]).alias("start"), (acc["at"] + z["gap"] + z["hit"]).alias("end"), z["part"].alias("part"))))).alias("found"))
    found = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each fixed pattern."""
    return {"assign": F.filter(located(text, ASSIGN, 2), lambda s: F.length(s["part"]) >= 6),
            "access": located(text, ACCESS), "hex": located(text, HEX)}


def _tail(z: Column) -> Column:
    """The normal distribution's weight above z, by a logistic fit good to four digits."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1.0 / (1.0 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def plain(token: Column) -> Column:
    """The symbols of a token: without padding, and without dashes where its letters are of one case."""
    bare = F.rtrim(token, F.lit("="))
    mixed = bare.rlike("[a-z]") & bare.rlike("[A-Z]")
    return F.when(mixed, F.translate(bare, "-_", "+/")).otherwise(F.translate(bare, "-_", ""))


def encoding(symbols: Column) -> Column:
    """Number of the first encoding that the symbols of a token fit, null for none and for too few; a letter is asked of all."""
    out = F.lit(None).cast("int")
    for code, (made_of, *_) in reversed(list(enumerate(ENCODINGS))):
        out = F.when(symbols.rlike(f"^{made_of}$"), F.lit(code)).otherwise(out)
    return F.when(symbols.rlike("[A-Za-z]") & (F.length(symbols) >= LEAST), out)


def _of(field: int, code: Column, seen=lambda x: x) -> Column:
    """A field of the encoding with that number."""
    return F.element_at(F.array(*[seen(F.lit(e[field])) for e in ENCODINGS]), code + 1)


def randomness(symbols: Column, code: Column) -> Column:
    """Fisher's combined p value of the battery for the symbols of a token in its encoding."""
    alphabet, low, high = (_of(i, code) for i in (1, 2, 3))
    k = F.length(alphabet)
    values = F.transform(F.split(symbols, ""), lambda c: F.instr(alphabet, c) - 1)

    def tests(v: Column) -> Column:
        n = F.size(v).cast("double")
        pairs = n * (n - 1) / 2
        equal = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda acc, c: acc + _pairs(F.size(F.filter(v, lambda x: x == c))))
        spread = F.sqrt(pairs / k * (1 - 1 / k.cast("double")))
        uniform = _tail((equal - pairs / k) / spread)
        # Neighbours as one array of (value, next value).
        steps = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        mean, var = (k - 1) / 2, (k * k - 1) / 12
        within = lambda x: (x >= low) & (x < high)
        turns = F.size(F.filter(steps, lambda s: within(s["a"]) != within(s["b"])))
        # Changes of class in n independent symbols: their mean, and their variance with that of neighbours.
        both = (high - low) / k * (1 - (high - low) / k)
        turn = 2 * both
        turn_var = (n - 1) * turn * (1 - turn) + 2 * (n - 2) * (both - turn * turn)
        runs = 2 * _tail(F.abs((turns - (n - 1) * turn) / F.sqrt(turn_var)))
        product = F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + (s["a"] - mean) * (s["b"] - mean))
        serial = 2 * _tail(F.abs(product / (var * F.sqrt(n - 1))))
        x = -(F.log(uniform) + F.log(F.least(runs, F.lit(1.0))) + F.log(F.least(serial, F.lit(1.0))))
        return F.exp(-x) * (1 + x + x * x / 2)

    # The values are computed once, as the only element of an array.
    return F.element_at(F.transform(F.array(values), tests), 1)


def _pairs(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("double")


def _model() -> str:
    """Bits of every symbol of ``CODED`` after every other, row by row."""
    kind = lambda c: 0 if c in LOWER else 1 if c in UPPER else 2 if c == "0" else 3

    def bits(a: str, b: str) -> float:
        if b == ".":
            return 0.0
        if kind(b) >= 2:
            return TURNS[kind(a)][kind(b)] + (math.log2(10) if b == "0" else 2.0)
        starts = kind(a) >= 2 or kind(b) > kind(a)
        pair = PAIRS[26 if starts else LOWER.index(a.lower())][LOWER.index(b.lower())]
        return TURNS[kind(a)][kind(b)] + (ord(pair) - ord("a")) / 2

    return ",".join(f"{bits(a, b):.4f}" for a in CODED for b in CODED)


def gain(token: Column, symbols: Column, code: Column) -> Column:
    """Bits that the model of words and identifiers needs for a token beyond those of symbols drawn from its alphabet."""
    bits = F.split(F.lit(_model()), ",").cast("array<double>")
    bare = F.rtrim(token, F.lit("="))
    mixed = bare.rlike("[a-z]") & bare.rlike("[A-Z]")
    coded = F.when(mixed, F.translate(bare, "123456789+/_", "000000000---")).otherwise(
        F.translate(F.lower(bare), "123456789+/_-", "000000000...."))
    places = F.transform(F.split(coded, ""), lambda c: F.instr(F.lit(CODED), c) - 1)
    step = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.get(bits, acc["last"] * len(CODED) + c)).alias("sum"))
    start = F.struct(F.lit(CODED.index("-")).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(places, start, step, lambda acc: acc["sum"]) - F.length(symbols) * F.log2(_of(1, code, F.length))


def candidates(text: Column) -> Column:
    """Runs and parts of runs in a known encoding with start, end, p value, gain and rank among those that overlap."""
    found = F.array_distinct(F.concat(*[located(text, c) for c in CANDIDATES]))
    read = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                              s["part"].alias("token"), plain(s["part"]).alias("part")))
    rated = F.transform(read, lambda s: F.struct(s["start"], s["end"], s["token"], s["part"], encoding(s["part"]).alias("code")))
    scored = F.transform(F.filter(rated, lambda s: s["code"].isNotNull()), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["token"].alias("token"),
        randomness(s["part"], s["code"]).alias("p"), gain(s["token"], s["part"], s["code"]).alias("gain")))
    # What a run is preferred by to its parts: by slashes, and by separators at all.
    ahead = lambda s: PART * (s["token"].contains("/").cast("int") + s["token"].rlike("[+/_-]").cast("int"))
    return F.transform(scored, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["p"].alias("p"), s["gain"].alias("gain"), (s["gain"] + ahead(s)).alias("rank")))


def apart(spans: Column) -> Column:
    """The spans in order that overlap none taken before them."""
    meet = lambda s, t: (s["start"] < t["end"]) & (t["start"] < s["end"])
    return F.aggregate(spans, F.slice(spans, 1, 0), lambda acc, s: F.when(
        F.exists(acc, lambda t: meet(s, t)), acc).otherwise(F.concat(acc, F.array(s))))


def scan(docs: DataFrame) -> DataFrame:
    """Per document the counts and digest of the fixed patterns' spans, and all spans."""
    body = F.coalesce(F.col("text"), F.lit(""))
    kinds = base_spans(F.col("_body"))
    tagged = [_tagged(spans, no) for no, spans in enumerate(kinds.values())]
    found = (docs.select("doc_id", body.alias("_body"))
             .select("doc_id", *[t.alias(k) for t, k in zip(tagged, kinds)], candidates(F.col("_body")).alias("candidates")))
    found = cut_lineage(found, "secrets")
    random = F.filter("candidates", lambda c: (c["p"] >= LEAST_P) & (c["gain"] >= LEAST_GAIN))
    best = lambda spans: F.array_sort(spans, lambda s, t: F.when(s["rank"] > t["rank"], -1).when(
        s["rank"] < t["rank"], 1).otherwise(s["start"] - t["start"]))
    base = F.array_sort(F.concat(*kinds))
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    own = _tagged(F.col("own"), KINDS.index("random"))
    every = (found.withColumn("base", base).withColumn("free", best(F.filter(random, free))).withColumn("own", apart(F.col("free")))
             .withColumn("every", F.array_sort(F.concat("base", own))))
    return every.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in kinds],
                        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"))


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    name = lambda n: F.element_at(F.array(*[F.lit(k) for k in KINDS]), n + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
