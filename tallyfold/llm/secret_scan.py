"""Secret scans: key patterns, and tokens that pass a battery of randomness tests.

DataFrame functions only. A candidate token is a long run of base-64 characters
with letters and digits. Its encoding is the smallest alphabet that holds it.
Under the hypothesis that its characters are drawn uniformly and independently,
three tests give p-values: chi-squared over equal bins of the alphabet, runs above
and below its middle, and serial correlation. Bonferroni's minimum joins them.
Tokens of one encoding and one band of lengths form a family; the Benjamini and
Hochberg procedure decides in each which tokens are not random, so that short
tokens, of which there are many, don't hide what long ones show. The others are
reported. Families are counted in bins of p, so that the procedure needs no sort
of all tokens and its thresholds are a table of fixed size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: The base patterns and the least length of what they must hold.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
LOWER_HEX, UPPER_HEX = "0123456789abcdef", "0123456789ABCDEF"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from the smallest alphabet on.
ALPHABETS = [
    ("lower-hex", "^[0-9a-f]+$", LOWER_HEX),
    ("upper-hex", "^[0-9A-F]+$", UPPER_HEX),
    ("base-32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("lower-36", "^[a-z0-9]+$", DIGITS + LOWER),
    ("upper-36", "^[A-Z0-9]+$", DIGITS + UPPER),
    ("base-62", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base-64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base-64-url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
]
LENGTH_BANDS = [28, 40, 64, 128]
FALSE_DISCOVERIES = 0.05
P_BINS = 2_000
BINS_PER_DECADE = 100


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal distribution (polynomial of Abramowitz and Stegun, 26.2.17)."""
    size = F.abs(z)
    t = 1 / (1 + 0.2316419 * size)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-size * size / 2) * 0.3989422804014327 * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def _sum(values: Column, of=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + of(x).cast("double"))


def randomness(tokens: DataFrame) -> DataFrame:
    """``tokens`` (column token) with encoding, band and p, the probability that a random token looks so odd; tokens of no alphabet go."""
    case = lambda i: reduce(lambda c, e: c.when(F.col("token").rlike(e[1]), F.lit(e[i])), ALPHABETS, F)
    named = tokens.withColumns({"encoding": case(0), "alphabet": case(2), "length": F.length("token")}).where(F.col("encoding").isNotNull())
    place = F.transform(F.sequence(F.lit(1), F.col("length")), lambda i: F.instr(F.col("alphabet"), F.substr(F.col("token"), i, F.lit(1))) - 1)
    coded = named.withColumns({"values": place, "base": F.length("alphabet"), "bins": F.least(F.length("alphabet"), F.greatest(F.lit(2), F.floor(F.col("length") / 5).cast("int")))})
    n, values, base, bins = F.col("length"), F.col("values"), F.col("base"), F.col("bins")
    of_bin = F.transform(values, lambda v: F.floor(v * bins / base))
    share = lambda b: (F.ceil((b + 1) * base / bins) - F.ceil(b * base / bins)) / base
    squares = F.transform(
        F.sequence(F.lit(0), bins - 1), lambda b: F.pow(F.size(F.filter(F.col("of_bin"), lambda x: x == b)) - n * share(b), 2.0) / (n * share(b))
    )
    high = F.transform(values, lambda v: (v * 2 >= base).cast("int"))
    stats = coded.withColumns({"of_bin": of_bin, "high": high})
    mean = _sum(values) / n
    stats = stats.withColumns(
        {
            "chi": _sum(squares),
            "ups": _sum(F.col("high")),
            "runs": 1 + _sum(F.zip_with(F.slice("high", F.lit(1), n - 1), F.slice("high", F.lit(2), n - 1), lambda a, b: (a != b).cast("int"))),
            "mean": mean,
        }
    )
    centred = lambda v: v - F.col("mean")
    stats = stats.withColumns(
        {
            "spread": _sum(values, lambda v: centred(v) * centred(v)),
            "lagged": _sum(F.zip_with(F.slice("values", F.lit(1), n - 1), F.slice("values", F.lit(2), n - 1), lambda a, b: centred(a) * centred(b))),
        }
    )
    free = (bins - 1).cast("double")
    z_chi = (F.pow(F.col("chi") / free, 1 / 3) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    ups, downs = F.col("ups"), n - F.col("ups")
    due = 1 + 2 * ups * downs / n
    varies = (due - 1) * (due - 2) / (n - 1)
    p_runs = F.when(varies > 0, _two_sided((F.col("runs") - due) / F.sqrt(varies))).otherwise(F.lit(0.0))
    p_serial = F.when(F.col("spread") > 0, _two_sided((F.col("lagged") / F.col("spread") + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))
    band = reduce(lambda c, b: c + (F.col("length") >= b).cast("int"), LENGTH_BANDS, F.lit(0))
    p = F.least(F.lit(1.0), 3 * F.least(_upper_tail(z_chi), p_runs, p_serial))
    return stats.select(*tokens.columns, "encoding", band.alias("band"), p.alias("p"))


def not_random(tested: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """encoding, band and the least p-bin of the tokens that Benjamini and Hochberg's procedure rejects in that family."""
    counts = tested.groupBy("encoding", "band", "p_bin").agg(F.count("*").alias("n"))
    family = Window.partitionBy("encoding", "band")
    running = counts.withColumns({"rejected": F.sum("n").over(family.orderBy(F.desc("p_bin"))), "m": F.sum("n").over(family)})
    # The largest p of a bin stands for all of it.
    passed = running.where(F.pow(F.lit(10.0), -F.col("p_bin") / BINS_PER_DECADE) <= rate * F.col("rejected") / F.col("m"))
    return passed.groupBy("encoding", "band").agg(F.min("p_bin").alias("limit"))


def _matches(pattern: str, group: int | None = None) -> tuple[Column, Column, Column]:
    """Whole matches, the pieces between them and a group; empty where there is no match."""
    text, empty = F.col("text"), F.array().cast("array<string>")
    guard = lambda c: F.when(text.rlike(pattern), c).otherwise(empty)
    regex = F.lit(pattern)
    return guard(F.regexp_extract_all(text, regex, F.lit(0))), guard(F.split(text, pattern, -1)), guard(F.regexp_extract_all(text, regex, F.lit(group or 0)))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans and spans of each row of docs (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start and then
    kind, comma-joined; spans has the random tokens too. A null text is empty.
    Rows of one doc_id and text are scanned once and all returned.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    patterns = {"assign": (ASSIGN, 2), "access": (ACCESS, None), "hex": (HEX, None), "random": (CANDIDATE, None)}
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.select("doc_id", "text", *[c.alias(f"{kind}_{i}") for kind, (p, g) in patterns.items() for i, c in enumerate(_matches(p, g))])

    def sizes(kind: str) -> Column:
        return F.transform(
            F.col(f"{kind}_0"),
            lambda m, i: F.struct(
                F.length(F.get(F.col(f"{kind}_1"), i)).alias("gap"), F.length(m).alias("size"), F.get(F.col(f"{kind}_2"), i).alias("value")
            ),
        ).alias(kind)

    kept = scratch.keep(found.select("doc_id", F.xxhash64("text").alias("text_hash"), *[sizes(k) for k in KINDS]), "matches")
    some = kept.where(reduce(lambda a, b: a | b, [F.size(k) > 0 for k in KINDS])).dropDuplicates(["doc_id", "text_hash"])
    rows = reduce(
        DataFrame.unionByName,
        [
            some.select("doc_id", "text_hash", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.posexplode(kind).alias("i", "m")).select(
                "doc_id", "text_hash", "rank", "kind", "i", "m.gap", "m.size", "m.value"
            )
            for rank, kind in enumerate(KINDS)
        ],
    )
    walk = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i")
    until = F.sum(F.col("gap") + F.col("size")).over(walk)
    spans = rows.withColumn("until", until).withColumn("start", F.col("until") - F.col("size"))
    spans = scratch.keep(spans.where((F.col("kind") != "assign") | (F.length("value") >= LEAST_VALUE)), "spans")

    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    tokens = spans.where((F.col("kind") == "random") & mixed).withColumnRenamed("value", "token")
    tested = randomness(tokens).withColumn(
        "p_bin", F.least(F.lit(P_BINS), F.floor(-F.log10(F.greatest("p", F.lit(1e-30))) * BINS_PER_DECADE).cast("int"))
    )
    tested = scratch.keep(tested, "tested")
    random = tested.join(F.broadcast(not_random(tested)), ["encoding", "band"], "left").where(F.col("limit").isNull() | (F.col("p_bin") < F.col("limit")))
    columns = ["doc_id", "text_hash", "rank", "kind", "start", "until"]
    reported = spans.where(F.col("kind") != "random").select(*columns).unionByName(random.select(*columns))
    render = lambda s: F.concat_ws(":", s["kind"], s["start"], s["until"])
    listed = F.array_sort(F.collect_list(F.struct("start", "rank", "until", "kind")))
    per_doc = reported.groupBy("doc_id", "text_hash").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS[:3]], listed.alias("listed")
    )
    per_doc = per_doc.select(
        F.col("doc_id").alias("found_id"),
        F.col("text_hash").alias("found_hash"),
        *[f"n_{k}" for k in KINDS[:3]],
        F.array_join(F.transform(F.filter("listed", lambda s: s["rank"] < 3), render), ",").alias("base_spans"),
        F.array_join(F.transform("listed", render), ",").alias("spans"),
    )
    joined = kept.select("doc_id", "text_hash").join(
        per_doc, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left"
    )
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS[:3]],
        F.coalesce("base_spans", F.lit("")).alias("base_spans"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
