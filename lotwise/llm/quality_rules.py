"""Quality rules: fixed limits and robust multivariate outliers (native).

Four base statistics are counted inside each text.  Texts within the fixed
limits are then judged by the minimum covariance determinant (MCD) of their
group, a language and source: transformed statistics are compared with a mean
and covariance estimated from the ``half`` of the group that lies closest
together, so that outliers do not hide themselves, and a text whose Mahalanobis
distance exceeds a chi-square quantile goes.

The estimate starts at medians and median absolute deviations and takes
``steps`` concentration steps, then one reweighting step.  Every step is an
aggregate over small vectors with map-side sums; quantiles come from counts of
narrow bins, so they are the same in every run and no group is gathered.  The
covariance has a floor per statistic, since most clean texts share the value 0.
Sources of a language with fewer than ``least_group`` texts are judged
together; so are the texts of such languages; fewer than that in all are kept.

Only built-in expressions are used.

Defined results: a null or wordless text has no words and fails the fixed limits;
null languages and sources are groups of their own; repeated rows count each
time; null ids stay null; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.llm.tables import cut, table

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEAT = 50

#: Half of a group, so that copies or another kind of text may hold almost as much of it.
HALF = 0.5
STEPS = 3
LEAST_GROUP = 50
#: Chance that a clean text of a normal group lies beyond the cutoff.
TAIL = 1e-9
#: Standard deviations added to the estimated ones, one per statistic.
FLOORS = (0.1, 0.3, 0.2, 0.1)
DIMENSIONS = 4


# --- base statistics ---------------------------------------------------------

def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("source").cast("string").alias("source"), text.alias("text"),
                       F.regexp_extract_all(text, F.lit(WORD), 0).alias("words"),
                       F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"))
    n = F.size("words").cast("int")
    # hashes of all three-word windows, sorted with their places: equal windows
    # become neighbours
    places = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.struct(
        F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i"))
    rows = rows.select("doc_id", "lang", "source", "text", n.cast("long").alias("n_words"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       F.sort_array(F.transform(places, window)).alias("sorted"))
    rest = F.when(F.size("sorted") > 1, F.slice("sorted", F.lit(2), F.size("sorted") - 1))
    twice = F.zip_with("sorted", rest, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    found = F.flatten(F.filter(twice, lambda x: x.isNotNull()))
    covered = F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2))))
    chars = F.char_length("text")
    return rows.select(
        "doc_id", "lang", "source", "n_words",
        F.char_length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (chars - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), "n_dup_lines",
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEAT)


def vector() -> list[Column]:
    """The transformed statistics of a text with words."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return [F.ln(chars / words), F.ln(F.lit(1.0) + F.lit(100.0) * F.col("n_symbols") / chars),
            F.ln(F.lit(1.0) + F.col("n_dup_lines")), F.asin(F.sqrt(F.col("n_repeat_words") / words))]


# --- chi-square for even degrees of freedom ----------------------------------

def chi2_cdf(x: float, degrees: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))


def chi2_quantile(q: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, degrees) < q else (low, mid)
    return high


# --- estimation --------------------------------------------------------------

def binned_quantile(rows: DataFrame, value: Column, keys: Sequence[str], share: float, width: float) -> DataFrame:
    """(keys, bin): the smallest bin of ``width`` that holds the quantile of each group."""
    bins = rows.select(*keys, F.floor(value / F.lit(width)).alias("bin")).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*keys)
    below = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return (bins.withColumn("below", F.sum("n").over(below)).withColumn("all", F.sum("n").over(whole))
            .where(F.col("below") >= F.col("all") * share).groupBy(*keys).agg(F.min("bin").alias("bin")))


def _centre(rows: DataFrame, value: Column, width: float, name: str) -> DataFrame:
    """(group, [values]) of binned medians per dimension, as an array."""
    found = binned_quantile(rows, value, ["group", "d"], 0.5, width)
    return found.groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "bin"))),
                                                  lambda s: (s["bin"] + 0.5) * width).alias(name))


def start(points: DataFrame, width: float = 0.01) -> DataFrame:
    """(group, mean, scale): medians and median absolute deviations."""
    long = points.select("group", F.posexplode("x").alias("d", "v"))
    middle = _centre(long, F.col("v"), width, "mean")
    away = long.join(middle, "group").select(
        "group", "d", F.abs(F.col("v") - F.element_at("mean", F.col("d") + 1)).alias("v"))
    spread = _centre(away, F.col("v"), width, "mad")
    return middle.join(spread, "group").select("group", "mean", F.transform("mad", lambda v: v * 1.4826).alias("scale"))


def with_factor(moments: DataFrame, scale: float, floors: Sequence[float]) -> DataFrame:
    """(group, mean, factor): the Cholesky factor of the scaled, floored covariance.

    ``moments`` has n, s (sums) and q (sums of products of the lower triangle).
    """
    p = len(floors)
    s = lambda i: F.get("s", F.lit(i))
    frame = moments.select("group", "n", "s", "q", F.transform("s", lambda v: v / F.col("n")).alias("mean"))
    k = 0
    for i in range(p):
        for j in range(i + 1):
            value = (F.get("q", F.lit(k)) - s(i) * s(j) / F.col("n")) / F.col("n") * scale
            if i == j:
                value = F.greatest(value, F.lit(0.0)) + floors[i] ** 2
            frame = frame.withColumn(f"c{i}{j}", value)
            k += 1
    for i in range(p):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}")
            for m in range(j):
                value = value - F.col(f"l{i}{m}") * F.col(f"l{j}{m}")
            value = F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"l{j}{j}")
            frame = frame.withColumn(f"l{i}{j}", value)
    return frame.select("group", "mean", F.array(*[F.col(f"l{i}{j}") for i in range(p) for j in range(i + 1)])
                        .alias("factor"))


def distance(p: int) -> Column:
    """Squared Mahalanobis distance of x from mean, by forward substitution."""
    y, k = [], 0
    for i in range(p):
        value = F.get("x", F.lit(i)) - F.get("mean", F.lit(i))
        for j in range(i):
            value = value - F.get("factor", F.lit(k + j)) * y[j]
        y.append(value / F.get("factor", F.lit(k + i)))
        k += i + 1
    return sum((v * v for v in y[1:]), y[0] * y[0])


def moments(rows: DataFrame, p: int) -> DataFrame:
    x = lambda i: F.get("x", F.lit(i))
    return rows.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x(i)) for i in range(p)]).alias("s"),
        F.array(*[F.sum(x(i) * x(j)) for i in range(p) for j in range(i + 1)]).alias("q"))


def closest(rows: DataFrame, half: float) -> DataFrame:
    """The ``half`` of each group with the smallest ``d2``."""
    width = 1 / 64
    level = F.ln(F.col("d2") + F.lit(1e-9))
    limit = binned_quantile(rows, level, ["group"], half, width).withColumnRenamed("bin", "limit")
    return rows.join(limit, "group").where(F.floor(level / width) <= F.col("limit"))


def robust_estimates(points: DataFrame, half: float = HALF, steps: int = STEPS,
                     floors: Sequence[float] = FLOORS) -> DataFrame:
    """(group, mean, factor) by MCD; ``points`` (group, x) must be stored."""
    p = len(floors)
    # makes the covariance of the closest share consistent for normal data
    scale = half / chi2_cdf(chi2_quantile(half, p), p + 2)
    first = cut(start(points), "start")
    spread = [F.get("scale", F.lit(i)) + floors[i] for i in range(p)]
    d2 = sum((F.pow((F.get("x", F.lit(i)) - F.get("mean", F.lit(i))) / spread[i], 2) for i in range(1, p)),
             F.pow((F.get("x", F.lit(0)) - F.get("mean", F.lit(0))) / spread[0], 2))
    rows = points.join(first, "group").select("group", "x", d2.alias("d2"))
    for _ in range(steps + 1):
        found = cut(with_factor(moments(closest(rows, half), p), scale, floors), "estimate")
        rows = points.join(found, "group").select("group", "x", distance(p).alias("d2"))
    near = rows.where(F.col("d2") <= chi2_quantile(0.975, p))
    scale = 0.975 / chi2_cdf(chi2_quantile(0.975, p), p + 2)
    return cut(with_factor(moments(near, p), scale, floors), "estimate")


def grouped(stats: DataFrame, least_group: int) -> DataFrame:
    """``stats`` with the group that judges each text; null if it is too small."""
    name = lambda *cols: F.to_json(F.array(*cols), {"ignoreNullFields": "false"})
    own = stats.withColumn("own", name("lang", "source")).withColumn("tongue", name("lang"))
    fit = own.where(~F.col("base_failed"))
    sizes = fit.groupBy("own", "tongue").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < least_group
    left = sizes.where(small).groupBy("tongue").agg(F.sum("n").alias("t_n"))
    sizes = sizes.join(left, "tongue", "left")
    rest = F.sum(F.when(small & (F.col("t_n") < least_group), F.col("n"))).over(Window.partitionBy())
    group = (F.when(~small, F.col("own")).when(F.col("t_n") >= least_group, F.col("tongue"))
             .when(rest >= least_group, F.lit("rest")))
    return own.join(sizes.select(F.col("own").alias("g_own"), group.alias("group")),
                    (F.col("own") == F.col("g_own")) & ~F.col("base_failed"), "left").drop("own", "tongue", "g_own")


def judge(docs: DataFrame, half: float = HALF, steps: int = STEPS, least_group: int = LEAST_GROUP,
          tail: float = TAIL, floors: Sequence[float] = FLOORS) -> DataFrame:
    """Base statistics, squared distance and verdict of each document."""
    stats = cut(base_statistics(docs).withColumn("base_failed", failed()), "statistics")
    rows = cut(grouped(stats, least_group).withColumn(
        "x", F.when(F.col("group").isNotNull(), F.array(*vector()))), "vectors")
    found = robust_estimates(rows.where("group IS NOT NULL").select("group", "x"), half, steps, floors)
    cutoff = chi2_quantile(1 - tail, len(floors))
    rows = rows.join(found, "group", "left").withColumn("distance", distance(len(floors)))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, judged within their language and source."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("distance", 6).alias("distance"))
