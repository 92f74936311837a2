"""URL filtering by allow and block rules and by mined token combinations.

Fixed rules (host and path prefix) come first; the longest that fits decides.
Every other URL is judged by association rules: FP-growth over the token sets of
URLs labelled bad gives the combinations that a fixed number of bad URLs share,
whatever the size of the table.  They are counted over all labelled URLs; those
bad often enough, and no less often than labelled URLs at large, block.

Two steps keep the mining small without losing a rule.  Tokens are counted first:
one that is a rule by itself covers every combination with it, and one that too
few bad URLs have is in no rule, so neither goes to FP-growth.  Tokens that stand
in exactly the same labelled URLs are mined as one and come back together.

Rules are a table, found through an inverted index: they are joined by their
rarest token with the distinct token sets of the URLs.  Only built-in
expressions and the JVM's FP-growth run.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no fixed rule and is judged by its (no) tokens: it is allowed.  Null labels
count as good; repeated labels count each time.  Without labels nothing is
mined.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.tables import cut, table

#: (verdict, host, path prefix), fixed by the query's contract
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A combination needs as many bad URLs as this many URLs have at the least
#: confidence, however few or many there are in all.
MIN_COUNT = 50
MIN_CONFIDENCE = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_match(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, on, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(prefix)
        name = F.when(fits, F.lit(on + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(say)).otherwise(verdict)
    return name, verdict


def tokens(url: str, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: host, its labels, path words, file type, query keys, fragment."""
    tag = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(kind), x))
    whole = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(whole, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"(?s)^([^=]*)", 1))
    found = F.array_distinct(F.flatten(F.array(
        tag("host:", F.array(host)), tag("label:in:", F.split(host, r"\.")),
        tag("path:", F.regexp_extract_all(path, F.lit("([A-Za-z]+)"), 1)),
        tag("type:", F.regexp_extract_all(path, F.lit(r"\.([A-Za-z0-9]+)$"), 1)), tag("key:", keys),
        tag("scheme:", F.regexp_extract_all(whole, F.lit(r"^([A-Za-z]+)://"), 1)),
        tag("part:", F.regexp_extract_all(whole, F.lit(r"#(.+)$"), 1)))))
    return F.filter(found, lambda x: ~x.endswith(":"))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, tokens) for each page."""
    rows = pages.select("page_id", "url", host_of("url").alias("host"), path_of("url").alias("path"))
    return rows.select("page_id", "host", "path", tokens("url", F.col("host"), F.col("path")).alias("tokens"))


def hits(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``sets`` (with tokens) beside each rule whose antecedent they contain, by inverted index."""
    return (sets.withColumn("token", F.explode("tokens")).join(rules, F.col("token") == F.col("lead"))
            .where(F.size(F.array_except("antecedent", "tokens")) == 0))


def token_counts(sets: DataFrame) -> DataFrame:
    """(token, n, n_bad, place): labelled URLs with a token, and a fingerprint of which those are."""
    each = sets.select(F.explode("tokens").alias("token"), "n", "n_bad", F.xxhash64("tokens").alias("s"),
                       F.xxhash64("tokens", F.lit(1)).alias("t"))
    return each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"),
                                     F.struct(F.bit_xor("s").alias("s"), F.bit_xor("t").alias("t"),
                                              F.count(F.lit(1)).alias("sets")).alias("place"))


def combinations(sets: DataFrame, tokens_: DataFrame, least: int) -> DataFrame | None:
    """(antecedent, lead): combinations of two or more of the tokens that ``least`` bad URLs share.

    ``tokens_`` are (token, n, place); those of one place stand for one another.
    """
    from pyspark.ml.fpm import FPGrowth

    classes = cut(tokens_.groupBy("place").agg(F.min("token").alias("first"), F.min("n").alias("often"),
                                               F.sort_array(F.collect_list("token")).alias("members")), "classes")
    bad = (sets.where("n_bad > 0").select("tokens", "n_bad", F.explode("tokens").alias("token"))
           .join(classes.select(F.col("first").alias("token")), "token")
           .groupBy("tokens", "n_bad").agg(F.collect_list("token").alias("items"))
           .select("items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_bad"))).alias("copy")).select("items"))
    bad = cut(bad, "bad-baskets")
    rows = bad.count()
    if rows < least:
        return None
    # half a row less, so that rounding of the share does not ask for one more
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / rows).fit(bad)
    found = model.freqItemsets.select("items")
    sized = (found.withColumn("token", F.explode("items"))
             .join(classes.withColumnRenamed("first", "token"), "token")
             .groupBy("items").agg(F.min(F.struct("often", "token"))["token"].alias("lead"),
                                   F.sort_array(F.flatten(F.collect_list("members"))).alias("antecedent")))
    return sized.where(F.size("antecedent") > 1).select("antecedent", "lead")


def rule_table(rows: DataFrame, labels: DataFrame, min_confidence: float = MIN_CONFIDENCE,
               min_count: int = MIN_COUNT) -> DataFrame | None:
    """(antecedent, lead, confidence): token combinations that imply a bad label; None if there are none.

    Only combinations that no smaller one already covers are kept.
    """
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    marks = labels.select(F.col("doc_id").alias("l_id"), bad.alias("bad"))
    baskets = rows.join(marks, F.col("page_id") == F.col("l_id")).select("tokens", "bad")
    sets = cut(baskets.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad")), "sets")
    total, n_bad = sets.agg(F.sum("n"), F.sum("n_bad")).first()
    least = max(1, math.ceil(min_count * min_confidence - 1e-9))
    if (n_bad or 0) < least:
        return None
    needed = max(min_confidence, n_bad / total)
    enough = cut(token_counts(sets).where(F.col("n_bad") >= least)
                 .withColumn("confidence", F.col("n_bad") / F.col("n")), "tokens")
    sure = F.col("confidence") >= needed
    rules = enough.where(sure).select(F.array("token").alias("antecedent"), F.col("token").alias("lead"), "confidence")
    found = combinations(sets, enough.where(~sure), least)
    if found is None:
        return rules
    counted = (hits(sets, cut(found, "combinations")).groupBy("antecedent", "lead")
               .agg((F.sum("n_bad") / F.sum("n")).alias("confidence"), F.sum("n_bad").alias("n_bad")))
    larger = cut(counted.where((F.col("confidence") >= needed) & (F.col("n_bad") >= least)).drop("n_bad"), "rules")
    inside = hits(larger.select(F.col("antecedent").alias("tokens")), larger)
    covered = inside.where(F.size("antecedent") < F.size("tokens")).select(F.col("tokens").alias("antecedent")).distinct()
    return rules.unionByName(larger.join(covered, "antecedent", "left_anti"))


def best_lift(rows: DataFrame, labels: DataFrame, min_count: int = MIN_COUNT,
              min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(token, n, n_bad, lift) of the tokens that enough bad URLs have, best first, to look at."""
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    marks = labels.select(F.col("doc_id").alias("l_id"), bad.alias("bad"))
    sets = (rows.join(marks, F.col("page_id") == F.col("l_id")).groupBy("tokens")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad")))
    base = sets.agg(F.sum("n_bad") / F.sum("n")).scalar()
    least = math.ceil(min_count * min_confidence - 1e-9)
    return (token_counts(sets).where(F.col("n_bad") >= least)
            .select("token", "n", "n_bad", (F.col("n_bad") / F.col("n") / base).alias("lift"))
            .orderBy(F.col("lift").desc(), "token"))


def mine(rows: DataFrame, labels: DataFrame, min_confidence: float = MIN_CONFIDENCE,
         min_count: int = MIN_COUNT) -> list[tuple[tuple[str, ...], float]]:
    """The rules as a list, to look at."""
    rules = rule_table(rows, labels, min_confidence, min_count)
    found = [] if rules is None else [(tuple(r.antecedent), r.confidence) for r in rules.collect()]
    return sorted(found, key=lambda r: (len(r[0]), r[0]))


def with_matches(rows: DataFrame, rules: DataFrame | None) -> DataFrame:
    """``rows`` with ``mined``, whether their tokens contain the antecedent of a rule."""
    if rules is None:
        return rows.withColumn("mined", F.lit(False))
    blocked = hits(rows.select("tokens").distinct(), rules).select(F.col("tokens").alias("b_tokens")).distinct()
    return (rows.join(blocked, F.col("tokens") == F.col("b_tokens"), "left")
            .withColumn("mined", F.col("b_tokens").isNotNull()))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
          min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) for each page."""
    rows = parsed(pages)
    rows = with_matches(rows, rule_table(rows, labels, min_confidence, min_count))
    name, verdict = rule_match(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
                       "mined")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages``, with rules mined from ``labels``."""
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
