"""Mixing sources to target weights as a time-varying curriculum (native).

Every source has a weight and a schedule of that weight over training time 0..1.
Targets fill by weight and stop at ``max_repeat`` times a source's size; the
excess goes to the others by weight.  A source's cumulative token demand is its
target times the integral of its schedule; inverting it turns the cumulative
tokens of a source (documents in a fixed hash order, pass after pass) into
training positions, by which documents are range-sorted.

Only built-in expressions are used.  Running sums are two-level: sums per
(source, hash bucket), a window over a source's buckets, and a window inside a
bucket, so a source with a third of all rows spreads over ``16 ** digits`` tasks.
The windows over all sources see one row per source.

Defined results: a null text has size 0; a null source is a source of its own,
ranked last; null or repeated ids are ordered like others; empty tables give no
rows; a source of size 0 has target 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from lotwise.llm.tables import cut, table

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
#: Multipliers of a source's weight at times 0..1, for each weight in turn:
#: light sources early, heavy ones late.  Linear between the knots.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
DIGITS = 3

WORD = r"[^\x20\x09-\x0D]+"


def unit_schedule(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """The schedule scaled so that its integral over 0..1 is 1."""
    area = sum((t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in zip(knots, knots[1:]))
    return [(t, m / area) for t, m in knots]


def training_time(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """Invert the schedule's integral: the time at which ``share`` of the demand is met."""
    knots, done, out = unit_schedule(knots), 0.0, None
    for (t0, m0), (t1, m1) in zip(knots, knots[1:]):
        span, slope = t1 - t0, (m1 - m0) / (t1 - t0)
        left = F.greatest(share - F.lit(done), F.lit(0.0))
        if slope == 0:
            time = F.lit(t0) + left / F.lit(m0)
        else:
            root = F.greatest(F.lit(m0 * m0) + F.lit(2 * slope) * left, F.lit(0.0))
            time = F.lit(t0) + (F.sqrt(root) - F.lit(m0)) / F.lit(slope)
        time = F.least(time, F.lit(t1))
        done += span * (m0 + m1) / 2
        out = F.when(share <= F.lit(done), time) if out is None else out.when(share <= F.lit(done), time)
    return out.otherwise(F.lit(1.0))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", digits: int = DIGITS, carry: Sequence[Column] = ()) -> DataFrame:
    """Words, source and hash order of every document; ``carry`` adds columns."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"), F.substring(key, 1, digits).alias("bucket"), *carry)


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: size, weight class and target."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = (per.withColumn("class", F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
           .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                              F.col("class") + 1))
           .withColumn("cap", (F.lit(max_repeat) * F.col("source_size")).cast("double"))
           .withColumn("total", F.sum("source_size").over(every).cast("double"))
           .withColumn("all_weight", F.sum("weight").over(every)))
    # sources fill up in the order of cap / weight; one is capped if the level
    # that holds when all before it are capped reaches its cap
    rising = (Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0.0)
    before = F.coalesce(F.sum("cap").over(rising), zero)
    lighter = F.coalesce(F.sum("weight").over(rising), zero)
    per = per.withColumn("full", F.col("cap") * (F.col("all_weight") - lighter)
                         <= F.col("weight") * (F.col("total") - before))
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(every)
    used = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(zero)).over(every)
    level = (F.col("total") - spent) / F.nullif(F.col("all_weight") - used, zero)
    return per.select("source", "source_size", "class", "total",
                      F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def curriculum(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT,
               schedules: Sequence = SCHEDULES, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document with its passes; ``sized`` must be stored.

    Columns named in ``carry`` break ties of the order and are kept.

    ``passes`` lists (pass, words, position): the words that the mix takes in
    this pass and the training position of its first word.  The last pass of a
    source ends inside a document, so a source's words equal its target.
    """
    goal = targets(sized, weights, max_repeat)
    over_buckets = (Window.partitionBy("source").orderBy("bucket")
                    .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
               .withColumn("base", F.coalesce(F.sum("words").over(over_buckets), F.lit(0)))
               .select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), "base"))
    goal = goal.withColumnRenamed("source", "g_source")
    offsets = (offsets.join(goal, F.col("b_source").eqNullSafe(F.col("g_source"))).drop("g_source"))
    inside = (Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *carry)
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = (sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(offsets, F.col("source").eqNullSafe(F.col("b_source"))
                  & (F.col("bucket") == F.col("b_bucket")))
            .withColumn("before", F.col("before") + F.col("base")))
    goal_words = F.floor(F.col("target") + F.lit(0.5))
    rows = rows.withColumn("full", F.coalesce(F.least(F.lit(max_repeat), F.floor(
        F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))), F.lit(0)))
    rows = rows.withColumn("rest", F.greatest(F.lit(0), F.least(
        F.col("size"), goal_words - F.col("full") * F.col("source_size") - F.col("before"))))
    rows = rows.withColumn("taken", F.col("full") * F.col("size") + F.col("rest"))

    def position(number: Column) -> Column:
        share = (number * F.col("source_size") + F.col("before")) / F.nullif(F.col("target"), F.lit(0.0))
        by_class = [F.when(F.col("class") == i, training_time(share, knots))
                    for i, knots in enumerate(schedules)]
        return F.col("total") * F.coalesce(*by_class)

    one = lambda n: F.struct(
        n.alias("pass"), F.when(n < F.col("full"), F.col("size")).otherwise(F.col("rest")).alias("words"),
        position(n).alias("position"))
    passes = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("full")), one),
                      lambda p: p["words"] > 0)
    return rows.withColumn("passes", passes).select(
        "doc_id", "source", "size", "source_size", "target", "taken",
        F.round(F.get("passes", F.lit(0))["position"], 3).alias("position"), "passes", *carry)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed, range-sorted by the position of their first pass."""
    sized = cut(sizes(table(spark, sf_dir, "documents")), "sizes")
    mixed = curriculum(sized)
    return (mixed.select("doc_id", "size", "source_size", "target", "taken", "position")
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


def identity(docs: DataFrame) -> list[Column]:
    """128 bits over all columns of a row, null apart from empty; rows alike in every column share them."""
    parts = []
    for field in docs.schema.fields:
        column = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, (ArrayType, MapType, StructType))
        parts += [column.isNull(), F.to_json(F.struct(column)) if nested else column]
    return [F.xxhash64(F.lit(seed), *parts).alias(f"row_{seed}") for seed in (1, 2)]


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents in training order, once for each pass that takes them.

    A pass counts when it takes at least half of the document's words, so that
    only whole documents are emitted.  Documents without words are in no pass.

    Passes are placed without texts; a row meets its places by a hash of all its
    columns.  Rows alike in every column are one text with the places of all, so
    a text moves once to its places and once to its training position.
    """
    key = ["row_1", "row_2"]
    sized = sizes(docs, carry=identity(docs))
    places = (curriculum(cut(sized, "sizes"), carry=key)
              .select(*key, "size", F.explode("passes").alias("p"))
              .where(F.col("p.words") * 2 >= F.col("size"))
              .select(*key, F.col("p.position").alias("position")))
    texts = (docs.select(*identity(docs), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
             .groupBy(*key).agg(F.first("row").alias("row")))
    return places.join(texts, key).orderBy("position", *key).select("row.*")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS class
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, (class + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap,
         sum(source_size) OVER ()::DOUBLE AS total, sum(class + 1) OVER ()::DOUBLE AS all_weight
  FROM per),
marked AS (
  SELECT *, cap * (all_weight - coalesce(sum(weight) OVER w, 0))
            <= weight * (total - coalesce(sum(cap) OVER w, 0)) AS is_full
  FROM weighed
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, class, total,
         CASE WHEN is_full THEN cap ELSE weight
              * ((total - coalesce(sum(cap) FILTER (is_full) OVER (), 0))
                 / nullif(all_weight - coalesce(sum(weight) FILTER (is_full) OVER (), 0), 0)) END AS target
  FROM marked),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.class, g.total,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
         coalesce(least(3, floor(g.target / nullif(g.source_size, 0))), 0)::BIGINT AS rounds
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
rested AS (
  SELECT *, greatest(0, least(size, floor(target + 0.5)::BIGINT - rounds * source_size - ahead)) AS rest,
         ahead / target AS share
  FROM placed)
SELECT doc_id, size, source_size, target, (rounds * size + rest)::BIGINT AS taken,
       CASE WHEN size > 0 AND (rounds > 0 OR rest > 0) THEN
         round(total * CASE class WHEN 0 THEN (sqrt(greatest(2.25 - 2.0 * share, 0)) - 1.5) / -1.0
                                  WHEN 1 THEN share
                                  ELSE (sqrt(greatest(0.25 + 2.0 * share, 0)) - 0.5) / 1.0 END, 3) END AS position
FROM rested
"""
