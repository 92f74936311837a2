"""Car recommendations: live cars scored against each dealer's purchases.

Score of a live car for a dealer (0 to 9):

* make: ``3 * purchases of the make / all purchases`` (0 if unseen);
* model: ``2 * purchases of (make, model) / purchases of the make``;
* year and mileage: ``clamp(2 - |x - mean| / std, 0, 2)`` with the sample
  deviation of the dealer's purchases, 0 when the deviation is missing or 0
  or the car's value is missing.

``recommend_for_dealer`` ranks every live car for one dealer, as the dashboard
does.  ``recommend_cars`` reports the exact first ``top_k`` cars of every dealer
(ties by the car's columns) without forming dealers x cars.  The argument:

1. Let Y and K be the year and mileage scores.  The make and model scores of
   all cars of a bought (make, model) are equal; those of a bought make are at
   least the make's; all others are at least 0.  So a car is scored with a set
   S of cars that score at least as much besides Y + K: its (make, model), its
   make, or all cars.
2. If Y > 0, only the cars of S of the same year matter: each scores at least
   as much besides K, so a car in the dealer's top k is among the first k of
   that year by (K, car).  If Y = 0, every car of S scores at least as much
   besides K, so the car is among the first k of S by (K, car).
3. "Cells" are therefore (), (year), (make), (make, year), (make, model) and
   (make, model, year).  In a cell K only falls as ``|km - mean|`` grows, so
   its first k by (K, car) are among the k nearest mileages on each side (each
   with its first k cars) and the cell's first k cars, which fill up when
   fewer than k cars have K > 0.

A cell's mileages are ranked and dealt to blocks of ``max(k, sqrt(m))`` of its
``m`` mileages.  A binary search over the blocks' first mileages finds a dealer's
block; it and its two neighbours hold the k nearest mileages on each side.  Once
k cars are known, only mileages whose score can still reach the k-th best are
taken.  Cells and cars are compared as structs, field by field, never as joined
text.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lotwise.functions.display import one_decimal
from lotwise.session import materialize

# ---- fixed values: score weights and bounds ----
MAKE_WEIGHT = 3
MODEL_WEIGHT = 2
RANGE_POINTS = 2            # year and mileage scores are clamped to [0, 2]
# -------------------------------------------------

KM_WIDTH = 500              # kilometers per bucket, by which mileages are ranked
KM_BUCKETS = 1000           # mileages beyond this many buckets share the last
YEARS = (1899, 2101)        # years outside count as these two when dealt out
SALTS = 16
SEED_PAIRS = 8              # bought pairs that the first round looks at, at least
SLACK = 1e-9                # float margin of the pruning comparisons

CAR = ("sf_vehicle_name", "make", "model", "year", "kilometers")
SCORES = ("make_score", "model_score", "year_score", "km_score")


def dealer_stats(history: DataFrame, key: str = "dealer_name") -> DataFrame:
    """Purchases, mean and sample deviation of year and kilometers per dealer."""
    return history.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_purchases"),
        F.avg("year").alias("year_mean"), F.stddev_samp("year").alias("year_std"),
        F.avg("kilometers").alias("km_mean"), F.stddev_samp("kilometers").alias("km_std"))


def _scores_from_counts(stats: DataFrame, pair_counts: DataFrame, key: str):
    """Make and model scores from per-(dealer, make, model) counts (small tables)."""
    made = pair_counts.where(F.col("make").isNotNull()).groupBy(key, "make") \
        .agg(F.sum("n").alias("make_purchases"))
    makes = made.join(stats.select(key, "n_purchases"), key).select(
        key, "make", "make_purchases",
        (F.col("make_purchases") / F.col("n_purchases") * F.lit(MAKE_WEIGHT))
        .alias("make_score"))
    models = pair_counts.where(F.col("make").isNotNull() & F.col("model").isNotNull()) \
        .join(made, [key, "make"]).select(
            key, "make", "model", F.col("n").alias("model_purchases"),
            (F.col("n") / F.col("make_purchases") * F.lit(MODEL_WEIGHT)).alias("model_score"))
    return makes, models


def dealer_preferences(history: DataFrame, key: str = "dealer_name") -> DataFrame:
    """The recommender's profile, one row per (dealer, make, model) bought.

    ``model`` may be NULL (a make bought with unknown model); its
    ``model_score`` is then NULL because such a row never matches a car.
    Two passes over the history: dealer moments and (dealer, make, model) counts.
    """
    stats = dealer_stats(history, key)
    pair_counts = history.groupBy(key, "make", "model").agg(F.count(F.lit(1)).alias("n"))
    makes, _ = _scores_from_counts(stats, pair_counts, key)
    pairs = pair_counts.where(F.col("make").isNotNull()) \
        .withColumnRenamed("n", "model_purchases")
    out = pairs.join(makes, [key, "make"]).join(stats, key)
    model_score = F.when(F.col("model").isNotNull(),
                         F.col("model_purchases") / F.col("make_purchases")
                         * F.lit(MODEL_WEIGHT))
    return out.select(key, "make", "model", "n_purchases", "make_purchases",
                      "model_purchases", "make_score", model_score.alias("model_score"),
                      "year_mean", "year_std", "km_mean", "km_std")


def range_score(value: Column, mean: Column, std: Column) -> Column:
    """``clamp(2 - |value - mean| / std, 0, 2)`` if ``std > 0``, else 0."""
    raw = F.lit(RANGE_POINTS) - F.abs(value - mean) / std
    clamped = F.least(F.lit(RANGE_POINTS), F.greatest(F.lit(0.0), raw))
    return F.when(std > 0, F.coalesce(clamped, F.lit(0.0))).otherwise(F.lit(0.0))


def _cell(level: int, make: Column | None = None, model: Column | None = None,
          year: Column | None = None) -> Column:
    """A cell's key: a struct, so that NULLs and any text compare field by field."""
    none = F.lit(None)
    return F.struct(F.lit(level).alias("level"),
                    (none if make is None else make).cast("string").alias("make"),
                    (none if model is None else model).cast("string").alias("model"),
                    (none if year is None else year).cast("double").alias("year"))


def _km_bucket(km: Column) -> Column:
    return F.least(F.greatest(F.floor(km / F.lit(KM_WIDTH)), F.lit(-1)), F.lit(KM_BUCKETS))


def _live_cars(live: DataFrame) -> DataFrame:
    """Distinct live cars with their multiplicity."""
    return live.groupBy(*CAR).agg(F.count(F.lit(1)).alias("copies"))


def _upper_bound(values: Column, x: Column) -> Column:
    """How many of the ascending ``values`` are at most ``x``, by binary search."""
    size = F.size(values)
    steps = F.sequence(F.lit(1), F.ceil(F.log2(size + 1)).cast("int"))
    range_ = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def step(acc, _):
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        halved = F.when(F.get(values, mid) <= x, range_(mid + 1, acc["hi"])).otherwise(range_(acc["lo"], mid))
        return F.when(acc["lo"] < acc["hi"], halved).otherwise(acc)

    return F.aggregate(steps, range_(F.lit(0), size), step, lambda acc: acc["lo"])


class _CellIndex:
    """First cars, blocks of ranked mileages and block boundaries of every cell.

    Every collected list has a bound: ``k`` cars per mileage, and for a cell of
    ``m`` mileages at most about ``max(k, sqrt(m))`` mileages of a block and
    ``sqrt(m)`` boundaries.  Mileages are ranked inside buckets, whose running
    sizes a cell's window adds up; no window sees a cell's cars.
    """

    def __init__(self, cars: DataFrame, k: int):
        self.k = k
        mk, md, y = F.col("make"), F.col("model"), F.col("year")
        cells = cars.select(
            F.struct(F.struct(*CAR).alias("car"), "copies").alias("item"), "kilometers",
            F.explode(F.array(_cell(0), _cell(1, year=y), _cell(2, mk), _cell(3, mk, year=y),
                              _cell(4, mk, md), _cell(5, mk, md, y))).alias("cell"))
        salted = cells.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
        first = Window.partitionBy("cell", "salt").orderBy("item.car")
        self.heads = (salted.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
                      .groupBy("cell").agg(F.slice(F.sort_array(F.collect_list("item")), 1, k)
                                           .alias("items")))
        alike = Window.partitionBy("cell", "km").orderBy("item.car")
        points = (cells.withColumnRenamed("kilometers", "km").where(F.col("km").isNotNull())
                  .withColumn("r", F.row_number().over(alike)).where(F.col("r") <= k)
                  .groupBy("cell", _km_bucket(F.col("km")).alias("bucket"), "km")
                  .agg(F.sort_array(F.collect_list("item")).alias("items")))
        in_cell = Window.partitionBy("cell").orderBy("bucket")
        sizes = points.groupBy("cell", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
            "cell", "bucket", (F.sum("n").over(in_cell) - F.col("n")).alias("before"),
            F.sum("n").over(Window.partitionBy("cell")).alias("m"))
        rank = F.col("before") + F.row_number().over(Window.partitionBy("cell", "bucket").orderBy("km")) - 1
        width = F.greatest(F.lit(k), F.ceil(F.sqrt("m")))
        self.points = materialize(points.join(sizes, ["cell", "bucket"]).select(
            "cell", "km", "items", F.floor(rank / width).cast("int").alias("block")))
        self.blocks = self.points.groupBy("cell", "block").agg(
            F.sort_array(F.collect_list("km")).alias("kms"))
        bounds = self.points.groupBy("cell", "block").agg(F.min("km").alias("km"))
        self.directory = bounds.groupBy("cell").agg(F.sort_array(F.collect_list("km")).alias("bounds"))

    def attained(self, queries: DataFrame, key: str) -> DataFrame:
        """(dealer, scores): what up to k cars of each query's cell score, without the cars.

        The cars are those nearest the mean in its own block, one per mileage, so the
        scores of different cells count different cars unless the cells overlap.
        """
        k, mean, std = self.k, F.col("km_mean"), F.col("km_std")
        centre = F.coalesce(mean, F.lit(0.0))
        found = (queries.join(self.directory, "cell")
                 .withColumn("block", F.greatest(_upper_bound(F.col("bounds"), centre) - 1, F.lit(0)))
                 .drop("bounds").join(self.blocks, ["cell", "block"]))
        below = F.filter("kms", lambda x: x <= centre)
        above = F.filter("kms", lambda x: (x > centre) & ~F.isnan(x))
        nearest = F.concat(F.slice(below, F.greatest(F.size(below) - (k - 1), F.lit(1)), F.lit(k)), F.slice(above, 1, k))
        given = F.col(SCORES[0]) + F.col(SCORES[1]) + F.col(SCORES[2])
        gained = F.transform(nearest, lambda x: given + F.when(
            F.isnan(centre) | F.isnan(std), F.lit(0.0)).otherwise(range_score(x, mean, std)))
        return found.select(key, F.slice(F.sort_array(gained, asc=False), 1, k).alias("scores"))

    def search(self, queries: DataFrame, key: str) -> DataFrame:
        """Scored cars (dealer, car, copies, SCORES) of each query.

        A query is (dealer, cell, km_mean, km_std, floor) with the make, model and
        year score that the cell's cars have at least.  ``floor`` is the mileage
        score below which a car of the cell cannot be among the dealer's first k;
        NULL when there is no such bound.
        """
        k, mean = self.k, F.col("km_mean")
        needed = F.coalesce(F.col("floor"), F.lit(0.0))
        given = SCORES[:-1]
        reach = F.col("km_std") * (F.lit(RANGE_POINTS + SLACK) - F.greatest(needed, F.lit(0.0)))
        asked = (queries.where((F.col("km_std") > 0) & mean.isNotNull())
                 .select(key, "cell", *given, "km_mean", "km_std", (mean - reach).alias("lo"),
                         (mean + reach).alias("hi")).where(F.col("lo") <= F.col("hi")))
        # the block of the mean and its neighbours, as far as the reach goes
        found = asked.join(self.directory, "cell").withColumn("own", _upper_bound(F.col("bounds"), mean) - 1)
        found = found.withColumn("block", F.explode(F.sequence(
            F.greatest(F.col("own") - 1, F.lit(0)),
            F.least(F.col("own") + 1, F.size("bounds") - 1)))).drop("own", "bounds")
        found = found.join(self.blocks, ["cell", "block"])
        below = F.filter("kms", lambda x: (x <= mean) & (x >= F.col("lo")))
        above = F.filter("kms", lambda x: (x > mean) & (x <= F.col("hi")))
        found = found.withColumns({"below": below, "above": above}).drop("kms", "lo", "hi")
        nearest = F.slice("below", F.greatest(F.size("below") - (k - 1), F.lit(1)), F.lit(k))
        near = (found.withColumn("km", F.explode(F.concat(nearest, F.slice("above", 1, k))))
                .join(self.points.select("cell", "km", "items"), ["cell", "km"])
                .select(key, F.explode("items").alias("item"), *given,
                        range_score(F.col("km"), mean, F.col("km_std")).alias("km_score")))
        near = near.unionByName(
            queries.where(needed <= SLACK).select(key, "cell", *given).join(self.heads, "cell")
            .select(key, F.explode("items").alias("item"), *given, F.lit(0.0).alias("km_score")))
        return near.select(key, "item.car", "item.copies", *SCORES)


def _totals(scored: DataFrame) -> DataFrame:
    scored = scored.withColumns({
        "year_score": range_score(F.col("year"), F.col("year_mean"), F.col("year_std")),
        "km_score": range_score(F.col("kilometers"), F.col("km_mean"), F.col("km_std"))})
    return scored.withColumn("match_score", _sum_of_scores())


def _sum_of_scores() -> Column:
    return F.col("make_score") + F.col("model_score") + F.col("year_score") + F.col("km_score")


def _breakdown() -> Column:
    return F.concat(
        F.lit("Make: "), one_decimal(F.col("make_score")),
        F.lit(", Model: "), one_decimal(F.col("model_score")),
        F.lit(", Year: "), one_decimal(F.col("year_score")),
        F.lit(", Mileage: "), one_decimal(F.col("km_score")))


def _spans(cars: DataFrame, *columns: str) -> DataFrame:
    """Least and greatest mileage of the cars of each cell."""
    return cars.groupBy(*columns).agg(F.min("kilometers").alias("km_lo"), F.max("kilometers").alias("km_hi"))


def _first(found: DataFrame, k: int, key: str) -> DataFrame:
    """The k best cars of each dealer.

    A car found in several cells has several lower bounds of each score, of which
    the greatest count.
    """
    best = found.groupBy(key, "car").agg(F.max("copies").alias("copies"), *[F.max(c).alias(c) for c in SCORES])
    best = best.withColumn("match_score", _sum_of_scores())
    order = Window.partitionBy(key).orderBy(F.col("match_score").desc(), "car")
    return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _whole_year(c: Column) -> Column:
    return F.least(F.greatest(F.floor(c), F.lit(YEARS[0])), F.lit(YEARS[1]))


def _years_in_reach(stats: DataFrame, years: DataFrame, key: str, deviations: Column | None = None,
                    also: tuple = ()) -> DataFrame:
    """(dealer, year) of the live years near a dealer's mean year.

    Dealers are dealt to whole years within so many deviations, or to the two
    around the mean, and met by an equality join (on the columns ``also`` too); at
    most ``YEARS`` of them.
    """
    mean = F.col("year_mean")
    reach = F.lit(1.0) if deviations is None else deviations * F.col("year_std")
    near = stats.where((F.col("year_std") > 0) & (reach >= 0)).withColumn(
        "slot", F.explode(F.sequence(_whole_year(mean - (0 if deviations is None else reach)),
                                     _whole_year(mean + reach))))
    return near.join(years.withColumn("slot", _whole_year(F.col("year"))), ["slot", *also]).drop("slot")


def recommend_cars(history: DataFrame, live: DataFrame, top_k: int,
                   key: str = "dealer_name") -> DataFrame:
    """The ``top_k`` best-scoring live cars of every dealer with purchases.

    Order: ``match_score`` descending, then the car's columns.  Dealers without
    history get no rows, as on the dashboard.  Exact (module doc).

    The search runs in two rounds.  The first only finds a score ``tau`` that k cars
    reach, from the mileages of the index and without the cars: in the years around a
    dealer's mean among the cars of its best-scored pairs, in those pairs as a whole,
    as many as hold k cars, and, where these leave room, in the years among all cars.
    The second needs only the cells, and in them the mileages, that can reach it.
    A cell's query carries the make, model and year scores that its cars have at
    least, so a found car needs no join to be scored: a car of the first k is found
    in the cell where these are its own, and its best score counts.
    The small tables that both rounds read (moments, counts, live cars, index,
    queries, ``tau``) are written to the shared checkpoint folder while the plan is
    built; the rest is lazy.
    """
    def stock_and_index():
        stored = materialize(_live_cars(live), "cars")
        return stored, _CellIndex(stored, top_k)

    # the live cars do not depend on the history, so both are stored side by side
    pool = ThreadPoolExecutor(1)
    stocked = pool.submit(stock_and_index)
    held = history.select(key, "make", "model", "year", "kilometers").persist()
    stats = materialize(dealer_stats(held, key), "stats")
    pair_counts = materialize(held.groupBy(key, "make", "model").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    held.unpersist()
    cars, index = stocked.result()
    pool.shutdown()
    moments = stats.select(key, "year_mean", "year_std", "km_mean", "km_std")
    gain = range_score(F.col("year"), F.col("year_mean"), F.col("year_std"))
    dated = cars.where(F.col("year").isNotNull())
    mk, md, y = F.col("make"), F.col("model"), F.col("year")

    zero = F.lit(0.0)

    def asked(frame: DataFrame, cell: Column, scores: tuple, floor: Column | None = None) -> DataFrame:
        """Queries of a cell whose cars have at least these make, model and year scores."""
        return frame.select(key, cell.alias("cell"), "km_mean", "km_std",
                            (F.lit(None) if floor is None else floor).cast("double").alias("floor"),
                            *[c.alias(n) for c, n in zip(scores, SCORES)])

    # scores of the pairs that a dealer bought; both windows run on one shuffle of them
    made, modelled = F.col("make_score"), F.col("model_score")
    in_make = F.sum("n").over(Window.partitionBy(key, "make"))
    stock = cars.groupBy("make", "model").agg(F.count(F.lit(1)).alias("stock"))
    ahead = Window.partitionBy(key).orderBy((made + modelled).desc(), "make", "model")
    held_ahead = F.coalesce(F.sum("stock").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    scored = (pair_counts.where(F.col("make").isNotNull()).repartition(key).withColumn("in_make", in_make)
              .join(stats.select(key, "n_purchases"), key).select(
                  key, "make", "model", (F.col("in_make") / F.col("n_purchases") * F.lit(MAKE_WEIGHT))
                  .alias("make_score"), (F.col("n") / F.col("in_make") * F.lit(MODEL_WEIGHT)).alias("model_score")))
    scored = materialize(scored, "pair-scores")
    makes = scored.select(key, "make", "make_score").distinct()
    pairs = materialize(scored.join(stock, ["make", "model"]).withColumn("seed", F.when(
        held_ahead < top_k, 1).when(F.row_number().over(ahead) <= SEED_PAIRS, 2)).drop("stock"), "pairs")

    # round 1: a score that k different cars reach, to prune by.  Only cells of one kind
    # share no cars, so each kind is taken for itself
    def reached(frames: list[DataFrame]) -> DataFrame:
        found = [index.attained(frame, key).withColumn("kind", F.lit(i)) for i, frame in enumerate(frames)]
        scores = reduce(DataFrame.unionByName, found).groupBy(key, "kind").agg(
            F.sort_array(F.flatten(F.collect_list("scores")), asc=False).alias("scores"))
        return scores.groupBy(key).agg(F.max(F.get("scores", F.lit(top_k - 1))).alias("tau"))

    whole = asked(pairs.where("seed = 1").join(moments, key), _cell(4, mk, md), (made, modelled, zero))
    around = pairs.where("seed is not null").join(moments, key)
    around = asked(_years_in_reach(around, _spans(dated, "make", "model", "year"), key, also=("make", "model")),
                   _cell(5, mk, md, y), (made, modelled, gain))
    top = F.lit(float(RANGE_POINTS))
    moments = materialize(moments.join(reached([whole, around]), key, "left"), "moments")
    low = moments.where(F.col("tau").isNull() | (F.col("tau") < top + top))
    years = asked(_years_in_reach(low, _spans(dated, "year"), key), _cell(1, year=y), (zero, zero, gain))
    more = reached([years]).withColumnRenamed("tau", "tau_of_years")
    moments = materialize(moments.join(more, key, "left").withColumn("tau", F.greatest("tau", "tau_of_years"))
                          .drop("tau_of_years"), "moments")

    # round 2: every cell whose bound reaches tau
    matters = lambda bound: F.col("tau").isNull() | (bound >= F.col("tau") - F.lit(SLACK))
    # the best mileage score in a cell is at the mean moved into its range
    near = range_score(F.least(F.greatest("km_mean", "km_lo"), "km_hi"), F.col("km_mean"), F.col("km_std"))

    def open_(frame: DataFrame, cell: Column, scores: tuple) -> DataFrame:
        bound = scores[0] + scores[1] + scores[2]
        return asked(frame.where(matters(bound + near)), cell, scores, F.col("tau") - bound)

    wanted = pairs.join(moments, key)
    bought = makes.join(moments, key)
    any_ = cars.agg(F.min("kilometers").alias("km_lo"), F.max("kilometers").alias("km_hi"))
    left = F.least(top, top + top - F.coalesce("tau", zero)) + F.lit(SLACK)
    parts = (
        open_(wanted.where(matters(made + modelled + top + top))
              .join(_spans(dated, "make", "model", "year"), ["make", "model"]).where(gain > 0),
              _cell(5, mk, md, y), (made, modelled, gain)),
        open_(bought.where(matters(made + top + top)).join(_spans(dated, "make", "year"), "make").where(gain > 0),
              _cell(3, mk, year=y), (made, zero, gain)),
        open_(_years_in_reach(moments, _spans(dated, "year"), key, left).where(gain > 0),
              _cell(1, year=y), (zero, zero, gain)),
        open_(wanted.where(matters(made + modelled + top)).join(_spans(cars, "make", "model"), ["make", "model"]),
              _cell(4, mk, md), (made, modelled, zero)),
        open_(bought.where(matters(made + top)).join(_spans(cars, "make"), "make"), _cell(2, mk), (made, zero, zero)),
        open_(moments.where(matters(top)).withColumns({
            "km_lo": any_.select("km_lo").scalar(), "km_hi": any_.select("km_hi").scalar()}),
            _cell(0), (zero, zero, zero)))
    second = reduce(DataFrame.unionByName, parts)
    rows = (_first(index.search(materialize(second, "queries"), key), top_k, key)
            # a car listed twice in the snapshot is recommended twice, as on the dashboard
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))
    order = Window.partitionBy(key).orderBy(F.col("match_score").desc(), "car", "copy")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select(
        key, "car.*", "match_score", _breakdown().alias("score_breakdown"), "rank")


def recommend_for_dealer(history: DataFrame, live: DataFrame, dealer: str,
                         key: str = "dealer_name") -> DataFrame:
    """Every live car with its score for one dealer, best first (ties by name).

    The dealer's profile is three scalar subqueries: the moments, and maps of
    make and model scores whose size is bounded by what one dealer has bought.
    So the live cars are scored in one pass, without a join.  A dealer without
    history gets no rows.
    """
    own = history.where(F.col(key) == F.lit(dealer))
    stats = dealer_stats(own, key)
    makes, models = _scores_from_counts(
        stats, own.groupBy(key, "make", "model").agg(F.count(F.lit(1)).alias("n")), key)
    moments = stats.select(F.struct("n_purchases", "year_mean", "year_std", "km_mean", "km_std")).scalar()
    by_make = makes.select(F.map_from_entries(F.collect_list(F.struct("make", "make_score")))).scalar()
    by_model = models.select(F.map_from_entries(F.collect_list(
        F.struct(F.struct("make", "model"), "model_score")))).scalar()
    rows = live.select(*CAR, moments.alias("own"), by_make.alias("makes"), by_model.alias("models"))
    rows = rows.where(F.col("own.n_purchases") > 0).select(
        F.lit(dealer).alias(key), *CAR, "own.*",
        F.coalesce(F.try_element_at("makes", F.col("make")), F.lit(0.0)).alias("make_score"),
        F.coalesce(F.when(F.col("make").isNotNull() & F.col("model").isNotNull(), F.try_element_at(
            "models", F.struct("make", "model"))), F.lit(0.0)).alias("model_score"))
    return _totals(rows).select(key, *CAR, "match_score", _breakdown().alias("score_breakdown")) \
        .orderBy(F.col("match_score").desc(), "sf_vehicle_name", "kilometers", "year", "make", "model")
