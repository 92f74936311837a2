"""Near duplicates by MinHash with tensored banding.

Two small collections of ``bands`` band values (``rows`` minhashes each) are
computed per document; a table key combines one value of the first with one of
the second.  So ``bands ** 2`` tables of ``2 * rows`` minhashes cost
``2 * bands * rows`` minhashes.  A pair of similarity s meets in a table unless
it differs in all values of one collection: at 0.75, with 16 bands of 2, that is
2 * (1 - 0.75**2) ** 16 = 0.000004, and linked neighbours usually close the gap.

1. Documents with equal shingle sets form a class; only classes are compared.
2. Band values that one class alone has can be in no shared key, so keys are
   built from the values that occur twice.
3. Each bucket links its members to one centre (a star, never all pairs).
   Candidates pass a length test and a test of the signatures, whose error at
   0.75 is below 1e-7, and are confirmed on the full sets.
4. Buckets whose members are still in several components are searched to the
   end by an exact prefix-filter join: two sets of similarity t share one of
   their rarest ``n - ceil(t n) + 1`` shingles, and at the first that they share
   enough must be left of both for the overlap that t asks for.  Counts of the
   shingles by hash group bound the overlap once more.  Only pairs across
   components are looked for.
5. Components of the confirmed links give each document its class id.

Defined results: null or wordless texts have no shingles and link with nothing;
rows with equal texts share a component; a null id is never a component id
unless the whole component lacks ids; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.llm import text as T
from lotwise.llm.components import components
from lotwise.llm.tables import cut, table

WORDS = 5
PERCENT = 75
BANDS = 16
ROWS = 2
#: Hash groups whose counts bound the overlap of two classes.
GROUPS = 64
#: Components of this many classes meet one another apart from the rest.
GIANT = 64
#: Candidates of one document that are confirmed in one group.
STAR_LIMIT = 512
#: Equal minhashes, of 64, below which a pair cannot be similar (error < 1e-7 at 0.75).
LEAST_EQUAL = 29

SIGNED = "id string, h long, n long, d1 long, d2 long, signature array<int>"


def shingle_hashes(buf: np.ndarray, off: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a batch."""
    low = T.lower(buf)
    start, end, first = T.words(low, off)
    h = T.word_hashes(low, start, end)
    scale = T.powers(T.BASE, words + 1)
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        rolled += h[k:k + len(rolled)] * scale[k + 1]
    rolled = T.mix(rolled)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= words:
            own = np.sort(rolled[lo:hi - words + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif hi > lo:
            whole = (h[lo:hi] * scale[1:hi - lo + 1]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(T.mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _multipliers(count: int) -> np.ndarray:
    """Odd multipliers, one per minhash."""
    return T.mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(T.BASE)) | np.uint64(1)


def signatures(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Set size, 128-bit set digest and minhashes of each keyed document."""
    count = 2 * bands * rows

    def run(batches):
        by = _multipliers(count)
        for batch in batches:
            data, offsets = T.binary(batch.column("text"))
            sizes, digests, minhashes = [], [], []
            for lo, hi in T.slices(offsets):
                for own in shingle_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], words):
                    sizes.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.view(np.uint8)))
                    least = np.zeros(count, np.uint64) if len(own) == 0 else np.full(count, ~np.uint64(0))
                    for part in range(0, len(own), 4096):
                        np.minimum(least, (own[part:part + 4096, None] * by).min(axis=0), out=least)
                    minhashes.append((least >> np.uint64(32)).astype(np.uint32))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            flat = np.concatenate(minhashes) if minhashes else np.zeros(0, np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array(sizes, pa.int64()),
                 pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * count, pa.int32()),
                                          pa.array(flat.view(np.int32)))],
                ["id", "h", "n", "d1", "d2", "signature"])
        T.release()

    return docs.mapInArrow(run, SIGNED)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id as text ('' for null), a hash of the text, and its bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))


def shared_keys(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, node) for every table key that at least two classes have."""
    values = F.array(*[
        F.xxhash64(F.lit(b), F.slice("signature", b * rows + 1, rows)) for b in range(2 * bands)])
    value = classes.select("node", F.posexplode(values).alias("band", "value"))
    value = cut(value, "bands")
    often = value.groupBy("value").agg(F.count(F.lit(1)).alias("c")).where("c >= 2").select("value")
    side = value.join(often, "value").groupBy("node").agg(
        F.collect_list(F.when(F.col("band") < bands, F.col("value"))).alias("one"),
        F.collect_list(F.when(F.col("band") >= bands, F.col("value"))).alias("two"))
    pair = F.flatten(F.transform("one", lambda x: F.transform("two", lambda y: F.xxhash64(x, y))))
    keys = cut(side.select("node", F.explode(pair).alias("key")), "keys")
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"),
                                    F.min(F.struct(F.xxhash64("node"), "node")).alias("c"))
    return cut(keys.join(often.where("size >= 2").select("key", "size", F.col("c.node").alias("centre")), "key"),
               "buckets")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int, least_equal: int) -> DataFrame:
    """Pairs (a, b) of classes whose lengths and signatures allow a link."""
    side = lambda c: classes.select(*[F.col(x).alias(f"{c}_{x}") for x in ("node", "n", "signature")])
    both = pairs.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), F.col("b") == F.col("b_node"))
    equal = F.size(F.filter(F.zip_with("a_signature", "b_signature", lambda x, y: x == y), lambda x: x))
    return (both.where((F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
                       & (equal >= least_equal)).select("a", "b"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, words: int, star_limit: int) -> DataFrame:
    """Links (u, v) among the pairs, confirmed on the full shingle sets.

    The partners of ``b`` come to it in groups of about ``star_limit``, so a
    class with very many candidates is spread over tasks.
    """
    spread = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / star_limit).alias("parts"))
    one = (pairs.join(spread, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
           .join(texts.withColumnRenamed("node", "a"), "a").select("b", "part", "a", "text"))
    two = (spread.join(texts.withColumnRenamed("node", "b"), "b")
           .select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
                   F.lit(None).cast("long").alias("a"), "text"))

    def run(batches):
        current, mine = None, None
        for batch in batches:
            data, offsets = T.binary(batch.column("text"))
            links: list[tuple[int, int]] = []
            b, a = batch.column("b").to_pylist(), batch.column("a").to_pylist()
            for lo, hi in T.slices(offsets):
                sets = shingle_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], words)
                for k, own in enumerate(sets, lo):
                    if a[k] is None:
                        current, mine = b[k], own
                    else:
                        assert current == b[k]
                        shared = len(np.intersect1d(own, mine, assume_unique=True))
                        if 100 * shared >= percent * (len(own) + len(mine) - shared):
                            links.append((a[k], b[k]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["u", "v"])
        T.release()

    return (one.unionByName(two).repartition("b", "part")
            .sortWithinPartitions("b", "part", F.col("a").asc_nulls_first()).select("b", "a", "text")
            .mapInArrow(run, "u long, v long"))


def prefix_pairs(members: DataFrame, texts: DataFrame, percent: int, words: int, giant: int = GIANT) -> DataFrame:
    """Pairs (a, b) across components that share a rare shingle: exact, without minhashes.

    ``members`` has the node and root of the classes in mixed buckets.  A pair
    has at most one end in a giant component, or its ends in two of them, so
    the shingles that one giant component alone has are never paired.
    """

    def run(batches):
        for batch in batches:
            data, offsets = T.binary(batch.column("text"))
            nodes = batch.column("node").to_numpy()
            for lo, hi in T.slices(offsets):
                sets = shingle_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], words)
                size = np.array([len(x) for x in sets])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(nodes[lo:hi], size)), pa.array(np.repeat(size, size)),
                     pa.array(np.concatenate(sets).view(np.int64))], ["node", "n", "s"])

    sizes = members.groupBy("root").agg((F.count(F.lit(1)) >= giant).alias("giant"))
    members = members.join(sizes, "root")
    shingles = texts.join(members.select("node"), "node").mapInArrow(run, "node long, n long, s long")
    shingles = cut(shingles.join(members, "node"), "shingles")
    large = F.when(F.col("giant"), F.col("root"))
    often = shingles.groupBy("s").agg(
        F.count(F.lit(1)).alias("df"), (F.min("root") < F.max("root")).alias("mixed"),
        F.coalesce(F.min(large) < F.max(large), F.lit(False)).alias("giants")).where("df >= 2")
    # shingles of one class alone come first in its order and meet nothing, so
    # the others' places follow from their number
    mine = Window.partitionBy("node")
    place = F.col("n") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("df", "s"))
    shared = shingles.join(often, "s").withColumn("place", place)
    # shingles that a class has in common with any other, counted by hash group:
    # two classes share at most the smaller count of each group
    groups = (shared.groupBy("node", F.pmod("s", F.lit(GROUPS)).cast("int").alias("g")).agg(
        F.count(F.lit(1)).cast("int").alias("c")).groupBy("node").agg(
        F.map_from_entries(F.collect_list(F.struct("g", "c"))).alias("by_group")))
    groups = groups.select("node", F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.coalesce(
        F.try_element_at("by_group", g), F.lit(0))).alias("counts"))
    rare = cut(shared.where(
        F.col("mixed") & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).join(groups, "node"), "prefixes")
    one = ["node", "n", "root", "place", "counts"]
    other = rare.select("s", "giant", "giants", *[F.col(c).alias(f"o_{c}") for c in one])
    total = F.col("n") + F.col("o_n")
    overlap = F.ceil(total * percent / (100 + percent))
    # whichever is smaller needs a shorter prefix, since the other is no smaller
    short = lambda n: n - F.ceil(2 * n * percent / (100 + percent)) + 1
    fits = ((F.least("n", "o_n") * 100 >= F.greatest("n", "o_n") * percent)
            & F.when(F.col("n") <= F.col("o_n"), F.col("place") <= short(F.col("n")))
            .otherwise(F.col("o_place") <= short(F.col("o_n")))
            & (1 + F.least(F.col("n") - F.col("place"), F.col("o_n") - F.col("o_place")) >= overlap)
            & (F.col("root") != F.col("o_root"))
            & (F.aggregate(F.zip_with("counts", "o_counts", lambda x, y: F.least(x, y)), F.lit(0),
                           lambda total, x: total + x) >= overlap))
    found = None
    for left, right, once in (
            (rare.where("NOT giant"), other, F.col("giant") | (F.col("node") < F.col("o_node"))),
            (rare.where("giant AND giants"), other.where("giant AND giants"), F.col("node") < F.col("o_node"))):
        pairs = (left.select("s", *one).join(right, "s").where(fits & once)
                 .select(F.col("node").alias("a"), F.col("o_node").alias("b")))
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS,
                    rows: int = ROWS, giant: int = GIANT, star_limit: int = STAR_LIMIT,
                    least_equal: int = LEAST_EQUAL) -> DataFrame:
    """(id, h, n, component_id) for each document; ``docs`` is ``keyed``."""
    signed = cut(signatures(docs, words, bands, rows), "signatures")
    number = F.nullif(F.col("id"), F.lit("")).cast("long")
    classes = (signed.where("n > 0").groupBy("d1", "d2").agg(
        F.min("n").alias("n"), F.min(F.struct("id", "h")).alias("rep"), F.min(number).alias("least_id"),
        F.first("signature").alias("signature")).withColumn("node", F.monotonically_increasing_id()))
    classes = cut(classes, "classes")
    buckets = shared_keys(classes, bands, rows)
    wanted = (buckets.select("node").distinct().join(classes, "node")
              .select("node", F.col("rep.id").alias("id"), F.col("rep.h").alias("h")))
    texts = cut(wanted.join(docs, ["id", "h"]).select("node", "text").dropDuplicates(["node"]), "texts")

    stars = (buckets.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
             .distinct())
    links = cut(confirmed(cut(plausible(stars, classes, percent, least_equal), "pairs"),
                          texts, percent, words, star_limit), "links")
    roots = components(links)
    placed = (buckets.join(roots, "node", "left")
              .select("key", "node", F.coalesce("root", "node").alias("root")))
    mixed = (placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("lo < hi").select("key"))
    members = cut(placed.join(mixed, "key").select("node", "root").distinct(), "members")
    pairs = prefix_pairs(members, texts, percent, words, giant)
    more = cut(confirmed(cut(plausible(pairs, classes, percent, least_equal), "pairs"),
                         texts, percent, words, star_limit), "links")
    if not more.isEmpty():
        # the new links join components, so only those are merged
        of = lambda c: members.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        merged = components(more.join(of("u"), "u").join(of("v"), "v")
                            .select(F.col("u_root").alias("u"), F.col("v_root").alias("v")))
        merged = merged.select(F.col("node").alias("old"), F.col("root").alias("new"))
        known = roots.unionByName(merged.select(F.col("old").alias("node"), F.col("old").alias("root"))).distinct()
        roots = (known.join(merged, known["root"] == merged["old"], "left")
                 .groupBy("node").agg(F.min(F.coalesce("new", "root")).alias("root")))

    whole = (classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = whole.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = whole.join(named, "root").select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), "component_id", "root")
    linked = (signed.where("n > 0").join(named, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")))
              .select("id", "h", "n", "component_id", "root"))
    return linked.unionByName(signed.where("n = 0").select(
        "id", "h", "n", number.alias("component_id"), F.lit(None).cast("long").alias("root")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, with all its columns.

    The smallest id stays (null is largest; of equal ids, the text of the smallest
    hash; of equal rows, one).  Wordless documents all stay.
    """
    found = near_duplicates(keyed(docs)).select("id", "h", "n", "root").distinct()
    number = F.nullif(F.col("id"), F.lit("")).cast("long")
    first = F.min(F.struct(number.isNull().alias("missing"), number.alias("number"), "h", "id", "n")).alias("first")
    kept = (found.where("n > 0").groupBy("root").agg(first).select("first.id", "first.h", "first.n")
            .unionByName(found.where("n = 0").select("id", "h", "n"))
            .withColumnRenamed("id", "k_id").withColumnRenamed("h", "k_h"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("h"))
    same = Window.partitionBy("id", "h").orderBy(F.xxhash64("row"))
    return (packed.join(kept, (F.col("id") == F.col("k_id")) & (F.col("h") == F.col("k_h")))
            .withColumn("copy", F.row_number().over(same))
            .where("copy = 1 OR n = 0").select("row.*"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: five-word shingles, similarity of at least 0.75."""
    found = near_duplicates(keyed(table(spark, sf_dir, "documents")))
    number = F.nullif(F.col("id"), F.lit("")).cast("long")
    return found.select(number.alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
                        number.eqNullSafe(F.col("component_id")).alias("kept"))
