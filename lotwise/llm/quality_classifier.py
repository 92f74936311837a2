"""Quality classifier: naive Bayes log-count ratios and a linear support vector machine.

A text is the set of its n-grams: words, word pairs, and runs of word shapes
(letter case, symbols, last character, length, same as the word before), hashed
to 2**BITS features.  The indicators are scaled by the classes' log-count ratios
and a hinge-loss model is fitted by dual coordinate descent; a logistic curve
on rows kept out of the fit turns margins into probabilities.

The model is fitted in one task on a bounded sample, the ``sample`` labelled
rows first in hash order; labels alone choose it, so the join that fetches their
texts broadcasts at most ``sample`` ids.  The model has 2**BITS weights at any
corpus size.  Scoring is a map over all texts.

Labels, language, source and id are no inputs of a score.  Rows whose
crc32(id) modulo 5 is 0 are never learnt from.

Defined results: a null text is empty and is scored by the bias alone; a null id
counts as the text ''; null labels are not learnt from; repeated labels and
rows count each time; without labels of both classes every score is the share of
class 1, or 0.5 without any; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import text as T
from lotwise.llm.tables import table

BITS = 18
SAMPLE = 10_000
FOLDS = 5
THRESHOLD = 0.3
SMOOTH = 1.0
COST = 1.0
EPOCHS = 12
#: Every so many rows of the sample are kept out of the fit, for the curve.
CURVE_EVERY = 5

BIAS = 0  # the feature that every text has


def held_out(id_col: str = "doc_id") -> Column:
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.crc32(key), F.lit(FOLDS)) == 0


# --- features ----------------------------------------------------------------

def _counts(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(mask)))
    return sums[end] - sums[start]


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_UPPER = _table(bytes(range(65, 91)))
_LOWER = _table(bytes(range(97, 123)) + bytes(range(128, 256)))
_DIGIT = _table(bytes(range(48, 58)))
_POINT = _table(b".,;:")


def word_shapes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, same: np.ndarray) -> np.ndarray:
    """A small number per word: case, digits, symbols, last character, length, repeated."""
    upper = np.minimum(_counts(_UPPER[buf], start, end), 2)
    lower = _counts(_LOWER[buf], start, end) > 0
    digit = _counts(_DIGIT[buf], start, end) > 0
    symbol = np.minimum(_counts(~(_UPPER | _LOWER | _DIGIT | _POINT)[buf], start, end), 3)
    last = buf[end - 1]
    tail = np.where(_POINT[last], 1, np.where((_LOWER | _UPPER)[last], 0, 2))
    length = np.minimum((end - start) // 4, 5)
    return ((((((upper * 2 + lower) * 2 + digit) * 4 + symbol) * 3 + tail) * 6 + length) * 2 + same).astype(np.uint64)


def feature_sets(buf: np.ndarray, off: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """The distinct features of each text of a batch; the bias is always one."""
    start, end, first = T.words(buf, off)
    n = len(start)
    h = T.word_hashes(T.lower(buf), start, end)
    same = np.zeros(n, bool)
    same[1:] = h[1:] == h[:-1]
    begins = first[:-1][first[:-1] < first[1:]]
    same[begins] = False
    shape = T.mix(word_shapes(buf, start, end, same) + np.uint64(1)) if n else h
    odd = [np.uint64(x | 1) for x in (T.BASE, T.BASE * 3 % (1 << 64), T.BASE * 5 % (1 << 64))]
    kinds: list[tuple[int, np.ndarray]] = [(1, h * odd[0] + np.uint64(11)), (1, shape * odd[0] + np.uint64(13))]
    for source, tag in ((h, 17), (shape, 19)):
        kinds.append((2, source[:-1] * odd[0] + source[1:] * odd[1] + np.uint64(tag)))
    kinds.append((3, shape[:-2] * odd[0] + shape[1:-1] * odd[1] + shape[2:] * odd[2] + np.uint64(23)))
    hashed = [(k, (T.mix(v) >> np.uint64(64 - bits)).astype(np.int32)) for k, v in kinds]
    out = []
    bias = np.array([BIAS], np.int32)
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(np.unique(np.concatenate([bias] + [v[lo:max(lo, hi - k + 1)] for k, v in hashed])))
    return out


def _batches(batch: pa.RecordBatch):
    data, offsets = T.binary(batch.column("text"))
    for lo, hi in T.slices(offsets):
        yield feature_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])


# --- model -------------------------------------------------------------------

def log_ratios(sets: list[np.ndarray], labels: np.ndarray, size: int, smooth: float) -> np.ndarray:
    """Log of each feature's smoothed share of class 1 over that of class 0."""
    shares = []
    for label in (1, 0):
        own = [s for s, y in zip(sets, labels) if y == label]
        count = np.bincount(np.concatenate(own), minlength=size) + smooth
        shares.append(count / count.sum())
    ratio = np.log(shares[0] / shares[1])
    ratio[BIAS] = 1.0
    return ratio


def dual_descent(sets: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, size: int, cost: float,
                 epochs: int) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model, one dual variable at a time."""
    w, alpha = np.zeros(size), np.zeros(len(sets))
    rng = np.random.default_rng(7)
    square = np.array([float(v @ v) for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(sets)):
            gradient = signs[i] * float(w[sets[i]] @ values[i]) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                w[sets[i]] += step * signs[i] * values[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that fit the labels best (Newton steps, smoothed targets)."""
    positive = labels.sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        theta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


class Model:
    """Weights times ratios, squared ratios, and the curve."""

    def __init__(self, weight: np.ndarray, square: np.ndarray, slope: float, offset: float):
        self.weight, self.square = weight.astype(np.float32), square.astype(np.float32)
        self.slope, self.offset = slope, offset

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        return np.array([float(self.weight[s].sum(dtype=np.float64) / np.sqrt(self.square[s].sum(dtype=np.float64)))
                         for s in sets])

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(sets) + self.offset, -30, 30)))


def fit(sets: list[np.ndarray], labels: np.ndarray, bits: int = BITS, smooth: float = SMOOTH, cost: float = COST,
        epochs: int = EPOCHS) -> Model:
    """Fit on rows in a fixed order; every ``CURVE_EVERY``-th serves the curve."""
    size = 1 << bits
    apart = np.arange(len(sets)) % CURVE_EVERY == 0
    own = [s for s, x in zip(sets, apart) if not x]
    y = labels[~apart]
    if len(set(y.tolist())) < 2 or len(set(labels[apart].tolist())) < 2:
        share = min(max(labels.mean() if len(labels) else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size), np.ones(size), 0.0, float(np.log(share / (1 - share))))
    ratio = log_ratios(own, y, size, smooth)
    values = [ratio[s] / np.linalg.norm(ratio[s]) for s in own]
    weight = dual_descent(own, values, np.where(y == 1, 1.0, -1.0), size, cost, epochs)
    model = Model(weight * ratio, ratio * ratio, 1.0, 0.0)
    model.slope, model.offset = logistic_curve(
        model.margins([s for s, x in zip(sets, apart) if x]), labels[apart])
    return model


# --- Spark -------------------------------------------------------------------

def _plain(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the bounded sample; the model comes to the driver."""
    order = F.xxhash64("doc_id")
    chosen = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
              .select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("label"), order.alias("order"))
              .orderBy("order", "l_id", "label").limit(sample))
    rows = (_plain(docs, "doc_id").join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
            .select("order", "doc_id", "label", "text"))

    def features(batches):
        for batch in batches:
            sets = [s for part in _batches(batch) for s in part]
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("doc_id"), batch.column("label"),
                 pa.array(sets, pa.list_(pa.int32()))], ["order", "doc_id", "label", "features"])
        T.release()

    def solve(rows):
        rows = rows.sort_by([("order", "ascending"), ("doc_id", "ascending"), ("label", "ascending")])
        sets = [np.asarray(x.values) for x in rows.column("features")]
        model = fit(sets, rows.column("label").to_numpy())
        return pa.table({"weight": pa.array([model.weight.tobytes()]), "square": pa.array([model.square.tobytes()]),
                         "slope": [model.slope], "offset": [model.offset]})

    found = (rows.mapInArrow(features, "order long, doc_id long, label int, features array<int>")
             .groupBy().applyInArrow(solve, "weight binary, square binary, slope double, offset double").collect())
    if not found:
        return fit([], np.zeros(0))
    got = found[0]
    return Model(np.frombuffer(got.weight, np.float32), np.frombuffer(got.square, np.float32), got.slope, got.offset)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [shared.value.scores(sets) for sets in _batches(batch)]
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values), pa.array((values >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])
        T.release()

    return (_plain(docs, F.col("doc_id").cast("long").alias("doc_id"))
            .mapInArrow(run, "doc_id long, score double, predicted int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model accepts, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            text = pc.fill_null(batch.column(place), "").cast(pa.binary())
            one = pa.RecordBatch.from_arrays([text], ["text"])
            scores = [shared.value.scores(sets) for sets in _batches(one)]
            keep = np.concatenate(scores) >= threshold if scores else np.zeros(0, bool)
            yield batch.filter(pa.array(keep))
        T.release()

    return docs.mapInArrow(run, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored by a model of ``labels.quality``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
