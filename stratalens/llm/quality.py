"""Quality scores learnt from preference pairs (Bradley-Terry).

Every good labelled text should beat every bad one: a linear score is fitted by
logistic loss on feature differences of such pairs.  A quantile of the training
scores becomes the cut, placed at 0.3 of the reported score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textnum

#: Labelled rows that a model is fitted on, at most; more are thinned by a hash of doc_id.
MAX_FIT_ROWS = 20_000
#: Preference pairs drawn for each text of the rarer class.
PAIRS_EACH = 20
CUT = 0.3

_CLASSES = ["upper", "lower", "digit", "space", "newline", "mark", "sign", "bar", "high"]
_class_of = np.full(256, 6, np.uint8)
_class_of[65:91], _class_of[97:123], _class_of[48:58] = 0, 1, 2
_class_of[[32, 9, 11, 12, 13]], _class_of[10] = 3, 4
_class_of[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]], _class_of[124] = 5, 7
_class_of[128:] = 8
NAMES = [*_CLASSES, "log_length", "log_words", "word_length", "distinct_words", "long_words", "commonest", "line_words", "distinct_pairs"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of shape statistics per text, in 0 to about 1; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    shares = np.bincount(owner * 9 + _class_of[data], minlength=9 * n).reshape(n, 9)
    start, end, row = textnum.words(data, offsets, textnum.SPACE)
    count = np.bincount(row, minlength=n)
    some = np.maximum(count, 1)
    length = np.bincount(row, weights=end - start, minlength=n) / some
    hashes = textnum.word_hashes(data, start, end)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, r[new], runs)
    pairs, owner2 = textnum.distinct_per_row(*textnum.shingle_hashes(hashes, row, 2, n))
    x = np.empty((n, len(NAMES)))
    x[:, :9] = shares / np.maximum(size, 1)[:, None]
    x[:, 9] = np.log1p(size) / 12
    x[:, 10] = np.log1p(count) / 10
    x[:, 11] = np.minimum(length, 40) / 20
    x[:, 12] = np.bincount(r[new], minlength=n) / some
    x[:, 13] = np.bincount(row, weights=(end - start) > 20, minlength=n) / some
    x[:, 14] = top / some
    x[:, 15] = np.minimum(count / (shares[:, 4] + 1), 200) / 200
    x[:, 16] = np.bincount(owner2, minlength=n) / some
    return x


def expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares and square roots: a linear score can then bend."""
    return np.hstack([x, x * x, np.sqrt(x)])


@dataclass(frozen=True)
class Model:
    """score = sigmoid(weights . (expand(x) - centre) / scale - cut + logit(CUT))."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (expand(x) - self.centre) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.raw(x) - self.cut + np.log(CUT / (1 - CUT)), -500, 500)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Model:
    """Fit on feature rows and 0/1 labels.  With one class only, or none, every score is the prior side of the cut."""
    wide = expand(x) if len(x) else np.zeros((1, 3 * len(NAMES)))
    centre, scale = wide.mean(0), wide.std(0) + 1e-6
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(wide.shape[1])
    if not len(good) or not len(bad):
        return Model(centre, scale, weights, -3.0 if len(good) or not len(bad) else 3.0)
    z = (wide - centre) / scale
    few, many = (bad, good) if len(bad) <= len(good) else (good, bad)
    rng = np.random.default_rng(11)
    first = np.repeat(few, PAIRS_EACH)
    second = many[rng.integers(0, len(many), len(first))]
    d = z[second] - z[first] if few is bad else z[first] - z[second]
    for _ in range(rounds):  # Newton steps on sum log(1 + exp(-d.w)) + ridge |w|^2 / 2
        p = 1 / (1 + np.exp(np.clip((d * weights).sum(axis=1), -500, 500)))
        gradient = ridge * weights - (d * p[:, None]).sum(axis=0)
        # einsum, as a threaded BLAS can stall beside a JVM
        curve = np.einsum("ni,nj->ij", d * (p * (1 - p))[:, None], d)
        step = np.linalg.solve(curve + ridge * np.eye(d.shape[1]), gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-3:
            break
    raw = (z * weights).sum(axis=1)
    # the cut is the quantile of training scores that parts the labels best
    quantiles = np.quantile(raw, np.linspace(0, 1, 401))
    below_bad = np.searchsorted(np.sort(raw[bad]), quantiles) / len(bad)
    below_good = np.searchsorted(np.sort(raw[good]), quantiles) / len(good)
    gain = below_bad * len(bad) - below_good * len(good)
    best = np.flatnonzero(gain == gain.max())
    return Model(centre, scale, weights, float(quantiles[best[len(best) // 2]]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def feature_rows(docs: DataFrame) -> DataFrame:
    """(label, _h, x) of labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in textnum.blocks(batches):
            x = features(data, offsets)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("label"), rows.column("_h"), flat], ["label", "_h", "x"])

    return docs.select("label", "_h", "text").mapInArrow(run, "label int, _h long, x array<double>")


def thin_below(rows: DataFrame, most: int) -> int:
    """A bound on the 60-bit hash ``_h`` under which there are ``most`` rows at most, the same whatever the partitioning.

    Rows are counted by the hash's first 12 bits; where even the first such slice
    holds too many, that slice is looked into by the next 12 bits.
    """
    for shift in range(48, -1, -12):
        tally = rows.filter(F.col("_h") < 1 << (shift + 12)).groupBy(F.shiftright("_h", shift).alias("k")).count().orderBy("k").collect()
        room, below = most, 0
        for r in tally:
            room -= r["count"]
            if room < 0:
                break
            below = r["k"] + 1
        if room >= 0:
            return 1 << (shift + 12)
        if below:
            return below << shift
    return 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Model:
    """Fit on labelled rows that are not held out, ``max_rows`` of them at most.

    Rows with a null id, label or no matching text are passed over; of several labels
    of one id the better counts, and each different text of a repeated id is a row of its
    own, while equal rows count once.  Ids are thinned before texts are joined, and what
    the join gives, as numbers, once more, so that a repeated id keeps to the bound too.
    Without labelled rows every score is on the good side of the cut.  Columns of other
    names aren't read.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("label"))
    known = known.select("doc_id", F.col("label").cast("int").alias("label"), F.shiftrightunsigned(F.xxhash64("doc_id"), 4).alias("_h"))
    known = known.filter(F.col("_h") < thin_below(known, max_rows)).drop("_h")
    # at most max_rows pairs of two numbers: small enough to send to every task
    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    joined = joined.withColumn("_h", F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), 4))
    made = common.materialise(feature_rows(joined), "labelled-features")
    bound = thin_below(made.select("_h").distinct(), max_rows)
    rows = made.filter(F.col("_h") < bound).dropDuplicates(["_h"]).toArrow().sort_by("_h")
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    return fit(x, np.array(rows.column("label").to_pylist(), int))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus ``score`` and ``predicted`` (columns of these names are replaced); null texts count as empty.

    Equal texts have equal scores, an empty table gives an empty result, and a very long
    text is a block of its own in its task.
    """
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        parts = [model.score(features(data, offsets)) for _, data, offsets in textnum.blocks(iter([batch]))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    out = docs.withColumn("score", score("text"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; labels of held-out rows are never read into the fit."""
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
