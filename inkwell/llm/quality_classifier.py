"""Operator 3: quality scores from random Fourier features of document statistics.

Statistics of each whole text are standardised; cosines of random projections (the features of a Gaussian
kernel) feed a ridge regression whose normal equations are summed over partitions; isotonic regression over
binned scores turns its output into a probability. Each labelled row is scored for that by a ridge that hasn't seen
it: the sums are kept by FOLDS (a hash of the statistics), and those of all folds but one fit that one's ridge.

Labels are read only from rows that are not held out. Everything that reaches the driver has a fixed size: the
upper triangle of one (features x features) matrix and N_BINS bins.

Defined results: null text counts as empty; an empty text gets the score of its (zero) statistics; repeated rows
get one row each, alike; null labels are left out; labels that contradict each other for a doc_id count as 1 if
any is 1; without a label of either class all scores are 0.5 or the one class's share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

N_FEATURES = 192
GAMMA = 0.08
RIDGE = 1.0
N_BINS = 1024
FOLDS = 5
SEED = 20240607
STATS = (
    "log_chars", "log_words", "mean_word", "upper", "digits", "symbols", "marks", "distinct", "run_share",
    "repeat3", "ratio", "log_line", "dup_lines", "pipes", "short_words", "loud",
)
_SYMBOLS = str.maketrans("", "", "#*$%&|<>@^~=+_{}[]\\")
_MARKS = str.maketrans("", "", ".,;:!?\"'()-")
_DIGITS = str.maketrans("", "", "0123456789")


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, w = len(text), len(words)
    if not w:
        return [0.0] * len(STATS)
    lines = [x for x in text.split("\n") if x]
    data = text.encode("utf-8", "surrogatepass")
    threes = list(zip(words, words[1:], words[2:]))
    lower = sum(map(str.islower, words))
    upper = sum(map(str.isupper, words))
    return [
        float(np.log1p(n)),
        float(np.log1p(w)),
        (n - w) / w,
        upper / w,
        (n - len(text.translate(_DIGITS))) / n,
        (n - len(text.translate(_SYMBOLS))) / n,
        (n - len(text.translate(_MARKS))) / n,
        len(set(words)) / w**0.9,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        1 - len(set(threes)) / len(threes) if threes else 0.0,
        len(zlib.compress(data, 1)) / len(data),
        float(np.log1p(n / max(1, len(lines)))),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        text.count("|") / w,
        lower / w,
        text.count("!") / w,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = [statistics(t) for t in batch.column(1).to_pylist()]
        flat = pa.array(np.asarray(stats, float).reshape(len(stats), len(STATS)).ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.FixedSizeListArray.from_arrays(flat, len(STATS)).cast(pa.list_(pa.float64()))], ["doc_id", "x"])


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(True))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(STATS))


def projections(mean: np.ndarray, std: np.ndarray, n: int = N_FEATURES):
    rng = np.random.default_rng(SEED)
    w = rng.normal(0, np.sqrt(2 * GAMMA), (len(STATS), n))
    b = rng.uniform(0, 2 * np.pi, n)

    def features(x: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / std, -8, 8)
        return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / n) * np.cos(z @ w + b)])

    return features


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.empty(0)


def fit(train: DataFrame, n_features: int = N_FEATURES, ridge: float = RIDGE):
    """A function from statistics to scores, fitted on train (x array<double>, y int); None without labels."""
    sums = train.select(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *(f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(STATS)) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not sums["n"] or sums["y"] in (0.0, 1.0):
        share = 0.5 if not sums["n"] else float(sums["y"])
        return lambda x: np.full(len(x), share)
    mean = np.array([sums[f"m{i}"] for i in range(len(STATS))])
    std = np.array([max(sums[f"s{i}"], 1e-6) for i in range(len(STATS))])
    features = projections(mean, std, n_features)
    d = n_features + 2  # the ones, the features, and the label
    up = np.triu_indices(d)

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, d, d))
        for batch in batches:
            if batch.num_rows:
                a = np.hstack([features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)[:, None].astype(float)])
                fold = batch.column(2).to_numpy(zero_copy_only=False)
                for k in range(FOLDS):
                    total[k] += a[fold == k].T @ a[fold == k]
        sums = total[:, up[0], up[1]].ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["i", "v"])

    dealt = train.select("x", "y", F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = dealt.mapInArrow(normal_equations, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros(FOLDS * len(up[0]))
    sums[rows["i"].to_numpy()] = rows["v"].to_numpy()
    grams = np.zeros((FOLDS, d, d))
    grams[:, up[0], up[1]] = sums.reshape(FOLDS, -1)
    grams += np.triu(grams, 1).transpose(0, 2, 1)
    penalty = np.full(d - 1, ridge)
    penalty[0] = 1e-9

    def solved(gram: np.ndarray) -> np.ndarray:
        return np.linalg.solve(gram[:-1, :-1] + np.diag(penalty), gram[:-1, -1])

    whole = grams.sum(0)
    beta = solved(whole)
    # of a fold that has all rows nothing is left to fit: it takes the whole's
    unseen = np.array([solved(whole - g) if (whole - g)[0, 0] > 0 else beta for g in grams])

    def raw(x: np.ndarray) -> np.ndarray:
        return np.clip(features(x) @ beta, -0.5, 1.5)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, y = np.zeros(N_BINS), np.zeros(N_BINS)
        for batch in batches:
            if batch.num_rows:
                own = unseen[batch.column(2).to_numpy(zero_copy_only=False)]
                score = np.clip((features(_matrix(batch.column(0))) * own).sum(1), -0.5, 1.5)
                at = np.minimum(((score + 0.5) / 2 * N_BINS).astype(int), N_BINS - 1)
                np.add.at(n, at, 1)
                np.add.at(y, at, batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_BINS, dtype=np.int32)), pa.array(n), pa.array(y)], ["bin", "n", "y"])

    bins = dealt.mapInArrow(binned, "bin int, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).filter("n > 0").orderBy("bin").toPandas()
    at = (bins["bin"].to_numpy() + 0.5) / N_BINS * 2 - 0.5
    level = isotonic((bins["y"] / bins["n"]).to_numpy(), bins["n"].to_numpy())
    return lambda x: np.clip(np.interp(raw(x), at, level), 0, 1)


def label_of(labels: DataFrame, column: str, out: Column) -> DataFrame:
    """_of (doc_id) and y of the labels that are known and not held out."""
    return labels.filter(F.col(column).isNotNull() & ~out).groupBy("doc_id").agg(F.max(column).cast("int").alias("y")).withColumnRenamed("doc_id", "_of")


def labelled(docs: DataFrame, labels: DataFrame, column: str, out: Column) -> DataFrame:
    """docs (with doc_id) joined with the labels y of rows that are not held out."""
    return docs.join(label_of(labels, column, out), F.col("doc_id") == F.col("_of")).drop("_of")


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    out = held_out(F.col("doc_id"), folds, fold)
    measured = stash(docs.select("doc_id", "text").mapInArrow(_measure, "doc_id long, x array<double>"), "quality")
    train = labelled(measured, labels.select("doc_id", "quality"), "quality", out).select("x", "y")
    model = fit(train)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model(_matrix(batch.column(1))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    found = measured.mapInArrow(scored, "doc_id long, score double")
    return found.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
