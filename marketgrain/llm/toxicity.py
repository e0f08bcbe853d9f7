"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(score - threshold_k): one weight vector is shared by all thresholds, which are kept in order, and
fitted by the likelihood of the grades, the differences of neighbouring probabilities. Features of a text are its words (A-Z
in lower case, punctuation split off) and the beginnings of its words of four, five and six bytes, which inflected and
compounded words share; a feature counts with log2(1 + number of the text's distinct words that have it).

Training takes a bounded, hash-ordered sample of labelled documents of each class. Features are chosen by the likelihood
ratio of their presence in the classes. The penalty is that with the least loss in cross-validation inside the sample, where
each fold's model also chooses its features without the fold. Labels
are 0 and 1 only: toxic texts are graded 1 to 3 by thirds of their cross-fitted scores, each score being that of a model
which hasn't seen the text, so a grade says how plainly a text is toxic, and expected severity is the sum of P(grade > k).

Scoring reads whole texts: absent features count nothing, and a long clean text has few of weight however long it is.

Nulls and edges: a null or empty text has no features; without labels of both classes nothing is toxic (severity 0);
repeated rows are scored alike; of several labels of one doc_id the greatest counts, of several texts the least; labels
without a document or a class are left out; ties between features go to the least hash; further columns are ignored unless
named in ``carry``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrain.llm.shared import cleared, with_carry, written
from marketgrain.llm.textarrays import NOT_ALNUM, bounded, head_hash, text_buffers, text_of, word_hashes, word_heads

#: Labelled documents of each class that training takes at most.
SAMPLE_ROWS = 4_000
#: Features with weights.
FEATURES = 1_024
#: A feature must be in so many sampled texts, and tell the classes apart by so much of log-likelihood (chance gives it to one in 600).
LEAST_TEXTS = 3
LEAST_RATIO = 5.0
#: Bytes of the word beginnings that are features.
HEADS = (4, 5, 6)
GRADES = 3
#: A text is toxic if P(grade > 0) is this much at least.
TOXIC_PROBABILITY = 0.5
#: L2 penalties to choose from, folds of the cross-validation, and steps of a fit.
PENALTIES = (0.1, 1.0, 10.0, 100.0)
FOLDS = 5
STEPS = 200


@dataclass(frozen=True)
class OrdinalModel:
    """Sorted feature hashes, their weights, and the ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and each k."""
        return _sigmoid(scores[:, None] - self.thresholds)


@dataclass(frozen=True)
class Design:
    """A sparse matrix of features: for each entry its row, column and value."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    n_rows: int
    n_columns: int

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.columns] * self.values, self.n_rows)

    def only(self, rows: np.ndarray, columns: np.ndarray) -> Design:
        """The rows and columns that are marked; the others are empty."""
        some = rows[self.rows] & columns[self.columns]
        return Design(self.rows[some], self.columns[some], self.values[some], self.n_rows, self.n_columns)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values if len(table) else np.zeros(len(values), bool)


def _unique(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each distinct (text, value), in their order, and how often it occurs."""
    order = np.lexsort((value, text))
    new = np.ones(len(order), bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (text[order][1:] != text[order][:-1])
    return order[new], np.diff(np.append(np.flatnonzero(new), len(order)))


def _features(column: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature hash and value of every feature of each text; only those in the sorted ``known``, if it is given."""
    data, offsets = text_buffers(column)
    words, ends = word_hashes(data, offsets, NOT_ALNUM, lower=True)
    heads, sizes = word_heads(data, offsets, NOT_ALNUM, lower=True)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    if known is not None:
        some = _is_in(words, known)
        for n in HEADS:
            some |= (sizes > n) & _is_in(head_hash(heads, n), known)
        text, words, heads, sizes = text[some], words[some], heads[some], sizes[some]
    first, _ = _unique(text, words)
    text, words, heads, sizes = text[first], words[first], heads[first], sizes[first]
    texts, hashes = [text], [words]
    for n in HEADS:
        longer = sizes > n
        texts.append(text[longer])
        hashes.append(head_hash(heads[longer], n))
    text, hashes = np.concatenate(texts), np.concatenate(hashes)
    if known is not None:
        some = _is_in(hashes, known)
        text, hashes = text[some], hashes[some]
    first, counts = _unique(text, hashes)
    return text[first], hashes[first], np.log2(1 + counts)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "toxic") -> DataFrame:
    """At most ``rows`` labelled documents of each class, in the order of a hash of their doc_id: doc_id, y, text, fold."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    chosen = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(rows) for y in (0, 1)]
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    return joined.groupBy("doc_id", "y").agg(F.min("text").alias("text")).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))


def _ratio(a, b, n_a, n_b):
    """Log-likelihood ratio of a feature in ``a`` of n_a and ``b`` of n_b texts, as a column."""
    share, total = (a + b) / F.lit(n_a + n_b), F.lit(0.0)
    for seen, n in ((a, n_a), (b, n_b)):
        for count, expected in ((seen, n * share), (n - seen, n * (1 - share))):
            total = total + F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)
    return total


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, label: str = "toxic", penalties: tuple[float, ...] = PENALTIES) -> OrdinalModel:
    """Fit on the bounded sample. Its features are counted and chosen by Spark; the chosen ones of each sampled text come to
    the driver, of 2 * ``rows`` texts at most. Cross-validation fits are tasks of their own."""
    with cleared(docs.sparkSession):
        return _fitted(docs, labels, rows, label, penalties)


def _fitted(docs: DataFrame, labels: DataFrame, rows: int, label: str, penalties: tuple[float, ...]) -> OrdinalModel:

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, lambda b: b.column(2)):
            text, hashes, _ = _features(batch.column(2))
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes.view(np.int64))], ["y", "fold", "feature"])

    sample = labelled_sample(docs, labels, rows, label)
    truth = pd.DataFrame([(r["doc_id"], r["y"], r["fold"]) for r in sample.select("doc_id", "y", "fold").collect()], columns=["doc_id", "y", "fold"]).sort_values("doc_id")
    ids, y, fold = (truth[c].to_numpy(np.int64) for c in truth)
    if len(set(y.tolist())) < 2:  # nothing to tell apart
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.arange(GRADES) + 1.0)
    counted = [F.sum("y").alias("toxic"), F.count("*").alias("n")]
    for k in range(FOLDS):
        counted += [F.sum(F.when(F.col("fold") == k, F.col("y")).otherwise(0)).alias(f"toxic{k}"), F.count_if(F.col("fold") == k).alias(f"n{k}")]
    found = sample.select("y", "fold", "text").mapInArrow(read, "y int, fold int, feature long")
    counts = written(found.groupBy("feature").agg(*counted).where(F.col("n") >= LEAST_TEXTS), "features")

    def best(toxic, n, rows: np.ndarray) -> np.ndarray:
        """The features that tell most about the class of ``rows``."""
        ratio = _ratio(toxic, n - toxic, int(y[rows].sum()), int((1 - y[rows]).sum()))
        top = counts.where((n >= LEAST_TEXTS) & (ratio >= LEAST_RATIO)).orderBy(ratio.desc(), "feature").limit(FEATURES).select("feature").collect()
        return np.sort(np.array([r["feature"] for r in top], np.int64).view(np.uint64))

    features = best(F.col("toxic"), F.col("n"), np.ones(len(y), bool))
    by_fold = [best(F.col("toxic") - F.col(f"toxic{k}"), F.col("n") - F.col(f"n{k}"), fold != k) for k in range(FOLDS)]
    every = np.unique(np.concatenate([features, *by_fold]))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, lambda b: b.column(1)):
            text, hashes, values = _features(batch.column(1), every)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(np.searchsorted(every, hashes).astype(np.int32)), pa.array(values)], ["doc_id", "column", "value"])

    entries = sample.select("doc_id", "text").mapInArrow(chosen, "doc_id long, column int, value double").toArrow()
    design = Design(np.searchsorted(ids, entries.column("doc_id").to_numpy()), entries.column("column").to_numpy().astype(np.int64), entries.column("value").to_numpy(), len(ids), len(every))
    penalty, scores = cross_validate(docs.sparkSession, design, y, fold, [_is_in(every, f) for f in by_fold], penalties)
    cuts = np.quantile(scores[y == 1], [k / GRADES for k in range(1, GRADES)])
    grade = np.where(y == 1, 1 + np.searchsorted(cuts, scores, "right"), 0)
    own = _is_in(every, features)
    weights, thresholds = train(design.only(np.ones(len(y), bool), own), grade, np.ones(len(y), bool), GRADES, penalty)
    return OrdinalModel(features, weights[own], thresholds)


def cross_validate(spark: SparkSession, design: Design, y: np.ndarray, fold: np.ndarray, columns: list[np.ndarray], penalties: tuple[float, ...]) -> tuple[float, np.ndarray]:
    """The penalty with the least loss on left-out folds, and each row's score by the model that left it out. ``columns``: those
    that each fold's model may use."""
    sent = spark.sparkContext.broadcast((design, y, fold, columns))

    def evaluate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        design, y, fold, columns = sent.value
        for frame in frames:
            for penalty, k in zip(frame["penalty"].tolist(), frame["fold"].tolist()):
                if not (y[fold != k] == 1).any() or not (y[fold != k] == 0).any():
                    continue
                weights, thresholds = train(design.only(fold != k, columns[k]), y, fold != k, 1, penalty)
                out = np.flatnonzero(fold == k)
                scores = (design.scores(weights) - thresholds[0])[out]
                loss = float(np.logaddexp(0, np.where(y[out] == 1, -scores, scores)).sum())
                yield pd.DataFrame({"penalty": [penalty], "loss": [loss], "rows": [out.tolist()], "scores": [scores.tolist()]})

    grid = spark.createDataFrame([(p, k) for p in penalties for k in range(FOLDS)], "penalty double, fold long").repartition(len(penalties) * FOLDS)
    done = grid.mapInPandas(evaluate, "penalty double, loss double, rows array<long>, scores array<double>").collect()
    losses = {p: sum(r["loss"] for r in done if r["penalty"] == p) for p in penalties}
    best = min(penalties, key=lambda p: (losses[p], -p))
    scores = np.zeros(len(y))
    for r in done:
        if r["penalty"] == best:
            scores[r["rows"]] = r["scores"]
    return best, scores


def loss_and_gradient(weights: np.ndarray, first: float, gaps: np.ndarray, design: Design, grade: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[float, np.ndarray, float, np.ndarray]:
    """The weighted negative log-likelihood with its penalty, and its gradient. Thresholds are ``first``, then sums of exp(gaps)."""
    steps = np.exp(gaps)
    thresholds = first + np.concatenate([[0], np.cumsum(steps)])
    above = _sigmoid(design.scores(weights)[:, None] - thresholds)
    ends = np.concatenate([np.ones((len(grade), 1)), above, np.zeros((len(grade), 1))], axis=1)
    slope = ends * (1 - ends)
    at, n = np.arange(len(grade)), max(1, int((weight > 0).sum()))
    p = np.maximum(ends[at, grade] - ends[at, grade + 1], 1e-12)
    loss = -(weight * np.log(p)).sum() + 0.5 * penalty * (weights**2).sum() / n
    low, high = -weight * slope[at, grade] / p, -weight * slope[at, grade + 1] / p
    by_score = low - high
    by_threshold = np.array([(high * (grade == k)).sum() - (low * (grade == k + 1)).sum() for k in range(len(thresholds))])
    by_weight = np.bincount(design.columns, by_score[design.rows] * design.values, len(weights)) + penalty * weights / n
    return loss, by_weight, by_threshold.sum(), by_threshold[1:][::-1].cumsum()[::-1] * steps


def train(design: Design, grade: np.ndarray, rows: np.ndarray, grades: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds fitted on ``rows``, the only ones in ``design``, by full gradient steps of adaptive size."""
    weight = rows / max(1, rows.sum())
    at = [np.zeros(design.n_columns), 0.0, np.zeros(grades - 1)]
    sums = [np.zeros(design.n_columns), 0.0, np.zeros(grades - 1)]
    for _ in range(STEPS):
        _, *gradient = loss_and_gradient(*at, design, grade, weight, penalty)
        for k in range(3):
            sums[k] = sums[k] + gradient[k] ** 2
            at[k] = at[k] - 0.3 * gradient[k] / (np.sqrt(sums[k]) + 1e-12)
    return at[0], at[1] + np.concatenate([[0], np.cumsum(np.exp(at[2]))])


def score(docs: DataFrame, model: OrdinalModel, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row's doc_id, expected_severity (0..GRADES), grade (its most likely grade), toxic, and the columns of ``carry``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, texts = sent.value, lambda b: text_of(b, text_column, carry)
        for batch in bounded(batches, texts):
            text, hashes, values = _features(texts(batch), model.features)
            scores = np.bincount(text, model.weights[np.searchsorted(model.features, hashes)] * values, batch.num_rows) if len(model.features) else np.zeros(batch.num_rows)
            above = model.probabilities(scores) if len(model.features) else np.zeros((batch.num_rows, GRADES))
            each = np.concatenate([np.ones((batch.num_rows, 1)), above], axis=1) - np.concatenate([above, np.zeros((batch.num_rows, 1))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1), pa.int32()), pa.array(above[:, 0] >= TOXIC_PROBABILITY), batch.column(2)],
                ["doc_id", "expected_severity", "grade", "toxic", "carry"],
            )

    rows = with_carry(docs, id_column, text_column, carry)
    scored = rows.mapInArrow(apply, f"doc_id long, expected_severity double, grade int, toxic boolean, carry {rows.schema['carry'].dataType.simpleString()}")
    return scored.select("doc_id", "expected_severity", "grade", "toxic", *[F.col("carry")[c].alias(c) for c in carry])
