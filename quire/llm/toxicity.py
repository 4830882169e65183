"""Toxicity by maximum-scoring segments.

Tokens are a word and its first letters (PREFIXES tells how many), as inflected and compound words share their stem. A token's score is its
log-odds between toxic and clean documents with an informative Dirichlet prior: pseudo-counts in proportion to the
token's share in both, which shrink rare tokens to zero. Tokens are evidence if their z-score is so high that hardly any
of all tokens tested would reach it by chance (CHANCE); few labels test few tokens and so ask for less than many. Any
other word has a small negative score, the log-ratio of the shares of words without evidence. So scores have a
negative mean on clean text, as segment statistics require.

A linear-time scan finds all maximal segments of a text (the disjoint runs that no extension or cut improves). A
segment of score S in n words has the normalised score lambda * S - ln(K n); lambda and K are those of the extreme-value
distribution of the best segment of clean texts. Segments over LEAST_BITS are significant. A document's evidence is the
logarithm of the sum of its significant segments, and a logistic curve makes it a probability.

Tokens are counted on all rows that may be learnt from. What is fitted on top of the tokens (drift, lambda, K and the
curve) needs rows whose tokens weren't counted: each row is seen by a model of the FOLDS - 1 folds it isn't in.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import batch_rows, table, written

#: Labelled rows that the model is fitted on at most, about; drawn by a hash of doc_id.
SAMPLE = 30_000
FOLDS = 4
PREFIXES = (5, 4)
#: Pseudo-documents of the prior for each document counted.
PRIOR = 0.15
#: Toxic documents in which a token occurs at least to be tested.
LEAST_DOCS = 3
#: Tokens taken for evidence by chance, about.
CHANCE = 0.1
LEAST_BITS = 0.0
#: A word without evidence scores this or less, so that segments end between distant hits.
LEAST_DRIFT = -0.05
PREDICTED = 0.7
#: Words whose score a worker remembers.
REMEMBERED = 500_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(word: str) -> tuple[str, ...]:
    """The word, and its stems marked by a star."""
    return (word, *(word[:n] + "*" for n in PREFIXES if len(word) > n))


@dataclass
class Model:
    scores: dict[str, tuple[float, float]]  # z-score and log-odds
    drift: float = -0.05
    scale: float = 1.0
    log_k: float = 0.0
    slope: float = 1.0
    shift: float = -4.0

    def scorer(self) -> Scorer:
        return Scorer(self.scores)


class Scorer(dict):
    """Scores by word: the log-odds of the feature that is known best (by z-score), 0 for a word without evidence."""

    def __init__(self, known: dict[str, tuple[float, float]]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> float:
        s = max((self.known[f] for f in features(word) if f in self.known), default=(0.0, 0.0))[1]
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = s
        return s

    def hits(self, text: str | None) -> tuple[int, list[int], list[float]]:
        """Number of words, and places and scores of those that are evidence."""
        scores = list(map(self.__getitem__, words_of(text)))
        at = [i for i, s in enumerate(scores) if s > 0] if any(scores) else []
        return len(scores), at, [scores[i] for i in at]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in order, in linear time.

    A list of candidates is kept with the sums before and after each. A new positive item looks back for a candidate that
    starts lower: if that one also ended lower, both and all between are one segment.
    """
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    lower: list[int] = []  # for each, the nearest one before it that starts lower: looking back skips the others
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left = i, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = lower[j]
            if j < 0 or found[j][3] >= total:
                break
            start, left = found[j][0], found[j][2]
            del found[j:], lower[j:]
        found.append((start, i + 1, left, total))
        lower.append(j)
    return [(a, b, y - x) for a, b, x, y in found]


def passages(n: int, at: list[int], scores: list[float], model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """(best score, significant segments (first word, end, normalised score)) of a text of n words with these hits.

    The words between two hits are one item, so a text costs what its hits cost.
    """
    if not len(at):
        return 0.0, []
    items = [float(scores[0])]
    for k in range(1, len(at)):
        items += [model.drift * (at[k] - at[k - 1] - 1), float(scores[k])]
    found = segments(items)
    base = model.log_k + math.log(n)
    bits = [(int(at[a // 2]), int(at[(b - 1) // 2]) + 1, model.scale * s - base) for a, b, s in found]
    return max(s for _, _, s in found), [x for x in bits if x[2] >= LEAST_BITS]


def total(found: list[tuple[int, int, float]]) -> float:
    """Evidence of significant segments together, on a scale on which the curve is about straight."""
    return math.log1p(sum(x[2] for x in found))


def probability(value: float, model: Model) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * value + model.shift))))


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, toxic, fold) of the labelled rows that may be learnt from, about `sample` of them."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = written(known.filter(~_held_out(F.col("doc_id"))), "known")
    rate = min(1.0, sample / max(1, known.count()))
    drawn = known.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))).filter(F.col("draw") < int(rate * 1_000_000))
    drawn = drawn.select(F.col("doc_id").alias("_id"), (F.col("toxic") == 1).cast("int").alias("toxic"), F.pmod("draw", F.lit(FOLDS)).cast("int").alias("fold"))
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).drop("_id")


def _once(rows: DataFrame) -> DataFrame:
    """rows with one of each group of copies, as those are one observation; else all words of a much copied text would be
    evidence. Near copies mostly share the least hash of their shingles of three words."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+")
    rows = rows.withColumn("_w", words)
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - 3, F.lit(0))), lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(3))))
    return rows.withColumn("_least", F.array_min(grams)).dropDuplicates(["_least", "toxic"]).drop("_w", "_least")


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and z-scores of tokens that occur in so many toxic and clean documents."""
    size = PRIOR * (n_toxic + n_clean)
    prior = PRIOR * (toxic + clean)
    t, c = toxic + prior, clean + prior
    delta = np.log(t / np.maximum(n_toxic + size - t, 1e-9)) - np.log(c / np.maximum(n_clean + size - c, 1e-9))
    return delta, delta / np.sqrt(1 / t + 1 / c)


def least_z(tested: int) -> float:
    """The z-score that any of so many tokens reaches by chance once in 1 / CHANCE samples."""
    return NormalDist().inv_cdf(1 - CHANCE / (tested + 1))


def _tokens(rows: DataFrame) -> tuple[pd.DataFrame, int]:
    """Counts by token (c0, t0, c1, t1 and so on: clean and toxic documents of each fold) where toxic ones are at least twice
    as frequent, and how many tokens were tested. Bounded by the sample."""
    columns = [f"{k}{f}" for f in range(FOLDS) for k in "ct"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic, fold in zip(b["text"], b["toxic"], b["fold"], strict=True):
                for f in {f for w in set(words_of(text)) for f in features(w)}:
                    counts.setdefault(f, [0] * (2 * FOLDS))[2 * fold + toxic] += 1
            frame = pd.DataFrame(list(counts.values()), columns=columns, dtype="int64")
            frame.insert(0, "token", list(counts))
            yield frame

    counted = rows.select("text", "toxic", "fold").mapInPandas(count, ", ".join(["token string", *(f"{c} long" for c in columns)]))
    summed = counted.groupBy("token").agg(*(F.sum(c).alias(c) for c in columns))
    clean, toxic = (sum((F.col(f"{k}{f}") for f in range(1, FOLDS)), F.col(f"{k}0")) for k in "ct")
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    summed = summed.filter(toxic >= LEAST_DOCS)
    summed = written(summed.withColumn("likely", toxic * n.get(0, 0) > clean * n.get(1, 0) * 2), "tokens")
    return summed.filter("likely").drop("likely").toPandas().sort_values("token"), summed.count()


def _evidence(tokens: pd.DataFrame, tested: int, sizes: np.ndarray, without: int | None = None) -> dict[str, tuple[float, float]]:
    """Scores of the tokens that are evidence, by all folds but one; sizes are documents by fold and label."""
    folds = [f for f in range(FOLDS) if f != without]
    clean, toxic = (sum(tokens[f"{k}{f}"].to_numpy(float) for f in folds) for k in "ct")
    n_clean, n_toxic = (int(sum(sizes[f][k] for f in folds)) for k in (0, 1))
    if not len(tokens) or not n_toxic or not n_clean:
        return {}
    some = toxic > 0
    delta, z = log_odds(toxic[some], clean[some], n_toxic, n_clean)
    least = least_z(tested)
    return {t: (float(s), float(d)) for t, s, d in zip(tokens["token"][some], z, delta, strict=True) if s >= least}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from rows with crc32(doc_id as text) mod 3 other than 1. Without labels of both kinds it knows no token."""
    with batch_rows(docs.sparkSession):
        rows = written(_once(_sample(docs, labels, sample)), "sample")
        sizes = np.zeros((FOLDS, 2), dtype=int)
        for fold, toxic, n in rows.groupBy("fold", "toxic").count().collect():
            sizes[fold][toxic] = n
        if not sizes[:, 0].sum() or not sizes[:, 1].sum():
            return Model({})
        tokens, tested = _tokens(rows)
        return _calibrated(Model(_evidence(tokens, tested, sizes)), [_evidence(tokens, tested, sizes, f) for f in range(FOLDS)], rows)


def _calibrated(model: Model, folds: list[dict[str, tuple[float, float]]], rows: DataFrame) -> Model:
    """Drift, extreme-value scale and the curve, by the hits of each row under the model that hasn't counted it."""

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(x) for x in folds]
        for b in batches:
            out = [(toxic, *scorers[fold].hits(text)) for text, toxic, fold in zip(b["text"], b["toxic"], b["fold"], strict=True)]
            yield pd.DataFrame(out, columns=["toxic", "n", "places", "scores"])

    seen = written(rows.select("text", "toxic", "fold").mapInPandas(hits, "toxic int, n long, places array<int>, scores array<double>"), "hits")
    share = seen.groupBy("toxic").agg(F.sum("n"), F.sum(F.size("places"))).collect()
    rate = {r[0]: (r[2] + 0.5) / (r[1] + 1.0) for r in share}
    p, q = rate.get(0, 1e-4), rate.get(1, 1e-2)
    model.drift = min(LEAST_DRIFT, math.log(max(1e-9, 1 - q) / max(1e-9, 1 - p)))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"n": b["n"], "best": [passages(*x, model)[0] for x in zip(b["n"], b["places"], b["scores"], strict=True)]})

    top = seen.filter("toxic = 0 and n > 0").select("n", "places", "scores").mapInPandas(best, "n long, best double").toPandas()
    # the best segment M of n clean words: scale * M - ln n follows a Gumbel law around ln K; its tail is exponential in M
    # a few segments of mean 1 are taken for seen before, so that small samples give a scale too
    some = top["best"][top["best"] > 0]
    model.scale = float(min(3.0, max(0.3, (len(some) + 5) / (some.sum() + 5))))
    model.log_k = math.log((len(some) + 0.5) / (float(top["n"].sum()) + 1))

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "x": [total(passages(*x, model)[1]) for x in zip(b["n"], b["places"], b["scores"], strict=True)]})

    seen = seen.mapInPandas(values, "toxic int, x double").toPandas().sort_values(["x", "toxic"])
    model.slope, model.shift = logistic(seen["x"].to_numpy(float), seen["toxic"].to_numpy(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (0 at least) and shift by Newton steps with a small ridge."""
    a, b = 1.0, -2.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((p - y) * x).sum() + 0.01 * a, (p - y).sum() + 0.001 * b])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.001]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(0.0, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, first_word, last_word) of every row of docs.

    The passage columns tell how many significant passages there are, and where the best one starts and ends (null for
    none). Null texts are as empty ones: no evidence, the score of the curve at zero. Very long texts are scored as a whole.
    A null doc_id isn't held out. Of passages with equal scores the first is the best. Repeated rows get equal rows; an
    empty table gives none; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = model.scorer()
        for b in batches:
            out = []
            for text in b["text"]:
                found = passages(*scorer.hits(text), model)[1]
                top = max(found, key=lambda x: x[2], default=(None, None))
                score = probability(total(found), model)
                out.append((score, int(score >= PREDICTED), len(found), top[0], top[1] - 1 if found else None))
            frame = pd.DataFrame(out, columns=["score", "predicted", "n_passages", "first_word", "last_word"])
            for k in ("first_word", "last_word"):
                frame[k] = frame[k].astype("Int64")
            frame.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    kinds = "doc_id long, score double, predicted int, n_passages int, first_word long, last_word long"
    with batch_rows(docs.sparkSession):
        rows = written(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, kinds), "scores")
    return rows.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages", "first_word", "last_word")


def clean_only(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that are predicted toxic, written, all columns as they were.

    Null, empty and wordless texts have no evidence and stay; very long texts are judged as a whole. Rows with null or
    repeated doc_ids are judged by their own text, so repeated rows stay or go together. An empty table gives no rows;
    columns other than text are kept and not looked at, whatever their names.
    """

    @F.pandas_udf("boolean")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([probability(total(passages(*scorer.hits(t), model)[1]), model) >= PREDICTED for t in texts])

    with batch_rows(docs.sparkSession):
        return written(docs.filter(~toxic(F.col("text"))), "clean")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
