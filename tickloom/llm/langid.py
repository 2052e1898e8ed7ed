"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import table
from tickloom.llm.registry import query
from tickloom.llm.wordtable import by_size

ORDERS, BUCKET_BITS, DIM = (1, 2, 3, 4), 15, 16
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x30000)])


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all subwords of the texts, one text after the other, and how many each text has.

    Subwords are runs of 1 to 4 letters of the lower-cased text; from 2 on, a border of the word counts
    as a character at either end.
    """
    points = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    sizes = np.array([len(p) + 5 for p in points])
    line = np.zeros(int(sizes.sum()) + 1, np.uint32)
    starts = np.cumsum(sizes) - sizes
    for s, p in zip(starts, points):
        line[s + 1:s + 1 + len(p)] = p
    line[~_letters()[np.minimum(line, 0x2FFFF)]] = 0
    owner = np.repeat(np.arange(len(texts)), sizes)
    mixed = line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    buckets, owners = [], []
    n = len(owner)
    full = line[:n] != 0
    for order in ORDERS:
        m = n - order + 1
        ok = full[:m].copy() if order == 1 else full[:m] | full[1:1 + m] if order == 2 else np.ones(m, bool)
        for k in range(1, order - 1):
            ok &= full[k:k + m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), order, np.uint64)
        for k in range(order):
            h = (h ^ mixed[at + k]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        buckets.append((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        owners.append(owner[at])
    bucket, who = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return bucket[order], np.bincount(who, minlength=len(texts))


@dataclass
class LanguageModel:
    """``weights``: logit share of each bucket (embedding times softmax matrix); ``threshold``: least score that is not rejected.

    ``rarity``: minus the log of each bucket's share in the fitted texts. Its mean over a text, in deviations
    from what is usual for the named label (``usual``; ``between`` texts and ``within`` them), is the
    strangeness of the text, which does not depend on the number of labels; above ``strangest`` it is rejected.
    """

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    rarity: np.ndarray = field(default_factory=lambda: np.zeros(1 << BUCKET_BITS, np.float32))
    usual: np.ndarray = field(default_factory=lambda: np.zeros(0))
    between: float = 0.0
    within: float = 1.0
    strangest: float = np.inf
    facts: dict = field(default_factory=dict)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, mean rarity and number of subwords of each text."""
        bucket, n = subwords(texts)
        out, rare = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        some = n > 0
        if some.any():
            starts = (np.cumsum(n) - n)[some]
            out[some] = np.add.reduceat(self.weights[bucket], starts, axis=0, dtype=np.float64) / n[some, None]
            rare[some] = np.add.reduceat(self.rarity[bucket], starts, dtype=np.float64) / n[some]
        return out + self.bias, rare, n

    def strangeness(self, rare: np.ndarray, n: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Overlapping subwords count as one of each length (``ORDERS``) for every letter."""
        return (rare - self.usual[label]) / np.sqrt(self.between + self.within * len(ORDERS) / np.maximum(n, 1))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, calibrated probability and rejection of each text; ``und``, 0 and rejected without a letter or without labels."""
        names, scores, rejected = [], [], []
        for run in by_size(texts):
            if not self.labels:
                names += [UNKNOWN] * len(run)
                scores.append(np.zeros(len(run)))
                rejected.append(np.ones(len(run), bool))
                continue
            z, rare, n = self.logits(run)
            p = _softmax(z / self.temperature)
            lettered = np.array([any(map(str.isalpha, t)) for t in run])
            best = p.argmax(axis=1)
            names += [self.labels[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            scores.append(np.where(lettered, p[np.arange(len(run)), best], 0.0))
            rejected.append(~lettered | (scores[-1] < self.threshold) | (self.strangeness(rare, n, best) > self.strangest))
        return names, np.concatenate(scores) if scores else np.zeros(0), np.concatenate(rejected) if rejected else np.zeros(0, bool)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_sgd(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and softmax by stochastic gradient descent over (buckets, their shares, label) rows."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-0.5, 0.5, (1 << BUCKET_BITS, DIM)) / DIM
    soft, bias = np.zeros((DIM, n_labels)), np.zeros(n_labels)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, share, y = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ emb[idx]
            err = _softmax(hidden @ soft + bias)
            err[y] -= 1
            back = soft @ err
            soft -= lr * np.outer(hidden, err)
            bias -= 0.1 * lr * err
            emb[idx] -= (0.2 * lr / (share @ share)) * share[:, None] * back  # moves the average by the same step for short and long texts
    return emb @ soft, bias


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    grid = 2.0 ** np.arange(-5, 5.01, 0.25)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_rarity(model: LanguageModel, fit: list[tuple[np.ndarray, np.ndarray, int]], held: list[tuple[np.ndarray, np.ndarray, int]], lose: float, least: float) -> None:
    """Strangeness of ``model`` from (buckets, their counts, label) rows.

    A bucket's share is the mean of its shares in the labels, so a label with few texts counts like the
    others. The level loses the share ``lose`` of the ``held`` rows, but texts up to ``least`` deviations always
    stay, since the farthest of few rows says little.
    """
    n_labels = len(model.labels)
    counts = np.zeros((n_labels, 1 << BUCKET_BITS))
    for i, n, y in fit:
        counts[y, i] += n
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    model.rarity = -np.log(shares.mean(axis=0)).astype(np.float32)

    def describe(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([n.sum() for _, n, _ in rows])
        mean = np.array([n @ model.rarity[i] for i, n, _ in rows]) / sizes
        square = np.array([n @ model.rarity[i] ** 2 for i, n, _ in rows]) / sizes
        return mean, square - mean**2, sizes, np.array([y for *_, y in rows])

    mean, spread, sizes, y = describe(held)
    fit_mean, _, _, fit_y = describe(fit)
    model.usual = np.array([mean[y == k].mean() if (y == k).any() else fit_mean[fit_y == k].mean() if (fit_y == k).any() else mean.mean() for k in range(n_labels)])
    model.between, model.within = float(((mean - model.usual[y]) ** 2).mean()), float(max(spread.mean(), 1e-6))
    model.strangest = float(max(least, np.quantile(model.strangeness(mean, sizes, y), 1 - lose)))


def train(docs: DataFrame, learn: Column, calibrate: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          sample: int = 2400, lose: float = 0.001, ceiling: float = 0.4, strange: float = 5.0) -> LanguageModel:
    """Fit on at most about ``sample`` labelled rows, in equal parts per label, chosen by a hash of the id.

    ``learn`` and ``calibrate`` select disjoint rows; only text and label are learned from. The
    temperature makes scores fit the calibration rows; a score is rejected below the level that loses
    the share ``lose`` of the rightly named calibration rows, and never from ``ceiling`` up. Scores
    say nothing about languages that were not learned, least of all with one or two labels; texts of
    unusual subwords are rejected by ``fit_rarity``, with ``strange`` as its least level. The driver gets the
    sample as subword counts, at most 2**15 per document, and the list of labels.
    """
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.xxhash64(F.lit("sample"), F.col(id_col)).alias("k"), calibrate.alias("c"), (learn | calibrate).alias("u"))
    rows = rows.filter("u AND l IS NOT NULL AND t IS NOT NULL")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    labels = sorted(counts)
    if not labels:
        return LanguageModel([], np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))
    part = {x: min(1.0, sample / len(labels) / counts[x]) for x in labels}
    cut = F.element_at(F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.array(*[F.lit(min(2**63 - 1, int((2 * part[x] - 1) * 2**63))) for x in labels])), F.col("l"))

    @F.pandas_udf("struct<idx:array<int>,n:array<int>>")
    def count_subwords(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b:
                bucket, _ = subwords([t])
                out.append(np.unique(bucket, return_counts=True))
            yield pd.DataFrame({"idx": [x[0] for x in out], "n": [x[1].astype(np.int32) for x in out]})

    got = rows.filter(F.col("k") <= cut).select("k", "l", "c", count_subwords("t").alias("f")).select("k", "l", "c", "f.*").toArrow()
    at = {x: i for i, x in enumerate(labels)}
    sparse = [(k.as_py(), c.as_py(), i.values.to_numpy(), n.values.to_numpy().astype(float), at[name.as_py()]) for k, name, c, i, n in zip(*got.columns) if len(i)]
    sparse.sort(key=lambda r: (r[0], r[4], len(r[2]), r[3].sum()))
    counted = [[(i, n, y) for _, c, i, n, y in sparse if c is flag] for flag in (False, True)]
    fit, held = ([(i, n / n.sum(), y) for i, n, y in rows] for rows in counted)
    weights, bias = fit_sgd(fit or held, len(labels))
    model = LanguageModel(labels, weights.astype(np.float32), bias)
    if sparse:
        fit_rarity(model, counted[0] or counted[1], counted[1] or counted[0], lose, strange)
    if held:
        z = np.array([s @ weights[i] for i, s, _ in held]) + bias
        y = np.array([r[2] for r in held])
        model.temperature = _temperature(z, y)
        p = _softmax(z / model.temperature)
        right = p.argmax(axis=1) == y
        if right.any():
            model.threshold = float(min(ceiling, np.quantile(p.max(axis=1)[right], lose)))
        model.facts = {"fitted": len(fit), "calibrated": len(held), "accuracy": float(right.mean())}
    return model


def held_out(id_col: str = "doc_id") -> tuple[Column, Column, Column]:
    """Held-out, learning and calibration rows by crc32 of the id as text modulo 5: 0, 2 to 4, and 1. A null id counts as empty text."""
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5
    return fold == 0, fold >= 2, fold == 1


def predictor(model: LanguageModel, text: str | Column) -> Column:
    """Struct of lang_pred, score and rejected for a text column.

    Null, empty and letterless texts: und, 0, rejected. Whole texts are read, whatever their length.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names, scores, rejected = model.predict(list(b))
            yield pd.DataFrame({"lang_pred": names, "score": scores, "rejected": rejected})

    return run(F.col(text) if isinstance(text, str) else text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predicted language of every document, learned from the labelled rows that are not held out.

    Returns doc_id, held_out, lang_pred, score and rejected. Labels, ids and other columns never
    enter a prediction. Without any label everything is und. Repeated rows each get a row; empty
    table: no rows.
    """
    held, learn, calibrate = held_out(id_col)
    model = train(docs, learn, calibrate, text_col, lang_col, id_col)
    return docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), predictor(model, text_col).alias("p")).select("doc_id", "held_out", "p.*")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is told with enough confidence, with all columns."""
    _, learn, calibrate = held_out(id_col)
    model = train(docs, learn, calibrate, text_col, lang_col, id_col)
    return docs.withColumn("_told", predictor(model, text_col)).filter("NOT _told.rejected").drop("_told")


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
