"""Toxicity categories by a chain of linear models.

Terms (words, and word beginnings of 4 to 6 letters) are chosen on a bounded sample of
labelled rows (``sample`` rows, drawn by hash; all, if fewer) by how far their shares
of toxic and other texts lie apart.  Categories are predicted one after the other:
each logistic model sees the terms and the probabilities of the categories before it.
In training those are out-of-fold predictions, so that a later model learns from
probabilities as uncertain as the ones it will get.

A null or empty text has no term.  Null labels teach nothing; a category without
examples of both kinds gets its mean.  Repeated labels and ids count as often as they occur.
"""

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graticule.llm.common import letters, named
from graticule.session import durable

BEGINNINGS = (4, 5, 6)
FOLDS = 5


def terms_of(text):
    """Distinct terms of a text; beginnings are marked by a final ``*``."""
    words = set(letters.findall((text or "").lower()))
    out = set(words)
    for n in BEGINNINGS:
        out |= {w[:n] + "*" for w in words if len(w) >= n}
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class LinearModel:
    """Logistic regression on sparse terms and a few dense columns."""

    def __init__(self, n_terms, n_dense):
        self.terms, self.dense, self.bias = np.zeros(n_terms), np.zeros(n_dense), 0.0

    def margin(self, rows, at, dense):
        """``rows``/``at``: row and term of each entry; ``dense``: rows x columns."""
        return np.bincount(rows, self.terms[at], len(dense)) + dense @ self.dense + self.bias

    def fit(self, rows, at, dense, labels, ridge=1.0, rounds=200):
        """Accelerated gradient steps, scaled by each column's curvature bound."""
        n = len(labels)
        mean = labels.mean() if n else 0.5
        self.bias = float(np.log(max(mean, 1e-4) / max(1 - mean, 1e-4)))
        if not n or labels.min() == labels.max():
            return self
        # rows sum at most this much of the diagonal bound
        per_row = np.bincount(rows, minlength=n) + (dense ** 2).sum(1) + 1
        scale_t = np.bincount(at, per_row[rows], len(self.terms)) / 4 + ridge
        scale_d = (np.abs(dense) * per_row[:, None]).sum(0) / 4 + ridge
        scale_b = per_row.sum() / 4
        old = (self.terms.copy(), self.dense.copy(), self.bias)
        for k in range(rounds):
            push = k / (k + 3)
            t, d = (a + push * (a - b) for a, b in zip((self.terms, self.dense), old))
            b = self.bias + push * (self.bias - old[2])
            old = (self.terms, self.dense, self.bias)
            off = sigmoid(np.bincount(rows, t[at], n) + dense @ d + b) - labels
            self.terms = t - (np.bincount(at, off[rows], len(t)) + ridge * t) / scale_t
            self.dense = d - (dense.T @ off + ridge * d) / scale_d
            self.bias = b - off.sum() / scale_b
        return self


class Chain:
    """Models in the order of the categories, with the terms they know."""

    def __init__(self, terms, names):
        self.place = {t: i for i, t in enumerate(terms)}
        self.names, self.models = list(names), []

    def encode(self, texts):
        found = [sorted(self.place[t] for t in terms_of(x) & self.place.keys()) for x in texts]
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        return rows, np.array([i for f in found for i in f], dtype=np.int64)

    def fit(self, rows, at, labels, folds):
        """``labels``: rows x categories; ``folds``: fold of each row."""
        n = len(labels)
        seen = np.zeros((n, 0))
        for j in range(len(self.names)):
            outside = np.zeros(n)
            for f in range(FOLDS):
                learn, ask = folds != f, folds == f
                if ask.any():
                    model = self._one(rows, at, seen, labels[:, j], learn)
                    outside[ask] = sigmoid(model.margin(rows, at, seen))[ask]
            self.models.append(self._one(rows, at, seen, labels[:, j], np.ones(n, dtype=bool)))
            seen = np.column_stack([seen, outside])
        return self

    def _one(self, rows, at, seen, labels, use):
        number = np.cumsum(use) - 1
        kept = use[rows]
        return LinearModel(len(self.place), seen.shape[1]).fit(
            number[rows[kept]], at[kept], seen[use], labels[use])

    def predict(self, texts):
        """texts x categories."""
        rows, at = self.encode(texts)
        seen = np.zeros((len(texts), 0))
        for model in self.models:
            seen = np.column_stack([seen, sigmoid(model.margin(rows, at, seen))])
        return seen


def choose_terms(drawn: DataFrame, most=2000, least=3):
    """Terms of rows (text, toxic) whose shares differ most, in units of their error."""

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([sorted(terms_of(x)) for x in texts.to_pylist()], pa.list_(pa.string()))

    sizes = drawn.agg(F.sum("toxic").alias("a"), F.count("toxic").alias("n")).first()
    with_, total = float(sizes["a"] or 0), float(sizes["n"] or 0)
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    gap = F.log(a / (with_ + 1)) - F.log(b / (total - with_ + 1))
    counted = drawn.select("toxic", F.explode(split(F.col("text"))).alias("term")).groupBy("term").agg(
        F.sum("toxic").cast("double").alias("a"), F.count("toxic").cast("double").alias("n"))
    return [r["term"] for r in counted.where(F.col("n") >= least).select(
        "term", (F.abs(gap) / F.sqrt(1 / a + 1 / b)).alias("z")).orderBy(
        F.desc("z"), "term").limit(most).collect()]


def learn(docs: DataFrame, labels: DataFrame, categories, key="doc_id", text="text",
          label="toxic", sample=20_000, most_terms=2000) -> Chain:
    """A chain for ``categories`` and, at its end, the label itself.

    ``categories`` maps a name to words: a labelled text with one of them, as a whole
    word, is an example of that category.  A key with several labels has the largest.
    ``sample`` bounds the fit: labelled keys are drawn by hash, and should repeated keys
    give more than twice as many rows, those with the smallest hashes of their content count.
    """
    known = labels.where(named(label).isNotNull()).groupBy(named(key).alias("_key")).agg(
        F.max(named(label).cast("int")).alias("toxic"))
    n = known.count()
    share = min(1.0, sample / n) if n else 1.0
    pick = F.pmod(F.xxhash64("_key", F.lit(17)), F.lit(1 << 20)) < share * (1 << 20)
    # written once: three passes read it
    drawn = durable(docs.select(named(key).alias("_key"), named(text).alias("text")).where(pick).join(
        known.where(pick), "_key").select("_key", "text", "toxic"))
    chain = Chain(choose_terms(drawn, most_terms), [*categories, label])
    places = chain.place
    sought = [frozenset(words) for words in categories.values()]

    def encode(batches):
        for b in batches:
            rows, at = [], []
            for x in b["text"].to_pylist():
                found = terms_of(x)
                rows.append(sorted(places[t] for t in found & places.keys()))
                at.append([int(bool(found & s)) for s in sought])
            yield pa.RecordBatch.from_arrays(
                [b["_key"], b["toxic"], pa.array(rows, pa.list_(pa.int32())),
                 pa.array(at, pa.list_(pa.int32()))], names=["_key", "toxic", "at", "hits"])

    # the limit stands behind the texts, so none of them meet in one task
    columns = ["_key", "toxic", "at", "hits"]
    got = drawn.mapInArrow(
        encode, "_key bigint, toxic int, at array<int>, hits array<int>").orderBy(
        F.xxhash64(*columns), *columns).limit(2 * sample).toArrow()
    order = np.lexsort((np.asarray(got["toxic"]), np.asarray(got["_key"])))
    lists = [got["at"][int(i)].as_py() for i in order]
    toxic = np.asarray(got["toxic"], dtype=float)[order]
    hits = np.array([got["hits"][int(i)].as_py() for i in order], dtype=float)
    hits = hits.reshape(len(order), len(sought))
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at = np.array([i for x in lists for i in x], dtype=np.int64)
    y = np.column_stack([hits * toxic[:, None], toxic])
    keys = np.asarray(got["_key"])[order].astype(np.uint64)
    folds = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(FOLDS)
    return chain.fit(rows, at, y, folds)


def predict(text: Column, chain: Chain) -> Column:
    """Struct with the probability of each category."""
    kind = "struct<" + ",".join(f"`{n}`:double" for n in chain.names) + ">"

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = chain.predict(texts.to_pylist())
            yield pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(c)) for c in found.T], names=chain.names)

    return run(text)
