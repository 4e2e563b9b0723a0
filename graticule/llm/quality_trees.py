"""Quality scores by histogram gradient-boosted trees over document statistics.

Every whole text gives ``FEATURES`` numbers: lengths, shares of kinds of characters,
repetition of words, windows and lines.  Trees are grown on quantile bins of a bounded
sample of labelled rows (``sample`` rows, drawn by hash; all, if there are fewer), each
split chosen from histograms of gradients.  All trees are complete and kept as flat
arrays by heap position, so a batch of rows walks all trees at once with array look-ups.

A null or empty text has a row of zeros and is scored like any other.  Null labels and
labels of missing documents teach nothing; repeated labels and ids count as often as
they occur.  Without labels of both kinds the score is the mean label, or 0.5.
"""

from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graticule.llm.common import named

FEATURES = [
    "log_chars", "log_words", "log_lines", "mean_word", "upper", "digit", "symbol", "shout", "bar",
    "stop", "comma", "other_punctuation", "space", "line_feed", "non_ascii", "entropy",
    "distinct_words", "top_word", "same_neighbour", "distinct_windows", "distinct_lines",
    "longest_word", "words_per_line",
]

_codes = np.arange(256)
_masks = np.stack([
    (_codes >= 65) & (_codes <= 90),
    (_codes >= 48) & (_codes <= 57),
    np.isin(_codes, list(b"#*$%&|<>")),
    np.isin(_codes, list(b"!?")),
    _codes == ord("|"),
    _codes == ord("."),
    _codes == ord(","),
    np.isin(_codes, list(b"'\"():;-_/\\[]{}@+=~^`")),
    _codes == 32,
    _codes == 10,
    _codes >= 128,
]).astype(np.float64).T


def statistics(texts) -> np.ndarray:
    """rows x FEATURES of a list of texts."""
    rows = np.zeros((len(texts), len(FEATURES)), dtype=np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        seen = np.bincount(raw, minlength=256)
        share = seen / len(raw)
        used = share[share > 0]
        words = text.split()
        lines = [x for x in text.split("\n") if x.strip()]
        rows[i, :3] = np.log1p([len(text), len(words), len(lines)])
        rows[i, 4:15] = share @ _masks
        rows[i, 15] = -(used * np.log2(used)).sum()
        if words:
            n = len(words)
            counts = Counter(words)
            windows = len(set(zip(words, words[1:], words[2:])))
            rows[i, 3] = len(text) / n
            rows[i, 16:] = (
                len(counts) / n, max(counts.values()) / n,
                sum(map(str.__eq__, words, words[1:])) / n,
                windows / max(1, n - 2), len(set(lines)) / len(lines),
                np.log1p(max(map(len, counts))), np.log1p(n / len(lines)))
    return rows


class BoostedTrees:
    """Complete trees of one depth as arrays: feature, threshold, leaf values."""

    def __init__(self, depth, base):
        self.depth, self.base = depth, base
        self.feature = np.zeros((0, 2 ** depth - 1), dtype=np.int32)
        self.threshold = np.zeros((0, 2 ** depth - 1), dtype=np.float32)
        self.leaf = np.zeros((0, 2 ** depth), dtype=np.float64)

    def raw(self, rows):
        out = np.full(len(rows), self.base)
        if not len(self.leaf):
            return out
        trees = np.arange(len(self.leaf))[None, :]
        for k in range(0, len(rows), 4096):
            part = rows[k:k + 4096]
            node = np.zeros((len(part), len(self.leaf)), dtype=np.int64)
            every = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                right = part[every, self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + right
            out[k:k + 4096] += self.leaf[trees, node - (2 ** self.depth - 1)].sum(1)
        return out

    def score(self, rows):
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -40, 40)))


def fit_trees(rows, labels, trees=80, depth=4, bins=64, rate=0.15, ridge=1.0, least=5.0):
    """Boosting with the logistic loss; deterministic."""
    labels = np.asarray(labels, dtype=np.float64)
    mean = labels.mean() if len(labels) else 0.5
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    model = BoostedTrees(depth, float(np.log(mean / (1 - mean))))
    if not len(labels) or labels.min() == labels.max():
        return model
    n_features = rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins)[1:-1])).astype(np.float32)
             for j in range(n_features)]
    binned = np.stack([np.searchsorted(e, rows[:, j], side="left") for j, e in enumerate(edges)])
    flat = binned + (np.arange(n_features) * bins)[:, None]
    raw = np.full(len(labels), model.base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = p - labels, p * (1 - p)
        node = np.zeros(len(labels), dtype=np.int64)
        feature = np.zeros(2 ** depth - 1, dtype=np.int32)
        threshold = np.full(2 ** depth - 1, np.inf, dtype=np.float32)
        for level in range(depth):
            width = 2 ** level
            at = (node[None, :] * (n_features * bins) + flat).ravel()
            size = width * n_features * bins
            g = np.bincount(at, np.tile(slope, n_features), size).reshape(width, n_features, bins)
            h = np.bincount(at, np.tile(curve, n_features), size).reshape(width, n_features, bins)
            left_g, left_h = g.cumsum(2), h.cumsum(2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g ** 2 / (left_h + ridge) + right_g ** 2 / (right_h + ridge) - (
                all_g ** 2 / (all_h + ridge))
            gain[(left_h * 4 < least) | (right_h * 4 < least)] = -1
            best = gain.reshape(width, -1).argmax(1)
            split = np.full(width, bins, dtype=np.int64)
            chosen = best // bins
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[width - 1 + k], threshold[width - 1 + k] = j, edges[j][b]
                    split[k] = b
            node = 2 * node + (binned[chosen[node], np.arange(len(node))] > split[node])
        g = np.bincount(node, slope, 2 ** depth)
        h = np.bincount(node, curve, 2 ** depth)
        leaf = -rate * g / (h + ridge)
        raw += leaf[node]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    model.feature, model.threshold, model.leaf = map(np.stack, (features, thresholds, leaves))
    return model


def measure(text: Column) -> Column:
    """Statistics of each text as array<float>."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = statistics(texts.to_pylist())
            ends = np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))

    return run(text)


def learn(measured: DataFrame, labels: DataFrame, key="doc_id", label="quality", sample=20_000,
          **settings) -> BoostedTrees:
    """Trees from rows (key, features) joined with (key, label).

    A key with several labels has the largest.  ``sample`` bounds the fit: keys are drawn
    by hash, and should repeated keys give more than twice as many rows, those with the
    smallest hashes of their content count.
    """
    known = labels.where(named(label).isNotNull()).groupBy(named(key).alias("_key")).agg(
        F.max(named(label).cast("double")).alias("_label"))
    pairs = measured.select(named(key).alias("_key"), F.col("features")).join(known, "_key")
    n = pairs.count()
    share = min(1.0, sample / n) if n else 1.0
    # by hash, so a lost task draws the same rows again
    drawn = pairs.where(F.pmod(F.xxhash64("_key", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20))
    columns = ["_key", "features", "_label"]
    got = drawn.select(*columns).orderBy(F.xxhash64(*columns), *columns).limit(2 * sample).toArrow()
    order = np.argsort(np.asarray(got["_key"]), kind="stable") if got.num_rows else []
    rows = np.asarray(got["features"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    return fit_trees(rows[order], np.asarray(got["_label"])[order], **settings) if len(order) else (
        fit_trees(np.zeros((0, len(FEATURES))), []))


def score(features: Column, model: BoostedTrees) -> Column:
    """Probability of label 1."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(model.score(np.asarray(b.flatten()).reshape(len(b), -1)))

    return run(features)
