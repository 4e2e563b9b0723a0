"""Language identification as a mixture: proportions of languages in each document.

Languages are learned as hashed character trigrams of lower-cased words, counted over
all training rows.  A document's words come from an unknown mixture of languages;
expectation-maximisation over the words' likelihoods gives the proportions.  The set of
languages is chosen by penalised likelihood: starting from all, the weakest language is
taken out as long as the log-likelihood falls by less than ``penalty * log(words) / 2``.

A document's language is the one with the largest proportion, that proportion its score.
A text that is null or has no letter, and every text if nothing was learned, is ``und``
with score 0.  Null languages teach nothing.  The model has ``2 ** BITS`` numbers per
language, however many rows there are.
"""

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from graticule.llm.common import free_name, letters, named

BITS = 16
UNKNOWN = "und"
CACHE_WORDS = 300_000
BLOCK_WORDS = 400_000


def trigram_buckets(words):
    """Bucket of each trigram of the marked words, and which ones lie inside a word."""
    joined = "".join(["\x02" + w + "\x03" for w in words])
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(sizes)
    mixed = np.zeros(len(codes), dtype=np.uint32)
    mixed[:-2] = codes[:-2] * np.uint32(2654435761) + codes[1:-1] * np.uint32(2246822519) + (
        codes[2:] * np.uint32(3266489917))
    mixed ^= mixed >> np.uint32(15)
    inside = np.ones(len(codes), dtype=bool)
    inside[ends - 1] = False
    inside[ends - 2] = False
    return (mixed * np.uint32(2246822519)) >> np.uint32(32 - BITS), inside, ends - sizes


class LanguageModel:
    def __init__(self, names, counts, smooth=0.1):
        """``counts``: languages x buckets."""
        self.names = list(names)
        table = (counts + smooth) / (counts.sum(1, keepdims=True) + smooth * counts.shape[1])
        self.logs = np.log(table).T.astype(np.float32)

    def word_logs(self, words):
        """words x languages: log-likelihood of each word."""
        buckets, inside, starts = trigram_buckets(words)
        each = self.logs[buckets]
        each[~inside] = 0
        return np.add.reduceat(each, starts, axis=0)


def mix(logs, starts, sizes, penalty=2.0, first=12, later=6):
    """documents x languages: proportions, zero outside the chosen set.

    ``logs`` has a row per word, those of a document in a row; every document has words.
    """
    n_docs, n_langs = len(starts), logs.shape[1]
    likely = np.maximum(np.exp(logs - logs.max(1, keepdims=True)), np.float32(1e-30))
    doc = np.repeat(np.arange(n_docs), sizes)

    def climb(share, rounds, rows, doc, starts, sizes):
        for _ in range(rounds):
            part = rows * share[doc]
            total = part.sum(1, keepdims=True)
            share = np.add.reduceat(part / total, starts, axis=0) / sizes[:, None]
            share = share.astype(np.float32)
        fit = np.log(np.maximum((rows * share[doc]).sum(1), 1e-38), dtype=np.float64)
        return share, np.add.reduceat(fit, starts)

    share = np.full((n_docs, n_langs), 1 / n_langs, dtype=np.float32)
    share, fit = climb(share, first, likely, doc, starts, sizes)
    cost = penalty * np.log(np.maximum(sizes, 2)) / 2
    going = np.flatnonzero((share > 0).sum(1) > 1)
    while len(going):
        # only the documents whose set may still shrink are worked on
        lens = sizes[going]
        begins = np.concatenate([[0], np.cumsum(lens)[:-1]])
        rows = np.repeat(starts[going] - begins, lens) + np.arange(lens.sum())
        fewer = share[going].copy()
        weakest = np.where(fewer > 0, fewer, np.inf).argmin(1)
        # languages with less than half a word go together with the weakest
        fewer[fewer * lens[:, None] < 0.5] = 0
        fewer[np.arange(len(going)), weakest] = 0
        gone = fewer.sum(1) <= 0
        fewer[gone] = share[going][gone]
        fewer /= fewer.sum(1, keepdims=True)
        fewer, worse = climb(
            fewer, later, likely[rows], np.repeat(np.arange(len(going)), lens), begins, lens)
        dropped = (share[going] > 0).sum(1) - (fewer > 0).sum(1)
        better = (fit[going] - worse < cost[going] * dropped) & (dropped > 0)
        done = going[better]
        share[done], fit[done] = fewer[better], worse[better]
        going = done[(share[done] > 0).sum(1) > 1]
    return share


def has_letter(text):
    """Whether a text has a letter: signs such as ``½`` and ``²`` are none."""
    return any(c.isalpha() for run in letters.finditer(text) for c in run.group())


class Identifier:
    """Languages and scores of batches of texts, words looked up once."""

    def __init__(self, model, penalty=2.0):
        self.model, self.penalty = model, penalty
        self.rows, self.logs, self.used = {}, None, 0

    def _add(self, words):
        if self.used + len(words) > CACHE_WORDS:
            self.rows, self.used = {}, 0
        size = max(CACHE_WORDS, len(words))
        if self.logs is None or len(self.logs) < size:
            self.logs = np.zeros((size, len(self.model.names)), dtype=np.float32)
        for k in range(0, len(words), 50_000):
            part = words[k:k + 50_000]
            self.logs[self.used:self.used + len(part)] = self.model.word_logs(part)
            self.rows.update(zip(part, range(self.used, self.used + len(part))))
            self.used += len(part)

    def _block(self, texts):
        words = [letters.findall(t.lower()) for t in texts]
        flat = [w for ws in words for w in ws]
        new = [w for w in set(flat) if w not in self.rows]
        if new:
            self._add(new)
            lost = [w for w in set(flat) if w not in self.rows]
            if lost:  # the store was emptied meanwhile
                self.rows, self.used = {}, 0
                self._add(list(set(flat)))
        at = np.fromiter(map(self.rows.__getitem__, flat), dtype=np.int64, count=len(flat))
        sizes = np.array([len(ws) for ws in words])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return mix(self.logs[at], starts, sizes, self.penalty)

    def judge(self, texts):
        """(languages, scores) of a list of texts."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.model.names:
            return names, scores
        block, chars = [], 0
        known = [i for i, t in enumerate(texts) if t and has_letter(t)]
        for i in known:
            block.append(i)
            chars += len(texts[i])
            if chars > 5 * BLOCK_WORDS or i == known[-1]:
                share = self._block([texts[j] for j in block])
                best = share.argmax(1)
                for j, b, row in zip(block, best, share):
                    names[j], scores[j] = self.model.names[b], min(1.0, float(row[b]))
                block, chars = [], 0
        return names, scores


def learn(rows: DataFrame, text="text", lang="lang") -> LanguageModel:
    """Trigram counts per language over all rows with a language."""

    def count(batches):
        sums = {}
        for b in batches:
            by = {}
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    words = by.setdefault(name, {})
                    for w in letters.findall(t.lower()):
                        words[w] = words.get(w, 0) + 1
            for name, words in by.items():
                if words:
                    buckets, inside, starts = trigram_buckets(list(words))
                    times = np.fromiter(words.values(), dtype=np.float64, count=len(words))
                    each = np.repeat(times, np.diff(np.append(starts, len(buckets))))
                    found = np.bincount(buckets[inside], each[inside], minlength=1 << BITS)
                    sums[name] = sums[name] + found if name in sums else found
            if len(sums) > 64:
                yield from _counted(sums)
                sums = {}
        yield from _counted(sums)

    counted = rows.where(named(lang).isNotNull()).select(named(text), named(lang)).mapInArrow(
        count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toArrow()
    found = counted["lang"].to_pylist()
    names = sorted(set(found))
    place = {n: i for i, n in enumerate(names)}
    counts = np.zeros((len(names), 1 << BITS))
    counts[[place[n] for n in found], np.asarray(counted["bucket"])] = np.asarray(counted["n"])
    return LanguageModel(names, counts)


def _counted(sums):
    for name, found in sums.items():
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at])],
            names=["lang", "bucket", "n"])


def identify(text: Column, model: LanguageModel, penalty=2.0) -> Column:
    """Struct of the language (lang_pred) and its proportion (score)."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = Identifier(model, penalty)
        for texts in batches:
            names, scores = tool.judge(texts.to_pylist())
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["lang_pred", "score"])

    return run(text)


def keep_identified(docs: DataFrame, model: LanguageModel, text="text") -> DataFrame:
    """Rows with a language; those without one, ``und``, go, mixtures stay."""
    flag = free_name(docs, "found")
    found = docs.withColumn(flag, identify(named(text), model))
    return found.where(F.col(flag)["lang_pred"] != UNKNOWN).select(*[named(c) for c in docs.columns])
