"""Toxicity by cumulative-link ordinal regression on sparse word features.

``P(grade <= k) = sigmoid(threshold_k - w . x)``: the word weights are shared by all
thresholds, which are kept in order.  Features are words and beginnings of words.  The
labels only tell clean from toxic, so training grades a toxic document 1, 2 or 3 by the
amount of features in it that are typical of toxic documents.
The model is fitted on a bounded sample of labelled documents (at most ``SAMPLE`` of
the classes); every document is scored by its whole text.  The score is the expected
grade, 0 to 3; a document is toxic if grade 0 has a probability below one half.

Defined results: a null text or one without words has no feature and is scored by the
thresholds alone; null labels do not count, of several labels the most toxic counts;
without labels of both classes severity is 0 and nothing is toxic; repeated rows are
scored one by one; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.arrays import steps, text_buffers
from siftloom.llm.columns import apart
from siftloom.llm.registry import query, table
from siftloom.llm.words import lower_ascii, mix, non_letters, run_hashes, word_hashes, words_of
from siftloom.session import cut_lineage

#: Labelled documents that are fitted on, at most: clean and toxic.
SAMPLE = (6000, 3000)
#: Bytes of the word beginnings that are features beside the words.
PREFIXES = (4, 5)
#: Features that get a weight, at most, and the share of the toxic sample that one must occur in.
FEATURES = 512
SUPPORT = 0.004
#: Log-odds from which a word is typical of toxic documents.
TYPICAL = 1.5
GRADES = 4


class Model(NamedTuple):
    words: np.ndarray  # sorted word hashes (uint64)
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than the grades

    def grades(self, score: np.ndarray) -> np.ndarray:
        """Probability of each grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        below = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
        return np.diff(below, axis=1)


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and of the longer words' first bytes, and their number."""
    data = lower_ascii(data)
    words = words_of(data, offsets, non_letters())
    n = np.diff(words.first)
    h, row = [word_hashes(data, words)], [np.repeat(np.arange(len(n)), n)]
    for size in PREFIXES:
        long = np.flatnonzero(words.end - words.start > size)
        h.append(mix(run_hashes(data, words.start[long], words.start[long] + size) ^ np.uint64(size)))
        row.append(row[0][long])
    h, row = np.concatenate(h), np.concatenate(row)
    return h[np.argsort(row, kind="stable")], np.bincount(row, minlength=len(n))


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` with a feature's hash ``h``, its count ``tf`` and the features of the text ``n``: a row per distinct feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, text):
                h, sizes = _hashes(*text_buffers(batch.column(text)))
                row = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, int)
                tf = np.diff(np.append(new, len(h)))
                at = pa.array(row[new])
                yield pa.RecordBatch.from_pydict(
                    {k: batch.column(k).take(at) for k in keep}
                    | {"h": pa.array(h[new].view(np.int64)), "tf": pa.array(tf.astype(np.int64)), "n": pa.array(sizes[row[new]])})

    kept = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{kept}, h long, tf long, n long")


def _descend(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray, width: int):
    """Weights and thresholds by accelerated gradient descent with soft thresholding (L1)."""
    rows, rounds, rate, l1, l2 = len(grade), 1500, 0.05, 1e-4, 1e-6
    share = np.cumsum([weight[grade == g].sum() for g in range(GRADES)]) / weight.sum()
    share = np.clip(share[:-1], 1e-3, 1 - 1e-3)
    # thresholds = first, then first plus positive gaps, so they stay in order
    logit = np.log(share / (1 - share))
    free = np.concatenate([logit[:1], np.log(np.maximum(np.diff(logit), 1e-2))])
    w = np.zeros(width)
    moment = [np.zeros(width), np.zeros(width), np.zeros(len(free)), np.zeros(len(free))]
    for step in range(1, rounds + 1):
        gaps = np.exp(free[1:])
        cuts = np.concatenate([free[:1], free[0] + np.cumsum(gaps)])
        score = np.bincount(row, w[col] * value, rows)
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper = 1 / (1 + np.exp(-np.clip(edges[grade + 1] - score, -40, 40)))
        lower = 1 / (1 + np.exp(-np.clip(edges[grade] - score, -40, 40)))
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        dscore = weight * (du - dl) / weight.sum()  # of the negative log-likelihood
        gw = np.bincount(col, dscore[row] * value, width) + l2 * w
        dcut = np.zeros(GRADES + 1)
        np.add.at(dcut, grade + 1, -weight * du / weight.sum())
        np.add.at(dcut, grade, weight * dl / weight.sum())
        dcut = dcut[1:GRADES]
        gf = np.concatenate([[dcut.sum()], np.cumsum(dcut[::-1])[::-1][1:] * gaps])
        for g, x, m, v in ((gw, w, moment[0], moment[1]), (gf, free, moment[2], moment[3])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return w, np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", flag: str = "toxic") -> Model | None:
    """Model from a bounded sample of the labelled documents; None without both classes."""
    marks = (labels.where(F.col(key).isNotNull() & F.col(flag).isNotNull())
             .groupBy(F.col(key).alias("_key")).agg((F.max(flag) > 0).cast("int").alias("_y")))
    counts = {r._y: r.n for r in marks.groupBy("_y").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return None
    picked = None
    for y in (0, 1):
        some = marks.where(F.col("_y") == y).orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE[y])
        picked = some if picked is None else picked.unionByName(some)
    # the sample has sum(SAMPLE) keys at most, so it can be broadcast
    texts = docs.select(key, text).join(F.broadcast(picked), F.col(key) == F.col("_key"))
    rows = cut_lineage(features(texts, ["_key", "_y"], text))
    sizes = {r._y: r.n for r in rows.groupBy("_y").agg(F.countDistinct("_key").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    clean, toxic = float(sizes[0]), float(sizes[1])
    seen = rows.groupBy("h").agg(F.sum("_y").cast("double").alias("a"), F.sum(1 - F.col("_y")).cast("double").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (clean - F.col("b") + 0.5))
    gain = F.pow(F.col("a") / toxic - F.col("b") / clean, 2) / (F.col("a") + F.col("b"))
    chosen = (seen.where(F.col("a") >= max(3.0, SUPPORT * toxic)).select("h", odds.alias("odds"), gain.alias("gain"))
              .orderBy(F.desc("gain"), "h").limit(FEATURES))
    top = chosen.toPandas()  # FEATURES rows at most
    if not len(top):
        return None
    # at most FEATURES entries for each sampled document
    table_ = rows.join(F.broadcast(chosen.select("h")), "h").select("_key", "_y", "h", "tf", "n").toPandas()
    everyone = rows.groupBy("_key", "_y").agg(F.max("n").alias("n")).toPandas().sort_values("_key")
    words = np.sort(top.h.to_numpy().view(np.uint64))
    typical = np.zeros(len(words))
    typical[np.searchsorted(words, top.h.to_numpy().view(np.uint64))] = top.odds.to_numpy() >= TYPICAL
    row = np.searchsorted(everyone["_key"].to_numpy(), table_["_key"].to_numpy())
    col = np.searchsorted(words, table_.h.to_numpy().view(np.uint64))
    tf = table_.tf.to_numpy()
    y = everyone["_y"].to_numpy()
    amount = np.bincount(row, typical[col] * np.log1p(tf), len(y))
    cuts = np.quantile(amount[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (amount > cuts[0]) + (amount > cuts[1]), 0)
    # both classes weigh the same while fitting; then the thresholds move to the share of each among all labels
    weight = np.where(y == 1, 0.5 / toxic, 0.5 / clean)
    w, thresholds = _descend(row, col, np.log1p(tf), grade, weight, len(words))
    used = w != 0
    return Model(words[used], w[used], thresholds + np.log(counts[0] / counts[1]))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``_tox_severity`` (expected grade), ``_tox_p`` (of any toxicity) and ``_tox_grade``."""
    if model is None:
        return docs.withColumns({"_tox_severity": F.lit(0.0), "_tox_p": F.lit(0.0), "_tox_grade": F.lit(0)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, text):
                h, sizes = _hashes(*text_buffers(batch.column(text)))
                at = np.searchsorted(model.words, h)
                hit = np.flatnonzero(model.words[np.minimum(at, len(model.words) - 1)] == h) if len(model.words) else np.zeros(0, int)
                row = np.repeat(np.arange(len(sizes)), sizes)[hit]
                pair, tf = np.unique(row * len(model.words) + at[hit], return_counts=True)
                row, col = np.divmod(pair, max(1, len(model.words)))
                p = model.grades(np.bincount(row, model.weights[col] * np.log1p(tf), len(sizes)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(p @ np.arange(GRADES)), pa.array(1 - p[:, 0]), pa.array(p.argmax(axis=1).astype(np.int32))],
                    [*batch.schema.names, "_tox_severity", "_tox_p", "_tox_grade"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{own}, _tox_severity double, _tox_p double, _tox_grade int")


def toxicity_filter(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", flag: str = "toxic") -> DataFrame:
    """The documents that are not toxic, with their own columns."""
    docs, names, back = apart(docs)
    labels = labels.select(F.col(key).alias(names[key]), F.col(flag).alias("flag"))
    scored = score(docs, fit(docs, labels, names[key], names[text], "flag"), names[text])
    return back(scored.where(F.col("_tox_p") <= 0.5))


@query("op1_toxicity")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", F.col("_tox_severity").alias("severity"), F.col("_tox_p").alias("p_toxic"),
                       F.col("_tox_grade").alias("grade"), (F.col("_tox_p") > 0.5).alias("toxic"),
                       (F.col("_tox_p") <= 0.5).alias("kept"))
