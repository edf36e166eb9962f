"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are 0 (clean) to 3; P(grade <= k) = sigmoid(theta_k - w.x) with one weight vector for
all thresholds. x holds log(1 + count) of words and of word beginnings. The output is the expected severity, the sum
of P(grade >= k) over k = 1..3, and a document is toxic where P(grade >= 1) >= THRESHOLD.

The labels only say toxic or not. Grades for fitting come from them: 0 where not; otherwise the third
of the sample's toxic documents that the document is in, by how many different features it has that
are typical of toxic ones (at least TYPICAL times as frequent in toxic documents of the sample, in 5
of them at least). Repeating them doesn't raise the grade.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, labelled_rows, table

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 4000
TYPICAL = 12.0
#: A document is toxic where P(grade >= 1) reaches this: the least of 0.1, 0.15, ... that flags at most one in 300 clean
#: documents in five-fold cross-validation within the training rows of sf0.1 (README).
THRESHOLD = 0.25
#: A feature occurs in so many documents of the sample at least.
MIN_DOCS = 8
TOKEN = re.compile(r"\w+")


#: Lengths of the word beginnings that are features too.
STEMS = (3, 4, 5, 6)
#: Texts are taken together up to so many characters (one longer text stands alone).
AT_ONCE = 500_000
#: Words that a task remembers, about.
KNOWN = 200_000


def parts(word: str) -> list[str]:
    """The features of a word: itself, and its beginnings followed by a hyphen."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


class Features(dict):
    """Numbers of words, as they come up, and beside them the numbers of their features: all, which get
    numbers too, or those of ``index`` alone."""

    def __init__(self, index: dict[str, int] | None = None) -> None:
        self.grows, self.index = index is None, {} if index is None else index
        self.of, self.size = array("q"), array("q")  # features of all words, one after the other, and how many each has

    def __missing__(self, word: str) -> int:
        own, index = parts(word), self.index
        own = [index.setdefault(x, len(index)) for x in own] if self.grows else [index[x] for x in own if x in index]
        self.of.extend(own)
        self.size.append(len(own))
        n = self[word] = len(self.size) - 1
        return n

    def forget(self) -> None:
        self.clear()
        self.of, self.size = array("q"), array("q")

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, count) of each feature that a text has, by row and feature."""
        words = [TOKEN.findall((t or "").lower()) for t in texts]
        row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=len(row))
        size, flat = np.array(self.size, dtype=np.int64), np.array(self.of, dtype=np.int64)
        n = size[ids]
        place = np.repeat((np.cumsum(size) - size)[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        width = max(1, len(self.index))
        key = np.sort(np.repeat(row, n) * width + flat[place])
        at = np.flatnonzero(np.diff(key, prepend=-1))
        return key[at] // width, key[at] % width, np.diff(np.append(at, len(key))).astype(float)


def slices(texts: list[str | None], most: int = AT_ONCE) -> Iterator[slice]:
    """Runs of texts of ``most`` characters at most, or of one text."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size > most and i > start:
            yield slice(start, i)
            start, size = i, len(text or "")
    if start < len(texts):
        yield slice(start, len(texts))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sparse(texts: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Features in MIN_DOCS texts at least, numbered; and (row, column, count) of each that occurs."""
    features = Features()
    got = []
    for part in slices(texts):
        row, col, n = features.counted(texts[part])
        got.append(((part.start + row).astype(np.int32), col.astype(np.int32), n.astype(np.int32)))
    docs = np.zeros(len(features.index), dtype=np.int64)
    for _, col, _ in got:
        docs += np.bincount(col, minlength=len(docs))
    names = sorted(x for x, i in features.index.items() if docs[i] >= MIN_DOCS)
    number = np.full(len(docs), -1, dtype=np.int32)
    number[[features.index[x] for x in names]] = np.arange(len(names))
    del features
    for i, (row, col, n) in enumerate(got):
        keep = number[col] >= 0
        got[i] = (row[keep], number[col[keep]], n[keep])
    row, col = (np.concatenate([np.zeros(0, dtype=np.int32), *[g[k] for g in got]]) for k in (0, 1))
    return {x: i for i, x in enumerate(names)}, row, col, np.concatenate([np.zeros(0), *[g[2] for g in got]])


def grades_of(toxic: np.ndarray, row: np.ndarray, col: np.ndarray, n_features: int) -> np.ndarray:
    bad = np.bincount(col, weights=toxic[row], minlength=n_features)
    good = np.bincount(col, weights=1 - toxic[row], minlength=n_features)
    typical = (bad >= 5) & (bad / toxic.sum() > TYPICAL * (good + 0.5) / (1 - toxic).sum())
    hits = np.bincount(row, weights=typical[col], minlength=len(toxic))
    return np.where(toxic == 0, 0, np.digitize(hits, np.quantile(hits[toxic == 1], [1 / 3, 2 / 3])) + 1)


def fit(texts: list[str], toxic: np.ndarray, *, steps: int = 250, ridge: float = 0.5) -> dict:
    """Weights by feature and the three thresholds. Without both labels: a model that calls all clean."""
    toxic = np.asarray(toxic, dtype=int)
    if not len(toxic) or toxic.min() == toxic.max():
        return {"w": {}, "theta": [40.0, 41.0, 42.0]}
    index, row, col, val = sparse(texts)
    grade = grades_of(toxic, row, col, len(index))
    val = np.log1p(val)
    k = 3
    w = np.zeros(len(index))
    by_col = np.argsort(col, kind="stable")
    col_row, col_val, cols = row[by_col], val[by_col], col[by_col]
    del by_col
    row_at, col_at = (np.flatnonzero(np.diff(x, prepend=-1)) for x in (row, cols))  # both rise
    rows, cols = row[row_at], cols[col_at]
    base, gaps = np.array([2.0]), np.zeros(k - 1)  # theta = base, base + exp(gaps[0]), ...
    m = [np.zeros_like(x) for x in (w, base, gaps)]
    v = [np.zeros_like(x) for x in (w, base, gaps)]
    lo, hi = grade - 1, grade  # P(grade) = s(theta[hi]) - s(theta[lo])
    for step in range(1, steps + 1):
        theta = np.concatenate([base, base + np.cumsum(np.exp(gaps))])
        z, g_w = np.zeros(len(grade)), ridge * w
        if len(row):
            z[rows] = np.add.reduceat(val * w[col], row_at)
        cdf = sigmoid(theta[None, :] - z[:, None])
        up = np.where(hi < k, cdf[np.arange(len(z)), np.minimum(hi, k - 1)], 1.0)
        down = np.where(lo >= 0, cdf[np.arange(len(z)), np.maximum(lo, 0)], 0.0)
        p = np.maximum(up - down, 1e-9)
        d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
        dz = d_up - d_down  # of -log p by z
        if len(row):
            g_w[cols] += np.add.reduceat(col_val * dz[col_row], col_at)
        g_t = np.zeros(k)
        np.add.at(g_t, hi[hi < k], -d_up[hi < k])
        np.add.at(g_t, lo[lo >= 0], d_down[lo >= 0])
        g_gaps = np.array([g_t[i + 1 :].sum() * np.exp(gaps[i]) for i in range(k - 1)])
        for i, (x, g) in enumerate(((w, g_w), (base, np.array([g_t.sum()])), (gaps, g_gaps))):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            x -= 0.05 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    theta = np.concatenate([base, base + np.cumsum(np.exp(gaps))])
    return {"w": {t: float(w[i]) for t, i in index.items() if abs(w[i]) > 1e-3}, "theta": [float(x) for x in theta]}


def severity(model: dict, texts: list[str | None], features: Features | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expected severity, and P(grade >= 1), of each text. ``features`` keeps what is known of words."""
    names = list(model["w"])
    features = Features({x: i for i, x in enumerate(names)}) if features is None else features
    w, z = np.array([model["w"][x] for x in names] or [0.0]), np.zeros(len(texts))
    for part in slices(texts):
        if len(features) > KNOWN:
            features.forget()
        row, col, n = features.counted(texts[part])
        z[part] = np.bincount(row, weights=w[col] * np.log1p(n), minlength=part.stop - part.start)
    above = sigmoid(z[:, None] - np.array(model["theta"])[None, :])
    return above.sum(1), above[:, 0]


def scored(text: Column, model: dict) -> Column:
    """A struct (severity double, toxic boolean) for a text column; null counts as empty."""

    @F.pandas_udf("severity double, toxic boolean")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        features = Features({x: i for i, x in enumerate(model["w"])})
        for texts in batches:
            expected, p = severity(model, texts.tolist(), features)
            yield pd.DataFrame({"severity": expected, "toxic": p >= THRESHOLD})

    return score(text)


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on ``sample`` labelled documents at most, none of the fifth with crc32(doc_id) mod 5 = 0. One task fits the
    model, so that the sample's texts and features take no memory of the driver."""
    rows = labelled_rows(docs, labels, "toxic", sample, crc_mod(F.col("doc_id"), 5) != 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.concat([pd.DataFrame({"text": [], "y": []}), *batches])
        yield pd.DataFrame({"model": [json.dumps(fit(own["text"].tolist(), (own["y"] > 0).astype(int).to_numpy()))]})

    found = rows.mapInPandas(run, "model string").first()
    return json.loads(found["model"]) if found else fit([], np.zeros(0))


def grade_documents(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, severity (0 to 3), grade (severity rounded), toxic. Null and empty texts score as
    texts without a word; repeated rows score alike; other columns are ignored."""
    s = scored(F.col(text_col), model)
    rows = docs.select(F.col(id_col).alias("d_id"), s.alias("s"))
    return rows.select(F.col("d_id").alias(id_col), F.col("s.severity").alias("severity"), F.round("s.severity").cast("int").alias("grade"), F.col("s.toxic").alias("toxic"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return grade_documents(docs, fit_on(docs, table(spark, sf_dir, "labels")))
