"""Quality by a linear-chain conditional random field over the lines of a document.

Each line is good (1) or bad (0). A line's score comes from its own features and those of the
lines before and after it; a 2 x 2 table scores neighbouring labels. Forward-backward gives each
line's marginal, and the document's quality is their mean weighted by line length.

Labels exist for documents only, so for fitting every line takes its document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, labelled_sample, table

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 3000
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = bytes(range(48, 58))
MARK = b"|#$%&*!=<>{}[]^~_+\\@/"
N_OWN = 11


def line_features(line: str) -> list[float]:
    raw = line.encode("utf-8", "replace")
    n = len(raw)
    words = line.split()
    k = len(words)
    share = lambda chars: (n - len(raw.translate(None, chars))) / n if n else 0.0
    upper, lower = share(UPPER), share(LOWER)
    return [
        1.0,
        min(1.0, 20 * share(MARK)),
        min(1.0, 20 * raw.count(b"|") / n) if n else 0.0,
        upper / (upper + lower) if upper + lower else 0.0,
        min(1.0, 5 * share(DIGIT)),
        1 - len(set(words)) / k if k else 0.0,
        sum(map(eq, words, words[1:])) / (k - 1) if k > 1 else 0.0,
        min(2.0, n / k / 10) if k else 0.0,
        float(k < 4),
        float(k < 12),
        float(raw[-1:] in (b".", b"?", b"!", b":")),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x 3 N_OWN features: own, before, after), (weight of each line)."""
    lines = (text or "").split("\n")
    own = np.array([line_features(x) for x in lines])
    edge = np.zeros((1, N_OWN))
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])]), np.array([len(x) + 1.0 for x in lines])


def by_length(lengths: np.ndarray, cells: int = 400_000) -> Iterator[np.ndarray]:
    """Documents in groups of like length, each of ``cells`` padded lines at most (or one document)."""
    order, start = np.argsort(lengths, kind="stable"), 0
    while start < len(order):
        end = start + 1
        while end < len(order) and (end + 1 - start) * lengths[order[end]] <= cells and lengths[order[end]] <= 2 * lengths[order[start]] + 4:
            end += 1
        yield order[start:end]
        start = end


def padded(parts: list[np.ndarray], t: int) -> np.ndarray:
    out = np.zeros((len(parts), t, *parts[0].shape[1:]))
    for i, x in enumerate(parts):
        out[i, : len(x)] = x
    return out


def forward_backward(e: np.ndarray, trans: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission scores e (docs x lines x 2), table trans, true lengths n. Marginals of each line,
    summed marginals of neighbouring pairs (docs x 2 x 2), log of the partition function."""
    d, t, _ = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for i in range(1, t):
        s = alpha[:, i - 1, :, None] + trans[None]
        nxt = np.logaddexp(s[:, 0], s[:, 1]) + e[:, i]
        alpha[:, i] = np.where((i < n)[:, None], nxt, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        s = trans[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :]
        beta[:, i] = np.where((i + 1 < n)[:, None], np.logaddexp(s[:, :, 0], s[:, :, 1]), 0.0)
    log_z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    marginal = np.exp(np.minimum(0.0, alpha + beta - log_z[:, None, None]))
    pairs = np.zeros((d, 2, 2))
    if t > 1:
        inside = (np.arange(1, t)[None, :] < n[:, None])[:, :, None, None]
        s = alpha[:, :-1, :, None] + trans[None, None] + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - log_z[:, None, None, None]
        pairs = (np.exp(np.minimum(0.0, s)) * inside).sum(1)
    return marginal, pairs, log_z


def emissions(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    good = x @ w
    return np.stack([np.zeros_like(good), good], axis=-1)


def fit(texts: list[str], labels: np.ndarray, *, steps: int = 120, ridge: float = 1.0) -> dict:
    """Weights of the features and the table. Without a labelled row: a model that scores 0.5."""
    w, trans = np.zeros(3 * N_OWN), np.zeros((2, 2))
    if not len(texts):
        return {"w": w, "trans": trans}
    parts = [features(t)[0] for t in texts]
    lengths = np.array([len(p) for p in parts])
    groups = [(padded([parts[i] for i in g], lengths[g].max()), lengths[g], np.asarray(labels)[g]) for g in by_length(lengths)]
    m, v = [np.zeros_like(w), np.zeros_like(trans)], [np.zeros_like(w), np.zeros_like(trans)]
    for step in range(1, steps + 1):
        g_w, g_t = ridge * w, ridge * trans
        for x, n, y in groups:
            marginal, pairs, _ = forward_backward(emissions(x, w), trans, n)
            seen = np.arange(x.shape[1])[None, :] < n[:, None]
            # a document counts once, however many lines it has
            g_w = g_w + np.einsum("dt,dtf->f", (marginal[:, :, 1] - y[:, None]) * seen / n[:, None], x)
            pairs[np.arange(len(y)), y, y] -= n - 1
            g_t = g_t + (pairs / n[:, None, None]).sum(0)
        for i, (p, g) in enumerate(((w, g_w), (trans, g_t))):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.01 * (g * g - v[i])
            p -= 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return {"w": w, "trans": trans}


def line_marginals(model: dict, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: P(good) of its lines, and their weights."""
    found = [features(t) for t in texts]
    lengths = np.array([len(x) for x, _ in found])
    out: list = [None] * len(found)
    for g in by_length(lengths):
        n = lengths[g]
        marginal, _, _ = forward_backward(emissions(padded([found[i][0] for i in g], n.max()), model["w"]), model["trans"], n)
        for k, i in enumerate(g):
            out[i] = (marginal[k, : n[k], 1], found[i][1])
    return out


def quality(text: Column, model: dict, docs_at_once: int = 500) -> Column:
    """Score from 0 to 1 for a text column; null counts as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            own = texts.tolist()
            parts = [line_marginals(model, own[i : i + docs_at_once]) for i in range(0, len(own), docs_at_once)]
            yield pd.Series([float(min(1.0, (p * k).sum() / k.sum())) for part in parts for p, k in part], dtype="float64")

    return score(text)


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on ``sample`` labelled documents at most, none with crc32(doc_id) mod 5 = 0."""
    rows = labelled_sample(docs, labels, "quality", sample, crc_mod(F.col("doc_id"), 5) != 0)
    return fit(rows["text"].tolist(), (rows["y"] > 0).astype(int).to_numpy())


def score_documents(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Per row: id, held_out, score, predicted. Null and empty texts score as one empty line; a null
    id is not held out; repeated rows score alike; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("d_id"), quality(F.col(text_col), model).alias("score"))
    held = F.coalesce(crc_mod(F.col("d_id"), 5) == 0, F.lit(False))
    return rows.select(F.col("d_id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_on(docs, table(spark, sf_dir, "labels")))
