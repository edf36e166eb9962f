"""Language-model scoring: interpolated modified Kneser-Ney, order 2.

Counting: tasks hash words to 64 bits, sum bigrams per Arrow batch, and a shuffle by the context's
hash brings each bigram together. Bigrams of frequent contexts (by a sample of the texts, and the start
of a text) are dealt by the hash of both words instead, and what is known of such a context is summed
over the parts. Every part of the hash range is then sorted and written to the shared folder as plain
arrays: bigram hashes and counts, contexts and their statistics, and, after a second, smaller shuffle,
words with their counts and continuation counts.

Scoring: workers memory-map those arrays and look up the distinct bigrams of a block of documents
by binary search. Only a handful of sums (discounts, totals) pass through the driver.

Files are written under a temporary name and renamed, so a task that runs twice does no harm. A
shared folder that isn't mounted is read through a local copy of the parts that a worker needs.
"""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, shared_dir, stored, table
from .dedup import AZ, MIX, WORDS, WordHashes, scramble

#: Hashes of the start context and of the end token; 64-bit hashes of words practically never meet them.
START = np.uint64(0x5354415254)
END = np.uint64(0x454E44)
BLOCK = 2000
#: Texts that frequent contexts are found on, about; which ones are found decides where bigrams are counted, not how.
SAMPLE = 2_000
STATS = ("total", "n1", "n2", "n3")


def tokens(texts: list[str | None], hashes: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of ``texts`` and of their contexts; the number of tokens of each text."""
    n, flat = np.empty(len(texts), dtype=np.int64), []
    for i, text in enumerate(texts):
        words = WORDS.findall((text or "").encode("utf-8", "replace").translate(AZ))
        n[i] = len(words) + 1
        flat.append(np.fromiter((hashes[w] for w in words), dtype=np.uint64, count=len(words)))
        flat.append(np.array([END]))
    v = np.concatenate(flat) if flat else np.zeros(0, dtype=np.uint64)
    u = np.empty_like(v)
    if len(v):
        u[1:] = v[:-1]
        u[np.cumsum(n) - n] = START
    return u, v, n


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return scramble(scramble(u * MIX[0] + MIX[1]) + v)


def part_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), dtype=np.int32)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows in sorted arrays."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def put(folder: str, name: str, **arrays: np.ndarray) -> None:
    where, path = fs.FileSystem.from_uri(folder)
    for key, value in arrays.items():
        out = io.BytesIO()
        np.save(out, value)
        temporary = f"{path}/.{uuid.uuid4().hex}"
        with where.open_output_stream(temporary) as f:
            f.write(out.getbuffer())
        where.move(temporary, f"{path}/{name}-{key}.npy")


def among(keys: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``keys`` are in the sorted array ``some``, and where."""
    if not len(some):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    at = np.minimum(np.searchsorted(some, keys), len(some) - 1)
    return some[at] == keys, at


def route(u: np.ndarray, v: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What decides the part of a bigram."""
    return np.where(among(u, hot)[0], pair_hash(u, v), scramble(u))


_maps: dict[str, np.ndarray | None] = {}


def get(folder: str, name: str, key: str) -> np.ndarray | None:
    """A memory-mapped array, None if no part of that name was written."""
    full = f"{folder}/{name}-{key}.npy"
    if full not in _maps:
        if _maps and not next(iter(_maps)).startswith(folder):
            _maps.clear()  # of another model
        where, path = fs.FileSystem.from_uri(full)
        if where.get_file_info(path).type == fs.FileType.NotFound:
            _maps[full] = None
        elif isinstance(where, fs.LocalFileSystem):
            _maps[full] = np.load(path, mmap_mode="r")
        else:
            handle, local = tempfile.mkstemp(suffix=".npy")
            with where.open_input_stream(path) as source, os.fdopen(handle, "wb") as f:
                f.write(source.read())
            _maps[full] = np.load(local, mmap_mode="r")
            os.unlink(local)
    return _maps[full]


def find(folder: str, kind: str, bits: int, route: np.ndarray, keys: np.ndarray, fields: dict[str, type]) -> dict[str, np.ndarray]:
    """For each of ``keys``, the named values beside it in the part that ``route`` falls in; 0 if absent."""
    out = {f: np.zeros(len(keys), dtype=t) for f, t in fields.items()}
    parts = part_of(route, bits)
    order = np.lexsort((keys, parts))
    bounds = np.searchsorted(parts[order], np.arange((1 << bits) + 1))
    for p in np.unique(parts):
        rows = order[bounds[p] : bounds[p + 1]]
        have = get(folder, f"{kind}-{p}", "key")
        if have is None or not len(have):
            continue
        at = np.minimum(np.searchsorted(have, keys[rows]), len(have) - 1)
        hit = np.asarray(have[at]) == keys[rows]
        for f in fields:
            out[f][rows[hit]] = get(folder, f"{kind}-{p}", f)[at[hit]]
    return out


def find_words(folder: str, kind: str, bits: int, words: np.ndarray, fields: dict[str, type]) -> dict[str, np.ndarray]:
    """``find`` for words or contexts, which repeat: each distinct one is looked up once."""
    some, back = np.unique(words, return_inverse=True)
    return {f: x[back] for f, x in find(folder, kind, bits, scramble(some), some, fields).items()}


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen once, twice, three and four times; fixed ones where
    none are seen once, or none twice, and the estimates aren't defined."""
    if min(n[:2]) <= 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(k, max(0.1, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]


def cut(count: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3).astype(np.int64)]


def frequent(texts: DataFrame, n_parts: int) -> np.ndarray:
    """Sorted hashes of the contexts with over a quarter of a part's share of the tokens of a sample, at
    most 4 * n_parts, and of the start of a text."""
    every = max(1, texts.count() // SAMPLE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            u, n = np.unique(tokens(batch.column(0).to_pylist(), hashes)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["u", "n"])

    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).mapInArrow(count, "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))
    some = stored(some, "lm-sample")
    total = some.agg(F.sum("n")).first()[0] or 0
    rows = some.filter(F.col("n") * 4 * n_parts > total).collect()
    return np.unique(np.array([START, *[np.int64(r["u"]).view(np.uint64) for r in rows]], dtype=np.uint64))


def train(docs: DataFrame, *, text_col: str = "text") -> dict:
    """Count all rows of ``docs`` and write the model; returns what is needed to score with it."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/xorweave-lm-{uuid.uuid4().hex}"
    if not re.match(r"\w+:", folder):
        folder = "file://" + folder
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path)
    texts = docs.select(F.col(text_col).alias("text"))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * texts.rdd.getNumPartitions())
    bits = int(np.ceil(np.log2(n_parts)))
    n_parts = 1 << bits
    hot = frequent(texts, n_parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            u, v, _ = tokens(batch.column(0).to_pylist(), hashes)
            order = np.lexsort((v, u))
            u, v = u[order], v[order]
            at = runs(u, v) if len(u) else np.zeros(0, dtype=np.int64)
            n = np.diff(np.append(at, len(u)))
            u, v = u[at], v[at]
            yield pa.RecordBatch.from_arrays([pa.array(part_of(route(u, v, hot), bits)), pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(n)], ["part", "u", "v", "n"])

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[np.asarray(c) for c in b.columns] for b in batches if len(b)]
        if not got:
            return
        part, u, v, n = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        u, v = u.view(np.uint64), v.view(np.uint64)
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            mine = mine[np.lexsort((v[mine], u[mine]))]
            pu, pv, pn = u[mine], v[mine], n[mine]
            at = runs(pu, pv)
            pn, pu, pv = np.add.reduceat(pn, at), pu[at], pv[at]
            at = runs(pu)
            stats = {"total": np.add.reduceat(pn, at), **{f"n{k}": np.add.reduceat((np.minimum(pn, 3) == k).astype(np.int64), at) for k in (1, 2, 3)}}
            own, shared = pu[at], among(pu[at], hot)[0]
            put(folder, f"context-{p}", key=own[~shared], **{f: x[~shared] for f, x in stats.items()})
            for i, f in enumerate(STATS):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(shared.sum(), 2 + i, dtype=np.int32), own[shared].view(np.int64), stats[f][shared], np.zeros(shared.sum(), dtype=np.int64))], ["kind", "w", "c", "cont"])
            h = pair_hash(pu, pv)
            order = np.argsort(h, kind="stable")
            put(folder, f"pair-{p}", key=h[order], n=pn[order].astype(np.uint32) if pn.max() < 2**32 else pn[order])
            order = np.argsort(pv, kind="stable")
            pv, pn = pv[order], pn[order]
            at = runs(pv)
            words = [np.zeros(len(at), dtype=np.int32), pv[at].view(np.int64), np.add.reduceat(pn, at), np.diff(np.append(at, len(pv)))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in words], ["kind", "w", "c", "cont"])
            of = np.bincount(np.minimum(pn, 5), minlength=6)[1:5]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.ones(4, dtype=np.int32), np.arange(1, 5), of, np.zeros(4, dtype=np.int64))], ["kind", "w", "c", "cont"])

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[np.asarray(c) for c in b.columns] for b in batches if len(b)]
        if not got:
            return
        part, w, c, cont = (np.concatenate(x) for x in zip(*got, strict=True))
        w = w.view(np.uint64)
        for p in np.unique(part):
            mine = np.flatnonzero(part == p)
            mine = mine[np.argsort(w[mine])]
            put(folder, f"word-{p}", key=w[mine], c=c[mine], cont=cont[mine])
        of = np.bincount(np.minimum(cont, 5), minlength=6)[1:6]
        sums = np.array([len(w), c.sum(), cont.sum(), *of], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in sums], ["v", "n", "pairs", "k1", "k2", "k3", "k4", "k5"])

    counted = texts.mapInArrow(count, "part int, u long, v long, n long").repartitionById(n_parts, "part")
    rows = stored(counted.mapInArrow(write_pairs, "kind int, w long, c long, cont long"), "lm")
    n2 = {r["w"]: r["c"] for r in rows.filter("kind = 1").groupBy("w").agg(F.sum("c").alias("c")).collect()}
    known = {(r["kind"], r["w"]): r["c"] for r in rows.filter("kind >= 2").groupBy("kind", "w").agg(F.sum("c").alias("c")).collect()}  # of the frequent contexts
    of_hot = {f: np.array([known.get((2 + i, int(w)), 0) for w in hot.view(np.int64)], dtype=np.int64) for i, f in enumerate(STATS)}
    words = rows.filter("kind = 0").groupBy("w").agg(F.sum("c").alias("c"), F.sum("cont").alias("cont"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(part_of(scramble(np.asarray(b.column(0)).view(np.uint64)), bits)), *b.columns], ["part", "w", "c", "cont"])

    placed = words.mapInArrow(place, "part int, w long, c long, cont long").repartitionById(n_parts, "part")
    fields = ["v", "n", "pairs", "k1", "k2", "k3", "k4", "k5"]
    sums = stored(placed.mapInArrow(write_words, ", ".join(f"{f} long" for f in fields)), "lm-sums").agg(*[F.sum(f).alias(f) for f in fields]).first()
    t = {f: int(sums[f] or 0) for f in fields}
    d1 = discounts([t["k1"], t["k2"], t["k3"], t["k4"]])
    spread = (d1[0] * t["k1"] + d1[1] * t["k2"] + d1[2] * (t["k3"] + t["k4"] + t["k5"])) / t["pairs"] if t["pairs"] else 1.0
    return {"folder": folder, "bits": bits, "words": t["v"], "tokens": t["n"], "pairs": t["pairs"], "d1": d1, "d2": discounts([int(n2.get(k, 0)) for k in (1, 2, 3, 4)]), "spread": spread, "hot": hot, "of_hot": of_hot}


def score_block(model: dict, texts: list[str | None], hashes: dict) -> tuple[np.ndarray, ...]:
    """Of each text: tokens, known tokens, base score, score."""
    u, v, n = tokens(texts, hashes)
    folder, bits = model["folder"], model["bits"]
    h = pair_hash(u, v)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    du, dv, dh = u[first], v[first], h[first]
    word = find_words(folder, "word", bits, dv, {"c": np.int64, "cont": np.int64})
    context = find_words(folder, "context", bits, du, dict.fromkeys(STATS, np.int64))
    shared, at = among(du, model["hot"])
    for f in STATS:
        context[f][shared] = model["of_hot"][f][at[shared]]
    pair = find(folder, "pair", bits, route(du, dv, model["hot"]), dh, {"n": np.int64})["n"]
    p = np.maximum(word["cont"] - cut(word["cont"], model["d1"]), 0) / max(1, model["pairs"]) + model["spread"] / (model["words"] + 1)
    d = model["d2"]
    total = np.maximum(context["total"], 1)
    left = (d[0] * context["n1"] + d[1] * context["n2"] + d[2] * context["n3"]) / total
    p = np.where(context["total"] > 0, np.maximum(pair - cut(pair, d), 0) / total + left * p, p)
    base = np.log10((word["c"] + 1) / (model["tokens"] + model["words"] + 1))
    at = np.cumsum(n) - n
    add = lambda x: np.add.reduceat(x[back], at)
    return n, add((word["c"] > 0).astype(np.int64)), add(base), add(np.log10(p))


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, base_score, score (log10 probabilities of the whole text),
    perplexity. Null and empty texts consist of the end token; repeated rows score alike; an empty
    training table gives every token the same probability; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                columns = score_block(model, part.column(1).to_pylist(), hashes)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x) for x in columns]], ["s_id", "n_tokens", "n_known", "base_score", "score"])

    own = docs.select(F.col(id_col).alias("s_id"), F.col(text_col).alias("text"))
    kind = own.schema["s_id"].dataType.simpleString()
    out = own.mapInArrow(run, f"s_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("s_id").alias(id_col), "n_tokens", "n_known", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    model = train(docs.filter(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
