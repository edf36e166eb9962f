"""Byte-level byte-pair encoding and decoding.

A word (a match of the tokenizer's pattern) starts as single bytes; as long as some pair of
neighbours joined is in the vocabulary, the leftmost pair of the lowest rank is joined.

* The DICTIONARY most frequent words of the whole corpus (counted exactly) are encoded by Spark
  higher-order functions: ``aggregate`` folds the merges over an array of piece ids, looking ranks
  up in one flat array, a hash table of packed numbers, which is broadcast as a row.
* The result, of bounded size, goes to the tasks that encode the documents. The rarer words are
  merged there by the same rule, many words at a time; see the README for what folding all of them
  would cost.
* No match of PATTERN goes from what isn't white space on to a blank, so Arrow splits texts there, and
  PATTERN runs once per distinct span of some MB of text. Another pattern runs over whole texts.
* Decoding maps ids to their pieces and joins them, in Spark expressions.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
#: Words of the dictionary, and the bytes that one of them has at most.
DICTIONARY = 65_536
LONGEST = 32
#: Odd multipliers of the two slots of a key in the literal.
MULTIPLIERS = (5_308_871, 7_654_321)
#: What a span can't end with if another follows: white space as PATTERN has it, or nothing.
OPEN = pa.array(["", *(c for c in map(chr, range(0xD800)) if regex.match(r"\s", c))])
#: Bytes of text that a task cuts at once (or one text), and rows that it then yields at once.
CUT = 1 << 21
YIELD = 500
#: Greater than any rank; times PLACES, it is a 32-bit number still.
NONE = 1 << 24
PLACES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Pairs:
    """The merges as arrays: ids of a left and a right piece (as left * size + right, sorted), and the id of both joined."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.pieces, self.piece_ids = pa.array(list(ranks), pa.binary()), np.array(list(ranks.values()), dtype=np.int32)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        joined = {ranks[w[:i]] * self.size + ranks[w[i:]]: r for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks}
        self.keys = np.array(sorted(joined), dtype=np.int64)
        self.ids = np.array([joined[k] for k in self.keys.tolist()], dtype=np.int64)
        self.shift = int(self.ids.max(initial=0)).bit_length()
        self.slots = np.array(slots_of(self.keys.tolist(), self.ids.tolist()), dtype=np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where they don't join, or where one is missing (-1)."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -2)
        out = np.full(key.shape, NONE)
        for which in (0, 1):
            entry = self.slots[slot(key, which, len(self.slots))]
            np.copyto(out, entry & (1 << self.shift) - 1, where=entry >> self.shift == key)
        return out


def slots_of(keys: list[int], values: list[int]) -> list[int]:
    """An open hash table as one flat list: each key stands, packed with its value, in one of the two
    slots that ``slot`` names; -1 is an empty slot."""
    size = 1 << max(2, (3 * len(keys)).bit_length())
    shift = max(values, default=0).bit_length()
    out = [-1] * size
    for entry in (k << shift | v for k, v in zip(keys, values, strict=True)):
        at = slot(entry >> shift, 0, size)
        for _ in range(500):
            entry, out[at] = out[at], entry
            if entry < 0:
                break
            first, second = (slot(entry >> shift, n, size) for n in (0, 1))
            at = second if at == first else first
        else:
            raise ValueError("the hash table is too full")
    return out


def slot(key: Column | int | np.ndarray, which: int, size: int) -> Column | int | np.ndarray:
    """One of the two slots of a key below 2**40, for columns and numbers alike."""
    x = key * MULTIPLIERS[which]
    if isinstance(key, Column):
        return F.shiftright(x, 16).bitwiseAND(F.lit(size - 1))
    return x >> 16 & size - 1


class Ranks:
    """The merges as a flat hash table of packed numbers made in plain Python, as one Spark literal, and the pieces; each made when it is asked for."""

    def __init__(self, pairs: Pairs) -> None:
        self.pairs, self.size, self.shift, self.numbers = pairs, pairs.size, pairs.shift, pairs.slots
        self.bytes = F.from_json(F.lit(json.dumps(pairs.bytes.tolist())), "array<int>")

    @property
    def table(self) -> Column:
        """As a literal. It stands in the plan, which the driver prints and sends for every stage: for much work, see ``row``."""
        return F.from_json(F.lit(json.dumps(self.numbers.tolist(), separators=(",", ":"))), "array<bigint>")

    def row(self, spark: SparkSession) -> DataFrame:
        """One row (ranks) that holds the table."""
        ends = pa.array([0, len(self.numbers)], pa.int32())
        return spark.createDataFrame(pa.table({"ranks": pa.ListArray.from_arrays(ends, pa.array(self.numbers))}))

    @functools.cached_property
    def pieces(self) -> Column:
        pieces = [piece.decode("latin-1") for piece, _ in sorted(self.pairs.ranks.items(), key=lambda x: x[1])]
        return F.from_json(F.lit(json.dumps(pieces)), "array<string>")

    def of(self, table_: Column, left: Column, right: Column) -> Column:
        """Rank of a pair of pieces given by their ids, which is the id of both joined; NONE where they don't join."""
        entry = lambda k, n: F.get(table_, slot(k, n, len(self.numbers)))
        is_of = lambda e, k: F.shiftright(e, self.shift) == k
        value = lambda e: e.bitwiseAND(F.lit((1 << self.shift) - 1)).cast("int")
        other = lambda k: let(entry(k, 1), lambda e: F.when(is_of(e, k), value(e)).otherwise(F.lit(NONE)))
        found = lambda k: let(entry(k, 0), lambda e: F.when(is_of(e, k), value(e)).otherwise(other(k)))
        return let(left.cast("long") * F.lit(self.size).cast("long") + right, found)


def fold_word(word: Column, ranks: Ranks, table_: Column | None = None) -> Column:
    """array<int>: the ids of a string column's words, by ``table_`` (a column of ``Ranks.row``) or the literal, which stands in the plan once."""
    none = F.array().cast("array<int>")

    def fold(table_: Column) -> Column:
        def join_at(s: Column, i: Column, x: Column) -> Column:
            p, r = s["p"], s["r"]
            left = F.when(i > 1, F.array(ranks.of(table_, F.get(p, i - 2), x))).otherwise(none)
            right = F.when(i < F.size(p) - 1, F.array(ranks.of(table_, x, F.get(p, i + 1)))).otherwise(none)
            before, after = F.slice(r, 1, F.greatest(i - 2, F.lit(0))), F.slice(r, i + 2, F.size(p))
            return F.struct(F.concat(F.slice(p, 1, i - 1), F.array(x), F.slice(p, i + 2, F.size(p))).alias("p"), F.concat(before, left, right, after).alias("r"))

        def merge(s: Column, _: Column) -> Column:
            at = lambda low: F.array_position(s["r"], low).cast("int")
            return let(F.coalesce(F.array_min(s["r"]), F.lit(NONE)), lambda low: F.when(low >= NONE, s).otherwise(let(at(low), lambda i: join_at(s, i, low))))

        pairs = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c)), lambda a, b: ranks.of(table_, a, b))
        state = lambda c: F.struct(c.alias("p"), F.when(F.size(c) > 1, pairs(c)).otherwise(none).alias("r"))
        chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        start = let(ranks.bytes, lambda b: F.transform(chars, lambda x: F.get(b, F.ascii(x))))
        return let(start, lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c)), state(c), merge)["p"])

    return let(ranks.table if table_ is None else table_, fold)


def merged(word: bytes, ranks: dict[bytes, int]) -> np.ndarray:
    """The ids of one word of any length: the pairs wait in a heap, by rank and place."""
    p: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(p) + 1)), list(range(-1, len(p) - 1))
    wait = [(r, i, 2) for i, (a, b) in enumerate(zip(p, p[1:], strict=False)) if (r := ranks.get(a + b)) is not None]
    heapq.heapify(wait)
    while wait:
        _, i, length = heapq.heappop(wait)
        j = after[i]
        if p[i] is None or j >= len(p) or len(p[i]) + len(p[j]) != length:
            continue  # one of the two has been joined with another piece since
        p[i], p[j], after[i] = p[i] + p[j], None, after[j]
        if after[i] < len(p):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < len(p) and (r := ranks.get(p[k] + p[after[k]])) is not None:
                heapq.heappush(wait, (r, k, len(p[k]) + len(p[after[k]])))
    return np.array([ranks[x] for x in p if x is not None], dtype=np.int32)


def merged_rows(raw: np.ndarray, pairs: Pairs) -> pa.ListArray:
    """The ids of words of one length of at most PLACES bytes, each a column of ``raw``: all words join one pair at a time."""
    width, n = raw.shape
    rows = np.arange(width, dtype=np.int32)[:, None]
    packed = lambda rank, place: (rank * PLACES + place).astype(np.int32)  # noqa: E731  (the leftmost of the lowest rank is the least)
    p = np.vstack([pairs.bytes[raw], np.full((1, n), -1)])  # the last row stands for a neighbour that is missing
    r = np.full((width + 1, n), NONE * PLACES, dtype=np.int32)
    r[: width - 1] = packed(pairs.of(p[: width - 1], p[1:width]), rows[:-1])
    before, after = np.repeat(np.vstack([rows - 1, [[0]]]), n, 1), np.repeat(rows + 1, n, 1)
    while True:
        low = r[:width].min(0)
        word = np.flatnonzero(low < NONE * PLACES)
        if not len(word):
            break
        rank, at = np.divmod(low[word].astype(np.int64), PLACES)
        right, left = after[at, word], before[at, word]
        beyond = after[right, word]
        p[at, word], p[right, word], r[right, word] = rank, -1, NONE * PLACES
        after[at, word], before[beyond, word] = beyond, at
        r[at, word] = packed(pairs.of(rank, p[beyond, word]), at)
        r[left, word] = packed(pairs.of(p[left, word], rank), left)
    p = p[:width].T
    return lists_of((p >= 0).sum(1), p[p >= 0])


def lists_of(sizes: np.ndarray | list[int], values: np.ndarray) -> pa.ListArray:
    """array<int>: ``values`` in lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def merged_lists(words: pa.Array, pairs: Pairs, rows: int = 16384) -> pa.ListArray:
    """The ids of each word (binary); a word that is in the vocabulary is one piece, an empty one none."""
    if not len(words):
        return lists_of([], [])
    size = pc.binary_length(words).to_numpy()
    whole, base = pc.index_in(words, value_set=pairs.pieces).fill_null(-1).to_numpy(), len(pairs.piece_ids) + 1
    where = np.where(size > 0, whole, base - 1).astype(np.int64)
    out = [lists_of([*[1] * (base - 1), 0], pairs.piece_ids)]
    starts, data = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset :], np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    short = np.flatnonzero((where < 0) & (size <= LONGEST))
    short = short[np.argsort(size[short], kind="stable")]
    for same in np.split(short, np.flatnonzero(np.diff(size[short])) + 1):
        for own in np.split(same, range(rows, len(same), rows)):
            if len(own):
                out.append(merged_rows(data[starts[own] + np.arange(size[own[0]])[:, None]], pairs))
                where[own] = base + np.arange(len(own))
                base += len(own)
    for i in np.flatnonzero(where < 0).tolist():
        ids = merged(words[i].as_py(), pairs.ranks)
        out.append(lists_of([len(ids)], ids))
        where[i] = base
        base += 1
    return pa.concat_arrays(out).take(pa.array(where))


def merged_all(words: list[bytes], pairs: Pairs, rows: int = 16384) -> list[bytes]:
    """The ids of each word, as bytes of int32."""
    return [np.array(ids, dtype=np.int32).tobytes() for ids in merged_lists(pa.array(words, pa.binary()), pairs, rows).to_pylist()]


def spans_of(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, list[str]]:
    """Cuts texts into spans that no match of PATTERN crosses: a blank after what isn't white space starts one.

    As most spans are a blank and a word that holds none, only what stands after the blank is given for
    the distinct ones of these (the first result). Other distinct spans follow: the first of each text,
    and those that hold more white space or end in it. The second and third result are the spans of all
    texts, as indices into both, and where each text's spans end; the last is the other spans, as they are.
    """
    parts = pc.split_pattern(texts, " ")
    ends = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()
    coded = parts.flatten().dictionary_encode()
    at, kinds = coded.indices.to_numpy(), coded.dictionary
    open_ = pc.is_in(pc.utf8_slice_codeunits(kinds, -1, None), value_set=OPEN).to_numpy(zero_copy_only=False)
    opens = open_[at]
    first = np.zeros(len(at), dtype=bool)
    first[[0, *ends[:-1]]] = True
    start = first.copy()
    start[1:] |= ~opens[:-1]
    begins = np.flatnonzero(start)
    size = np.diff(begins, append=len(at))
    other = first[begins] | opens[begins]
    pieces, done, strings = kinds.take(pa.array(at[np.repeat(other, size)])).to_pylist(), 0, []
    for n, leads in zip(size[other].tolist(), first[begins[other]].tolist(), strict=True):
        strings.append(" " * (not leads) + " ".join(pieces[done : done + n]))
        done += n
    others = pa.array(strings, pa.string()).dictionary_encode()
    number = np.cumsum(~open_) - 1
    spans = number[at[begins]]
    spans[other] = (~open_).sum() + others.indices.to_numpy()
    return kinds.filter(pa.array(~open_)), pa.array(spans, pa.int32()), np.cumsum(start)[ends - 1], others.dictionary.to_pylist()


class Words:
    """The words of texts: ``texts`` has each text's spans, ``spans`` each distinct span's words (lists of indices),
    ``words`` the distinct words."""

    def __init__(self, texts: pa.Array, pattern: str) -> None:
        find = regex.compile(pattern).findall
        if pattern == PATTERN:
            plain, spans, ends, others = spans_of(texts)
        else:
            whole = texts.dictionary_encode()
            plain, spans, ends, others = texts[:0], whole.indices, np.arange(1, len(texts) + 1), whole.dictionary.to_pylist()
        # each starts at a blank, and none has another
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), " ")[0].as_py()
        words = find(" " + joined) if len(plain) else []
        n, more = len(words), [find(span) for span in others]
        words.extend(chain.from_iterable(more))
        coded = pa.array(words, pa.string()).dictionary_encode()
        del joined, words
        leads = pc.starts_with(coded.dictionary, " ").take(coded.indices[:n]).to_numpy(zero_copy_only=False)  # only a plain span's first word has a blank
        starts = np.concatenate([np.flatnonzero(leads), n + np.cumsum([0, *map(len, more)])])
        self.texts = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), spans)
        self.spans = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), coded.indices)
        self.words = coded.dictionary

    def counts(self) -> np.ndarray:
        """How often each of ``words`` stands in all texts."""
        times = np.bincount(self.texts.values.to_numpy(), minlength=len(self.spans))
        return np.bincount(self.spans.values.to_numpy(), np.repeat(times, self.spans.value_lengths().to_numpy()), len(self.words)).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, some CUT bytes of strings of a column at once; nulls become empty, and no batch is empty."""
    for batch in batches:
        texts = batch.column(column).cast(pa.string()).fill_null("")
        whole = batch.set_column(column, batch.schema.names[column], texts)
        part = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // CUT
        for own in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(part)) + 1):
            if len(own):
                yield whole.slice(own[0], len(own))


def inlined(lists: pa.ListArray, of: pa.ListArray) -> pa.ListArray:
    """Lists of indices, with the lists of ``of`` in place of the indices."""
    taken = of.take(lists.flatten())
    return pa.ListArray.from_arrays(taken.offsets.take(pc.subtract(lists.offsets, lists.offsets[0])), taken.values)


def dictionary(texts: DataFrame, ranks: Ranks, pattern: str, size: int = DICTIONARY) -> DataFrame:
    """(word, ids) of the most frequent words of all rows of ``texts`` (one string column): at most
    ``size``, all that occur more often than some number."""

    def rows_of(slice_: pa.Array) -> pa.RecordBatch:
        found = Words(slice_, pattern)
        rows = pa.RecordBatch.from_arrays([found.words, pa.array(found.counts())], ["word", "n"])
        return rows.filter(pc.and_(pc.less_equal(pc.binary_length(rows["word"]), LONGEST), pc.greater(rows["n"], 0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            yield rows_of(batch.column(0))

    counts = stored(texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    spark = texts.sparkSession
    parts = 2 * spark.sparkContext.defaultParallelism
    words = counts.filter(F.col("n") > rare_up_to(counts, size)).select("word", F.pmod(F.hash("word"), F.lit(8 * parts)).alias("group"))
    # the table is copied for each row that it is joined to, so a row holds many words
    groups = words.repartition(parts, "group").groupBy("group").agg(F.collect_list("word").alias("words")).crossJoin(F.broadcast(ranks.row(spark)))
    return groups.select(F.inline(F.transform("words", lambda w: F.struct(w.alias("word"), fold_word(w, ranks, F.col("ranks")).alias("ids")))))


def rare_up_to(counts: DataFrame, size: int, parts: int = 4096) -> int:
    """The least number that at most ``size`` rows of ``counts`` (n) exceed, from histograms of at most
    ``parts`` bars, each within the bar that the one before has found."""
    low, high = 0, (counts.agg(F.max("n")).first()[0] or 0) + 1  # more than low: too many, perhaps; more than high - 1: few enough
    above = 0
    while True:
        step = -(-(high - low) // parts)
        bars = counts.filter((F.col("n") > low) & (F.col("n") < high)).groupBy(F.expr(f"(n - {low} - 1) div {step}").alias("bar")).count().collect()
        for bar, rows in sorted(map(tuple, bars), reverse=True):
            if above + rows > size:
                low, high = low + bar * step, min(high, low + bar * step + step + 1)
                break
            above += rows
        else:
            return low
        if step == 1:
            return high - 1


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Per row of ``docs``: its id and ``ids`` array<int>. Null and empty texts have no ids; repeated
    rows encode alike; other columns are ignored."""
    return encoded(docs, Ranks(Pairs(read_ranks(ranks_path))), id_col, text_col, pattern)


def id_bytes(words: pa.Table) -> dict[str, bytes]:
    """The ids of each word of (word, ids), as bytes of int32."""
    known = {}
    for batch in words.to_batches():
        ids = batch.column("ids")
        flat, ends = ids.flatten().to_numpy().astype(np.int32).tobytes(), (4 * ids.value_lengths().to_numpy().cumsum()).tolist()
        known.update((w, flat[a:b]) for w, a, b in zip(batch.column("word").to_pylist(), [0, *ends], ends, strict=False))
    return known


def encoded(docs: DataFrame, ranks: Ranks, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """``encode`` by ranks that have been read."""
    texts = docs.select(F.col(text_col).alias("text"))
    known = id_bytes(dictionary(texts, ranks, pattern).toArrow())  # at most DICTIONARY rows of LONGEST bytes
    shared = docs.sparkSession.sparkContext.broadcast((ranks.pairs, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, known = shared.value
        frequent, ids = pa.array(known, pa.string()), lists_of([len(x) // 4 for x in known.values()], np.frombuffer(b"".join(known.values()), dtype=np.int32))

        def encode_slice(texts: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:  # what it needs besides goes before the next slice comes
            found = Words(texts, pattern)
            where = pc.index_in(found.words, value_set=frequent)
            rare = where.is_null().to_numpy(zero_copy_only=False)
            where = np.where(rare, len(frequent) + np.cumsum(rare) - 1, where.fill_null(0).to_numpy())
            all_ids = pa.concat_arrays([ids, merged_lists(found.words.filter(pa.array(rare)).cast(pa.binary()), pairs)])
            return found.texts, inlined(found.spans, all_ids.take(pa.array(where)))

        for batch in slices(batches, 1):
            texts, by_span = encode_slice(batch.column(1))
            for start in range(0, len(batch), YIELD):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, YIELD), inlined(texts.slice(start, YIELD), by_span)], ["b_id", "ids"])
            del texts, by_span

    own = docs.select(F.col(id_col).alias("b_id"), F.col(text_col).alias("text"))
    kind = own.schema["b_id"].dataType.simpleString()
    return own.mapInArrow(run, f"b_id {kind}, ids array<int>").select(F.col("b_id").alias(id_col), "ids")


def decoded(ids: Column, ranks: Ranks) -> Column:
    """binary: the pieces of an array<int> column's ids, joined."""
    return F.encode(F.array_join(F.transform(ids, lambda i: F.element_at(ranks.pieces, i + 1)), ""), "ISO-8859-1")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ranks = Ranks(Pairs(read_ranks(RANKS)))
    ids = F.col("ids")
    text = F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")
    return encoded(docs, ranks).select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2(decoded(ids, ranks), 256).alias("decoded_sha256")
    )
