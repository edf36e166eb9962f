"""Conversation structure repair by a dynamic program over a trie of signatures.

A conversation's signature has a symbol per message: the initial of its role and its first fault
(blank, duplicate, truncated, none). Edits keep a message, give it another role, delete it, or insert an
empty one, until the initials of the roles read ``(s?(ua)+)?``; the cheapest edits are wanted, and of
those the ones whose initials (the audit) come first in ASCII.

Distinct signatures are sorted, so that they stand in the order of a prefix trie: one task walks its part of
the trie depth first with the layers of the current path on a stack, keeps the layers of the prefix
that the next signature shares, and answers at terminal nodes. A layer has four states (nothing
yet, after a system, user or assistant message), each with its cost, its last edits, and the
rank of its audit among the four. Inserts are taken right before the message that follows, where the least audit
has them; so audits of a layer end with a message's edit and are told apart before the shorter one ends.

Conversations of any length: rows are sorted by ranges and cut into blocks of bounded size; what a block does
from each state to each state (costs and ranks) carries the path over its ends.
"""

from __future__ import annotations

import functools
import hashlib
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Messages of a block, and characters of it after which it ends.
BLOCK, BLOCK_CHARS = 4096, 1 << 22
WHITE = " \t\n\x0b\x0c\r"
#: Costs: another role, deletion, insertion, and a truncated message that stays.
REROLE, DELETE, INSERT, STAYS = 1, 2, 5, 5
#: States: nothing yet, after a system, user, assistant message; where the next user or assistant message leads.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: Faults; symbols are FIRST + 4 * initial (s, u, a, other) + fault.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
FIRST = ord("A")
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Inserts that make a conversation end well in each state.
TAIL = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


@functools.cache
def step(layer: tuple, symbol: str) -> tuple[tuple, int, tuple]:
    """The layer after one more message, how much its least cost has grown, and per state (state before, edits).

    A layer is (costs less their least, ranks) by state; None and -1 for a state that can't be reached. There
    are few layers, as costs differ by a few edits, so each is computed once per symbol."""
    costs, ranks = layer
    initial, fault = divmod(ord(symbol) - FIRST, 4)
    best: list[tuple | None] = [None] * 4
    for before in range(4):
        if costs[before] is None:
            continue
        moves = [("D", before, DELETE)]
        if fault in (FINE, TRUNCATED):
            stays = STAYS * (fault == TRUNCATED)
            for pre, at, cost in (("", before, stays), ("I", NEXT[before], INSERT + stays)):
                if initial == (2 if at == USER else 1):
                    moves.append((pre + "K", NEXT[at], cost))
                if initial == 0 and at == NOTHING:
                    moves.append((pre + "K", SYSTEM, cost))
                moves.append((pre + "R", NEXT[at], cost + REROLE))
        for edits, after, cost in moves:
            found = (costs[before] + cost, ranks[before], edits, before)
            if best[after] is None or found < best[after]:
                best[after] = found
    order = sorted((b[1], b[2], q) for q, b in enumerate(best) if b)
    rank = {q: i for i, (_, _, q) in enumerate(order)}
    least = min(b[0] for b in best if b)
    after = (tuple(b[0] - least if b else None for b in best), tuple(rank.get(q, -1) for q in range(4)))
    return after, least, tuple((b[3], b[2]) if b else None for b in best)


def starting(state: int) -> tuple:
    return tuple(0 if q == state else None for q in range(4)), tuple(0 if q == state else -1 for q in range(4))


class Trie:
    """Walks sorted signatures; the stack holds the layers of the current path. ``layers`` counts those computed."""

    def __init__(self, start: int) -> None:
        self.start, self.path, self.layers = start, "", 0
        self.stack: list[tuple] = [(starting(start), 0, None)]

    def answer(self, signature: str) -> list[dict]:
        """Per state that can be reached at the signature's end: start, end, cost, rank of the audit among them, audit."""
        shared = len(os.path.commonprefix([self.path, signature]))
        del self.stack[shared + 1 :]
        for symbol in signature[shared:]:
            layer, total, _ = self.stack[-1]
            after, more, back = step(layer, symbol)
            self.stack.append((after, total + more, back))
            self.layers += 1
        self.path = signature
        (costs, ranks), total, _ = self.stack[-1]
        return [{"start": self.start, "end": q, "cost": total + costs[q], "rank": ranks[q], "audit": self.audit(q)} for q in range(4) if costs[q] is not None]

    def audit(self, end: int) -> str:
        edits = []
        for _, _, back in self.stack[:0:-1]:
            end, own = back[end]
            edits.append(own)
        return "".join(reversed(edits))


def joined(blocks: list[list[dict]]) -> tuple[int, list[tuple[int, int]], str]:
    """Of a conversation's blocks (answers without audits) in order: the least cost, each block's first and last state, and
    the inserts at the end."""
    costs, ranks = starting(NOTHING)
    backs = []
    for answers in blocks:
        best: dict[int, tuple] = {}
        for x in answers:
            if costs[x["start"]] is not None:
                found = (costs[x["start"]] + x["cost"], ranks[x["start"]], x["rank"], x["start"])
                best[x["end"]] = min(best.get(x["end"], found), found)
        order = sorted((b[1], b[2], q) for q, b in best.items())
        rank = {q: i for i, (_, _, q) in enumerate(order)}
        costs, ranks = tuple(best[q][0] if q in best else None for q in range(4)), tuple(rank.get(q, -1) for q in range(4))
        backs.append({q: b[3] for q, b in best.items()})
    cost, _, end = min((costs[q] + INSERT * len(TAIL[q]), ranks[q], q) for q in range(4) if costs[q] is not None)
    tail, states = TAIL[end], []
    for back in reversed(backs):
        states.append((back[end], end))
        end = back[end]
    return cost, states[::-1], tail


def diagnosed(conversations: DataFrame) -> DataFrame:
    """(k, turn, role, text, at, symbol) of each message; k is conv_id as text, at the row's place in the table."""
    own = conversations.select(F.col("conv_id").cast("string").alias("k"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], F.monotonically_increasing_id().alias("at"))
    same = F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("k")), F.lit("")), F.lit("\0"), F.col("role"), F.lit("\0"), F.col("text")).cast("binary")))
    rows = stored(own.withColumn("same", same), "messages")
    place = F.struct(F.col("turn").isNotNull().alias("t"), F.coalesce("turn", F.lit(0)).alias("turn"), "at")
    # only messages that repeat are joined; where one repeats very often, the join's skewed parts are split
    again = rows.groupBy("same").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("same", "first")
    end = F.rtrim("text", F.lit(WHITE))
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    fault = F.when(end == "", BLANK).when(F.col("first").isNotNull() & (place != F.col("first")), DUPLICATE).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    return rows.join(again, "same", "left").select("k", "turn", "role", "text", "at", F.char((FIRST + 4 * initial + fault).cast("long")).alias("symbol"))


def cut(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """Blocks of conversations, written: k, block (rises within a conversation), signature, inner (whether the conversation may have
    started before), counts, and roles and texts of the messages that may stay."""
    faults = ("blank", "duplicate", "truncated")
    schema = "k string, block long, inner boolean, signature string, illegal long, blank long, duplicate long, truncated long, low long, high long, turns long, roles array<string>, texts array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out, chars = TaskContext.get().partitionId() << 32, [], 0
        key, held, size, inner = None, [], 0, True

        def block() -> dict:
            signature = "".join(r[3] for r in held)
            initials = [(ord(x) - FIRST) // 4 for x in signature]
            turns = [r[0] for r in held if r[0] is not None]
            stay = [r for r in held if (ord(r[3]) - FIRST) % 4 in (FINE, TRUNCATED)]
            return {
                "k": key[0], "block": number, "inner": inner, "signature": signature, "illegal": sum(x not in LEGAL for x in zip(initials, initials[1:], strict=False)),
                **{name: sum((ord(x) - FIRST) % 4 == i for x in signature) for i, name in enumerate(faults, 1)},
                "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)), "roles": [r[1] for r in stay], "texts": [r[2] for r in stay],
            }

        def batch() -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.string(), *[pa.int64()] * 7, pa.list_(pa.string()), pa.list_(pa.string())]
            names = [c.split()[0] for c in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], t) for n, t in zip(names, kinds, strict=True)], names)

        for rows_ in batches:
            for k, *row in zip(*(c.to_pylist() for c in rows_.columns), strict=True):
                if held and ((k,) != key or len(held) >= block_rows or size >= BLOCK_CHARS):
                    out.append(block())
                    number, inner, held, chars, size = number + 1, (k,) == key, [], chars + size, 0
                    if len(out) >= 1000 or chars >= BLOCK_CHARS:
                        yield batch()
                        out, chars = [], 0
                key = (k,)
                held.append(row)
                size += len(row[2])
        if held:
            out.append(block())
        if out:
            yield batch()

    ordered = rows.orderBy(F.col("k").asc_nulls_first(), F.col("turn").asc_nulls_first(), "at")
    return stored(ordered.select("k", "turn", "role", "text", "symbol").mapInArrow(run, schema), "blocks")


ANSWER = "struct<start:int,end:int,cost:bigint,rank:int,audit:string>"


def answered(blocks: DataFrame) -> DataFrame:
    """(inner, signature, answers) of each distinct signature: from nothing, or from any state if it is an inner one."""
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = {inner: [Trie(s) for s in (range(4) if inner else [NOTHING])] for inner in (False, True)}
        for batch in batches:
            for low in range(0, len(batch), 100):
                own = batch.slice(low, 100)
                answers = [[x for t in tries[inner] for x in t.answer(signature)] for inner, signature in zip(*(c.to_pylist() for c in own.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(answers, pa.list_(kind))], ["inner", "signature", "answers"])

    distinct = blocks.select("inner", "signature").distinct()
    return distinct.orderBy("inner", "signature").mapInArrow(run, f"inner boolean, signature string, answers array<{ANSWER}>")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def planned(blocks: DataFrame) -> DataFrame:
    """Per block, written: k, block, start (state), audit, and the counts of its conversation; the last one's audit has the final inserts."""
    slim = blocks.drop("roles", "texts")
    scored = stored(slim.join(answered(slim), ["inner", "signature"]), "answers")
    ends = [F.substring("signature", 1, 1).alias("head"), F.substring("signature", -1, 1).alias("last")]
    lean = F.transform("answers", lambda x: x.dropFields("audit")).alias("answers")
    own = F.struct("block", "illegal", "blank", "duplicate", "truncated", "low", "high", "turns", *ends, lean)
    met = scored.groupBy("k").agg(F.sort_array(F.collect_list(own)).alias("own"))  # a row per block: BLOCK messages
    initial = lambda x: (ord(x) - FIRST) // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("k", "block", "start", "end", "tail", *COUNTS)}
            for k, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cost, states, tail = joined([x["answers"] for x in own])
                turned = [x for x in own if x["turns"]]
                distinct = sum(x["turns"] for x in turned) - sum(x["high"] == y["low"] for x, y in zip(turned, turned[1:], strict=False))
                illegal = sum(x["illegal"] for x in own) + sum((initial(x["last"]), initial(y["head"])) not in LEGAL for x, y in zip(own, own[1:], strict=False))
                gaps = turned[-1]["high"] - turned[0]["low"] + 1 - distinct if turned else 0
                counts = [gaps, *[sum(x[n] for x in own) for n in ("blank", "duplicate", "truncated")], illegal, cost]
                for x, (start, end) in zip(own, states, strict=True):
                    for name, value in zip(out, (k, x["block"], start, end, tail if x is own[-1] else "", *counts), strict=True):
                        out[name].append(value)
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * len(COUNTS)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    paths = met.mapInArrow(run, "k string, block long, start int, end int, tail string, " + ", ".join(f"{n} long" for n in COUNTS))
    chosen = F.filter("answers", lambda x: (x["start"] == F.col("start")) & (x["end"] == F.col("end")))[0]["audit"]
    return stored(paths.join(scored.select("block", "answers"), "block").select("k", "block", "start", F.concat(chosen, F.col("tail")).alias("audit"), *COUNTS), "plan")


def edited(signature: str, audit: str, start: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of the messages of a block after its edits."""
    kept, symbols, state = zip(roles, texts, strict=True), iter(signature), start
    for edit in audit:
        forced = "assistant" if state == USER else "user"
        if edit == "I":
            yield forced, ""
        else:
            stays = (ord(next(symbols)) - FIRST) % 4 in (FINE, TRUNCATED)
            role, text = next(kept) if stays else (None, None)
            if edit == "D":
                continue
            yield (role if edit == "K" else forced), text
            if edit == "K" and state == NOTHING and role[0] == "s":
                state = SYSTEM
                continue
        state = NEXT[state]


def followed(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """Plan and texts of each block beside each other: sorted by k, block, kind (0: plan, 1: texts)."""
    none = lambda kind: F.lit(None).cast(kind)
    plans = plan.select("k", "block", F.lit(0).alias("kind"), "start", "audit", *COUNTS, none("string").alias("signature"), none("array<string>").alias("roles"), none("array<string>").alias("texts"))
    own = blocks.select("k", "block", F.lit(1).alias("kind"), none("int"), none("string"), *[none("long") for _ in COUNTS], "signature", "roles", "texts")
    return plans.union(own).repartition("k").sortWithinPartitions("k", "block", "kind")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """Of each block in order: its plan, and its messages after the edits."""
    plan: dict = {}
    for batch in batches:
        for at in range(len(batch)):
            row = batch.slice(at, 1).to_pylist()[0]  # a block at a time: texts may be long
            if row["kind"] == 0:
                plan = row
            else:
                yield plan, edited(row["signature"], plan["audit"], plan["start"], row["roles"], row["texts"])


def digests(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """Per conversation: k, the counts, audit, repaired_sha256. SHA-256 reads a conversation in order, so one task
    hashes each, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, audits, digest, lines = None, [], hashlib.sha256(), 0

        def row() -> pa.RecordBatch:
            values = [held["k"], *[held[c] for c in COUNTS], "".join(audits), digest.hexdigest()]
            kinds = [pa.string(), *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["k", *COUNTS, "audit", "repaired_sha256"])

        done, chars = [], 0
        for own, messages in rows_of(batches):
            if held is not None and own["k"] != held["k"]:
                done.append(row())
                chars += sum(map(len, audits))
                audits, digest, lines = [], hashlib.sha256(), 0
                if len(done) >= 1000 or chars >= BLOCK_CHARS:
                    yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                    done, chars = [], 0
            held = own
            audits.append(own["audit"])
            for role, text in messages:
                digest.update((("\n" if lines else "") + f"{role}:{text}").encode())
                lines += 1
        if held is not None:
            done.append(row())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]

    return followed(blocks, plan).mapInArrow(run, "k string, " + ", ".join(f"{n} long" for n in COUNTS) + ", audit string, repaired_sha256 string")


def messages(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """(k, block, nth, role, text): the repaired conversations; block and nth give their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, found in rows_of(batches):
            rows = list(found)
            n = len(rows)
            columns = [pa.array([own["k"]] * n, pa.string()), pa.array([own["block"]] * n, pa.int64()), pa.array(range(n), pa.int64()), *[pa.array([r[i] for r in rows], pa.string()) for i in range(2)]]
            yield pa.RecordBatch.from_arrays(columns, ["k", "block", "nth", "role", "text"])

    return followed(blocks, plan).mapInArrow(run, "k string, block long, nth long, role string, text string")


def repaired(conversations: DataFrame, everyone: DataFrame | None = None, *, block_rows: int = BLOCK) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Messages go by turn, nulls first, and in the order of the table where turns agree. Null roles and texts are one space; a role's initial is its
    first character, and an empty role has one that fits nowhere. Rows without a conv_id form one conversation. A row repeated
    in all columns is a duplicate like any other. ``everyone``: rows of which each conv_id is returned, with zeros, an empty audit and the hash
    of nothing if it has no messages. An empty table gives no rows. Other columns are ignored."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    blocks = cut(diagnosed(conversations), block_rows)
    found = digests(blocks, planned(blocks))
    if everyone is not None:
        every = everyone.select(F.col("conv_id").cast("string").alias("own_k")).distinct()
        found = every.join(found, F.col("own_k").eqNullSafe(F.col("k")), "left").drop("k").withColumnRenamed("own_k", "k")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS]
    return found.select(F.col("k").cast(kind).alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults, by crc32 of ``conv_id:turn`` modulo 20: 0 goes, 1 loses its text, 2 its ends of sentences, 3 stands twice, 4 is the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    own = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), case.alias("case")).filter("case <> 0")
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("case") == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repaired(damaged(conversations), conversations)
