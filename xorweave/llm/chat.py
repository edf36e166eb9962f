"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

The hidden state of a line is its speaker (system, user, assistant) and whether the line starts a
turn or goes on with one. What is seen of a line is the kind of marker at its start (of each role, a
marker of no known role, none, a blank line) and a few traits. A transcript keeps one style: a first pass
settles which form (sign in front, brackets, words for user and assistant) its markers have, and what looks
like a marker of another form is text. The tables of the model are counted on
a bounded sample of conversations, written out in each of STYLES. Viterbi finds the likeliest states;
the markers of the transcript's style are cut off lines that start a turn, nothing else is (a name stays, as it may
be text), and each turn is rendered the same way.

``format_chats`` takes a transcript per row. ``format_messages`` takes conversations as rows of
messages, of any number. Conversations of up to RANGE messages are shuffled by their id, once. The
sorted rows of longer ones are dealt to ranges, and where a conversation runs over the end of a range,
the best scores from each state to each state (a 6 x 6 table per range) carry the path over, so that
the result doesn't depend on where the ranges end; what settles their style is counted before.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, stored, table

ROLES = ("system", "user", "assistant")
#: States: role r starts a turn (r), or goes on with it (r + 3).
N_STATES = 6
#: A marker has its brackets on both sides, or a colon; one letter needs the colon.
MARKER = re.compile(
    r"^\s*(?:(?P<sign>[#>*\-]+)\s*)?(?:(?P<open>\[|\(|<\|?)\s*)?(?:(?P<system>system|instructions?|context)|(?P<user>user|human|customer|question|q|me|you)|(?P<assistant>assistant|bot|ai|model|agent|answer|a)|(?P<other>[a-z][\w ]{0,14}))\s*(?(open)(?:\|?>|\]|\))\s*:?|:)[*\s]*", re.I
)
#: Words for user and assistant that a transcript has together; any word for system goes with each. Those of SAME stand for each other.
SAME = frozenset(("user", "human"))
#: Names of a transcript without known roles, at most, besides the first line's.
NAMES_MOST = 8
PAIRS = tuple((u, a) for users, others in (("user human customer you me", "assistant bot ai model agent"), ("question", "answer"), ("q", "a")) for u in users.split() for a in others.split())
LIST = re.compile(r"\s*(?:[-*\u2022]|\w{1,3}[.)])\s")
KINDS, TRAITS = 6, 8
#: Share of what a state is taken to show that the sample doesn't tell, at least; a small sample leaves more open.
UNSEEN = 0.002
#: Rows (messages) that the tables are counted on, at most, and characters of each.
SAMPLE, SAMPLE_CHARS = 20_000, 20_000
#: Messages of a conversation that they are counted on, at most.
SAMPLE_TURNS = 200
#: Messages per range, about; a conversation of more is dealt to ranges.
RANGE = 20_000
#: Characters of a conversation, and of a range, about.
RANGE_CHARS = 1 << 26
#: How transcripts name the roles; each conversation has one of these styles. Names are of no known role.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("[system] ", "[human] ", "[bot] "),
    ("### Instructions: ", "### Question: ", "### Answer: "),
    ("<|system|> ", "<|user|> ", "<|assistant|> "),
)
NAMES = ("Setup: ", "Kim: ", "Lee: ")


def form(m: re.Match) -> tuple[str, str, str]:
    """The shape of a marker (its sign and bracket), its role or ``other``, and its word."""
    kind = m.lastgroup if m.lastgroup in (*ROLES, "other") else next(k for k in (*ROLES, "other") if m[k])
    return (m["sign"] or "")[:1] + (m["open"] or ""), kind, m[kind].lower()


def mark(line: str) -> tuple[str, str, str] | None:
    return form(m) if (m := MARKER.match(line)) else None


class Style(NamedTuple):
    """The shape of a transcript's markers, and the words for user and assistant, or the names if no role is known."""

    shape: str = ""
    users: frozenset = frozenset()
    assistants: frozenset = frozenset()
    names: frozenset = frozenset()


def style_of(first: tuple[str, str, str] | None, counts: Counter) -> Style:
    """The style of a transcript, given the form of its first line's marker and how often each form starts a line.

    The first line's marker is of the style, if it is of a known role. If not, some style has to have both words, and as many lines as
    markers like the first have; else the first line's word is a name, and so are the NAMES_MOST most frequent of its shape. A transcript whose first line has no marker has no names."""
    shape, kind, word = first or ("", "other", "")
    system: Counter = Counter()
    for (own, role, _), n in counts.items():
        if role == "system":
            system[own] += n

    def evidence(pair: tuple[str, str, str]) -> int:
        return system[pair[0]] + counts[pair[0], "user", pair[1]] + counts[pair[0], "assistant", pair[2]]

    shapes = [shape] if kind != "other" else sorted({own for own, role, _ in counts if role != "other"})
    known = [(own, u, a) for own in shapes for u, a in PAIRS if kind == "other" or word == {"user": u, "assistant": a}.get(kind, word)]
    if kind == "other":
        least = counts[first] if first else 2
        known = [s for s in known if counts[s[0], "user", s[1]] and counts[s[0], "assistant", s[2]] and evidence(s) >= least]
    if known:
        own, u, a = max(known, key=evidence)
        return Style(own, SAME if u in SAME else frozenset((u,)), frozenset((a,)))
    if not first:
        return Style()
    others = sorted((-n, w) for (own, role, w), n in counts.items() if own == shape and role == "other")
    return Style(shape, names=frozenset([word, *[w for _, w in others[:NAMES_MOST]]]))


def style_in(lines: list[str]) -> Style:
    forms = [mark(x) for x in lines]
    return style_of(forms[0], Counter(f for f in forms if f))


def role_of(line: str, style: Style) -> tuple[int, int]:
    """The kind of marker at the start of a line (a role, 3: a name, 4: none), and where the text behind a role's marker starts."""
    m = MARKER.match(line)
    if m:
        shape, kind, word = form(m)
        if shape == style.shape:
            if style.users and (kind == "system" or kind == "user" and word in style.users or kind == "assistant" and word in style.assistants):
                return ROLES.index(kind), m.end()
            if kind == "other" and word in style.names:
                return 3, 0
    return 4, 0


def seen(line: str, style: Style) -> int:
    """The class of a line: the kind of its marker, and three traits."""
    kind = role_of(line, style)[0] if line.strip() else 5
    return kind * TRAITS + 4 * line.rstrip().endswith("?") + 2 * (len(line) > 200) + bool(LIST.match(line))


class Model:
    """Log probabilities of the first state, the next state, and what is seen in a state."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    def matrix(self, lines: list[int]) -> np.ndarray:
        """Best scores from the state before the lines to that of the last one."""
        s = self.move + self.emit[:, lines[0]]
        for x in lines[1:]:
            s = (s[:, :, None] + self.move).max(1) + self.emit[:, x]
        return s

    def path(self, lines: list[int], before: int | None = None, end: int | None = None) -> list[int]:
        """The likeliest states, given the state before the lines and the last one's, if known."""
        score = (self.start if before is None else self.move[before]) + self.emit[:, lines[0]]
        back = []
        for x in lines[1:]:
            s = score[:, None] + self.move
            back.append(s.argmax(0))
            score = s.max(0) + self.emit[:, x]
        state = int(score.argmax()) if end is None else end
        out = [state]
        for b in reversed(back):
            state = int(b[state])
            out.append(state)
        return out[::-1]


def fit(conversations: list[list[tuple[str, str]]], styles: tuple = (*STYLES, NAMES)) -> Model:
    """Counts over (role, text) of the turns of each conversation, written out in each of ``styles``.

    Every move is counted a little beforehand, and what wasn't seen of a state is as likely as is usual. A conversation starts with a turn, and a
    line goes on only with the role before it."""
    start, move, emit = np.full(N_STATES, 1e-6), np.full((N_STATES, N_STATES), 1e-6), np.full((N_STATES, KINDS * TRAITS), 1.0)
    start[:3] += (1.0, 2.0, 1.0)
    for role in range(3):
        move[[role, role + 3], role + 3] += 1.0
        move[[role, role + 3], :3] += (0.0001, 0.5, 0.5)  # instructions come first, unless the sample has them elsewhere
        emit[role, role * TRAITS : (role + 1) * TRAITS] = 1000.0
        emit[role, 3 * TRAITS : 5 * TRAITS] = 100.0  # a turn may start with a name or without a marker
        emit[role + 3, : 3 * TRAITS] = 2.0  # text may hold a marker
        emit[role + 3, 4 * TRAITS :] = 100.0
    usual = emit / emit.sum(1, keepdims=True)
    emit = usual * 1e-6
    for own in styles:
        for turns in conversations:
            last = -1
            written_ = [((own[ROLES.index(role)] + text).split("\n"), ROLES.index(role)) for role, text in turns if role in ROLES]
            if not written_:
                continue
            style = style_in([x for lines, _ in written_ for x in lines])
            for lines, r in written_:
                for i, line in enumerate(lines):
                    state = r + 3 * (i > 0)
                    if last < 0:
                        start[state] += 1
                    else:
                        move[last, state] += 1
                    emit[state, seen(line, style)] += 1
                    last = state
    unseen = max(UNSEEN, 4 / (4 + emit.sum() / N_STATES))
    emit = (1 - unseen) * emit / emit.sum(1, keepdims=True) + unseen * usual  # the same share for each state, however often it was seen
    return Model(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), np.log(emit))


def fit_on(conversations: DataFrame, styles: tuple = (*STYLES, NAMES), sample: int = SAMPLE) -> Model:
    """Fit on ``sample`` messages at most: of conversations drawn by a hash of their id, as many as should
    hold that many messages. Conversations of more than SAMPLE_TURNS messages and texts of more than
    SAMPLE_CHARS characters don't count."""
    rows = conversations.select("conv_id", F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), "role", "text").dropna().filter(F.length("text") <= SAMPLE_CHARS)
    drawn = F.pmod(F.xxhash64(F.col("conv_id").cast("string")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, rows.count())))
    rows = stored(rows.filter(drawn), "sample")
    short = rows.groupBy("conv_id").count().filter(F.col("count") <= SAMPLE_TURNS).select("conv_id")
    rows = rows.join(small(short, sample), "conv_id", "left_semi").orderBy("conv_id", "turn", "role", "text").limit(sample).collect()
    by: dict[object, list[tuple[str, str]]] = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    return fit(list(by.values()), styles)


def pieces(line: str, state: int, style: Style) -> tuple[str | None, str]:
    """The role that a line starts a turn of, if it does, and its text without the marker."""
    if state >= 3:
        return None, line
    return ROLES[state], line[role_of(line, style)[1] :]


@functools.cache
def prior() -> Model:
    """The model before any conversation was seen."""
    return fit([])


def parse(transcript: str | None, model: Model | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn; nothing for a blank transcript. Without a model: by ``prior``."""
    model = model or prior()
    if not transcript or not transcript.strip():
        return []
    lines = transcript.split("\n")
    style = style_in(lines)
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, model.path([seen(x, style) for x in lines]), strict=True):
        role, text = pieces(line, state, style)
        if role is None and turns:
            turns[-1][1].append(text)
        else:
            turns.append((role or ROLES[state % 3], [text]))
    return [(role, "\n".join(own).strip()) for role, own in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def formatted(transcript: Column, model: Model) -> Column:
    """struct(roles array<string>, texts array<string>, chat string) of a transcript column."""

    @F.pandas_udf("roles array<string>, texts array<string>, chat string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            turns = [parse(t, model) for t in column]
            yield pd.DataFrame({"roles": [[r for r, _ in t] for t in turns], "texts": [[x for _, x in t] for t in turns], "chat": [render(t) for t in turns]})

    return run(transcript)


def written(conversations: DataFrame, styles: tuple = STYLES) -> DataFrame:
    """(conv_id, turn, role, line): each message with the marker of its role in its conversation's style. Null
    turns count as turn 0, null roles as user, null texts as empty; another role is its own marker."""
    role = F.coalesce(F.col("role"), F.lit("user"))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(styles)))
    markers = F.array(*[F.create_map(*[F.lit(x) for k, name in enumerate(ROLES) for x in (name, own[k])]) for own in styles])
    marker = F.coalesce(F.element_at(F.element_at(markers, (style + 1).cast("int")), role), F.concat(role, F.lit(": ")))
    return conversations.select("conv_id", F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), role.alias("role"), F.concat(marker, F.coalesce("text", F.lit(""))).alias("line"))


def transcripts(conversations: DataFrame, styles: tuple = STYLES) -> DataFrame:
    """(conv_id, n_turns, true_roles, transcript): whole conversations, each of which has to fit a cell;
    format_messages is for those of any length."""
    rows = written(conversations, styles).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "line", "role"))).alias("rows"))
    return rows.select("conv_id", F.size("rows").cast("long").alias("n_turns"), F.col("rows.role").alias("true_roles"), F.array_join("rows.line", "\n").alias("transcript"))


def format_chats(rows: DataFrame, *, keep: tuple, model: Model | None = None, transcript_col: str = "transcript") -> DataFrame:
    """Per row: the columns ``keep``, roles, texts, chat. Null and blank transcripts have no turns and an
    empty chat; repeated rows format alike; other columns are ignored. Without a model: by ``prior``."""
    out = rows.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], formatted(F.col(transcript_col), model or prior()).alias("f"))
    return out.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "f.roles", "f.texts", "f.chat")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows (part, conv_id, ...) sorted by part and conversation: the rows of each, without these two columns."""
    held: list[tuple] = []
    key = None
    for batch in batches:
        for part, conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (part, conv) != key:
                if held:
                    yield key, held
                key, held = (part, conv), []
            held.append(tuple(row))
    if held:
        yield key, held


def joints(pieces_: list[tuple], model: Model) -> dict[tuple, tuple[int | None, int]]:
    """From (part, conv_id, matrix) of the ranges of conversations: the state before each range (None before the
    first), and its last one, on the likeliest path of the whole conversation. The first state of a
    conversation is weighed as if a move led to it: start stands for the move."""
    out: dict[tuple, tuple[int | None, int]] = {}
    by: dict[object, list[tuple]] = {}
    for part, conv, m in pieces_:
        by.setdefault(conv, []).append((part, np.array(m).reshape(-1, N_STATES)))
    for conv, own in by.items():
        own.sort(key=lambda x: x[0])
        scores = [own[0][1][N_STATES]]  # the row below the square one: from the start
        for _, m in own[1:]:
            scores.append((scores[-1][:, None] + m[:N_STATES]).max(0))
        end = int(scores[-1].argmax())
        for i in range(len(own) - 1, -1, -1):
            before = int((scores[i - 1] + own[i][1][:N_STATES][:, end]).argmax()) if i else None
            out[own[i][0], conv] = (before, end)
            end = before if i else end
    return out


def tallies(batches: Iterator[pa.RecordBatch], own_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Per range of a conversation: how often each form of marker starts a line (lead false), and the first line's form (lead true)."""
    for (part, conv), rows in runs(batches):
        forms = [mark(x) for r in rows for x in r[1].split("\n")]
        found = [(*(forms[0] or (None,) * 3), 0, True), *[(*f, n, False) for f, n in Counter(f for f in forms if f).items()]]
        columns = [pa.array([part] * len(found), pa.int32()), pa.array([conv] * len(found), own_type), *[pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()))]]
        yield pa.RecordBatch.from_arrays(columns, ["part", "conv_id", "shape", "kind", "word", "n", "lead"])


def styles_of(dealt: DataFrame, id_type: str, own_type: pa.DataType) -> dict:
    """The style of each conversation of ranges: from sums of forms, of which those of known roles (a few hundred per conversation at
    most) and its names come to the driver."""
    said = stored(dealt.mapInArrow(lambda batches: tallies(batches, own_type), f"part int, conv_id {id_type}, shape string, kind string, word string, n long, lead boolean"), "forms")
    leads = said.filter("lead").groupBy(F.col("conv_id").alias("l_id")).agg(F.min_by(F.struct("shape", "kind", "word"), "part").alias("first"))
    counts = said.filter("not lead").groupBy("conv_id", "shape", "kind", "word").agg(F.sum("n").alias("n"))
    ordered = Window.partitionBy("conv_id", "kind", "shape").orderBy(F.desc("n"), "word")
    ranked = counts.withColumn("nth", F.row_number().over(ordered)).join(leads, F.col("conv_id").eqNullSafe(F.col("l_id")))
    own = (F.col("shape") == F.col("first.shape")) & ((F.col("nth") <= NAMES_MOST) | (F.col("word") == F.col("first.word")))
    by: dict[object, Counter] = {}
    for r in ranked.filter((F.col("kind") != "other") | own).select("conv_id", "shape", "kind", "word", "n").collect():
        by.setdefault(r["conv_id"], Counter())[r["shape"], r["kind"], r["word"]] = r["n"]
    return {r["l_id"]: style_of(tuple(r["first"]) if r["first"]["kind"] else None, by.get(r["l_id"], Counter())) for r in leads.collect()}


def format_messages(lines: DataFrame, model: Model, *, range_rows: int = RANGE) -> DataFrame:
    """Per row of ``lines`` (conv_id, turn, role, line): conv_id, turn, role, roles (of the turns that start in
    it), text (without the markers), chunk. The chunks of a conversation, joined in the order of turn, line
    and role, are its canonical chat but for the last end mark. Rows that are alike are interchangeable."""
    order = ["conv_id", "turn", "line", "role"]
    kind = lines.schema["conv_id"].dataType.simpleString()
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    conv_id, id_type, own_type = F.col("conv_id").cast("bigint" if whole else "string"), "bigint" if whole else "string", pa.int64() if whole else pa.string()
    own = lines.select(*order).withColumn("conv_id", conv_id)
    sizes = stored(own.groupBy("conv_id").agg(F.count("*").alias("size"), F.sum(F.length("line")).alias("chars")), "sizes")
    n_rows, n_chars = (x or 0 for x in sizes.agg(F.sum("size"), F.sum("chars")).first())
    ranges = max(2 * own.sparkSession.sparkContext.defaultParallelism, -(-n_rows // range_rows), -(-n_chars // RANGE_CHARS))
    long = sizes.filter((F.col("size") > range_rows) | (F.col("chars") > RANGE_CHARS)).select(F.col("conv_id").alias("long_id"))
    n_long = long.count()

    def of(how: str) -> DataFrame:
        """The rows of the long conversations, or of the others (left_anti)."""
        return own.join(small(long, 100_000), F.col("conv_id").eqNullSafe(F.col("long_id")), how)

    short = (of("left_anti") if n_long else own).withColumn("part", F.lit(0)).select("part", *order)
    short = short.repartition(ranges, "conv_id").sortWithinPartitions(*order)
    result = f"conv_id {id_type}, turn bigint, role string, roles array<string>, text string, chunk string"

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, conv), rows in runs(batches):
            first, *rest = [seen(x, styles[conv]) for r in rows for x in r[1].split("\n")]
            m = model.matrix([first, *rest])
            s = (model.start + model.emit[:, first])[None, :]
            for x in rest:
                s = (s[:, :, None] + model.move).max(1) + model.emit[:, x]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([conv], own_type), pa.array([np.concatenate([m, s]).ravel().tolist()])], ["part", "conv_id", "m"])

    def decode(batches: Iterator[pa.RecordBatch], ends: dict, styles: dict) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (part, conv), rows in runs(batches):
            before, end = ends.get((part, conv), (None, None))
            split = [r[1].split("\n") for r in rows]
            every = [x for lines_ in split for x in lines_]
            style = styles[conv] if ends else style_in(every)
            states = iter(model.path([seen(x, style) for x in every], before, end))
            first = before is None
            for row, lines_ in zip(rows, split, strict=True):
                roles, texts, chunk = [], [], []
                for i, line in enumerate(lines_):
                    state = next(states)
                    role, text = pieces(line, state, style)
                    if role is None and first:
                        role = ROLES[state % 3]
                    if role is not None:
                        roles.append(role)
                        chunk.append(("" if first else "\n<|end|>\n") + f"<|{role}|>\n")
                    else:
                        chunk.append("\n")
                    first = False
                    texts.append(text)
                    chunk.append(text)
                out.append((conv, row[0], row[2], roles, "\n".join(texts), "".join(chunk)))
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (own_type, pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["conv_id", "turn", "role", "roles", "text", "chunk"])

    found = short.mapInArrow(lambda batches: decode(batches, {}, {}), result)
    if n_long:
        rows = stored(of("left_semi").withColumn("rep", F.monotonically_increasing_id()), "messages")
        ranged = stored(rows.repartitionByRange(ranges, *order, "rep").withColumn("part", F.spark_partition_id()), "ranged")
        dealt = ranged.select("part", *order, "rep").repartition("part").sortWithinPartitions("part", *order, "rep")
        styles = styles_of(dealt, id_type, own_type)
        met = dealt.mapInArrow(matrices, f"part int, conv_id {id_type}, m array<double>")
        ends = joints([(r["part"], r["conv_id"], r["m"]) for r in met.collect()], model)  # one per range and one per long conversation at most
        found = found.union(dealt.mapInArrow(lambda batches: decode(batches, ends, styles), result))
    return found.withColumn("conv_id", F.col("conv_id").cast(kind))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per message: its conversation, turn and true role, the roles found, and its part of the canonical chat."""
    conversations = table(spark, sf_dir, "conversations")
    rows = format_messages(written(conversations), fit_on(conversations))
    right = F.col("roles") == F.array("role")
    return rows.select("conv_id", "turn", "role", F.lit(1).cast("long").alias("n_turns"), F.size("roles").cast("long").alias("n_found"), right.cast("long").alias("n_right"), F.array_join("roles", " ").alias("roles"), "text", "chunk")
