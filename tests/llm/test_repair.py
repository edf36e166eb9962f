"""Conversation repair against every edit sequence, and against a plain program over whole tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("xorweave.llm")
from xorweave.llm import repair  # noqa: E402

SF = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?")
WORD, LAST = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        last = LAST.search(text)
        out.append("blank" if not WORD.search(text) else "duplicate" if (role, text) in seen else "truncated" if last[1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows, most):
    """The cheapest (cost, audit, messages) of all edit sequences with at most ``most`` inserts at a place."""
    own = faults(rows)
    gaps = [tuple(("I", 5, (r, "")) for r in p) for n in range(most + 1) for p in itertools.product(("user", "assistant"), repeat=n)]
    choices = []
    for (role, text), fault in zip(rows, own, strict=True):
        stays = 5 * (fault == "truncated")
        keep = [] if fault in ("blank", "duplicate") else [("K", stays, (role, text)), *[("R", 1 + stays, (r, text)) for r in ("user", "assistant")]]
        choices += [gaps, [(x,) for x in [("D", 2, None), *keep]]]
    best = None
    for edits in itertools.product(*choices, gaps):
        edits = [e for part in edits for e in part]
        if GOOD.fullmatch("".join(e[2][0][:1] or " " for e in edits if e[2])):
            found = (sum(e[1] for e in edits), "".join(e[0] for e in edits), [e[2] for e in edits if e[2]])
            best = min(best or found, found, key=lambda x: x[:2])
    return best


def plain(rows):
    """The same by a program over whole strings."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    layer = {0: (0, "", [])}

    def put(out, state, found):
        if state not in out or found[:2] < out[state][:2]:
            out[state] = found

    for (role, text), fault in zip(rows, faults(rows), strict=True):
        out = {}
        for state, (cost, audit, made) in layer.items():
            put(out, state, (cost + 2, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            cost += 5 * (fault == "truncated")
            for n in range(3):
                at, names = state, []
                for _ in range(n):
                    names.append(("assistant" if at == 2 else "user", ""))
                    at = after[at]
                forced = "assistant" if at == 2 else "user"
                own, text_ = (cost + 5 * n, audit + "I" * n, made + names), text
                if role[:1] == forced[0]:
                    put(out, after[at], (own[0], own[1] + "K", own[2] + [(role, text_)]))
                if role[:1] == "s" and at == 0:
                    put(out, 1, (own[0], own[1] + "K", own[2] + [(role, text_)]))
                put(out, after[at], (own[0] + 1, own[1] + "R", own[2] + [(forced, text_)]))
        layer = out
    ends = []
    for state, (cost, audit, made) in layer.items():
        tail = {0: [], 3: [], 2: [("assistant", "")], 1: [("user", ""), ("assistant", "")]}[state]
        ends.append((cost + 5 * len(tail), audit + "I" * len(tail), made + tail))
    return min(ends, key=lambda x: x[:2])


def row_of(conv, rows):
    """The contract's row; ``rows`` (turn, role, text) in the order of the table."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    own = faults([r[1:] for r in rows])
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum((x[1][:1] + y[1][:1]) not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    cost, audit, made = plain([r[1:] for r in rows])
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, *[own.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha)


def spoilt(rows):
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        shown = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = (" " if x is None else x for x in (role, text))
        case = zlib.crc32(":".join(shown).encode()) % 20
        if case:
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            own += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return by


def want(rows):
    return sorted((row_of(conv, own) for conv, own in spoilt(rows).items()), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


TEXTS = ["Yes.", "No", "", " ", "Why?", "x.  \n", "and"]


def test_steps_against_every_edit():
    r = random.Random(3)
    for trial in range(300):
        n = trial % 4
        rows = [(r.choice(["user", "assistant", "system", "tool", "u2", ""]), r.choice(TEXTS)) for _ in range(n)]
        most = 2 if n < 3 else 1
        best = every_edit(rows, most)
        assert plain(rows) == best, rows
        signature = "".join(chr(repair.FIRST + 4 * "sua".find(role[:1] or "x") % 16 + ["", "blank", "duplicate", "truncated"].index(f)) for (role, _), f in zip(rows, faults(rows), strict=True))
        answers = repair.Trie(repair.NOTHING).answer(signature)
        cost, states, tail = repair.joined([answers])
        audit = next(x["audit"] for x in answers if x["end"] == states[0][1]) + tail
        stay = [x for x, f in zip(rows, faults(rows), strict=True) if f in ("", "truncated")]
        made = list(repair.edited(signature, audit, repair.NOTHING, [x[0] for x in stay], [x[1] for x in stay]))
        assert (cost, audit, made) == best, rows


def test_trie_shares_prefixes():
    r = random.Random(1)
    signatures = sorted({"".join(r.choice("AEIMFHK") for _ in range(r.randrange(12))) for _ in range(400)})
    trie = repair.Trie(repair.NOTHING)
    shared = [trie.answer(s) for s in signatures]
    assert shared == [repair.Trie(repair.NOTHING).answer(s) for s in signatures]
    assert trie.layers == len({s[:i] for s in signatures for i in range(1, len(s) + 1)})


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert got(repair.op11_repair(spark, SF)) == want(list(map(tuple, table.orderBy("conv_id", "turn").collect())))


@pytest.mark.parametrize("block", [3, 4096])
def test_awkward_rows(spark, block):
    r = random.Random(block)
    rows = [(c, r.choice([None, *range(12)]), r.choice(["user", "assistant", "system", "tool", None, ""]), r.choice([*TEXTS, None, "long " * 3000])) for c in (None, 1, 2, 3) for _ in range(25)]
    rows += [(7, t, "user", "Again.") for t in range(40)] + [(8, 5, "user", "Same.")] * 40 + [(9, None, "assistant", "x")]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], "conv_id long, turn long, role string, text string, same long, cost string").coalesce(1)
    assert got(repair.repaired(repair.damaged(df), df, block_rows=block)) == want(rows)


def test_long_conversation(spark):
    """One conversation over many blocks and parts, and the messages themselves."""
    r = random.Random(9)
    rows = [(1, t, r.choice(["user", "assistant", "system"]), f"{t}" + r.choice(["", ".", "!"]) if t % 7 else "again.") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    blocks = repair.cut(repair.diagnosed(df), 50)
    assert blocks.count() >= 60
    plan = repair.planned(blocks)
    _, audit, made = plain([x[2:] for x in rows])
    assert [repair.digests(blocks, plan).first()[c] for c in ("audit", "repaired_sha256")] == [audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()]
    assert [(x.role, x.text) for x in repair.messages(blocks, plan).orderBy("block", "nth").collect()] == made


def test_texts_as_ids_and_none(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hm."), ("b", 1, "user", "Oh.")], "conv_id string, turn int, role string, text string")
    assert sorted((x.conv_id, x.cost, x.audit) for x in repair.repaired(df).collect()) == [("a", 2, "D"), ("b", 2, "D")]
    assert repair.repaired(df.limit(0)).count() == 0
    empty = repair.repaired(df.limit(0), df).filter(F.col("conv_id") == "a").first()
    assert tuple(empty) == ("a", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
