"""Sorted stores, probing, pushdown, the join by tasks, resuming, and linear algebra."""

import functools
import operator
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from xorweave.functions import bits, shares
from xorweave.operators import basis, join, lists, match
from xorweave.sources import binary, stores, tasks
from xorweave.streaming import ledger

R = np.random.default_rng(11)


def frame(spark, keys):
    return spark.createDataFrame([(int(k),) for k in keys], "h long")


def unsigned(keys):
    return sorted(int(k) & (2**64 - 1) for k in keys)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Keys of all 64 bits, with repeats that run over parts, in several parts."""
    binary.register(spark)
    keys = [int(x) for x in R.integers(-(2**63), 2**63 - 1, 3000)] + [5] * 700 + [-1, bits.SIGN, 0]
    path = str(tmp_path_factory.mktemp("store") / "keys")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    stores.save_sorted(frame(spark, keys).repartition(7), path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path, keys


def bytes_of(filters, path, kind=binary.KEY):
    reader = binary.RecordReader([path], kind)
    left = list(reader.pushFilters(filters))
    return left, sum(p.size for p in reader.partitions())


def test_sorted_folder(spark, store):
    path, keys = store
    want = unsigned(keys)
    rows = stores.sorted_keys(spark, path).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(keys))) and [r.h & (2**64 - 1) for r in rows] == want
    assert [r.before for r in rows] == [None, *[r.h for r in rows[:-1]]]
    assert len(binary.manifest(path)) > 1
    found = sorted((r.pos, r.h) for r in stores.duplicate_positions(spark, path).collect())
    assert found == sorted((i, bits.signed(x)) for i, x in enumerate(want) if i and want[i - 1] == x)
    assert "Exchange" not in stores.duplicate_positions(spark, path)._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="isn't empty"):
        stores.save_sorted(frame(spark, [1]), path)


def test_order_is_checked(spark, tmp_path):
    binary.register(spark)
    at = str(tmp_path / "bad")
    with pytest.raises(Exception, match="ascending"):
        frame(spark, [3, 1, 2]).coalesce(1).write.format("xor_keys").option("sorted", "true").mode("append").save(at)
    frame(spark, [3, 1]).coalesce(1).write.format("xor_keys").mode("append").save(str(tmp_path / "plain"))
    with pytest.raises(Exception, match="ascending"):
        stores.sorted_keys(spark, str(tmp_path / "plain")).count()


def test_pushdown(spark, store, tmp_path):
    path, keys = store
    read = spark.read.format("xor_keys").load(path)
    cases = ["h = 5", "h > 1000 and h < 9000000000000000000", "h <= -1", "h >= -100 and h <= 100", "h in (0, 5, 77)", "h < -9223372036854775800", "h > 5 and h < 3"]
    for case in cases:
        assert sorted(r.h for r in read.filter(case).collect()) == sorted(r.h for r in frame(spark, keys).filter(case).collect()), case
    _, every = bytes_of([], path)
    assert every == 8 * len(keys)
    left, some = bytes_of([binary.EqualTo(("h",), 5)], path)
    assert not left and some == 8 * 700  # just the keys
    assert bytes_of([binary.GreaterThan(("h",), 10), binary.LessThan(("h",), 20)], path)[1] == 0
    other = binary.EqualTo(("x",), 1)
    assert bytes_of([other], path) == ([other], every)
    plan = read.filter("h = 5")._jdf.queryExecution().toString()
    assert "Filter (" not in plan.split("Physical Plan")[1]
    # an unsorted folder is read whole, and gives the same
    at = str(tmp_path / "plain")
    frame(spark, keys).write.format("xor_keys").mode("append").save(at)
    plain = spark.read.format("xor_keys").load(at)
    for case in cases:
        assert sorted(r.h for r in plain.filter(case).collect()) == sorted(r.h for r in read.filter(case).collect())
    assert bytes_of([binary.EqualTo(("h",), 5)], at)[1] == 8 * len(keys)


def test_shares_from_many_paths(spark, tmp_path):
    """Files, folders in folders, and lists of them; comparisons of any column."""
    binary.register(spark)
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "a" / "_hidden").mkdir()
    one = lambda kind, nonce: struct.pack("<hhIIII", kind, 9, 2**32 - 1, 5, nonce, 7)
    (tmp_path / "a" / "x.bin").write_bytes(one(0, 1) + one(1, 2))
    (tmp_path / "a" / "deep" / "y.bin").write_bytes(one(2, 3))
    (tmp_path / "a" / "_hidden" / "z.bin").write_bytes(one(2, 99))
    (tmp_path / "b.bin").write_bytes(one(1, 4) * 2)
    rows = spark.read.format("xor_shares").load([str(tmp_path / "a"), str(tmp_path / "b.bin")])
    assert sorted(r.nonce for r in rows.collect()) == [1, 2, 3, 4, 4]
    assert sorted(r.nonce for r in rows.filter("kind = 1 and nonce > 2 and extraNonce2 = 4294967295").collect()) == [4, 4]


def test_probed_index(spark, store):
    path, keys = store
    for k in (0, 3, 8):
        want = {r.prefix: r.off for r in lists.bucket_index(frame(spark, keys), k).collect()}
        rows = stores.probed_index(spark, path, k, counted=True).collect()
        assert {r.prefix: r.off for r in rows} == want
        assert sum(r.probes for r in rows) <= ((1 << k) + 1) * (len(keys).bit_length() + 1)
        stores.save_flat_index(spark, path, k)
        assert tasks.load_flat_index(path, k).tolist() == [want[p] for p in range((1 << k) + 1)]
    (binary.opened(path)[0]).copy_file(f"{path}/_index-3.idx", f"{path}/_index-4.idx")
    with pytest.raises(ValueError, match="isn't an index"):
        tasks.load_flat_index(path, 4)


def three(spark, tmp_path, a, b, c, k, width):
    binary.register(spark)
    return tuple(stores.save_list(frame(spark, x), str(tmp_path / f"{name}{k}-{time.time_ns()}"), k, width) for name, x in zip("abc", (a, b, c), strict=True))


def brute(a, b, c):
    members = set(c)
    return sorted((x, y) for x in a for y in b if x ^ y in members)


def test_join_by_tasks(spark, tmp_path, monkeypatch):
    """Against brute force, in one piece and in many, with heavy tasks cut; no shuffle."""
    a, b, c = ([int(x) for x in R.integers(0, 1 << 11, n)] for n in (90, 70, 60))
    a, c = a + [a[0]] * 20, c + c[:30]
    want = brute(a, b, c)
    for k in (0, 2):
        saved = three(spark, tmp_path, a, b, c, k, 11)
        found = tasks.joined(spark, saved, k)
        assert sorted(map(tuple, found.collect())) == want
        assert "Exchange" not in found._jdf.queryExecution().toString()
        monkeypatch.setattr(tasks, "PIECE", 7)
        monkeypatch.setattr(tasks, "RUN", 5)
        for kernel in ("pairs", "slice", "auto"):
            reader = tasks.TaskReader(list(saved), k, None, False, 50, kernel, 11)
            parts = reader.partitions()
            assert len(parts) > 4
            assert sorted((int(x), int(y)) for p in parts for batch in reader.read(p) for x, y in zip(*(column.to_pylist() for column in batch.columns), strict=True)) == want
        monkeypatch.undo()
    assert tasks.joined(spark, three(spark, tmp_path, [], b, c, 1, 11), 1).count() == 0


def test_each_store_is_read_so_often(spark, tmp_path, monkeypatch):
    """2^k times at most, in one partition per core and more."""
    k = 2
    saved = three(spark, tmp_path, *([int(x) for x in R.integers(0, 1 << 16, 400)] for _ in range(3)), k, 16)
    seen = {}
    real = tasks.Store.keys
    monkeypatch.setattr(tasks.Store, "keys", lambda self, low, high: seen.__setitem__(self.uri, seen.get(self.uri, 0) + high - low) or real(self, low, high))
    reader = tasks.TaskReader(list(saved), k, None, False, 4)
    for p in reader.partitions():
        list(reader.read(p))
    assert all(n <= 400 << k for n in seen.values()) and len(seen) == 3


def test_long_c(spark, tmp_path, monkeypatch):
    """C a thousand times longer than A and B: what a task holds doesn't grow with it, in both ways of dealing."""
    a, b = ([int(x) for x in R.integers(0, 1 << 40, 100)] for _ in range(2))
    c = spark.range(100_000).select(F.shiftright(F.xxhash64("id"), 24).bitwiseAND(F.lit((1 << 40) - 1)).alias("h")).union(frame(spark, [a[i] ^ b[i] for i in range(10)]))
    want = sorted(zip(a[:10], b[:10], strict=True))
    longest = []
    real = tasks.all_hits
    monkeypatch.setattr(tasks, "RUN", 1000)
    monkeypatch.setattr(tasks, "all_hits", lambda x, y, z: longest.append(len(z)) or real(x, y, z))
    saved = tuple(stores.save_list(x, str(tmp_path / n), 1, 40) for n, x in zip("abc", (frame(spark, a), frame(spark, b), c), strict=True))
    reader = tasks.TaskReader(list(saved), 1, None, False, 2)
    got = [(int(x), int(y)) for p in reader.partitions() for batch in reader.read(p) for x, y in zip(*(column.to_pylist() for column in batch.columns), strict=True)]
    assert sorted(got) == want and len(longest) >= 100 and max(longest) <= 1000
    monkeypatch.setattr(join, "RUN_ROWS", 1000)
    assert sorted(map(tuple, join.prefix(frame(spark, a), frame(spark, b), c, 1, 40).collect())) == want


def test_resumed(spark, tmp_path):
    """A run that stops half-way and goes on gives each pair once, also when a batch was recorded twice."""
    k, width = 2, 10
    a, b, c = ([int(x) for x in R.integers(0, 1 << width, n)] for n in (60, 50, 40))
    saved, path = three(spark, tmp_path, a, b, c, k, width), str(tmp_path / "ledger")
    assert ledger.run_pending(spark, saved, k, path, batch=5, batches=1) == 11
    done = ledger.read(spark, path)
    assert sorted(r.task_id for r in done.collect()) == [0, 1, 2, 3, 4]
    ledger.append(spark.createDataFrame([(*r[:1], r[1] + 1, *r[2:]) for r in done.collect()], ledger.SCHEMA), path)
    assert ledger.run_pending(spark, saved, k, path, batch=5) == 0
    assert ledger.run_pending(spark, saved, k, path) == 0
    done = ledger.read(spark, path)
    assert sorted(r.task_id for r in done.collect()) == list(range(16))
    assert sorted((r.a, r.b) for r in ledger.solutions(done).collect()) == brute(a, b, c)
    by_u = {r.u: r.pairs for r in join.tested_pairs(frame(spark, a), frame(spark, b), k, width).collect()}
    sums = {r.u: r.n for r in ledger.task_pairs(done).groupBy((F.col("task_id") % 4).cast("long").alias("u")).agg(F.sum("pairs").alias("n")).collect()}
    assert {u: n for u, n in sums.items() if n} == {u: n for u, n in by_u.items() if n}


def test_stream_counts_a_task_once(spark, tmp_path):
    """Stream totals are batch totals after repeats, late first records and restarts."""
    at = lambda name: str(tmp_path / name)
    record = lambda task, start, host, n: (task, float(start), 0.5 * start, host, [(task, i) for i in range(n)], 10 * task)
    batches = [
        [record(1, 5, "x", 2), record(2, 1, "y", 1), record(2, 1, "y", 1)], [record(1, 5, "x", 2), record(1, 7, "z", 3)], [record(1, 3, "y", 1), record(3, 2, "x", 0)], [record(3, 9, "y", 4), record(2, 1, "y", 1)],
    ]
    for rows in batches:
        ledger.append(spark.createDataFrame(rows, ledger.SCHEMA), at("ledger"))
        ledger.follow(spark, at("ledger"), at("changes"), at("state"), files=1)  # a new query each time
        want = ledger.read(spark, at("ledger")).groupBy("hostname").agg(F.count("*").alias("tasks"), F.sum(F.size("solutions")).alias("solutions"), F.sum("pairs").alias("pairs"), F.round(F.sum("duration"), 4).alias("seconds"))
        assert sorted(map(tuple, ledger.followed(spark, at("changes")).collect())) == sorted(map(tuple, want.collect()))
    totals = ledger.totals(ledger.read(spark, at("ledger"))).first()
    sums = ledger.followed(spark, at("changes")).agg(F.sum("tasks"), F.sum("solutions"), F.round(F.sum("seconds"), 4)).first()
    assert tuple(totals) == tuple(sums)


def test_rejects(spark, tmp_path):
    rows = [(k, 1, n, 5, n % 4, 9) for n, k in enumerate([0, 1, 2, 7, -1, None] * 20)] + [(1, 1, None, 5, 6, 7)]
    own = spark.createDataFrame(rows, "kind short, difficulty short, extraNonce2 long, extraNonce1 long, nonce long, ntime long")
    seen = stores.write_accounted(own, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.reason: r["count"] for r in back.groupBy("reason").count().collect()} == {r: n for r, n in seen.items() if n}
    assert seen["kind"] == 60 and seen["null"] == 1 and seen["ok"] + seen["digest"] == 60 and seen["ok"] > 0
    good = shares.with_key(own).filter("substring(digest, 64, 1) = '0'")
    assert sorted(r.h for r in back.filter("reason = 'ok'").collect()) == sorted(r.h for r in good.collect())
    assert stores.write_accounted(own.limit(0), str(tmp_path / "none")) == dict.fromkeys(shares.REASONS, 0)


def test_purge_by_part(spark, tmp_path):
    rows = [(k % 3, d, k, 5, k % 4, 9) for k in range(60) for d in (3, 8)]
    own = spark.createDataFrame(rows, "kind short, difficulty short, extraNonce2 long, extraNonce1 long, nonce long, ntime long")
    kept = stores.purged_by_part(stores.bucket_shares(own, "bucketed_shares", str(tmp_path / "b"), 4))
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, kept.select(*own.columns).collect())) == sorted(r for r in rows if r[1] == 8)
    spark.sql("drop table bucketed_shares")


def span(own):
    out = {0}
    for v in own:
        out |= {x ^ int(v) for x in out}
    return out


def test_basis(spark):
    for trial in range(4):
        r = np.random.default_rng(trial)
        own = [int(x) for x in r.integers(-(2**63), 2**63 - 1, trial * 3)]
        keys = [bits.signed(x & (2**64 - 1)) for x in (span(v & (2**64 - 1) for v in own) if trial < 3 else [int(v) for v in own] + [0, own[0] ^ own[1]])]
        found = basis.basis(frame(spark, keys).repartition(5))
        rows = found.collect()
        vectors = basis.vectors(found)
        assert [r.pivot for r in sorted(rows, key=lambda r: -r.pivot)] == [v.bit_length() - 1 for v in vectors]
        assert span(vectors) == span(k & (2**64 - 1) for k in keys) and len(vectors) == basis.rank(found).first().rank
        assert all(not v >> w.bit_length() - 1 & 1 for v in vectors for w in vectors if v != w)
        there, back = basis.changes(vectors)
        send = lambda x, m: functools.reduce(operator.xor, [m[i] for i in range(64) if x >> i & 1], 0)
        assert [send(x, there) for x in back] == [1 << i for i in range(64)] == [send(x, back) for x in there]
        assert [send(v, there) for v in vectors] == [1 << i for i in range(len(vectors))]
        some = keys[:20] + [int(x) for x in r.integers(-(2**63), 2**63 - 1, 20)]
        inside = frame(spark, some).select("h", basis.in_span(F.col("h"), vectors).alias("x")).collect()
        assert all(r.x == ((r.h & (2**64 - 1)) in span(vectors)) for r in inside)
    assert basis.basis(frame(spark, [])).count() == 0


def test_byte_tables(spark):
    rows = [int(x) for x in R.integers(0, 2**63, 64)]
    keys = frame(spark, [int(x) for x in R.integers(-(2**63), 2**63 - 1, 200)] + [0, -1, bits.SIGN])
    for n in (64, 26, 3, 0):
        both = keys.select(bits.byte_tables(F.col("h"), rows[:n]).alias("a"), (bits.matvec(F.col("h"), rows[:n]) if n else F.lit(0)).alias("b"))
        assert both.filter("a <> b").count() == 0


def test_preimages_once(spark, monkeypatch):
    """Solutions are evaluated once, and lists joined once."""
    a, b, c = (spark.range(50).select("id", (F.col("id") * m % 64).alias("h")) for m in (3, 5, 7))
    asked = []
    real = match.needed
    monkeypatch.setattr(match, "needed", lambda solutions: asked.append(1) or real(solutions))
    plan = match.preimages(join.all_pairs(a, b, c, width=6), a, b, c)._jdf.queryExecution().optimizedPlan().toString()
    assert len(asked) == 1 and "Join Cross" not in plan and plan.count("Range (") == 3
    got = {(r.a, r.b): (r.a_id, r.b_id, r.c_id) for r in match.preimages(join.all_pairs(a, b, c, width=6), a, b, c).collect()}
    first = [{} for _ in range(3)]
    for own, m in zip(first, (3, 5, 7), strict=True):
        for i in range(50):
            own.setdefault(i * m % 64, i)
    assert got == {(x, y): (first[0][x], first[1][y], first[2][x ^ y]) for x in first[0] for y in first[1] if x ^ y in first[2]}
