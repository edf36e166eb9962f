"""The queries of the join engine over the star-schema tables, and their SQL.

Lists A, B and C are keys hashed from orders, customer and part; shares come from lineitem.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, shares
from ..operators import basis, join, lists, match
from ..sources import binary, stores
from ..sources.shared import new_path, stored
from ..streaming import ledger

BITS = 26
SOURCES = {"A": ("orders", "o_orderkey"), "B": ("customer", "c_custkey"), "C": ("part", "p_partkey")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys(spark: SparkSession, sf_dir: str, tag: str, width: int = BITS) -> DataFrame:
    """(id, h) of one list."""
    name, ident = SOURCES[tag]
    return table(spark, sf_dir, name).select(F.col(ident).alias("id"), bits.hash_key(tag, F.col(ident), width).alias("h"))


def three(spark: SparkSession, sf_dir: str, width: int = BITS) -> list[DataFrame]:
    return [keys(spark, sf_dir, t, width) for t in "ABC"]


def share_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).cast("short").alias("kind"), F.col("l_quantity").cast("short").alias("difficulty"),
        F.col("l_partkey").alias("extraNonce2"), F.col("l_suppkey").alias("extraNonce1"), F.col("l_orderkey").alias("nonce"), F.col("l_linenumber").cast("long").alias("ntime"),
    )


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.all_pairs(*three(spark, sf_dir), width=BITS)


def event_ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tasks 0..n-1 for n events; those of purchases are finished, with their value as seconds."""
    events = table(spark, sf_dir, "events")
    every = events.select(F.col("event_id").alias("task_id"))
    return every, events.filter("event_type = 'purchase'").select(F.col("event_id").alias("task_id"), F.round(F.abs("value"), 4).alias("duration"))


def repeated_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of which some repeat with another difficulty, and some are of a kind that doesn't exist."""
    rows = share_rows(spark, sf_dir)
    again = rows.filter("ntime <= 2").withColumn("difficulty", (F.col("difficulty") + F.col("ntime") - 1).cast("short"))
    return rows.union(again).union(rows.filter("ntime = 7").withColumn("kind", F.lit(7).cast("short")))


def matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stand-in solutions (a, b), and the shares that they may need: a from keys of kind 2, b from those of kind 0, of one
    order, masked to 16 bits, so that many of them have no third share. Shares are hashed once, and written."""
    keyed = shares.with_key(repeated_shares(spark, sf_dir))
    own = stored(keyed.select("kind", "difficulty", "extraNonce2", "extraNonce1", "nonce", "ntime", F.col("h").bitwiseAND(F.lit(0xFFFF)).alias("h")), "shares")
    a, b = own.filter("kind = 2").select("nonce", F.col("h").alias("a")), own.filter("kind = 0").select("nonce", F.col("h").alias("b"))
    return a.join(b, "nonce").select("a", "b").distinct(), own


def share_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.share_preimages(*matched(spark, sf_dir), 3, ["nonce", "ntime", "kind", "difficulty", "extraNonce2", "extraNonce1"])


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger in which events are records of the task user_id, so that tasks are recorded many times."""
    pair = lambda i: F.struct((F.col("event_id") * 7 + i).alias("a"), (F.col("user_id") * 3).alias("b"))
    found = F.transform(F.slice(F.array(*[F.lit(i).cast("long") for i in range(4)]), 1, (F.col("event_id") % 4).cast("int")), pair)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").cast("double").alias("start_time"), F.round(F.abs("value"), 4).alias("duration"), F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string")).alias("hostname"), found.alias("solutions"), (F.col("event_id") % 1000).alias("pairs"))


def digested(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Lists (h, id, d) with stand-in digests of their records, in which all but 4 bits of word 6 are zero."""
    whole = lambda tag: F.sha2(F.concat(F.lit(tag), F.col("id").cast("string")).cast("binary"), 256)
    return [keys(spark, sf_dir, t).withColumn("d", F.overlay(whole(t), F.lit("0000000"), F.lit(50))) for t in "ABC"]


TASK_BITS = 3


def sorted_list(spark: SparkSession, sf_dir: str, keys_: DataFrame) -> str:
    """A list's keys as a sorted folder in the shared folder."""
    binary.register(spark)
    path = new_path(spark, "sorted")
    stores.save_sorted(keys_, path)
    return path


def resumed(spark: SparkSession, sf_dir: str, found: bool = True) -> DataFrame:
    """The ledger of a join by tasks that was broken off after one batch and resumed; and whose first batch was then appended again."""
    binary.register(spark)
    saved = tuple(stores.save_list(x, new_path(spark, "list"), TASK_BITS, BITS) for x in three(spark, sf_dir))
    path = new_path(spark, "ledger")
    ledger.run_pending(spark, saved, TASK_BITS, path, batch=40, batches=1, width=BITS, solutions=found)
    again = ledger.rows(spark, path)  # the files that there are now
    ledger.run_pending(spark, saved, TASK_BITS, path, batch=40, width=BITS, solutions=found)
    ledger.append(again.withColumn("start_time", F.col("start_time") + 1), path)
    return ledger.read(spark, path)


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals by host of a stream over records that come in three times, the last before the first, over a restart."""
    path, target, checkpoint = (new_path(spark, x) for x in ("records", "changes", "state"))
    rows = ledger_rows(spark, sf_dir).select("task_id", "start_time", "duration", "hostname", "solutions", "pairs").withColumn("task_id", F.col("task_id").cast("int"))
    for part in ("start_time % 2 = 1", "start_time % 4 = 0", "start_time % 2 = 0"):
        ledger.append(rows.filter(part), path)
        ledger.follow(spark, path, target, checkpoint)
    return ledger.followed(spark, target)


def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reason, n) of shares that are written with a folder for each reason; the counts are those of the write."""
    path = new_path(spark, "rejects")
    seen = stores.write_accounted(repeated_shares(spark, sf_dir), path, 4)
    n = spark.read.parquet(path).groupBy("reason").agg(F.count("*").alias("n"))
    return n.withColumn("counted", F.element_at(F.create_map(*[F.lit(x) for pair in seen.items() for x in pair]), F.col("reason")).cast("long"))


def purged_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = new_path(spark, "bucketed"), repeated_shares(spark, sf_dir)
    return stores.purged_by_part(stores.bucket_shares(rows, path.rpartition("/")[2].replace("-", "_"), path, stores.buckets_for(rows.count())))


def few_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares with few different numbers, so that many are alike but for their difficulty."""
    rows = share_rows(spark, sf_dir)
    return rows.withColumns({"extraNonce2": F.col("extraNonce2") % 7, "extraNonce1": F.col("extraNonce1") % 3, "nonce": F.col("nonce") % 500})


def share_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of kind 1 and low difficulty, from files of 20 bytes a share."""
    binary.register(spark)
    path = new_path(spark, "files")
    share_rows(spark, sf_dir).write.format("xor_shares").mode("append").save(path)
    return spark.read.format("xor_shares").load(path).filter("kind = 1 and difficulty <= 10")


def saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "index")
    stores.save_index(keys(spark, sf_dir, "B"), path, 5, BITS)
    return stores.load_index(spark, path, 5)


def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of prefixes 3 to 8 of 32, from folders by prefix."""
    path = new_path(spark, "keys")
    stores.save_keys(keys(spark, sf_dir, "A"), path, 5, BITS)
    return stores.key_range(spark, path, 3, 9)


def routed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "kinds")
    stores.route_keys(shares.with_key(share_rows(spark, sf_dir)), path)
    return spark.read.parquet(path).select(F.col("kind").cast("int").alias("kind"), bits.hex16(F.col("h")).alias("key_hex"))


def purged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares split into parts, of which one is purged."""
    parts, purged = new_path(spark, "parts"), new_path(spark, "purged")
    stores.split_shares(few_shares(spark, sf_dir), parts, 4)
    stores.purge_shares(spark, f"{parts}/part=2", purged)
    return spark.read.parquet(purged)


def images(spark: SparkSession, sf_dir: str, tag: str) -> DataFrame:
    """(id, h): keys sent to 64 bits by MATRIX, so that they span 26 dimensions of 64."""
    return keys(spark, sf_dir, tag).select("id", bits.byte_tables(F.col("h"), MATRIX).alias("h"))


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bit, product): M times its inverse, for each unit vector."""
    change = basis.basis_change(basis.basis(images(spark, sf_dir, "B")))
    rows = [r["m"] for r in change.orderBy("bit").collect()]  # 64 numbers
    return change.select("bit", bits.byte_tables(F.col("m_inv"), rows).alias("product"))


def spanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, inside): the keys of A that are sums of keys of B of the first ten ids."""
    own = basis.vectors(basis.basis(keys(spark, sf_dir, "B").filter("id <= 10")))
    return keys(spark, sf_dir, "A").select("id", basis.in_span(F.col("h"), own).alias("inside"))


def h_sql(tag: str, ident: str, width: int = BITS) -> str:
    return f"(CAST('0x' || substr(sha256('{tag}' || {ident}), 1, 15) AS BIGINT) & {(1 << width) - 1})"


def list_sql(tag: str, width: int = BITS) -> str:
    name, ident = SOURCES[tag]
    return f"(SELECT {ident} AS id, {h_sql(tag, ident, width)} AS h FROM {name})"


def join_sql(width: int = BITS) -> str:
    a, b, c = (list_sql(t, width) for t in "ABC")
    return f"SELECT a.h AS a, b.h AS b FROM {a} a, {b} b WHERE xor(a.h, b.h) IN (SELECT h FROM {c})"


SHARES_SQL = """(SELECT CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS SMALLINT) AS kind, CAST(l_quantity AS SMALLINT) AS difficulty,
  l_partkey AS "extraNonce2", l_suppkey AS "extraNonce1", l_orderkey AS nonce, CAST(l_linenumber AS BIGINT) AS ntime FROM lineitem)"""
FEW_SQL = f'(SELECT * REPLACE ("extraNonce2" % 7 AS "extraNonce2", "extraNonce1" % 3 AS "extraNonce1", nonce % 500 AS nonce) FROM {SHARES_SQL})'
MATRIX = [0x9E3779B97F4A7C15 >> (i % 7) ^ (0x0123456789ABCDEF << (i % 5)) & (2**64 - 1) for i in range(BITS)]


def big(x: str) -> str:
    return f"lpad(lower(printf('%x', {x})), 8, '0')"


def little(x: str) -> str:
    return "(" + " || ".join(f"substr({big(x)}, {i}, 2)" for i in (7, 5, 3, 1)) + ")"


def dsha(x: str) -> str:
    return f"sha256(unhex(sha256(unhex({x}))))"


DIGEST_SQL = f"""(SELECT *, {dsha(f"(CASE kind WHEN 0 THEN '{shares.PREFIXES[0]}' WHEN 1 THEN '{shares.PREFIXES[1]}' ELSE '{shares.PREFIXES[2]}' END) || {dsha(f"'{shares.COINBASE_HEAD}' || {big('"extraNonce1"')} || {big('"extraNonce2"')} || '{shares.COINBASE_TAIL}'")} || {little('ntime')} || '{shares.MARK}' || {little('nonce')}")} AS digest FROM {SHARES_SQL})"""
MATVEC_SQL = "0::BIGINT"
for _i, _row in enumerate(MATRIX):
    MATVEC_SQL = f"xor({MATVEC_SQL}, CASE WHEN (h >> {_i}) & 1 = 1 THEN ({bits.signed(_row)})::BIGINT ELSE 0 END)"
PREIMAGE_SQL = f"""SELECT s.a, s.b, xor(s.a, s.b) AS c, a.id AS a_id, b.id AS b_id, c.id AS c_id
FROM (SELECT DISTINCT * FROM ({join_sql()})) s
JOIN (SELECT h, min(id) AS id FROM {list_sql('A')} GROUP BY h) a ON a.h = s.a
JOIN (SELECT h, min(id) AS id FROM {list_sql('B')} GROUP BY h) b ON b.h = s.b
JOIN (SELECT h, min(id) AS id FROM {list_sql('C')} GROUP BY h) c ON c.h = xor(s.a, s.b)"""
REPEATED_SQL = f"""(SELECT * FROM {SHARES_SQL} UNION ALL SELECT kind, CAST(difficulty + ntime - 1 AS SMALLINT), "extraNonce2", "extraNonce1", nonce, ntime FROM {SHARES_SQL} WHERE ntime <= 2
  UNION ALL SELECT 7::SMALLINT, difficulty, "extraNonce2", "extraNonce1", nonce, ntime FROM {SHARES_SQL} WHERE ntime = 7)"""
MATCH_SQL = f"""WITH own AS (SELECT kind, difficulty, "extraNonce2", "extraNonce1", nonce, ntime, CAST('0x' || substr(digest, 41, 2) || substr(digest, 39, 2) AS BIGINT) AS h, CAST(CASE kind WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS role
  FROM {DIGEST_SQL.replace(SHARES_SQL, REPEATED_SQL)} WHERE kind BETWEEN 0 AND 2),
s AS (SELECT DISTINCT a.h AS a, b.h AS b FROM own a JOIN own b ON a.kind = 2 AND b.kind = 0 AND a.nonce = b.nonce),
needed AS (SELECT 0 AS role, a AS h FROM s UNION SELECT 1, b FROM s UNION SELECT 2, xor(a, b) FROM s),
matched AS (SELECT own.* FROM own SEMI JOIN needed USING (role, h))"""


def xor_word_sql(at: int) -> str:
    """XOR of the three digests' word that starts at a character of the text; of word 6, only the first 4 bits are there."""
    word = lambda tag, col: f"CAST('0x' || substr(sha256('{tag}' || {col}), {at}, {1 if at == 49 else 8}) AS BIGINT)"
    return f"xor(xor({word('A', 'a_id')}, {word('B', 'b_id')}), {word('C', 'c_id')})"


TABLE_ROWS = [(0x9E3779B97F4A7C15 * (2 * i + 1) ^ 0x0123456789ABCDEF << (i % 9)) & (2**64 - 1) for i in range(64)]
TABLES_SQL = "0::BIGINT"
for _i, _row in enumerate(TABLE_ROWS):
    TABLES_SQL = f"xor({TABLES_SQL}, CASE WHEN {'h < 0' if _i == 63 else f'(h >> {_i}) & 1 = 1'} THEN ({bits.signed(_row)})::BIGINT ELSE 0 END)"


def echelon_sql(source: str) -> str:
    """CTEs up to ``basis`` (pivot, vector), the reduced echelon basis of the h of a query: bit by bit from the top, one key that has it is
    taken off the others; then each vector off those above."""
    out = [f"k64 AS MATERIALIZED (SELECT DISTINCT h FROM ({source}))"]
    has = lambda x, i: f"{x} < 0" if i == 63 else f"({x} >> {i}) & 1 = 1"
    for i in range(63, -1, -1):
        out.append(f"p{i} AS MATERIALIZED (SELECT max(h) AS p FROM k{i + 1} WHERE {has('h', i)})")
        out.append(f"k{i} AS MATERIALIZED (SELECT DISTINCT CASE WHEN {has('h', i)} THEN xor(h, p) ELSE h END AS h FROM k{i + 1}, p{i})")
    out.append("v64 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i} AS top, p AS vector FROM p{i} WHERE p IS NOT NULL" for i in range(64)) + ")")
    for i in range(63, -1, -1):
        out.append(f"v{i} AS MATERIALIZED (SELECT top, CASE WHEN top > {i} AND {has('vector', i)} THEN xor(vector, coalesce((SELECT vector FROM v{i + 1} WHERE top = {i}), 0)) ELSE vector END AS vector FROM v{i + 1})")
    return "WITH " + ", ".join(out) + ", basis AS (SELECT CAST(top AS INTEGER) AS \"pivot\", vector FROM v0)"


UNION_SQL = " UNION ALL ".join(f"SELECT h FROM {list_sql(t)}" for t in "ABC")


def mixed(x: DataFrame) -> DataFrame:
    """Keys spread over all 64 bits, half of them with the high bit set."""
    return x.select("id", F.shiftleft("h", 37).bitwiseXOR(F.col("h")).alias("h"))


def q(fn: Callable[[SparkSession, str], DataFrame], sql: str) -> tuple:
    return fn, sql


_ALL: dict[str, tuple] = {
    "hash60": q(lambda s, d: keys(s, d, "A", 60), f"SELECT * FROM {list_sql('A', 60)}"),
    "double_sha": q(lambda s, d: table(s, d, "orders").select("o_orderkey", shares.double_sha(F.hex(F.concat(F.lit("A"), F.col("o_orderkey").cast("string")))).alias("digest")), "SELECT o_orderkey, sha256(unhex(sha256('A' || o_orderkey))) AS digest FROM orders"),
    "share_keys": q(
        lambda s, d: shares.with_key(share_rows(s, d)).select("kind", "nonce", "ntime", "digest", bits.hex16(F.col("h")).alias("key_hex"), "ok"),
        f"SELECT kind, nonce, ntime, digest, {' || '.join(f'substr(digest, {2 * i + 1}, 2)' for i in range(26, 18, -1))} AS key_hex, substr(digest, 57, 8) = '00000000' AS ok FROM {DIGEST_SQL}",
    ),
    "share_dedup": q(lambda s, d: shares.dedup_shares(few_shares(s, d)), f'SELECT "extraNonce2", "extraNonce1", nonce, ntime, kind, max(difficulty) AS difficulty FROM {FEW_SQL} GROUP BY ALL'),
    "share_files": q(share_files, f"SELECT * FROM {SHARES_SQL} WHERE kind = 1 AND difficulty <= 10"),
    "saved_index": q(saved_index, f"SELECT p.range AS prefix, CAST((SELECT count(*) FROM {list_sql('B')} WHERE h >> 21 < p.range) AS BIGINT) AS off FROM range(33) p"),
    "range_read": q(range_read, f"SELECT h FROM {list_sql('A')} WHERE h >> 21 BETWEEN 3 AND 8"),
    "routed_keys": q(routed_keys, f"SELECT CAST(kind AS INTEGER) AS kind, {' || '.join(f'substr(digest, {2 * i + 1}, 2)' for i in range(26, 18, -1))} AS key_hex FROM {DIGEST_SQL}"),
    "purged_files": q(purged_files, f'SELECT "extraNonce2", "extraNonce1", nonce, ntime, kind, max(difficulty) AS difficulty FROM {FEW_SQL} WHERE xor(xor("extraNonce2", nonce), ntime) % 4 = 2 GROUP BY ALL'),
    "rotated": q(lambda s, d: keys(s, d, "A").select("id", bits.hex16(bits.rotate_left(F.col("h"), 50)).alias("key_hex")), f"SELECT id, lpad(lower(printf('%x', (CAST(h & 16383 AS UBIGINT) << 50) + CAST(h >> 14 AS UBIGINT))), 16, '0') AS key_hex FROM {list_sql('A')}"),
    "plan_sizes": q(
        lambda s, d: join.describe_plan(*three(s, d), 4, BITS).withColumn("log2_pairs", F.round("log2_pairs", 6)),
        f"SELECT n_a, n_b, n_c, CAST(16 AS BIGINT) AS tasks, round(log2(n_a * n_b), 6) AS log2_pairs, CAST(ceil(n_c / greatest(1, {BITS} - ceil(log2(greatest(2, n_a, n_b))))) AS BIGINT) AS slices FROM (SELECT (SELECT count(*) FROM orders) AS n_a, (SELECT count(*) FROM customer) AS n_b, (SELECT count(*) FROM part) AS n_c)",
    ),
    "kind_stats": q(lambda s, d: shares.kind_stats(share_rows(s, d)), f"SELECT kind, count(*) AS n, round(sum(cbrt(difficulty)), 4) AS work FROM {SHARES_SQL} GROUP BY kind"),
    "work_bits": q(lambda s, d: shares.work_bits(shares.kind_stats(share_rows(s, d))).select(F.round("bits", 6).alias("bits")), f"SELECT round(sum(log2(work)) + 32, 6) AS bits FROM (SELECT kind, round(sum(cbrt(difficulty)), 4) AS work FROM {SHARES_SQL} GROUP BY kind)"),
    "split_sizes": q(lambda s, d: share_rows(s, d).groupBy(shares.part_of(16).alias("part")).agg(F.count("*").alias("n")), f'SELECT xor(xor("extraNonce2", nonce), ntime) % 16 AS part, count(*) AS n FROM {SHARES_SQL} GROUP BY 1'),
    "dup_count": q(lambda s, d: lists.duplicate_count(table(s, d, "lineitem").select(bits.hash_key("L", F.col("l_orderkey"), BITS).alias("h"))), f"SELECT count(*) - count(DISTINCT {h_sql('L', 'l_orderkey')}) AS n_dups FROM lineitem"),
    "dup_rows": q(lambda s, d: lists.repeats(lists.masked(keys(s, d, "A"), 12), "id"), f"SELECT h, id, CAST(nth AS INTEGER) AS nth FROM (SELECT h & 4095 AS h, id, row_number() OVER (PARTITION BY h & 4095 ORDER BY id) AS nth FROM {list_sql('A')}) WHERE nth > 1"),
    "unique_keys": q(lambda s, d: lists.unique_keys(lists.masked(keys(s, d, "A"), 12)), f"SELECT DISTINCT h & 4095 AS h FROM {list_sql('A')}"),
    "union_all": q(lambda s, d: lists.union_all(*[x.select("h") for x in three(s, d)]), UNION_SQL),
    "bucket_index": q(lambda s, d: lists.bucket_index(keys(s, d, "A"), 6, BITS), f"SELECT p.range AS prefix, CAST((SELECT count(*) FROM {list_sql('A')} WHERE h >> 20 < p.range) AS BIGINT) AS off FROM range(65) p"),
    "bucket_skew": q(
        lambda s, d: lists.bucket_skew(keys(s, d, "B"), 8, BITS),
        f"WITH n AS (SELECT count(h) AS n FROM range(256) p LEFT JOIN {list_sql('B')} ON h >> 18 = p.range GROUP BY p.range), m AS (SELECT CAST(sum(n) // 256 AS BIGINT) AS avg FROM n) SELECT avg, count(*) FILTER (n < avg // 3) AS thin, count(*) FILTER (n > 3 * avg) AS fat FROM n, m GROUP BY avg",
    ),
    "advise": q(lambda s, d: lists.advise(keys(s, d, "A")), "SELECT CAST(min(w.range) AS INTEGER) AS prefix_width FROM range(63) w, (SELECT count(*) AS n FROM orders) WHERE n >> w.range <= 256"),
    "sort_unsigned": q(
        lambda s, d: lists.sort_keys(mixed(keys(s, d, "C"))).select("id", bits.hex16(F.col("h")).alias("key_hex")),
        f"SELECT id, lpad(lower(printf('%x', h)), 16, '0') AS key_hex FROM (SELECT id, xor(h << 37, h) AS h FROM {list_sql('C')}) ORDER BY h < 0, h",
    ),
    "unsorted_places": q(lambda s, d: lists.unsorted_places(keys(s, d, "A"), "id"), f"SELECT id, h, before FROM (SELECT id, h, lag(h) OVER (ORDER BY id) AS before FROM {list_sql('A')}) WHERE h < before"),
    "trailing_zeros": q(lambda s, d: keys(s, d, "A", 60).select("id", bits.trailing_zeros(F.col("h")).alias("tz")), f"SELECT id, CAST(bit_count(xor(h - 1, h)) - 1 AS INTEGER) AS tz FROM {list_sql('A', 60)}"),
    "masks": q(
        lambda s, d: keys(s, d, "C", 60).select("id", bits.msb(F.col("h"), 9, 60).alias("top"), F.col("h").bitwiseAND(F.lit(bits.right_mask(7))).alias("low"), F.col("h").bitwiseAND(F.lit(bits.left_mask(12))).alias("high")),
        f"SELECT id, h >> 51 AS top, h & 127 AS low, h & ({bits.left_mask(12)})::BIGINT AS high FROM {list_sql('C', 60)}",
    ),
    "gf2_matvec": q(lambda s, d: keys(s, d, "C").select("id", bits.matvec(F.col("h"), MATRIX).alias("image")), f"SELECT id, {MATVEC_SQL} AS image FROM {list_sql('C')}"),
    "gf2_tables": q(lambda s, d: mixed(keys(s, d, "C")).select("id", bits.byte_tables(F.col("h"), TABLE_ROWS).alias("image")), f"SELECT id, {TABLES_SQL} AS image FROM (SELECT id, xor(h << 37, h) AS h FROM {list_sql('C')})"),
    "gf2_basis": q(lambda s, d: basis.basis(images(s, d, "A")), f"{echelon_sql(f'SELECT {MATVEC_SQL} AS h FROM {list_sql("A")}')} SELECT * FROM basis"),
    "gf2_rank": q(lambda s, d: basis.rank(basis.basis(keys(s, d, "B").filter("id <= 20"))), f"{echelon_sql(f'SELECT h FROM {list_sql("B")} WHERE id <= 20')} SELECT count(*) AS rank FROM basis"),
    "gf2_change": q(identity, "SELECT CAST(range AS INTEGER) AS bit, CASE WHEN range = 63 THEN -9223372036854775808 ELSE 1::BIGINT << range END AS product FROM range(64)"),
    "gf2_span": q(
        spanned,
        f"WITH RECURSIVE g AS (SELECT h, row_number() OVER (ORDER BY id) AS n FROM {list_sql('B')} WHERE id <= 10), sums AS (SELECT 0::BIGINT AS s, 0::BIGINT AS n UNION ALL SELECT xor(s, w * h), g.n FROM sums JOIN g ON g.n = sums.n + 1, (SELECT unnest([0, 1])::BIGINT AS w)) SELECT id, h IN (SELECT s FROM sums) AS inside FROM {list_sql('A')}",
    ),
    "dup_positions": q(
        lambda s, d: stores.duplicate_positions(s, sorted_list(s, d, mixed(lists.masked(keys(s, d, "A"), 26).withColumn("h", F.shiftright("h", 10))))).select("pos", bits.hex16(F.col("h")).alias("key_hex")),
        f"SELECT pos, lpad(lower(printf('%x', h)), 16, '0') AS key_hex FROM (SELECT h, row_number() OVER w - 1 AS pos, lag(h) OVER w AS before FROM (SELECT xor((h >> 10) << 37, h >> 10) AS h FROM {list_sql('A')}) WINDOW w AS (ORDER BY h < 0, h)) WHERE h = before",
    ),
    "probed_index": q(lambda s, d: stores.probed_index(s, sorted_list(s, d, keys(s, d, "A")), 6, BITS), f"SELECT p.range AS prefix, CAST((SELECT count(*) FROM {list_sql('A')} WHERE h >> 20 < p.range) AS BIGINT) AS off FROM range(65) p"),
    "keys_between": q(
        lambda s, d: s.read.format("xor_keys").load(sorted_list(s, d, keys(s, d, "A"))).filter("h >= 1000000 AND h < 9000000"), f"SELECT h FROM {list_sql('A')} WHERE h >= 1000000 AND h < 9000000"
    ),
    "pair_count": q(
        lambda s, d: join.tested_pairs(keys(s, d, "A"), keys(s, d, "B"), 4, BITS),
        f"SELECT u.range AS u, CAST(sum(na * nb) AS BIGINT) AS pairs FROM range(16) u, (SELECT h >> 22 AS pa, count(*) AS na FROM {list_sql('A')} GROUP BY 1) a, (SELECT h >> 22 AS pb, count(*) AS nb FROM {list_sql('B')} GROUP BY 1) b WHERE pb = xor(pa, u.range) GROUP BY 1",
    ),
    "xor3_all_pairs": q(solutions, join_sql()),
    "xor3_prefix": q(lambda s, d: join.prefix(*three(s, d), 4, BITS), join_sql()),
    "xor3_prefix_20": q(lambda s, d: join.prefix(*[lists.masked(x, 20) for x in three(s, d)], 4, 20), join_sql(20)),
    "xor3_slice": q(lambda s, d: join.by_slice(*three(s, d), BITS), join_sql()),
    "xor3_stored": q(lambda s, d: join.xor3_join(*three(s, d), strategy="stored", width=BITS, k=TASK_BITS), join_sql()),
    "xor3_stored_slice": q(lambda s, d: join.stored_join(*three(s, d), BITS, TASK_BITS, kernel="slice"), join_sql()),
    "xor3_resumed": q(lambda s, d: ledger.solutions(resumed(s, d)).select("a", "b"), join_sql()),
    "task_pairs": q(
        lambda s, d: ledger.task_pairs(resumed(s, d, found=False)).select("task_id", "pairs"),
        f"WITH na AS (SELECT h >> {BITS - TASK_BITS} AS p, count(*) AS n FROM {list_sql('A')} GROUP BY 1), nb AS (SELECT h >> {BITS - TASK_BITS} AS p, count(*) AS n FROM {list_sql('B')} GROUP BY 1) SELECT CAST(v * 8 + u AS INTEGER) AS task_id, CAST(coalesce(na.n * nb.n, 0) AS BIGINT) AS pairs FROM range(8) x(v) CROSS JOIN range(8) y(u) LEFT JOIN na ON na.p = v LEFT JOIN nb ON nb.p = xor(u, v)",
    ),
    "solution_lines": q(lambda s, d: solutions(s, d).select(match.solution_text().alias("line")), f"SELECT printf('%016x ^ %016x ... --> 0', a, b) AS line FROM ({join_sql()})"),
    "xor3_auto": q(lambda s, d: join.xor3_join(*three(s, d), width=BITS), join_sql()),
    "preimages": q(lambda s, d: match.joined_preimages(*three(s, d), width=BITS), PREIMAGE_SQL),
    "solution_keys": q(lambda s, d: match.needed_keys(*three(s, d), width=BITS), f"WITH s AS ({join_sql()}) SELECT 0 AS role, a AS h FROM s UNION SELECT 1, b FROM s UNION SELECT 2, xor(a, b) FROM s"),
    "rank_best": q(
        lambda s, d: match.best(match.highest(*digested(s, d), width=BITS), "score", "a_id").select("a_id", "b_id", "c_id", "score", F.col("width").cast("int").alias("width")),
        f"""WITH x AS (SELECT a_id, b_id, c_id, {xor_word_sql(33)} AS w, {xor_word_sql(49)} AS six FROM ({PREIMAGE_SQL}))
SELECT *, CAST(score + 96 AS INTEGER) AS width FROM (SELECT a_id, b_id, c_id, CAST(CASE WHEN w = 0 THEN 32 ELSE bit_count(xor(w - 1, w)) - 1 END AS INTEGER) AS score FROM x WHERE six = 0) ORDER BY score DESC, a_id LIMIT 1""",
    ),
    "share_purge": q(lambda s, d: shares.dedup_shares(repeated_shares(s, d)), f'SELECT "extraNonce2", "extraNonce1", nonce, ntime, kind, max(difficulty) AS difficulty FROM {REPEATED_SQL} GROUP BY ALL'),
    "share_purge_by_part": q(purged_by_part, f'SELECT "extraNonce2", "extraNonce1", nonce, ntime, kind, max(difficulty) AS difficulty FROM {REPEATED_SQL} GROUP BY ALL'),
    "reject_counts": q(
        reject_counts,
        f"SELECT reason, count(*) AS n, count(*) AS counted FROM (SELECT CASE WHEN kind NOT BETWEEN 0 AND 2 THEN 'kind' WHEN digest IS NULL THEN 'null' WHEN substr(digest, 64, 1) <> '0' THEN 'digest' ELSE 'ok' END AS reason FROM {DIGEST_SQL.replace(SHARES_SQL, REPEATED_SQL)}) GROUP BY reason",
    ),
    "share_lines": q(
        lambda s, d: share_rows(s, d).select("nonce", "ntime", shares.share_text().alias("line")), f"""SELECT nonce, ntime, printf('(%d) -- %08x | %08x | %08x | %08x', kind, "extraNonce2", "extraNonce1", nonce, ntime) AS line FROM {SHARES_SQL}"""
    ),
    "vector_lines": q(lambda s, d: keys(s, d, "C").select("id", bits.vector_text(F.shiftleft("h", 38), BITS).alias("line")), f"SELECT id, '[' || translate(lpad(bin(h), {BITS}, '0'), '0', ' ') || ']' AS line FROM {list_sql('C')}"),
    "share_dup_count": q(lambda s, d: shares.duplicate_shares(repeated_shares(s, d)), f'SELECT count(*) - count(DISTINCT ("extraNonce2", "extraNonce1", nonce, ntime, kind)) AS n_dups FROM {REPEATED_SQL}'),
    "share_kinds": q(
        lambda s, d: shares.with_key(repeated_shares(s, d)).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.substring("digest", 64, 1) == "0").alias("ends")),
        f"SELECT kind, count(*) AS n, count(*) FILTER (substr(digest, 64, 1) = '0') AS ends FROM {DIGEST_SQL.replace(SHARES_SQL, REPEATED_SQL)} WHERE kind BETWEEN 0 AND 2 GROUP BY kind",
    ),
    "role_matches": q(lambda s, d: match.role_matches(match.matched_shares(*matched(s, d), 3)), f"{MATCH_SQL} SELECT role, count(*) AS n FROM matched GROUP BY role"),
    "share_preimages": q(
        lambda s, d: share_solutions(s, d).select("a", "b", "c", *[F.col(f"share_{x}.{f}").alias(f"{x}_{f}") for x in "abc" for f in ("nonce", "ntime")]),
        f"{MATCH_SQL}, one AS (SELECT role, h, min((nonce, ntime)) AS r FROM matched GROUP BY role, h) SELECT s.a, s.b, xor(s.a, s.b) AS c, {', '.join(f'{x}.r[1] AS {x}_nonce, {x}.r[2] AS {x}_ntime' for x in 'abc')} FROM s JOIN one a ON a.role = 0 AND a.h = s.a JOIN one b ON b.role = 1 AND b.h = s.b JOIN one c ON c.role = 2 AND c.h = xor(s.a, s.b)",
    ),
    "winner_lines": q(
        lambda s, d: share_solutions(s, d).selectExpr("a", "b", "inline(array(share_a, share_b, share_c))").select("a", "b", "kind", shares.winner_text().alias("line")),
        f"""{MATCH_SQL}, one AS (SELECT role, h, min((nonce, ntime, kind, difficulty, "extraNonce2", "extraNonce1")) AS r FROM matched GROUP BY role, h), t AS (SELECT s.a, s.b, unnest([a.r, b.r, c.r]) AS r FROM s JOIN one a ON a.role = 0 AND a.h = s.a JOIN one b ON b.role = 1 AND b.h = s.b JOIN one c ON c.role = 2 AND c.h = xor(s.a, s.b))
SELECT a, b, r[3] AS kind, printf('Share("%08x", "%08x", "%08x", kind=%d, D=%d, extranonce1="%08x")', r[5], r[1], r[2], r[3], r[4], r[6]) AS line FROM t""",
    ),
    "ledger_totals": q(
        lambda s, d: ledger.totals(ledger.first_records(ledger_rows(s, d))),
        "SELECT count(*) AS tasks, CAST(sum(k) AS BIGINT) AS solutions, round(sum(sec), 4) AS seconds FROM (SELECT user_id, arg_min(event_id % 4, event_id) AS k, arg_min(round(abs(value), 4), event_id) AS sec FROM events GROUP BY user_id)",
    ),
    "ledger_solutions": q(
        lambda s, d: ledger.solutions(ledger.first_records(ledger_rows(s, d))),
        "SELECT e * 7 + i AS a, user_id * 3 AS b, xor(e * 7 + i, user_id * 3) AS c FROM (SELECT user_id, min(event_id) AS e FROM events GROUP BY user_id), range(4) r(i) WHERE i < e % 4",
    ),
    "ledger_stream": q(
        streamed,
        "SELECT 'h' || (e % 3) AS hostname, count(*) AS tasks, CAST(sum(e % 4) AS BIGINT) AS solutions, CAST(sum(e % 1000) AS BIGINT) AS pairs, round(sum(sec), 4) AS seconds FROM (SELECT user_id, min(event_id) AS e, arg_min(round(abs(value), 4), event_id) AS sec FROM events GROUP BY user_id) GROUP BY 1",
    ),
    "pending_tasks": q(lambda s, d: ledger.pending(*event_ledger(s, d)), "SELECT event_id AS task_id FROM events WHERE event_type <> 'purchase' OR event_type IS NULL"),
    "task_states": q(
        lambda s, d: ledger.states(*event_ledger(s, d)).select("state", "n", F.round("cpu_seconds", 2).alias("cpu_seconds")),
        "SELECT CASE WHEN event_type = 'purchase' THEN 'DONE' ELSE 'PENDING' END AS state, count(*) AS n, round(round(coalesce(sum(round(abs(value), 4)) FILTER (event_type = 'purchase'), 0), 4), 2) AS cpu_seconds FROM events GROUP BY 1",
    ),
}
QUERIES = {name: fn for name, (fn, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items()}
