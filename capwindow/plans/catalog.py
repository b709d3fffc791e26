"""The registered queries of the counter engine and their SQL twins, side by side."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capwindow import engine
from capwindow.functions import commands, windows
from capwindow.operators import counters, oplog, replication, snapshot
from capwindow.plans import choose
from capwindow.schema import OPS
from capwindow.sources import wal
from capwindow.sources.tables import table
from capwindow.streaming import counters as streaming

DAY, AS_OF = 86400, 1705320000
#: The number that snapshots are taken at: half of the log's largest.
SNAP = "(SELECT (max(event_id) + 1) // 2 FROM events)"
_QUERIES, _SQL = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)


def _half(spark, sf_dir: str) -> int:
    """SNAP of these tables, from the statistics of the files."""
    return ((table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) + 1) // 2


# SQL fragments: the logs, and the fold as gaps and islands.


def events_sql(bs: int | str = DAY, lsn: str = "event_id + 1", more: str = "") -> str:
    return (
        f"SELECT {lsn} AS lsn, 0 AS pos, CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'INCR' END AS op, 'user_' || user_id AS key, "
        f"CAST({bs} AS BIGINT) AS bs, epoch_us(ts) // 1000000 AS t FROM events{more}"
    )


ORDERS_SQL = "SELECT o_orderkey + 1 AS lsn, 0 AS pos, 'INCR' AS op, 'cust_' || o_custkey AS key, CAST(31536000 AS BIGINT) AS bs, epoch_us(o_orderdate) // 1000000 AS t FROM orders"


def fold_ctes(ops: str, name: str = "folded") -> str:
    """CTEs that end in one with the results of the operations."""
    return (
        f"{name}_ops AS ({ops}), {name}_lag AS (SELECT *, lag(op) OVER w AS pop, lag(t) OVER w AS pt FROM {name}_ops WINDOW w AS (PARTITION BY key, bs ORDER BY lsn, pos)), "
        f"{name}_flag AS (SELECT *, CASE WHEN op = 'DEL' OR pop IS NULL OR pop = 'DEL' OR pt < t - t % bs THEN 1 ELSE 0 END AS reset FROM {name}_lag), "
        f"{name}_grp AS (SELECT *, sum(reset) OVER (PARTITION BY key, bs ORDER BY lsn, pos ROWS UNBOUNDED PRECEDING) AS g FROM {name}_flag), "
        f"{name} AS (SELECT lsn, pos, op, key, bs, t, CAST(CASE WHEN op = 'INCR' THEN row_number() OVER (PARTITION BY key, bs, g ORDER BY lsn, pos) "
        f"WHEN pop = 'INCR' THEN 1 ELSE 0 END AS BIGINT) AS result FROM {name}_grp)"
    )


def fold_sql(ops: str, tail: str = "SELECT lsn, op, key, bs, t, result FROM folded") -> str:
    return f"WITH {fold_ctes(ops)} {tail}"


def state_cte(source: str = "folded", name: str = "state") -> str:
    return (
        f"{name} AS (SELECT key, bs, arg_max(op, lsn * 1000 + pos) AS op, arg_max(t, lsn * 1000 + pos) AS t, arg_max(result, lsn * 1000 + pos) AS value, max(lsn) AS lsn FROM {source} GROUP BY key, bs)"
    )


def fold_columns(df: DataFrame) -> DataFrame:
    return df.select("lsn", "op", "key", "bs", "t", "result")


def events(spark, sf_dir, *args, **kwargs) -> DataFrame:
    return oplog.event_ops(table(spark, sf_dir, "events"), *args, **kwargs)


# INCR and the fold


@register("incr_fold", fold_sql(events_sql()))
def incr_fold(spark, sf_dir):
    return fold_columns(counters.fold(events(spark, sf_dir)))


@register("incr_fold_permuted", fold_sql(events_sql(lsn="xor(event_id, 7) + 1")))
def incr_fold_permuted(spark, sf_dir):
    return fold_columns(counters.fold(events(spark, sf_dir, permuted=True)))


@register("incr_late_orders", fold_sql(ORDERS_SQL))
def incr_late_orders(spark, sf_dir):
    return fold_columns(counters.fold(oplog.order_ops(table(spark, sf_dir, "orders"))))


@register("incr_multi_window", fold_sql("SELECT e.* REPLACE (b.bs AS bs) FROM (" + events_sql() + ") e, (VALUES (60::BIGINT), (3600::BIGINT), (86400::BIGINT)) b(bs)"))
def incr_multi_window(spark, sf_dir):
    return fold_columns(counters.fold(oplog.spread_windows(events(spark, sf_dir), [60, 3600, DAY])))


@register("incr_fold_chunked", fold_sql(events_sql(lsn="xor(event_id, 7) + 1")))
def incr_fold_chunked(spark, sf_dir):
    return fold_columns(counters.fold_chunked(events(spark, sf_dir, permuted=True), 1000))


HOT_SQL = "SELECT event_id + 1 AS lsn, 0 AS pos, CASE WHEN event_id % 97 = 0 THEN 'DEL' ELSE 'INCR' END AS op, 'type_' || event_type AS key, CAST(86400 AS BIGINT) AS bs, epoch_us(ts) // 1000000 AS t FROM events"


@register("incr_hot_keys", fold_sql(HOT_SQL))
def incr_hot_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 97 == 0, "DEL").otherwise("INCR")
    ops = oplog.build_ops(e, F.col("event_id") + 1, F.concat(F.lit("type_"), "event_type"), windows.epoch_seconds(F.col("ts")), DAY, op)
    return fold_columns(counters.fold_chunked(ops, 2000))


@register("incr_monotone_fastpath", fold_sql(events_sql()))
def incr_monotone(spark, sf_dir):
    return fold_columns(counters.fold_monotone(events(spark, sf_dir)))


@register("incr_planned", fold_sql(events_sql()))
def incr_planned(spark, sf_dir):
    ops = events(spark, sf_dir)
    return fold_columns(choose.planned_fold(ops))


@register("event_time_windows", "SELECT 'cust_' || o_custkey AS key, CAST(31536000 AS BIGINT) AS bs, epoch_us(o_orderdate) // 1000000 // 31536000 * 31536000 AS window_start, count(*) AS n FROM orders GROUP BY ALL")
def event_time_windows(spark, sf_dir):
    return counters.window_counts(oplog.order_ops(table(spark, sf_dir, "orders")))


# GET

GET_SQL = f"SELECT key, bs, CAST(CASE WHEN t < {AS_OF} - {AS_OF} % bs THEN 0 ELSE value END AS BIGINT) AS value FROM state WHERE op = 'INCR'"
KNOWN = f" WHERE epoch_us(ts) // 1000000 <= {AS_OF}"


@register("get_asof", f"WITH {fold_ctes(events_sql(more=KNOWN))}, {state_cte()} {GET_SQL}")
def get_asof(spark, sf_dir):
    return counters.get_as_of(events(spark, sf_dir).where(F.col("t") <= AS_OF), AS_OF)


@register("get_lapsed_zero", f"WITH {fold_ctes(events_sql(3600, more=KNOWN))}, {state_cte()}, got AS ({GET_SQL}) SELECT key, bs, value FROM got WHERE value = 0")
def get_lapsed_zero(spark, sf_dir):
    return counters.get_as_of(events(spark, sf_dir, 3600).where(F.col("t") <= AS_OF), AS_OF).where(F.col("value") == 0)


@register(
    "get_missing_zero",
    f"WITH {fold_ctes(events_sql(more=KNOWN))}, {state_cte()}, got AS ({GET_SQL}), probes AS (SELECT 'user_' || c_custkey AS key, CAST({DAY} AS BIGINT) AS bs FROM customer) "
    "SELECT p.key, p.bs, coalesce(g.value, 0) AS value FROM probes p LEFT JOIN got g ON p.key = g.key AND p.bs = g.bs",
)
def get_missing_zero(spark, sf_dir):
    probes = table(spark, sf_dir, "customer").select(F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("key"), F.lit(DAY).cast("bigint").alias("bs"))
    return counters.get_many(probes, events(spark, sf_dir).where(F.col("t") <= AS_OF), AS_OF).select("key", "bs", "value")


# DEL and MDEL


@register("del_result", fold_sql(events_sql(), "SELECT lsn, key, bs, result FROM folded WHERE op = 'DEL'"))
def del_result(spark, sf_dir):
    return counters.fold(events(spark, sf_dir)).where(F.col("op") == "DEL").select("lsn", "key", "bs", "result")


@register(
    "del_then_incr",
    fold_sql(events_sql(), "SELECT lsn, key, result FROM (SELECT *, lag(op) OVER (PARTITION BY key, bs ORDER BY lsn) AS before FROM folded) WHERE op = 'INCR' AND before = 'DEL'"),
)
def del_then_incr(spark, sf_dir):
    before = F.lag("op").over(Window.partitionBy("key", "bs").orderBy("lsn"))
    return counters.fold(events(spark, sf_dir)).withColumn("before", before).where((F.col("op") == "INCR") & (F.col("before") == "DEL")).select("lsn", "key", "result")


#: Errors delete the user's counters of a day twice and of an hour once, in this order.
MDEL_PAIRS = (DAY, 3600, DAY)
MDEL_OPS = " UNION ALL ".join(
    [f"SELECT event_id + 1 AS lsn, 0 AS pos, 'INCR' AS op, 'user_' || user_id AS key, CAST({bs} AS BIGINT) AS bs, epoch_us(ts) // 1000000 AS t, false AS asked FROM events WHERE event_type <> 'error'" for bs in (DAY, 3600)]
    + [f"SELECT event_id + 1, {i}, 'DEL', 'user_' || user_id, {bs}, epoch_us(ts) // 1000000, true FROM events WHERE event_type = 'error'" for i, bs in enumerate(MDEL_PAIRS)]
)


@register("mdel_result", fold_sql(MDEL_OPS, "SELECT lsn, 'ok|' || string_agg(CAST(result AS VARCHAR), ';' ORDER BY pos) AS response FROM folded WHERE op = 'DEL' GROUP BY lsn"))
def mdel_result(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    incr = oplog.spread_windows(oplog.event_ops(e.where(F.col("event_type") != "error"), deletes=False), [DAY, 3600])
    pairs = F.posexplode(F.array(*(F.lit(b).cast("bigint") for b in MDEL_PAIRS))).alias("pos", "bs")
    asked = e.where(F.col("event_type") == "error").select((F.col("event_id") + 1).alias("lsn"), pairs, F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"), windows.epoch_seconds(F.col("ts")).alias("t"))
    return counters.multi_delete(asked, incr)


@register("mdel_duplicate_keys", fold_sql(MDEL_OPS, "SELECT lsn, sum(CASE WHEN pos = 0 THEN result ELSE 0 END)::BIGINT AS first, sum(CASE WHEN pos = 2 THEN result ELSE 0 END)::BIGINT AS again FROM folded WHERE op = 'DEL' GROUP BY lsn"))
def mdel_duplicate_keys(spark, sf_dir):
    parts = F.split(F.substring_index("response", "|", -1), ";")
    return mdel_result(spark, sf_dir).select("lsn", parts[0].cast("bigint").alias("first"), parts[2].cast("bigint").alias("again"))


# MSGSIZE and WATCH


@register("msgsize", "SELECT 'ok|4096' AS response")
def msgsize(spark, sf_dir):
    asked = spark.range(1).select(F.lit(1).cast("bigint").alias("lsn"), F.lit(0).cast("bigint").alias("t"), F.lit("MSGSIZE").alias("query"))
    return engine.run_commands(asked).select("response")


SERIES = (
    "after_op AS (SELECT key, bs, lsn, pos, t, CASE WHEN op = 'INCR' THEN result ELSE 0 END AS value, lead(t) OVER (PARTITION BY key, bs ORDER BY lsn, pos) AS next_t FROM folded), "
    "series AS (SELECT key, bs, lsn, pos, t, value FROM after_op UNION ALL SELECT key, bs, lsn, 1073741824, t - t % bs + bs, 0 FROM after_op WHERE value > 0 AND (next_t IS NULL OR next_t >= t - t % bs + bs))"
)


@register(
    "watch_changes",
    f"WITH {fold_ctes(events_sql())}, {SERIES}, b AS (SELECT *, coalesce(lag(value) OVER (PARTITION BY key, bs ORDER BY lsn, pos), 0) AS before FROM series) SELECT key, bs, lsn, t, before, value FROM b WHERE value <> before",
)
def watch_changes(spark, sf_dir):
    return counters.watch_changes(events(spark, sf_dir))


@register(
    "watch_first_change",
    f"WITH {fold_ctes(events_sql())}, {SERIES}, init AS (SELECT key, bs, arg_max(value, lsn * 2000000000 + pos) AS initial FROM series WHERE t <= {AS_OF} GROUP BY key, bs), "
    f"later AS (SELECT s.*, coalesce(i.initial, 0) AS initial FROM series s LEFT JOIN init i ON s.key = i.key AND s.bs = i.bs WHERE s.t > {AS_OF}) "
    "SELECT key, bs, arg_min(initial, lsn * 2000000000 + pos) AS initial, arg_min(t, lsn * 2000000000 + pos) AS t, arg_min(value, lsn * 2000000000 + pos) AS value FROM later WHERE value <> initial GROUP BY key, bs",
)
def watch_first_change(spark, sf_dir):
    return counters.watch_first(events(spark, sf_dir), AS_OF)


# Commands

COMMAND_TEXT = (
    "CASE event_id % 14 WHEN 0 THEN 'INCR user_' || user_id || ' 600' WHEN 1 THEN 'get  user_' || user_id || chr(9) || '060' WHEN 2 THEN ' del user_' || user_id || ' 0' WHEN 3 THEN 'MDEL user_1 60 user_2' "
    "WHEN 4 THEN 'MSGSIZE' WHEN 5 THEN 'INCR user_' || user_id || ' 4294967296' WHEN 6 THEN 'SET a b' WHEN 7 THEN 'INCR key ' || event_type WHEN 8 THEN 'mdel' WHEN 9 THEN 'INCR a#b 60' "
    "WHEN 10 THEN 'INCR k 18446744073709551616' WHEN 11 THEN '' WHEN 12 THEN 'MDEL a 60 b x' ELSE 'GET ' || repeat('k', 1025) || ' 60' END"
)


def command_rows(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.expr(COMMAND_TEXT.replace("chr(9)", "char(9)"))
    return e.select((F.col("event_id") + 1).alias("lsn"), windows.epoch_seconds(F.col("ts")).alias("t"), text.alias("query"))


TOKENS_SQL = (
    f"cmd AS (SELECT event_id + 1 AS lsn, {COMMAND_TEXT} AS query FROM events), "
    "tok AS (SELECT lsn, query, CASE WHEN regexp_matches(query, '^[A-Za-z0-9_\\-\\t\\n ]*$') THEN list_filter(regexp_split_to_array(query, '[\\t\\n ]+'), lambda x: x <> '') END AS tokens FROM cmd)"
)
ID_SQL = "CASE upper(tokens[1]) WHEN 'INCR' THEN 1 WHEN 'GET' THEN 2 WHEN 'DEL' THEN 3 WHEN 'MSGSIZE' THEN 4 WHEN 'MDEL' THEN 5 WHEN 'WATCH' THEN 6 ELSE 0 END"
ARITY_SQL = (
    "CASE WHEN tokens IS NULL THEN 'invalid symbol' WHEN id = 0 THEN 'invalid command' WHEN id IN (1, 2, 3, 6) AND len(tokens) <> 3 OR id = 4 AND len(tokens) <> 1 OR id = 5 AND len(tokens) % 2 = 0 THEN 'invalid arguments' END"
)
PAIR_SQL = (
    "CASE WHEN length(k) > 1024 THEN 'key length exceeds maximum' WHEN NOT regexp_full_match(b, '[0-9]+') OR TRY_CAST(b AS HUGEINT) > 18446744073709551615 THEN 'batch is not a number' "
    "WHEN CAST(b AS HUGEINT) < 1 OR CAST(b AS HUGEINT) > 4294967295 THEN 'invalid batch size: ' || CAST(CAST(b AS HUGEINT) AS VARCHAR) || ' (must be between 1 and 4294967295)' END"
)


@register("parse_tokens", f"WITH {TOKENS_SQL} SELECT lsn, array_to_string(tokens, ',') AS tokens, CASE WHEN tokens IS NULL THEN 'invalid symbol' END AS error FROM tok")
def parse_tokens(spark, sf_dir):
    words = commands.tokens(F.col("query"))
    return command_rows(spark, sf_dir).select("lsn", F.array_join(words, ",").alias("tokens"), F.when(words.isNull(), commands.INVALID_SYMBOL).alias("error"))


@register("analyze_arity", f"WITH {TOKENS_SQL}, ids AS (SELECT *, {ID_SQL} AS id FROM tok) SELECT lsn, CAST(id AS INTEGER) AS command_id, {ARITY_SQL} AS error FROM ids")
def analyze_arity(spark, sf_dir):
    words = commands.tokens(F.col("query"))
    number = F.coalesce(commands.command_id(F.get(words, F.lit(0))), F.lit(0))
    error = F.when(words.isNull(), commands.INVALID_SYMBOL).otherwise(commands.arity_error(number, F.greatest(F.size(words) - 1, F.lit(0))))
    return command_rows(spark, sf_dir).select("lsn", number.alias("command_id"), error.alias("error"))


@register(
    "command_errors",
    f"WITH {TOKENS_SQL}, ids AS (SELECT *, {ID_SQL} AS id FROM tok), bad AS (SELECT *, {ARITY_SQL} AS arity FROM ids), "
    "pairs AS (SELECT lsn, i, tokens[2 * i] AS k, tokens[2 * i + 1] AS b FROM (SELECT lsn, tokens, unnest(generate_series(1, (len(tokens) - 1) // 2)) AS i FROM bad WHERE arity IS NULL AND id <> 4)), "
    f"errs AS (SELECT lsn, arg_min(e, i) AS pair FROM (SELECT lsn, i, {PAIR_SQL} AS e FROM pairs) WHERE e IS NOT NULL GROUP BY lsn) "
    "SELECT b.lsn, coalesce(b.arity, e.pair) AS error FROM bad b LEFT JOIN errs e ON b.lsn = e.lsn",
)
def command_errors(spark, sf_dir):
    return commands.parse(command_rows(spark, sf_dir)).select("lsn", "error")


@register("batch_key_errors", f"WITH p AS (SELECT event_id, 'user_' || user_id AS k, CASE event_id % 5 WHEN 0 THEN '0' WHEN 1 THEN '060' WHEN 2 THEN '4294967296' WHEN 3 THEN 'abc' ELSE '18446744073709551616' END AS b FROM events) SELECT event_id, {PAIR_SQL} AS error, CASE WHEN event_id % 5 = 1 THEN CAST(60 AS BIGINT) END AS bs FROM p")
def batch_key_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.element_at(F.array(*map(F.lit, ("0", "060", "4294967296", "abc", "18446744073709551616"))), (F.col("event_id") % 5 + 1).cast("int"))
    error = commands.key_error(F.concat(F.lit("user_"), F.col("user_id").cast("string")), text)
    return e.select("event_id", error.alias("error"), F.when(error.isNull(), commands.batch_size(text).cast("bigint")).alias("bs"))


@register("response_format", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'err|invalid command' ELSE 'ok|' || CASE WHEN event_id % 3 = 0 THEN '18446744071562067968' ELSE CAST(user_id AS VARCHAR) END END AS response FROM events")
def response_format(spark, sf_dir):
    value = F.when(F.col("event_id") % 3 == 0, F.lit(1 << 31)).otherwise(F.col("user_id"))
    error = F.when(F.col("event_type") == "error", commands.INVALID_COMMAND)
    return table(spark, sf_dir, "events").select("event_id", commands.respond(commands.unsigned(value), error).alias("response"))


@register("response_parse", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'err' ELSE 'ok' END AS status, CASE WHEN event_type = 'error' THEN 'a|b' ELSE CAST(user_id AS VARCHAR) END AS payload FROM events")
def response_parse(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "err|a|b").otherwise(F.concat(F.lit("ok|"), F.col("user_id").cast("string")))
    status, payload = commands.response_parts(F.col("text"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text")).select("event_id", status.alias("status"), payload.alias("payload"))


SIZE_UNITS = ("B", "b", "", "KB", "Kb", "kb", "MB", "GB", "gB", "TB")


@register("size_parse", "SELECT event_id, CASE WHEN event_id % 10 < 3 THEN user_id WHEN event_id % 10 < 6 THEN user_id * 1024 WHEN event_id % 10 = 6 THEN user_id * 1048576 WHEN event_id % 10 = 7 THEN user_id * 1073741824 END AS bytes FROM events")
def size_parse(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, SIZE_UNITS)), (F.col("event_id") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", commands.size_bytes(F.concat(F.col("user_id").cast("string"), unit)).alias("bytes"))


@register("hex_time", "SELECT event_id, lower(to_hex(epoch_us(ts) // 1000000)) AS hex, epoch_us(ts) // 1000000 AS t FROM events")
def hex_time(spark, sf_dir):
    text = commands.time_hex(windows.epoch_seconds(F.col("ts")))
    return table(spark, sf_dir, "events").select("event_id", text.alias("hex"), commands.hex_time(text).alias("t"))


@register("partition_hash", "SELECT DISTINCT 'user_' || user_id AS key, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split('user_' || user_id, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 10 AS BIGINT) AS part FROM events")
def partition_hash(spark, sf_dir):
    key = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select(key.alias("key")).distinct().select("key", commands.partition_of(F.col("key")).alias("part"))


@register("window_bounds", f"SELECT event_id, t - t % 600 AS starts, t - t % 600 + 599 AS ends, {AS_OF} > t - t % 600 + 599 AS expired FROM (SELECT event_id, epoch_us(ts) // 1000000 AS t FROM events)")
def window_bounds(spark, sf_dir):
    windows.register(spark)
    t = table(spark, sf_dir, "events").select("event_id", windows.epoch_seconds(F.col("ts")).alias("t"))
    return t.selectExpr("event_id", "window_start(t, 600) AS starts", "window_end(t, 600) AS ends", f"window_expired(t, 600, {AS_OF}) AS expired")


CHAT = "SELECT event_id + 1 AS lsn, 0 AS pos, CASE WHEN event_type = 'error' THEN 'DEL' WHEN event_type = 'view' THEN 'GET' ELSE 'INCR' END AS op, 'user_' || user_id AS key, CAST(86400 AS BIGINT) AS bs, epoch_us(ts) // 1000000 AS t FROM events"


@register(
    "run_commands",
    f"WITH chat AS ({CHAT}), {fold_ctes("SELECT * FROM chat WHERE op <> 'GET'")}, seen AS (SELECT c.lsn, c.op, c.t, c.bs, f.op AS fop, f.t AS ft, f.result FROM chat c ASOF LEFT JOIN folded f ON c.key = f.key AND c.bs = f.bs AND c.lsn >= f.lsn) "
    "SELECT lsn, 'ok|' || CASE WHEN op <> 'GET' THEN result WHEN fop = 'INCR' AND ft >= t - t % bs THEN result ELSE 0 END AS response FROM seen",
)
def run_commands(spark, sf_dir):
    word = F.when(F.col("event_type") == "error", "DEL").when(F.col("event_type") == "view", "get").otherwise("INCR")
    text = F.concat_ws(" ", word, F.concat(F.lit("user_"), F.col("user_id").cast("string")), F.lit("86400"))
    asked = table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("lsn"), windows.epoch_seconds(F.col("ts")).alias("t"), text.alias("query"))
    return engine.run_commands(asked).select("lsn", "response")


ALL_WORDS = (
    "CASE WHEN event_id % 12 = 0 THEN 'WATCH' WHEN event_id % 12 = 1 THEN 'GET' WHEN event_id % 24 = 2 THEN 'MDEL' WHEN event_id % 12 = 3 THEN 'SET' "
    "WHEN event_id % 12 = 4 THEN 'MSGSIZE' WHEN event_type = 'error' THEN 'DEL' ELSE 'INCR' END"
)


@register(
    "run_all_commands",
    f"WITH raw AS (SELECT event_id + 1 AS lsn, 'user_' || user_id AS key, CAST(86400 AS BIGINT) AS bs, epoch_us(ts) // 1000000 AS t, {ALL_WORDS} AS word FROM events), "
    + fold_ctes(
        "SELECT lsn, 0 AS pos, CASE word WHEN 'MDEL' THEN 'DEL' ELSE word END AS op, key, bs, t FROM raw WHERE word IN ('INCR', 'DEL', 'MDEL') UNION ALL SELECT lsn, 1, 'DEL', key, bs, t FROM raw WHERE word = 'MDEL'"
    )
    + f", {SERIES}, ends AS (SELECT key, bs, lsn, arg_max(op, pos) AS op, arg_max(t, pos) AS t, arg_max(result, pos) AS result FROM folded GROUP BY key, bs, lsn), "
    "reads AS (SELECT r.lsn, r.word, r.key, r.bs, r.t, e.lsn AS at, CASE WHEN e.op = 'INCR' AND e.t >= r.t - r.t % r.bs THEN e.result ELSE 0 END AS value FROM raw r ASOF LEFT JOIN ends e ON r.key = e.key AND r.bs = e.bs AND r.lsn >= e.lsn WHERE r.word IN ('GET', 'WATCH')), "
    "seen AS (SELECT w.lsn, arg_min(s.value, s.lsn * 2000000000 + s.pos) AS seen FROM reads w JOIN series s ON w.key = s.key AND w.bs = s.bs WHERE w.word = 'WATCH' AND (s.lsn > w.lsn OR s.lsn = w.at AND s.pos = 1073741824 AND s.t > w.t) AND s.value <> w.value GROUP BY w.lsn), "
    "done AS (SELECT lsn, string_agg(CAST(result AS VARCHAR), ';' ORDER BY pos) AS r FROM folded GROUP BY lsn) "
    "SELECT raw.lsn, CASE raw.word WHEN 'SET' THEN 'err|invalid command' WHEN 'MSGSIZE' THEN 'ok|4096' WHEN 'GET' THEN 'ok|' || reads.value WHEN 'WATCH' THEN 'ok|' || seen.seen ELSE 'ok|' || done.r END AS response "
    "FROM raw LEFT JOIN reads ON raw.lsn = reads.lsn LEFT JOIN seen ON raw.lsn = seen.lsn LEFT JOIN done ON raw.lsn = done.lsn",
)
def run_all_commands(spark, sf_dir):
    """Every command, watches, multi-deletes and errors included, in one log."""
    pair = F.concat(F.lit(" user_"), F.col("user_id").cast("string"), F.lit(" 86400"))
    rows = table(spark, sf_dir, "events").withColumn("word", F.expr(ALL_WORDS))
    text = F.when(F.col("word") == "MSGSIZE", F.col("word")).when(F.col("word") == "MDEL", F.concat("word", pair, pair)).otherwise(F.concat("word", pair))
    return engine.run_commands(rows.select((F.col("event_id") + 1).alias("lsn"), windows.epoch_seconds(F.col("ts")).alias("t"), text.alias("query"))).select("lsn", "response")


# The log


@register("wal_sequence", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS lsn FROM events")
def wal_sequence(spark, sf_dir):
    return oplog.assign_lsn(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id").select("event_id", "lsn")


@register(
    "wal_group_commit",
    f"WITH o AS ({events_sql()}), g AS (SELECT lsn, CASE WHEN t - lag(t) OVER (ORDER BY lsn) > 600 THEN 1 ELSE 0 END AS gap FROM o), r AS (SELECT lsn, sum(gap) OVER (ORDER BY lsn) AS run FROM g) "
    "SELECT lsn, (row_number() OVER (PARTITION BY run ORDER BY lsn) - 1) % 4 + 1 AS place FROM r",
)
def wal_group_commit(spark, sf_dir):
    return counters.commit_places(events(spark, sf_dir), 4, 600, 1000)


@register("wal_records", f"SELECT lsn, CASE op WHEN 'INCR' THEN 1 ELSE 3 END AS command_id, key || ',' || bs || ',' || lower(to_hex(t)) AS arguments FROM ({events_sql()})")
def wal_records(spark, sf_dir):
    return snapshot.to_records(events(spark, sf_dir)).withColumn("arguments", F.array_join("arguments", ","))


def _scratch(spark, name: str) -> str:
    """A new folder in the cluster's shared one; a local one only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/capwindow"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("wal_decode", f"SELECT lsn, 0 AS pos, op, key, bs, t FROM ({events_sql()})")
def wal_decode(spark, sf_dir):
    """The binary form there and back: records in frames by segment, written as files and read again."""
    out = _scratch(spark, "segments")
    wal.write_segments(wal.segment_bytes(snapshot.to_records(snapshot.segments(events(spark, sf_dir), 10000), "segment")), out)
    return snapshot.from_records(wal.read_segments(spark, out))


def _varint_sql(n: str) -> str:
    return f"CAST(greatest(1, ceil(length(ltrim(bin({n}), '0')) / 7.0)) AS BIGINT)"


ROTATE_SQL = (
    f"WITH o AS ({events_sql()}), r AS (SELECT lsn, [key, CAST(bs AS VARCHAR), lower(to_hex(t))] AS a FROM o), "
    f"i AS (SELECT lsn, 1 + {_varint_sql('lsn')} + 2 + list_sum(list_transform(a, lambda x: 2 + length(x))) AS n FROM r), "
    f"s AS (SELECT lsn, CAST(1 + {_varint_sql('n::BIGINT')} + n AS BIGINT) AS bytes FROM i), "
    "b AS (SELECT *, (sum(bytes) OVER (ORDER BY lsn) - bytes) // 10000 AS file FROM s) "
    "SELECT 'wal_' || lpad(CAST(min(lsn) AS VARCHAR), 13, '0') || '.log' AS segment, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM b GROUP BY file"
)


@register("wal_rotation", ROTATE_SQL)
def wal_rotation(spark, sf_dir):
    """Segments of 10,000 bytes."""
    rotated = wal.rotate(snapshot.to_records(events(spark, sf_dir)), 10000)
    return rotated.groupBy("segment").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@register("wal_replay_unexpired", fold_sql(f"SELECT * FROM ({events_sql()}) WHERE NOT {AS_OF} > t - t % bs + bs - 1"))
def wal_replay_unexpired(spark, sf_dir):
    ops = snapshot.from_records(snapshot.to_records(events(spark, sf_dir)))
    return fold_columns(counters.fold(snapshot.unexpired(ops, AS_OF)))


# Snapshots

SNAP_SQL = f"WITH {fold_ctes(events_sql(more=f' WHERE event_id + 1 <= {SNAP}'))}, {state_cte()}, snap AS (SELECT key, bs AS batch_size, value, t AS tx_at, lsn AS tx FROM state WHERE op = 'INCR') "


@register("snapshot_at_lsn", SNAP_SQL + "SELECT * FROM snap")
def snapshot_at_lsn(spark, sf_dir):
    return snapshot.snapshot_at(events(spark, sf_dir), _half(spark, sf_dir))


@register("recover_snapshot_plus_tail", fold_sql(events_sql(), f"SELECT lsn, op, key, bs, t, result FROM folded WHERE lsn > {SNAP}"))
def recover_snapshot_plus_tail(spark, sf_dir):
    ops, at = events(spark, sf_dir), _half(spark, sf_dir)
    return fold_columns(snapshot.recover(snapshot.snapshot_at(ops, at), ops, at))


@register("restore_unexpired", SNAP_SQL + f"SELECT * FROM snap WHERE NOT {AS_OF} > tx_at - tx_at % batch_size + batch_size - 1")
def restore_unexpired(spark, sf_dir):
    return snapshot.restore(snapshot.snapshot_at(events(spark, sf_dir), _half(spark, sf_dir)), AS_OF)


@register("restore_max_tx", SNAP_SQL + "SELECT coalesce(max(tx), 0) AS max_tx FROM snap")
def restore_max_tx(spark, sf_dir):
    return snapshot.max_tx(snapshot.snapshot_at(events(spark, sf_dir), _half(spark, sf_dir)))


@register("dump_pages", SNAP_SQL + "SELECT page, count(*) AS rows, min(key) AS first_key, max(key) AS last_key FROM (SELECT key, (row_number() OVER (ORDER BY key, batch_size) - 1) // 10 AS page FROM snap) GROUP BY page")
def dump_pages(spark, sf_dir):
    return snapshot.pages(snapshot.snapshot_at(events(spark, sf_dir), _half(spark, sf_dir)), 10)


@register("gc_survivors", f"WITH {fold_ctes(events_sql(3600, more=KNOWN))}, {state_cte()} SELECT key, bs, value, t FROM state WHERE op = 'INCR' AND NOT {AS_OF} > t - t % bs + bs - 1 + 60")
def gc_survivors(spark, sf_dir):
    return snapshot.live_after(events(spark, sf_dir, 3600).where(F.col("t") <= AS_OF), AS_OF)


SEGMENTS_SQL = f"segs AS (SELECT *, 'wal_' || ((lsn - 1) // 1000 * 1000) || '.log' AS segment FROM ({events_sql()}))"


@register("truncate_segments", f"WITH {SEGMENTS_SQL} SELECT lsn, op, key, bs, t, segment FROM segs WHERE segment NOT IN (SELECT segment FROM segs GROUP BY segment HAVING max(lsn) < {SNAP})")
def truncate_segments(spark, sf_dir):
    return snapshot.truncate(snapshot.segments(events(spark, sf_dir), 1000), _half(spark, sf_dir)).select("lsn", "op", "key", "bs", "t", "segment")


@register("removable_segments", f"WITH {SEGMENTS_SQL} SELECT segment, max(lsn) AS last_lsn FROM segs GROUP BY segment HAVING max(lsn) < {SNAP}")
def removable_segments(spark, sf_dir):
    return snapshot.removable(snapshot.segments(events(spark, sf_dir), 1000), _half(spark, sf_dir))


@register("segment_upper_bound", f"WITH {SEGMENTS_SQL}, names AS (SELECT DISTINCT segment AS name FROM segs) SELECT name, coalesce((SELECT min(n.name) FROM names n WHERE n.name > names.name), '') AS following FROM names")
def segment_upper_bound(spark, sf_dir):
    names = snapshot.segments(events(spark, sf_dir), 1000).select(F.col("segment").alias("name")).distinct()
    return snapshot.next_segment(names, names)


# Replicas


@register("replica_catchup", f"SELECT lsn, op, key, bs, t FROM ({events_sql()}) WHERE lsn > {SNAP}")
def replica_catchup(spark, sf_dir):
    ops, at = events(spark, sf_dir), _half(spark, sf_dir)
    grown = ops.where(F.col("lsn") > at - 500).unionByName(ops.where(F.col("lsn") > at + 100))  # a segment that was sent again
    return replication.pending(grown, at).select("lsn", "op", "key", "bs", "t")


@register(
    "replica_divergence",
    f"WITH tail AS (SELECT lsn, max(lsn) OVER () AS top FROM ({events_sql()})) "
    f"SELECT 'caught up' AS replica, count(*) FILTER (lsn > {SNAP}) AS operations, 0::BIGINT AS only_master, 0::BIGINT AS only_replica FROM tail "
    f"UNION ALL SELECT 'behind', count(*) FILTER (lsn > {SNAP} AND lsn <= top - 100), count(*) FILTER (lsn > {SNAP} AND lsn > top - 100), 0 FROM tail",
)
def replica_divergence(spark, sf_dir):
    """A replica that has all operations, and one that lacks the last hundred numbers."""
    ops, at = events(spark, sf_dir), _half(spark, sf_dir)
    snap, master = snapshot.snapshot_at(ops, at), counters.fold(ops).where(F.col("lsn") > at)
    top = ops.agg(F.max("lsn")).first()[0] or 0
    out = []
    for name, until in (("caught up", top), ("behind", top - 100)):
        replica = snapshot.recover(snap, replication.pending(ops.where(F.col("lsn") <= until), at), at)
        counted = replica.agg(F.count("*").alias("operations")).join(replication.divergence(master, replica))  # one row each
        out.append(counted.select(F.lit(name).alias("replica"), "operations", "only_master", "only_replica"))
    return out[0].unionByName(out[1])


@register("retry_delays", "SELECT CAST(range AS BIGINT) AS attempt, CAST(least(300, pow(2, range - 1)) AS BIGINT) AS delay FROM range(1, 11)")
def retry_delays(spark, sf_dir):
    return spark.range(1, 11).select(F.col("id").alias("attempt"), replication.retry_delay(F.col("id")).alias("delay"))


# Streams


def _stream(spark, sf_dir, collect: bool) -> DataFrame:
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    ops = oplog.event_ops(source)
    out = _scratch(spark, "stream")
    streaming.drain(streaming.fold_stream(ops, collect), f"{out}/checkpoint", f"{out}/rows")
    return fold_columns(spark.read.parquet(f"{out}/rows"))


@register("stream_incr", fold_sql(events_sql()))
def stream_incr(spark, sf_dir):
    return _stream(spark, sf_dir, False)


LATE = AS_OF + 864000


@register(
    "stream_gc",
    f"WITH {fold_ctes(events_sql(3600, more=KNOWN))}, {state_cte()}, top AS (SELECT max(t) AS t FROM folded), "
    "users AS (SELECT DISTINCT key, bs FROM folded) SELECT lsn, op, key, bs, t, result FROM folded "
    f"UNION ALL SELECT 1000000000 + CAST(substr(u.key, 6) AS BIGINT), 'DEL', u.key, u.bs, {LATE}, CAST(CASE WHEN s.op = 'INCR' AND NOT top.t > s.t - s.t % s.bs + s.bs - 1 + 60 THEN 1 ELSE 0 END AS BIGINT) "
    "FROM users u JOIN state s ON u.key = s.key AND u.bs = s.bs, top",
)
def stream_gc(spark, sf_dir):
    """Hourly counters in two runs of a stream: the log up to a time, then a deletion of every counter, which meets only those that the
    watermark of the first run has not collected."""
    out = _scratch(spark, "stream")
    ops = events(spark, sf_dir, 3600).where(F.col("t") <= AS_OF)
    number = F.substring("key", 6, 20).cast("bigint") + 1000000000
    deletes = ops.select("key", "bs").distinct().select(number.alias("lsn"), F.lit(0).alias("pos"), F.lit("DEL").alias("op"), "key", "bs", F.lit(LATE).cast("bigint").alias("t"))
    for part in (ops, deletes):
        part.write.mode("append").parquet(f"{out}/log")
        streaming.drain(streaming.fold_stream(spark.readStream.schema(OPS).parquet(f"{out}/log"), True), f"{out}/checkpoint", f"{out}/rows")
    return fold_columns(spark.read.parquet(f"{out}/rows"))


# Analytics of our own on top of the counters


@register("cap_exceeded", fold_sql(events_sql(), "SELECT key, bs, t - t % bs AS window_start, count(*) AS over FROM folded WHERE op = 'INCR' AND result > 2 GROUP BY ALL"))
def cap_exceeded(spark, sf_dir):
    folded = counters.fold(events(spark, sf_dir)).where((F.col("op") == "INCR") & (F.col("result") > 2))
    return folded.groupBy("key", "bs", windows.window_start(F.col("t"), F.col("bs")).alias("window_start")).agg(F.count("*").alias("over"))


@register("top_keys", f"WITH c AS (SELECT key, t - t % bs AS window_start, count(*) AS n FROM ({events_sql()}) WHERE op = 'INCR' GROUP BY ALL) SELECT window_start, key, n FROM c QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY n DESC, key) <= 3")
def top_keys(spark, sf_dir):
    counted = counters.window_counts(events(spark, sf_dir))
    rank = F.row_number().over(Window.partitionBy("window_start").orderBy(F.desc("n"), "key"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= 3).select("window_start", "key", "n")


@register("count_distribution", fold_sql(events_sql(), "SELECT result, count(*) AS n FROM folded WHERE op = 'INCR' GROUP BY result"))
def count_distribution(spark, sf_dir):
    return counters.fold(events(spark, sf_dir)).where(F.col("op") == "INCR").groupBy("result").agg(F.count("*").alias("n"))


