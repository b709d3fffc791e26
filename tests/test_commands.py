"""Golden cases of parsing, validation and codecs; the log's binary form; the database front end; settings."""

import threading

import pytest
from pyspark.sql import functions as F

from capwindow.config import Config, Network, config_from, load, parse_duration, parse_size
from capwindow.engine import Database
from capwindow.functions import commands
from capwindow.operators import counters, replication, snapshot
from capwindow.sources import tables, wal
from capwindow.sources.server import CommandClient, CommandServer
from capwindow.streaming import counters as streaming


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "q string").select(column(F.col("q")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [("", []), ("   ", []), ("字文下", None), ("set", ["set"]), ("set key", ["set", "key"]), ("2set1", ["2set1"]), ("_set__", ["_set__"]), (".set#", None), (" set   key  ", ["set", "key"]), ("a\tb\nc", ["a", "b", "c"]), ("a\rb", None), ("a-b", ["a-b"])],
)
def test_tokens(spark, text, want):
    assert one(spark, text, commands.tokens) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("TRUNCATE", "invalid command"), ("", "invalid command"), ("INCR key", "invalid arguments"), ("MDEL key1 600 key2", "invalid arguments"), ("MSGSIZE key", "invalid arguments"),
        ("incr key 60", None), ("MDEL", None), ("WATCH key 60", None), ("GET key 0", "invalid batch size: 0 (must be between 1 and 4294967295)"), ("GET key 4294967295", None),
        ("GET key 4294967296", "invalid batch size: 4294967296 (must be between 1 and 4294967295)"), ("GET key abc", "batch is not a number"), ("GET key -5", "batch is not a number"),
        ("GET key 18446744073709551616", "batch is not a number"), ("GET key " + "9" * 50, "batch is not a number"), ("GET key " + "0" * 50 + "60", None), ("GET " + "k" * 1024 + " 60", None), ("GET " + "k" * 1025 + " 60", "key length exceeds maximum"),
        ("MDEL a 60 b 0", "invalid batch size: 0 (must be between 1 and 4294967295)"), ("x" * 5000, "message size 5000 exceeds maximum 4096"), ("GET a# 60", "invalid symbol"),
    ],
)
def test_errors(spark, text, want):
    assert commands.parse(spark.createDataFrame([(text,)], "query string")).first()["error"] == want


@pytest.mark.parametrize("text, want", [("20B", 20), ("20b", 20), ("20", 20), ("20KB", 20480), ("20Mb", 20971520), ("20gb", 21474836480), ("-20", None), ("-20TB", None), ("abc", None), ("1gB", None)])
def test_sizes(spark, text, want):
    assert one(spark, text, commands.size_bytes) == want
    if want is None:
        with pytest.raises(ValueError):
            parse_size(text)
    else:
        assert parse_size(text) == want


def test_settings():
    assert parse_duration("1m30s") == 90 and parse_duration("20ms") == 0.02
    assert config_from({"network": {"max_message_size": "8KB"}, "replica_of": "x"}) == Config(network=Network(max_message_size="8KB"), replica_of="x")
    for wrong in ({"colour": 1}, {"dump_interval": "soon"}):
        with pytest.raises(ValueError):
            config_from(wrong)


def test_settings_from_files(tmp_path):
    (tmp_path / "a.json").write_text('{"clean_interval": "10m", "log": {"batch_length": 4096}}')
    assert load(str(tmp_path / "a.json")).log.batch_length == 4096
    yaml = pytest.importorskip("yaml")
    (tmp_path / "a.yml").write_text(yaml.safe_dump({"sync_commit": False}))
    assert load(str(tmp_path / "a.yml")).sync_commit is False


def test_binary_log_round_trip(spark, tmp_path):
    records = [(i, 1 + i % 3, ["key", str(60 * i), "5f"]) for i in range(1, 300)] + [(2**40, 5, ["5f", "a", "60", "b", "x"])]
    data = b"".join(wal.encode_frame(records[i : i + 7]) for i in range(0, len(records), 7))
    assert wal.decode_segment(data) == records
    assert wal.decode_segment(data[:-3]) == records[: len(records) // 7 * 7 if len(records) % 7 else len(records) - 7]
    (tmp_path / "wal_1000.log").write_bytes(data)
    read = wal.read_segments(spark, str(tmp_path))
    assert sorted((r.lsn, r.command_id, r.arguments) for r in read.collect()) == sorted(records)
    ops = snapshot.from_records(read.where("command_id = 5")).collect()
    assert [(r.pos, r.key, r.bs, r.t) for r in ops] == [(0, "a", 60, 95)]


def test_log_and_snapshot_tables(spark, tmp_path):
    ops = spark.createDataFrame([(i, 0, "INCR", "k", 60, i) for i in range(1, 11)], "lsn bigint, pos int, op string, key string, bs bigint, t bigint")
    segmented = snapshot.segments(ops, 3)
    path = str(tmp_path / "log")
    tables.append_log(segmented, path)
    assert tables.log_tail(spark, path, 7).count() == 3
    gone = [r.segment for r in snapshot.removable(segmented, 7).collect()]
    tables.drop_segments(spark, path, gone)
    assert sorted(r.lsn for r in tables.read_log(spark, path).collect()) == [7, 8, 9, 10]
    assert tables.read_snapshot(spark, str(tmp_path / "snap"))[1] == 0
    tables.write_snapshot(snapshot.snapshot_at(ops, 4), str(tmp_path / "snap"), 4)
    tables.write_snapshot(snapshot.snapshot_at(ops, 7), str(tmp_path / "snap"), 7)
    snap, lsn = tables.read_snapshot(spark, str(tmp_path / "snap"))
    assert (lsn, snap.first()["value"]) == (7, 7)


def test_database(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    assert db.run(["INCR a 60", "incr a 60", "GET a 060", "GET b 60", "MSGSIZE", "NOPE", "MDEL a 60 a 60", "MDEL"], now=30) == ["ok|1", "ok|2", "ok|2", "ok|0", "ok|4096", "err|invalid command", "ok|1;0", "ok|"]
    assert db.run(["INCR a 60", "WATCH a 60", "INCR a 60", "DEL a 60"], now=40) == ["ok|1", "ok|2", "ok|2", "ok|1"]
    with pytest.raises(PermissionError):
        Database(spark, str(tmp_path / "db"), Config(replica_of="master")).run(["INCR a 60"], now=50)


def test_replica(spark):
    ops = spark.createDataFrame([(i, 0, "INCR", "k", 60, i) for i in (1, 2, 2, 3)], "lsn bigint, pos int, op string, key string, bs bigint, t bigint")
    assert sorted(r.lsn for r in replication.pending(ops, 1).collect()) == [2, 3]
    assert replication.divergence(ops, ops.where("lsn < 3")).first().asDict() == {"only_master": 1, "only_replica": 0}


def test_stream_in_two_runs(spark, tmp_path):
    """State goes on from the checkpoint, and lapsed counters are collected by event time."""
    schema = "lsn bigint, pos int, op string, key string, bs bigint, t bigint"
    source = str(tmp_path / "in")
    for rows in ([(1, 0, "INCR", "k", 60, 10), (2, 0, "INCR", "k", 60, 20)], [(3, 0, "INCR", "k", 60, 30), (4, 0, "DEL", "k", 60, 31), (5, 0, "INCR", "j", 60, 4000)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = streaming.fold_stream(spark.readStream.schema(schema).parquet(source), collect=True)
        streaming.drain(stream, str(tmp_path / "checkpoint"), str(tmp_path / "out"))
    assert {r.lsn: r.result for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1}


def test_server(spark, tmp_path):
    config = Config(network=Network(address="127.0.0.1:0", max_connections=2, max_message_size="100B"))
    with CommandServer(Database(spark, str(tmp_path / "db"), config)) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        address = f"127.0.0.1:{server.server_address[1]}"
        one, two = CommandClient(address, 60), CommandClient(address, 60)
        assert one.send("INCR a 4294967295") == ("ok", "1")
        assert one.send("x" * 101) == ("err", "message size 101 exceeds maximum 100")
        seen = []
        watcher = threading.Thread(target=lambda: seen.append(two.send("WATCH a 4294967295")))
        watcher.start()
        for want in range(2, 30):
            if not watcher.is_alive():
                break
            assert one.send("INCR a 4294967295") == ("ok", str(want))
        watcher.join(60)
        assert seen and seen[0][0] == "ok" and int(seen[0][1]) >= 2
        one.close(), two.close()
        server.shutdown()


def test_followed_log(spark, tmp_path):
    ops = spark.createDataFrame([(i, 0, "INCR", "k", 60, i) for i in range(1, 8)], "lsn bigint, pos int, op string, key string, bs bigint, t bigint")
    path = str(tmp_path / "log")
    for part in ("lsn <= 4", "lsn > 4"):
        tables.append_log(snapshot.segments(ops.where(part), 3), path)
        streaming.drain(streaming.follow_log(spark, path, 2), str(tmp_path / "checkpoint"), str(tmp_path / "out"))
    assert sorted(r.lsn for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3, 4, 5, 6, 7]


def test_upserts_and_window_counts(spark, tmp_path):
    schema = "lsn bigint, pos int, op string, key string, bs bigint, t bigint"
    source = str(tmp_path / "in")
    spark.createDataFrame([(i, 0, "INCR", f"k{i % 3}", 60, 20 * i) for i in range(1, 40)], schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    folded = streaming.fold_stream(stream).writeStream.foreachBatch(streaming.upsert_sink(str(tmp_path / "states"))).option("checkpointLocation", str(tmp_path / "c1"))
    folded.trigger(availableNow=True).start().awaitTermination()
    newest = {r.key: (r.lsn, r.result) for r in streaming.newest(spark.read.parquet(str(tmp_path / "states"))).collect()}
    ops = spark.read.schema(schema).parquet(source)
    assert newest == {r.key: (r.lsn, r.value) for r in counters.state_of(counters.fold(ops)).collect()}
    streaming.drain(streaming.window_stream(stream, 60, "0 seconds"), str(tmp_path / "c2"), str(tmp_path / "counts"))
    got = {(r.key, r.window_start): r.n for r in spark.read.parquet(str(tmp_path / "counts")).collect()}
    want = {(r.key, r.window_start): r.n for r in counters.window_counts(ops).collect()}
    assert got and got.items() <= want.items() and max(w for _, w in want) - max(w for _, w in got) <= 60
