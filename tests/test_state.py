"""The stateful parts: dumps with truncation, commits, replicas over the network, watches and rotated segments."""

import random
import threading

import pytest

from capwindow.config import Config, Log
from capwindow.engine import Database, run_commands
from capwindow.operators import counters, oplog, snapshot
from capwindow.schema import LOG, OPS
from capwindow.sources import replica, tables, wal
from tests.test_counters import plain_fold, random_log, results


def test_dump_truncates_and_state_goes_on(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    db.SEGMENT = 2
    assert db.run(["INCR a 60", "INCR a 60", "INCR b 60", "INCR c 600"], now=30) == ["ok|1", "ok|2", "ok|1", "ok|1"]
    assert db.dump(now=30) == 4
    assert sorted(r.segment for r in tables.read_log(spark, db.log_path).select("segment").distinct().collect()) == ["wal_1000.log"]
    assert db.run(["INCR a 60", "GET b 60", "WATCH b 60", "DEL b 60"], now=40) == ["ok|3", "ok|1", "ok|0", "ok|1"]
    assert db.dump(now=40) == 8 and db.dump(now=40) == 8
    again = Database(spark, str(tmp_path / "db"))
    assert again.run(["GET a 60", "GET b 60", "GET c 600"], now=50) == ["ok|3", "ok|0", "ok|1"]
    again.run(["INCR d 60"], now=190)
    again.dump(now=190)  # a's window and grace are over
    assert {r.key for r in tables.read_snapshot(spark, db.dump_path)[0].collect()} == {"c", "d"}
    assert len(tables.snapshot_versions(spark, db.dump_path)) == 2


def test_asynchronous_commits_wait_for_a_full_batch(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), Config(sync_commit=False, log=Log(batch_length=3, batch_timeout="1h")))
    assert db.run(["INCR a 60", "INCR a 60"], now=5) == ["ok|1", "ok|2"]
    assert not tables.exists(spark, db.log_path)
    assert db.run(["INCR a 60"], now=6) == ["ok|3"]  # reads what waits; now the batch is full
    assert tables.read_log(spark, db.log_path).count() == 3
    db.run(["INCR a 60"], now=7)
    db.flush()
    assert tables.read_log(spark, db.log_path).count() == 4


def watched_by_hand(rows, lsn, key, bs, t):
    """The first value after a watch that differs: values after later operations, and 0 where the window ends before the next one."""
    mine = [r for r in sorted(rows) if (r[3], r[4]) == (key, bs)]
    out, _ = plain_fold(mine)
    points = []
    for r, following in zip(mine, [*mine[1:], None]):
        value = out[r[0], r[1]] if r[2] == "INCR" else 0
        end = r[5] - r[5] % bs + bs
        points.append((r[0], value, r[5], end if value and (following is None or following[5] >= end) else None))
    before = [p for p in points if p[0] < lsn]
    initial = 0 if not before or before[-1][2] < t - t % bs else before[-1][1]
    if before and before[-1][3] is not None and before[-1][3] > t and initial:
        return 0
    for at, value, _, lapse in points:
        if at > lsn:
            if value != initial:
                return value
            if lapse is not None and initial:
                return 0
    return None


@pytest.mark.parametrize("seed", range(3))
def test_watches_and_reads_in_one_fold(spark, seed):
    rows = [r for r in random_log(seed, n=300, keys=3, monotone=True)]
    watches = [(r[0], 0, "WATCH", r[3], r[4], r[5]) for r in rows[::5]]
    changes = [r for r in rows if (r[0], 0, "WATCH", r[3], r[4], r[5]) not in watches]
    got = counters.next_values(counters.run_readings(spark.createDataFrame([*changes, *watches], OPS))).where("op = 'WATCH'").collect()
    assert {r.lsn: r.seen for r in got} == {w[0]: watched_by_hand(changes, w[0], w[3], w[4], w[5]) for w in watches}
    for lsn in (0, 300, 700):
        snap = snapshot.snapshot_at(spark.createDataFrame(changes, OPS), lsn)
        assert results(snapshot.recover(snap, spark.createDataFrame(changes, OPS), lsn)) == {k: v for k, v in plain_fold(changes)[0].items() if k[0] > lsn}


def test_one_fold_serves_all_commands(spark):
    df = spark.createDataFrame([(1, 0, "INCR a 60"), (2, 0, "WATCH a 60")], "lsn bigint, t bigint, query string")
    plan = run_commands(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS __island") == 1


def test_rotation_by_bytes(spark, tmp_path):
    rows = [(i, 1, [f"k{i % 300}" * (i % 40), "60", "65a0"]) for i in range(1, 2000)]
    records = spark.createDataFrame(rows, LOG).repartition(5)
    rotated = wal.rotate(records, 5000)
    sizes = {r.lsn: r.bytes for r in rotated.collect()}
    assert all(sizes[r[0]] == len(wal.encode_frame([r])) - 4 for r in rows)
    path = str(tmp_path / "segments")
    names = wal.write_segments(wal.segment_bytes(rotated), path)
    assert sorted(names) == wal.segment_names(spark, path) and len(names) > 5
    longest = max(sizes.values())
    assert all(len(wal.read_file(spark, f"{path}/{n}")) <= 5000 + longest + 4 * 2000 // 100 for n in names)
    assert sorted(map(tuple, wal.read_segments(spark, path).collect())) == rows


def test_segments_stay_off_the_driver(spark, tmp_path):
    pick, path = random.Random(1), str(tmp_path / "segments")
    rows = [(i, 1, ["é\n\0" + pick.randbytes(1000).hex(), "60", "65a0"]) for i in range(1, 2001)]
    segmented = spark.createDataFrame([(*r, f"wal_{r[0] // 1000}.log") for r in rows], f"{LOG}, segment string")
    limits = spark.sparkContext._jsc.sc().conf()
    limits.set("spark.driver.maxResultSize", "200k")  # each large segment has 2 MB
    try:
        names = wal.write_segments(wal.segment_bytes(segmented), path)
    finally:
        limits.remove("spark.driver.maxResultSize")
    assert sorted(names) == wal.segment_names(spark, path) == sorted(p.name for p in (tmp_path / "segments").iterdir() if p.suffix != ".crc") == ["wal_0.log", "wal_1.log", "wal_2.log"]
    mine = [r for r in rows if r[0] // 1000 == 1]
    assert wal.read_file(spark, f"{path}/wal_1.log") == b"".join(wal.encode_frame(mine[i : i + 100]) for i in range(0, 1000, 100)) + b"\0" * 4
    assert sorted(map(tuple, wal.read_segments(spark, path).collect())) == rows


def test_odd_segments(spark, tmp_path):
    path, kind = str(tmp_path / "segments"), "segment string, content binary"
    assert wal.write_segments(spark.createDataFrame([], kind), path) == []
    every = bytes(range(256)) * 2
    wal.write_segments(spark.createDataFrame([("wal_1.log", bytearray(every)), ("wal_2.log", bytearray())], kind), path)
    with pytest.raises(ValueError, match="two rows of segment wal_1.log"):
        wal.write_segments(spark.createDataFrame([("wal_1.log", bytearray(b"a")), ("wal_1.log", bytearray(b"b"))], kind).coalesce(1), path)
    assert wal.read_file(spark, f"{path}/wal_1.log") == every + b"\0" * 4 and wal.decode_segment(wal.read_file(spark, f"{path}/wal_2.log")) == []
    assert sorted(p.name for p in (tmp_path / "segments").iterdir() if p.suffix != ".crc") == ["wal_1.log", "wal_2.log"]


def test_running_total(spark):
    df = spark.range(500).selectExpr("id * 7 % 500 AS x", "id * 7 % 500 + 1 AS n").repartition(6)
    assert [(r.x, r.before) for r in oplog.running_total(df, "n", "x").orderBy("x").collect()] == [(i, i * (i + 1) // 2) for i in range(500)]


def put_segment(spark, path, name, ops):
    frame = wal.encode_frame([(lsn, {"INCR": 1, "DEL": 3}[op], [key, str(bs), f"{t:x}"]) for lsn, _, op, key, bs, t in ops])
    wal.write_segments(spark.createDataFrame([(name, bytearray(frame))], "segment string, content binary"), path)


def test_replica_follows_over_the_network(spark, tmp_path):
    db, segments = Database(spark, str(tmp_path / "master")), str(tmp_path / "segments")
    db.run([f"INCR k{i} 600" for i in range(5)], now=10)
    db.dump(now=10)
    ops = [(i, 0, "INCR", "k0", 600, 20) for i in range(4, 9)]  # 4 and 5 are in the dump
    put_segment(spark, segments, "wal_0000000000004.log", ops[:3])
    master = replica.Master(db, segments, page=2, sessions=1)
    with replica.ReplicationServer(master, ("127.0.0.1", 0), replicas=1) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        slept = []
        follower = replica.Replica(spark, str(tmp_path / "replica"), replica.connector(server.server_address), sleep=slept.append)
        follower.run(3)
        assert not follower.in_dump and follower.applied == 5
        follower.run(2)
        assert follower.applied == 6
        put_segment(spark, segments, "wal_0000000000004.log", ops[:4])  # the last segment grows
        put_segment(spark, segments, "wal_0000000000008.log", ops[4:])
        follower.last = ""
        follower.run(2)
        assert follower.applied == 8
        reader = Database(spark, str(tmp_path / "replica"), Config(replica_of="master"))
        assert reader.run(["GET k0 600", "GET k4 600"], now=30) == ["ok|4", "ok|1"]
        again = replica.Replica(spark, str(tmp_path / "replica"), follower.connect)
        assert (again.applied, again.in_dump) == (8, False)
        server.shutdown()


def test_sessions_and_the_last_segment(spark, tmp_path):
    db, segments = Database(spark, str(tmp_path / "master")), str(tmp_path / "segments")
    master = replica.Master(db, segments, page=2, sessions=1)
    assert master.answer({"session": "empty"}) == {"rows": [], "end": True, "version": 0}
    assert "error" in master.answer({"session": "empty"})  # it has ended
    assert master.answer({"last": ""})["name"] == ""
    db.run([f"INCR k{i} 600" for i in range(5)], now=10)
    db.dump(now=10)
    assert [r[0] for r in master.answer({"session": "one"})["rows"]] == ["k0", "k1"]
    assert "more than 1" in master.answer({"session": "two"})["error"]
    db.run(["INCR k9 600"], now=11)
    db.dump(now=11)
    assert "closed" in master.answer({"session": "one"})["error"]  # a newer dump
    assert master.answer({"session": "two"})["version"] == 6
    put_segment(spark, segments, "wal_0000000000001.log", [(1, 0, "INCR", "k", 60, 1)])
    first = master.answer({"last": ""})
    assert first["name"] == "wal_0000000000001.log" and master.answer({"last": first["name"]}) == first
    assert master.answer({"last": "wal_0000000000009.log"})["name"] == ""


def test_errors_pause_and_reconnection(spark, tmp_path):
    slept, made = [], []

    def refuse():
        made.append(1)
        raise ConnectionError

    follower = replica.Replica(spark, str(tmp_path / "r"), refuse, sleep=slept.append)
    delays = []
    for _ in range(9):
        assert not follower.step()
        delays.append(follower.delay())
    assert delays == [1, 2, 4, 8, 16, 32, 64, 128, 256]
    assert set(slept) == {1, 2, 4, 8} and len(made) == 9 * 2 * replica.ATTEMPTS
    assert not follower.step() and slept[-1] == 300 and follower.errors == 0
