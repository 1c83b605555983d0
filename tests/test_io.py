"""Sources, sinks, streams, the store and the façade."""

import json
import os
import random
import socket
import time

import pytest
from helpers import catalog, have_testdata, rows


from tidewell.api import Engine, function_names
from tidewell.operators import anomaly
from tidewell.plans.build import build
from tidewell.sinks.text import csv_lines, resp_frames, write_text
from tidewell.sources.lines import parse_bulk, parse_put, with_dictionary
from tidewell.session import scope, shared_folder
from tidewell.sources.listeners import LastTimes, PutListener, TcpListener, UdpListener
from tidewell.sources.resp import parse_frames, read_frames, stream_frames
from tidewell.streaming.buckets import standing_buckets
from tidewell.streaming.ingest import Store
from tidewell.streaming.late_store import LateStore
from tidewell.streaming.late_write import LateRule

FRAMES = b"+cpu|mem host=a\r\n:100\r\n*2\r\n+1.5\r\n:7\r\n+!log host=a\r\n+20060102T150405\r\n+it rained\r\n"


def test_frames():
    assert list(parse_frames(FRAMES)) == [("cpu host=a", 100, 1.5, None, None), ("mem host=a", 100, 7.0, None, None), ("!log host=a", 1136214245000000000, None, "it rained", None)]
    withdict = b"*2\r\n+a|b t=1\r\n:5\r\n:5\r\n:9\r\n*2\r\n:1\r\n:2\r\n"
    assert [r[:3] for r in parse_frames(withdict)] == [("a t=1", 9, 1.0), ("b t=1", 9, 2.0)]
    assert list(parse_frames(b"")) == []


@pytest.mark.parametrize(
    "data",
    [b"+a t=1\r\n:1\r\n", b"+a t=1\r\n:1\r\n+x\r\n", b"+a|b t=1\r\n:1\r\n+1\r\n", b"+a|b t=1\r\n:1\r\n*3\r\n:1\r\n:2\r\n:3\r\n", b":9\r\n:1\r\n:1\r\n", b"?\r\n", b"+a t=1\r\n+never\r\n:1\r\n", b"+a t=1\r\n:1\r\n:1", b"*3\r\n+a t=1\r\n:1\r\n:2\r\n", b":x\r\n"],
)
def test_broken_frames_end_with_an_error(data):
    out = list(parse_frames(data))
    assert out[-1][4] and all(r[4] is None for r in out[:-1])


def test_frames_survive_random_bytes():
    rng = random.Random(1)
    for _ in range(300):
        data = bytes(rng.choice(b"+:*$-0123ab \r\n") for _ in range(rng.randrange(80)))
        list(parse_frames(data))


def test_folder_as_batch_and_stream(spark, tmp_path):
    (tmp_path / "5.resp").write_bytes(FRAMES)
    (tmp_path / ".6.part").write_bytes(b"+broken")
    assert read_frames(spark, str(tmp_path)).count() == 3
    q = stream_frames(spark, str(tmp_path)).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "_c")).start()
    try:
        q.processAllAvailable()
        # a file that appears later under a smaller name
        (tmp_path / "2.resp").write_bytes(b"+x t=1\r\n:1\r\n:1\r\n")
        q.processAllAvailable()
        assert sorted(r.series for r in spark.table("frames").collect()) == ["!log host=a", "cpu host=a", "mem host=a", "x t=1"]
    finally:
        q.stop()


def wait_for(true, seconds=20):
    until = time.time() + seconds
    while time.time() < until and not true():
        time.sleep(0.05)
    return true()


def landed(folder):
    return [r for p in sorted(folder.glob("*.resp")) for r in parse_frames(p.read_bytes())]


def test_listeners_land_whole_files(tmp_path):
    t, u = tmp_path / "t", tmp_path / "u"
    tcp, udp = TcpListener(str(t), roll=30), UdpListener(str(u), every=0.2)
    try:
        with socket.create_connection(tcp.address) as s:
            s.sendall(b"*2\r\n+a t=1\r\n:5\r\n" + b"".join(b":5\r\n:%d\r\n:1\r\n" % i for i in range(5)))
        out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        for data in (b"+a t=1\r\n:1\r\n:1\r\n", b"+broken\r\n", b"+b t=1\r\n:1\r\n:1\r\n"):
            out.sendto(data, udp.address)
        out.close()
        assert wait_for(lambda: udp.dropped == 1 and len(landed(t)) == 5 and len(landed(u)) == 2)
    finally:
        tcp.close()
        udp.close()
    assert [r[:2] for r in landed(t)] == [("a t=1", i) for i in range(5)] and len(list(t.iterdir())) > 1
    assert sorted(r[0] for r in landed(u)) == ["a t=1", "b t=1"]


def test_slow_writers_land_by_time_and_are_answered(tmp_path):
    folder = tmp_path / "t"
    tcp = TcpListener(str(folder), every=0.2)
    try:
        with socket.create_connection(tcp.address) as s:
            s.settimeout(10)
            s.sendall(b"+m b=1 a=1\r\n:5\r\n:1\r\n")
            assert wait_for(lambda: len(landed(folder)) == 1)  # the connection is still open
            s.sendall(b"+m a=1 b=1\r\n:5\r\n:2\r\n")
            assert s.recv(100) == b"-DB late write\r\n"
            s.sendall(b"+m|n a=1 b=1\r\n:6\r\n*2\r\n:2\r\n:3\r\n")
            assert wait_for(lambda: len(landed(folder)) == 3)
            s.sendall(b"+metric\r\n:123\r\n+5.0\r\n")
            assert s.recv(100).startswith(b"-PARSER ") and s.recv(100) == b""
        for bad in (b"\n", b"*3\r\n+a t=1\r\n:1\r\n:2\r\n", b"+a t=1\r\n:1\r\n+x\r\n"):
            with socket.create_connection(tcp.address) as s:
                s.settimeout(10)
                s.sendall(bad)
                assert s.recv(100).startswith(b"-PARSER ")
    finally:
        tcp.close()
    assert len(landed(folder)) == 3


def test_put_lines_are_landed_and_answered(spark, tmp_path):
    folder = tmp_path / "p"
    put = PutListener(str(folder), every=0.2)
    try:
        with socket.create_connection(put.address) as s:
            s.settimeout(10)
            s.sendall(b"put m 10 1 a=1\r\nput m 11 2 a=1\nhelp\nput m 11 3 a=1\n")
            assert s.recv(100) == b"-DB late write\n"
            for line, begin in ((b"version", b"tidewell"), (b"stats", b"tidewell"), (b"nosuch", b"-PARSER"), (b"put m x 1 a=1", b"-PARSER"), (b"put m 12 x a=1", b"-PARSER"), (b"put m 12 1", b"-PARSER")):
                s.sendall(line + b"\n")
                assert s.recv(100).startswith(begin), line
    finally:
        put.close()
    lines = spark.read.option("pathGlobFilter", "*.put").text(str(folder))
    assert sorted(rows(parse_put(lines))) == [("m a=1", 10 * 10**9, 1.0, None), ("m a=1", 11 * 10**9, 2.0, None)]


def test_last_times_are_bounded():
    t = LastTimes(2)
    assert t.take("a", 5) and not t.take("a", 5) and t.take("b", 1) and t.take("a", 6) and t.take("c", 1)
    assert not t.take("a", 6) and t.take("b", 1)


def test_put_lines(spark):
    lines = ["put m 1136214245 3.5 b=1 a=2\r", "put m 1136214245000000000 -1e3 a=1", "put m 20060102T150405.5 7 a=1", "", "stats", "version", "nosuchcommand", "put m x 1 a=1", "put m 1 x a=1", "put m 1 1", None, "put"]
    out = rows(parse_put(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert out[:3] == [("m a=2 b=1", 1136214245000000000, 3.5, None), ("m a=1", 1136214245000000000, -1000.0, None), ("m a=1", 1136214245500000000, 7.0, None)]
    assert [r[3] for r in out[3:]] == ["unknown verb", "put needs a time", "put needs a value", "put needs a series name with tags", "put needs a series name with tags"]


def test_bulk_rows_and_dictionary(spark):
    df = spark.createDataFrame([("a|b t=1", 1, [1.0, None]), ("a|b t=1", 2, [1.0]), ("bad", 3, [1.0]), (None, 4, [1.0]), ("c x=2 t=1", 5, [9.0])], "name string, ts_ns bigint, values array<double>")
    assert rows(parse_bulk(df)) == [("a t=1", 1, 1.0), ("c t=1 x=2", 5, 9.0)]
    frames = spark.createDataFrame([(1, 10, [1.0, 2.0]), (2, 11, [1.0])], "id bigint, ts_ns bigint, values array<double>")
    names = spark.createDataFrame([(1, "a|b t=1"), (1, "a|b t=1")], "id bigint, name string")
    assert sorted(rows(parse_bulk(with_dictionary(frames, names)))) == [("a t=1", 10, 1.0), ("b t=1", 10, 2.0)]


def test_text_output(spark, tmp_path):
    df = spark.createDataFrame([("s t=1", 1136214245999999999, 0.1, None), ("s t=1", 5, None, 2.0)], "series string, ts_ns bigint, c0 double, c1 double")
    assert [r.line for r in csv_lines(df).collect()] == ["s t=1,20060102T150405.999999999,0.10000000000000001,", "s t=1,19700101T000000.000000005,,2"]
    assert resp_frames(df, iso=False).first().line == "+s t=1\r\n+ts=1136214245999999999\r\n*2\r\n+0.10000000000000001\r\n$-1\r\n"
    one = df.select("series", "ts_ns", "c0").limit(1)
    assert resp_frames(one).first().line.split("\r\n")[2] == "+0.10000000000000001"
    write_text(df.coalesce(1), str(tmp_path / "o"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "o").glob("part*"))
    assert data.startswith(b"+s t=1\r\n+20060102T") and data.endswith(b"\r\n")


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def _feed(folder, name, data):
    folder.mkdir(exist_ok=True)
    tmp = folder / f".{name}"
    tmp.write_text("\n".join(json.dumps(x) for x in data))
    # the file source reads in the order of modification times
    os.utime(tmp, (1_700_000_000 + int(name), 1_700_000_000 + int(name)))
    os.rename(tmp, folder / f"{name}.json")


def test_late_rows_on_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    _feed(folder, "1", [{"series": "a", "ts_ns": t, "value": 1.0, "seq": i} for i, t in enumerate([5, 3, 7])])
    _feed(folder, "2", [{"series": "a", "ts_ns": t, "value": 1.0, "seq": 10 + i} for i, t in enumerate([6, 8])] + [{"series": "b", "ts_ns": 1, "value": 1.0, "seq": 9}])
    got = {}
    rule = LateRule(str(tmp_path / "last"), lambda df, b: got.update({(b, r.seq): r.accepted for r in df.collect()}))
    q = _stream(spark, folder, "series string, ts_ns bigint, value double, seq bigint").writeStream.foreachBatch(rule).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = {(0, 0): True, (0, 1): False, (0, 2): True, (1, 9): True, (1, 10): False, (1, 11): True}
    assert got == want
    rule(spark.createDataFrame([("a", 6, 1.0, 10), ("a", 8, 1.0, 11), (None, 8, 1.0, 12)], "series string, ts_ns bigint, value double, seq bigint"), 1)  # repeated
    assert got == want | {(1, 12): False}


def test_standing_buckets(spark, tmp_path):
    folder, s = tmp_path / "in", 10**9
    _feed(folder, "1", [{"series": "a", "ts_ns": t * s, "value": float(t)} for t in (1, 4, 11, 12)])
    _feed(folder, "2", [{"series": "a", "ts_ns": t * s, "value": float(t)} for t in (2, 500)])
    _feed(folder, "3", [{"series": "a", "ts_ns": 501 * s, "value": 1.0}])
    out = standing_buckets(_stream(spark, folder, "series string, ts_ns bigint, value double"), 10 * s, ["min", "max", "count"], anchor_ns=s, lateness="60 seconds")
    q = out.writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert sorted(rows(spark.table("buckets"))) == [("a", s, 1.0, 4.0, 3.0), ("a", 11 * s, 11.0, 12.0, 2.0)]
    finally:
        q.stop()


def test_late_store_merges_batches_as_one_pass_does(spark, tmp_path):
    import datetime as dt

    from tidewell.operators import late_events

    rng, h = random.Random(2), 3_600_000_000_000
    base = 400_000 * h
    data = []
    for i in range(600):
        t = base + rng.randrange(5 * h)
        data.append((rng.choice([1, 1, 2]), t, float(rng.randrange(100)), (t // 1000) + rng.randrange(0, 7_200_000_000)))
    data += rng.sample(data, 60)
    data = [(k, t, v, dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=a)) for k, t, v, a in data]
    data.sort(key=lambda r: r[3])
    schema = "id bigint, ts_raw bigint, value double, arrived_at timestamp"
    cut = spark.createDataFrame([(1, 1_800_000_000), (2, 3_600_000_000)], "key bigint, cutoff_us bigint")
    store = LateStore(spark, str(tmp_path / "store"), cut)
    for b in range(4):
        store.add(spark.createDataFrame(data[b * 165 : (b + 1) * 165], schema), b)
    store.add(spark.createDataFrame(data[3 * 165 :], schema), 3)  # repeated after a failure
    cols = ["key", "period_ns", "n", "total", "least", "most", "n_late"]
    whole = late_events.combine(late_events.partials(late_events.judged(late_events.points(spark.createDataFrame(data, schema)), cut)))
    assert sorted(rows(store.read().select(*cols))) == sorted(rows(whole.select(*cols)))
    assert store.forget(0) == 0 and store.forget(1 << 62) == 4
    assert sorted(rows(store.read().select(*cols))) == sorted(rows(whole.select(*cols)))


def test_store_and_facade(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    schema = "series string, ts_ns bigint, value double, body string, seq bigint"
    store.write(spark.createDataFrame([("m  b=1 a=1", 10, 1.0, None, 1), ("m a=1 b=1", 9, 1.0, None, 2), ("bad", 1, 1.0, None, 3), ("!e a=1", 5, None, "hello", 4)], schema), 0)
    second = spark.createDataFrame([("m a=1 b=1", 10, 5.0, None, 1), ("m a=1 b=1", 11, 2.0, None, 2), ("m a=2 b=1", 1, 3.0, None, 3), ("m a=2 b=1", 2, None, None, 4)], schema)
    store.write(second, 1)
    store.write(second, 1)
    assert sorted((r.series, r.ts_ns, r.reason) for r in store.rejected().collect()) == [("bad", 1, "bad name"), ("m a=1 b=1", 9, "late write"), ("m a=1 b=1", 10, "late write"), ("m a=2 b=1", 2, "no value")]
    e = Engine(spark, store.catalog())
    q = {"select": "m", "range": {"from": 0, "to": 100}, "order-by": "time"}
    assert rows(e.query(q)) == [("m a=2 b=1", 1, 3.0), ("m a=1 b=1", 10, 1.0), ("m a=1 b=1", 11, 2.0)]
    assert e.stats() == {"series": 3, "metrics": 2, "samples": 3, "events": 1}
    status, text = e.respond("/api/query", json.dumps(q | {"output": {"format": "csv", "timestamp": "raw"}, "limit": 1}))
    assert status == 200 and list(text) == ["m a=2 b=1,ts=1,3"]
    assert e.respond("/api/query", "{")[0] == 400 and next(e.respond("/api/query", {"select": "zz", "range": {"from": 0, "to": 1}})[1]).startswith("-not found")
    assert list(e.respond("/api/suggest", {"select": "metric-names", "starts-with": "!", "output": {"format": "csv"}})[1]) == ["!e"]
    assert e.respond("/nope")[0] == 404 and "ewma" in function_names()
    c = e.cursor(q)
    assert not c.is_done and len(c.read(2)) == 2 and len(c.read(9)) == 1 and c.is_done
    assert e.cursor({"select": "zz", "range": {"from": 0, "to": 1}}).is_error


def test_a_store_judges_by_last_times_alone(spark, tmp_path):
    store, schema = Store(spark, str(tmp_path / "db")), "series string, ts_ns bigint, value double, body string, seq bigint"
    before = set(os.listdir(shared_folder(spark).removeprefix("file:")))
    for b in range(4):
        store.write(spark.createDataFrame([("m a=1", 10 * b, 1.0, None, 1), ("m a=1", 10 * b + 5, float("nan"), None, 2), ("m a=1", 10 * b + 4, 2.0, None, 3), (f"m a={b + 2}", 1, 1.0, None, 4)], schema), b)
    assert set(os.listdir(shared_folder(spark).removeprefix("file:"))) == before  # nothing is left behind
    assert sorted(x for x in os.listdir(tmp_path / "db" / "last") if x.startswith("batch")) == ["batch=2", "batch=3"]
    assert sorted((r.ts_ns, r.reason) for r in store.rejected().collect()) == [(10 * b + 5, "no value") for b in range(4)]
    assert store.catalog().samples.count() == 12 and store.catalog().series.count() == 5
    with scope() as keep:
        assert keep(spark.range(3)).count() == 3


def test_answers_come_in_time_order(spark):
    rng = random.Random(1)
    data = [(f"m k={k}", t, 1.0) for k in range(3) for t in range(40)]
    rng.shuffle(data)
    e = Engine(spark, catalog(spark, data))
    ask = {"select": "m", "range": {"from": 0, "to": 40}, "output": {"format": "csv", "timestamp": "raw"}}
    want = [f"m k={k},ts={t},1" for t in range(40) for k in range(3)]
    assert list(e.respond("/api/query", ask)[1]) == want
    assert [(r.series, r.ts_ns) for r in e.cursor(ask).read(999)] == [(f"m k={k}", t) for t in range(40) for k in range(3)]
    back = list(e.respond("/api/query", ask | {"range": {"from": 40, "to": 0}})[1])
    assert back == want[:2:-1]
    for q in ({"group-aggregate": {"step": 10, "metric": "m", "func": "sum"}}, {"join": ["m", "m"]}):
        times = [r.ts_ns for r in e.cursor(q | {"range": {"from": 0, "to": 40}}).read(999)]
        assert times == sorted(times) and len(times) > 3
    for q, keys in (({"group-aggregate": {"step": 10, "metric": "m", "func": "sum"}}, ("series", "ts_ns")), ({"join": ["m", "m"]}, ("series", "ts_ns"))):
        got = [(r.series, r.ts_ns) for r in e.cursor(q | {"range": {"from": 0, "to": 40}, "order-by": "series"}).read(999)]
        assert got == sorted(got)
    assert [r.series for r in e.cursor({"aggregate": {"m": "sum"}}).read(9)] == [f"m:sum k={k}" for k in range(3)]


def test_forecasts():
    x = [float(i) for i in range(30)]
    assert anomaly.forecast(x, "double-exp", 0.5, 0.5)[5:8] == [5.0, 6.0, 7.0]
    assert anomaly.forecast(x, "sma", period=3)[2:5] == [None, 1.0, 2.0]
    assert anomaly.forecast([7.0] * 20, "ewma", 0.3)[10:] == [7.0] * 10
    seasonal = [5.0 + v for v in (3.0, -1.0, 0.0, -2.0)] * 6
    got = anomaly.forecast(seasonal, "holt-winters", 0.3, 0.2, 0.4, 4)
    assert got[:4] == [None] * 4 and got[4:] == pytest.approx(seasonal[4:])


def test_anomalies(spark):
    cat = catalog(spark, [(f"m k={k}", t, 10.0 + (500.0 if (k, t) == (2, 25) else 0.0)) for k in range(4) for t in range(30)])
    ask = {"group-aggregate": {"step": 1, "metric": "m", "func": "mean"}, "range": {"from": 0, "to": 30}}
    b = build(cat, ask).withColumnRenamed("mean", "value")
    for method, p in (("sma", {"period": 4}), ("ewma", {"alpha": 0.2}), ("double-exp", {"alpha": 0.1, "beta": 0.1}), ("holt-winters", {"alpha": 0.1, "beta": 0.1, "gamma": 0.1, "period": 5})):
        for sketch in (None, (3, 1024)):
            out = anomaly.anomalies(b, method, 0.8, sketch=sketch, **p)
            assert rows(out.filter("anomaly and ts_ns = 25").select("series")) == [("m:mean k=2",)]
        for name in (method, method + "-sketch"):
            found = rows(build(cat, ask | {"apply": [{"name": "anomaly-detector", "method": name, "threshold": 0.8} | p]}))
            assert ("m:mean k=2", 25, 510.0) in found


@pytest.mark.skipif(not have_testdata(), reason="the driver's test data isn't here")
def test_every_query_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    made = entry.queries()
    assert set(entry.oracle_sql()) <= set(made)
    assert entry.entry(spark).count() >= 0
    for name in ("p1_found", "p3_found", "p4_found", "p5_found", "join_two"):
        assert made[name](spark, "/root/testdata/sf0.001").limit(1).count() >= 0


def test_the_rest_works_without_the_training_data_package():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    blocked = "import sys; sys.modules['tidewell.' + 'llm'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'p1_found' in q, 'p8_found' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", blocked], cwd=root, capture_output=True, text=True, timeout=120)
    n, general, special, whole = out.stdout.split()
    assert int(n) > 80 and (general, special, whole) == ("True", "False", "True"), out.stderr
