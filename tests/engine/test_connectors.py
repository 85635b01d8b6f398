"""The feed and the alert sink as connectors, and the scanner's state against the table."""

import json

import pytest
from pyspark.sql import functions as F

from tidelake.operators import bars as B
from tidelake.sources import connectors as cn
from tidelake.streaming import live, scanner

SF = "/root/testdata/sf0.001"
DAY = 86400


@pytest.fixture(scope="module")
def bars(spark):
    return B.bars(spark.read.parquet(f"{SF}/events.parquet")).persist()


@pytest.fixture(scope="module")
def feed(spark, bars, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("feed") / "pages")
    cn.register(spark)
    cn.write_pages(bars, folder, DAY)
    t = bars.agg(F.min("t"), F.max("t")).first()
    symbols = ",".join(sorted(r.sym for r in bars.select("sym").distinct().collect()))
    return {"folder": folder, "symbols": symbols, "start": str(t[0]), "end": str((t[1] // DAY + 1) * DAY), "step": str(DAY), "rate": "100000"}


def rows(df):
    return sorted(map(tuple, df.select("sym", "t", "o", "h", "l", "c", "v", "tb").collect()))


def test_batch_reads_every_page(spark, bars, feed):
    assert rows(cn.parsed(spark.read.format("feed_pages").options(**feed).load())) == rows(bars)
    none = spark.read.format("feed_pages").options(**feed | {"symbols": "nobody"}).load()
    assert none.count() == 0


def test_stream_goes_on_from_its_offset_without_loss_or_repeat(spark, bars, feed, tmp_path):
    start, end = int(feed["start"]), int(feed["end"])
    for part in (start + 5 * DAY, start + 5 * DAY, start + 11 * DAY + 77, end, end):  # a stop with nothing new, one within a page
        pages = spark.readStream.format("feed_pages").options(**feed | {"end": str(part)}).load()
        live.run_once(cn.parsed(pages), str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(bars)


def test_alerts_are_published_once_and_failures_leave_nothing(spark, bars, tmp_path):
    schema = "sym string, t long, c double"
    some = bars.select("sym", "t", "c").where("c > 50")
    path = str(tmp_path / "alerts")
    some.write.format("alert_sink").option("path", path).mode("append").save()
    assert sorted(map(tuple, cn.alerts(spark, path, schema).collect())) == sorted(map(tuple, some.collect()))
    bad = some.withColumn("c", F.when(F.col("t") > 0, F.raise_error(F.lit("lost"))).cast("double"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("alert_sink").option("path", path).mode("append").save()
    assert cn.alerts(spark, path, schema).count() == some.count()
    sink = cn._StreamAlerts({"path": str(tmp_path / "again")})
    for value in (1, 2):  # a batch that is repeated replaces what it published
        sink.commit([sink.write(iter([_Row(value)])), None], 7)
    assert [json.loads(x.value) for x in spark.read.text(str(tmp_path / "again" / "alerts-*")).collect()] == [{"v": 2}]
    sink.abort([sink.write(iter([_Row(3)]))], 8)
    assert [f for f in (tmp_path / "again" / "_staged").iterdir() if not f.name.startswith(".")] == []


class _Row:
    def __init__(self, v):
        self.v = v

    def asDict(self):
        return {"v": self.v}


def test_alerts_of_a_stream(spark, bars, feed, tmp_path):
    for part in (int(feed["start"]) + 6 * DAY, int(feed["end"])):
        pages = spark.readStream.format("feed_pages").options(**feed | {"end": str(part)}).load()
        sure = cn.parsed(pages).where("c > 50").select("sym", "t", "c")
        sure.writeStream.format("alert_sink").option("path", str(tmp_path / "a")).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    got = cn.alerts(spark, str(tmp_path / "a"), "sym string, t long, c double")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bars.where("c > 50").select("sym", "t", "c").collect()))


def test_scanner_equals_the_table(spark, tmp_path):
    """Events in files out of order, a few of them late but within the watermark: the same bars, scores and alerts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        t0 = 1_700_000_000 // 14400 * 14400
        events = [("ab"[i % 2], t0 + i * 1700 - (4000 if i % 9 == 0 else 0), float((i * 37) % 101), i) for i in range(600)]
        df = spark.createDataFrame(events, "event_type string, sec long, value double, event_id long").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
        for k in range(6):
            df.where((F.col("event_id") >= k * 100) & (F.col("event_id") < k * 100 + 100)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}.parquet"))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = scanner.scanned(stream, back=5, least=1.0, cooldown=40_000, late="2 hours")
        live.run_once(out, str(tmp_path / "out"), str(tmp_path / "state"))
        got = {(r.sym, r.t): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    table = df.withColumn("t", F.floor(F.unix_timestamp("ts") / 14400) * 14400).groupBy(F.col("event_type").alias("sym"), "t").agg(F.max_by("value", F.struct("ts", "event_id")).alias("c"), F.count("*").alias("n"))
    newest = df.agg(F.max(F.unix_timestamp("ts"))).first()[0] - 7200
    want = {(r.sym, r.t): r for r in scanner.scanned_table(table, back=5, least=1.0, cooldown=40_000).collect() if r.t + 14400 <= newest}
    assert got.keys() == want.keys() and len(got) > 60 and sum(r.alert for r in got.values()) > 5
    for k, r in got.items():
        w = want[k]
        assert (r.c, r.n, r.alert) == (w.c, w.n, w.alert)
        assert (r.score is None or r.score != r.score) == (w.score is None) and (w.score is None or abs(r.score - w.score) < 1e-9)
