import json
from datetime import timedelta

from eventweave.engine import Engine, match_lines, standard_events
from eventweave.functions.conditions import AndCondition, EqCondition, Var
from eventweave.plans import statistics
from eventweave.plans.pattern import Event, Not, Pattern, Seq
from eventweave.plans.planner import ReplanTrigger
from eventweave.sources import formats, io
from eventweave.streaming.match import AdaptiveRun, stream_matches

STOCKS = ["AAPL,202401010930,136,137.5,135.5,136.2,1000", "MSFT,202401010931,80.5,81,80,80.7,2000,0.5", "", "AAPL,202401010932,bad,1,1,1,5"]


def test_stock_lines_and_text_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(STOCKS))
    events = formats.StockFormatter()(io.read_lines(spark, str(tmp_path / "in")))
    rows = events.orderBy("seq").collect()
    assert [(r.event_type, r.opening_price, r.volume, r.prob) for r in rows] == [("AAPL", 136.0, 1000, None), ("MSFT", 80.5, 2000, 0.5), ("AAPL", None, 5, None)]
    assert rows[1].us - rows[0].us == 60_000_000
    assert io.first(events).ticker == "AAPL" and io.last(events).volume == 5
    p = Pattern(Seq(Event("AAPL", "a"), Event("MSFT", "m")), window=timedelta(minutes=5))
    lines = match_lines(Engine(p).run(events.drop("prob")), ["a", "m"], ["ticker", "opening_price"])
    io.write_text(lines, str(tmp_path / "out"), one_file=True)
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("part-*"))
    assert text == "ticker=AAPL opening_price=136.0\nticker=MSFT opening_price=80.5\n\n"


def test_sensors_and_generator(spark):
    lines = io.generate_sensors(spark, 40, seed=3)
    assert lines.collect() == io.generate_sensors(spark, 40, seed=3).collect()
    rows = formats.SensorFormatter()(lines).collect()
    assert len(rows) == 40 and {r.event_type for r in rows} <= set(formats.SensorFormatter.LAYOUTS)
    for r in rows:
        own = formats.SensorFormatter.LAYOUTS[r.event_type]
        assert all(r[x] is not None for x in own) and all(r[x] is None for k, v in formats.SensorFormatter.LAYOUTS.items() if k != r.event_type for x in v)


def test_tweets(spark):
    one = {"id": 5, "created_at": "Sun Nov 10 12:00:05 +0000 2024", "text": "Hello Spark", "place": {"full_name": "Here"}, "retweeted_status": {"id": 9}, "user": {"id": 1}}
    lines = io.from_items(spark, [json.dumps(one), "{broken", json.dumps(one | {"id": 6, "text": "other"})])
    rows = formats.TweetFormatter(["spark"])(lines).collect()
    assert [(r.id, r.place, r.retweeted_status, r.event_type) for r in rows] == [(5, "Here", 9, "Tweet")]
    assert rows[0].us == 1731240005_000_000


def test_statistics(spark):
    df = spark.createDataFrame([(0, "A", 0, 1), (1, "B", 1_000_000, 2), (2, "B", 4_000_000, 0)], "seq long, event_type string, us long, x long")
    assert {(r.event_type, r.n, r.rate) for r in statistics.arrival_rates(df).collect()} == {("A", 1, 0.25), ("B", 2, 0.5)}
    assert sum(r.n for r in statistics.arrival_rates(df, "2 seconds").collect()) == 3
    r = statistics.own_selectivity(df, "B", "b", EqCondition(Var("b", "x"), 2)).first()
    assert (r.events, r.selectivity) == (2, 0.5)


def events(spark):
    rows = [(0, "A", "2024-01-01 00:00:00", 1), (1, "B", "2024-01-01 00:00:05", 1), (2, "A", "2024-01-01 00:00:06", 2), (3, "C", "2024-01-01 00:00:08", 2), (4, "B", "2024-01-01 00:00:09", 2), (5, "Z", "2024-01-02 00:00:00", 0)]
    df = spark.createDataFrame(rows, "seq long, event_type string, t string, k long").selectExpr("seq", "event_type", "cast(t as timestamp) ts", "k")
    return standard_events(df)


def test_streaming_equals_batch(spark, tmp_path):
    batch = events(spark)
    batch.repartition(1).write.parquet(str(tmp_path / "e"))
    key = AndCondition(EqCondition(Var("a", "k"), Var("b", "k")))
    a, b = Event("A", "a"), Event("B", "b")
    for i, structure in enumerate([Seq(a, b), Seq(a, b, Not(Event("Z", "z"))), Seq(a, Event("C", "c"), b)]):
        p = Pattern(structure, key, timedelta(seconds=30))
        out = stream_matches(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e")), p, "1 second")
        run = out.writeStream.format("memory").queryName(f"m{i}").outputMode("append").start()
        run.processAllAvailable()
        run.stop()
        got = sorted((r.a__seq, r.b__seq) for r in spark.table(f"m{i}").collect())
        assert got == sorted((r.a__seq, r.b__seq) for r in Engine(p).run(batch).collect())


def test_adaptive_batches_lose_and_repeat_nothing(spark):
    batch = events(spark)
    p = Pattern(Seq(Event("A", "a"), Event("B", "b")), window=timedelta(seconds=30))
    found = []
    run = AdaptiveRun(p, lambda df, i: found.extend((r.a__seq, r.b__seq) for r in df.collect()), trigger=ReplanTrigger("deviation", 0.1))
    for i, (lo, hi) in enumerate(((0, 2), (2, 4), (4, 6))):
        run(batch.where(f"seq >= {lo} and seq < {hi}"), i)
    assert sorted(found) == sorted((r.a__seq, r.b__seq) for r in Engine(p).run(batch).collect()) and run.replans >= 1


def test_live_lines_with_words(spark, tmp_path):
    from eventweave.sources.live import KeywordLines

    file = tmp_path / "live.txt"
    file.write_text("About Spark\nother\n")
    spark.dataSource.register(KeywordLines)
    lines = spark.readStream.format("keyword_lines").option("path", str(file)).option("words", "spark, flink").load()
    run = lines.writeStream.format("memory").queryName("live").outputMode("append").start()
    run.processAllAvailable()
    with file.open("a") as f:
        f.write("no\nFLINK too\nspark unfinished")
    run.processAllAvailable()
    run.stop()
    assert sorted((r.value, r.seq) for r in spark.table("live").collect()) == [("About Spark", 0), ("FLINK too", 21)]


def unequal_files(folder):
    import os

    folder.mkdir()
    lines = []
    for k, n in enumerate([2, 50, 0, 1, 7]):
        own = [f"{'abcde'[k]}{i}" for i in range(n)]
        (folder / f"{'abcde'[k]}.txt").write_text("".join(f"{x}\n" for x in own))
        os.utime(folder / f"{'abcde'[k]}.txt", (1_700_000_000 + k, 1_700_000_000 + k))
        lines += own
    return lines


def test_lines_of_unequal_files_are_in_order(spark, tmp_path):
    lines = unequal_files(tmp_path / "in")
    got = {r.seq: r.value for r in io.read_lines(spark, str(tmp_path / "in")).collect()}
    assert [got[i] for i in range(len(lines))] == lines and len(got) == len(lines)
    (tmp_path / "big.txt").write_text("".join(f"{i}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")  # many splits of one file
    try:
        rows = io.read_lines(spark, str(tmp_path / "big.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 20_000 and all(str(r.seq) == r.value for r in rows)


def test_stream_of_lines_equals_batch(spark, tmp_path):
    lines = unequal_files(tmp_path / "in")
    run = io.stream_lines(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("lines_read").trigger(availableNow=True).start()
    run.awaitTermination()
    assert not run.exception()
    rows = sorted((r.seq, r.value) for r in spark.table("lines_read").collect())
    assert [v for _, v in rows] == lines and len({s for s, _ in rows}) == len(lines)
    assert all(b[0] - a[0] == 1 for a, b in zip(rows, rows[1:], strict=False) if a[1][0] == b[1][0])


def test_contiguous_lines_across_files(spark, tmp_path):
    from datetime import timedelta

    from eventweave.engine import Engine, standard_events
    from eventweave.plans.pattern import Event, Pattern, Policy, Seq
    from pyspark.sql import functions as F

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("x\ny\nx\n")
    (tmp_path / "in" / "2.txt").write_text("y\nx\nx\ny\n")
    events = io.read_lines(spark, str(tmp_path / "in")).select("seq", F.col("value").alias("event_type"), F.timestamp_seconds("seq").alias("ts"))
    p = Pattern(Seq(Event("x", "a"), Event("y", "b")), window=timedelta(hours=1), policy=Policy(contiguous=["a", "b"]))
    assert sorted((r.a__seq, r.b__seq) for r in Engine(p).run(standard_events(events)).collect()) == [(0, 1), (2, 3), (5, 6)]
