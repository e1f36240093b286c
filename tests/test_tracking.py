"""Live tracking as a stream: throttle, stop, change of path, expiry, bad rows aside, and latest answers."""

from pyspark.sql import functions as F

from penumbra.session import ship_package
from penumbra.streaming import tracking

START = 1_700_000_000


def run(spark, tmp_path, rows, schema, stream, name):
    """Rows in files by their first field, one file a batch, through a stream; what comes out."""
    ship_package(spark)
    df = spark.createDataFrame(rows, f"batch int, {schema}").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    for batch in sorted({r[0] for r in rows}):
        df.where(F.col("batch") == batch).drop("batch").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}-in")
    source = spark.readStream.schema(df.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}-in")
    query = stream(source).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}-check").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.table(name).collect()


SAMPLES = "user_id long, path_key string, event_id long, ms long, input string, lat double, lon double, acc double, distance_m double"


def sample(batch, user, seconds, event, lat=37.5, lon=127.0, acc=5.0, distance=0.0, path="p", kind=tracking.SAMPLE):
    return (batch, user, path, event, int((START + seconds) * 1000), kind, lat, lon, acc, distance)


def test_throttle_reset_stop_and_bad_rows(spark, tmp_path):
    step = 20 / 111_000  # twenty metres
    rows = [
        sample(0, 1, 0, 1), sample(0, 1, 2, 2), sample(0, 1, 2.5, 3, lat=37.5 + step), sample(0, 1, 5.5, 4, lat=37.5 + step),  # 2: too soon and too near; 3: far enough; 4: late enough
        sample(0, 2, 0, 1, distance=100.0), sample(0, 2, 4, 2, distance=100.0), sample(1, 2, 8, 3, distance=100.0), sample(1, 2, 12, 4, distance=100.0, path="q"),  # off-route at the third, then a new path
        sample(0, 3, 0, 1, distance=90.0), sample(0, 3, 4, 2, kind=tracking.STOP), sample(1, 3, 5, 3, distance=90.0),  # after a stop nothing is too soon, and the streak starts again
        sample(0, 4, 0, 1, lat=float("nan")), sample(0, 4, 1, 2, acc=-1.0), sample(0, 4, 2, 3, lon=200.0), sample(0, 4, 3, 4, lat=None), sample(0, 4, 4, 5, distance=None),
        sample(1, 1, 4.5, 9)]  # older than the last that passed
    got = run(spark, tmp_path, rows, SAMPLES, tracking.track, "tracked")
    said = sorted((r.user_id, r.event_id, r.path_key, r.output, r.kind, r.streak) for r in got)
    assert said == [
        (1, 1, "p", "state", "on-route", 0), (1, 3, "p", "state", "on-route", 0), (1, 4, "p", "state", "on-route", 0),
        (2, 1, "p", "state", "checking", 1), (2, 2, "p", "state", "checking", 2), (2, 3, "p", "state", "off-route", 3), (2, 4, "q", "state", "checking", 1),
        (3, 1, "p", "state", "checking", 1), (3, 2, "p", "state", "stopped", 0), (3, 3, "p", "state", "checking", 1),
        (4, 1, "p", "error", "LOCATION_UNAVAILABLE", 0), (4, 2, "p", "error", "LOCATION_UNAVAILABLE", 0), (4, 3, "p", "error", "LOCATION_UNAVAILABLE", 0), (4, 4, "p", "error", "LOCATION_UNAVAILABLE", 0), (4, 5, "p", "state", "checking", 0)]


def test_a_walk_without_samples_expires(spark, tmp_path):
    late = tracking.EXPIRE_MS // 1000
    rows = [sample(0, 1, 0, 1, distance=90.0), sample(0, 1, 5, 2, distance=90.0), sample(0, 2, late, 1), sample(1, 2, late + 90, 2), sample(2, 2, late + 180, 3), sample(3, 1, late + 200, 3, distance=90.0), sample(3, 2, late + 200, 4)]
    got = run(spark, tmp_path, rows, SAMPLES, tracking.track, "expired")
    first = [(r.kind, r.streak) for r in sorted((r for r in got if r.user_id == 1), key=lambda r: r.ts)]
    assert first == [("checking", 1), ("checking", 2), ("expired", 0), ("checking", 1)]
    assert {r.kind for r in got if r.user_id == 2} == {"on-route"}


def test_two_sinks_of_one_stream(spark, tmp_path):
    ship_package(spark)
    rows = [sample(0, 1, 0, 1), sample(0, 1, 5, 2, lat=99.0)]
    df = spark.createDataFrame(rows, f"batch int, {SAMPLES}").withColumn("ts", F.timestamp_millis("ms")).drop("ms", "batch")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = tracking.track(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    query = tracking.to_two_sinks(stream, f"{tmp_path}/states", f"{tmp_path}/errors", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    assert [(r.event_id, r.kind) for r in spark.read.parquet(f"{tmp_path}/states").collect()] == [(1, "on-route")]
    assert [(r.event_id, r.kind) for r in spark.read.parquet(f"{tmp_path}/errors").collect()] == [(2, "LOCATION_UNAVAILABLE")]


def test_only_the_last_request_is_answered(spark, tmp_path):
    rows = [
        (0, 1, 1, 0, "asked", None), (0, 1, 2, 1000, "asked", None), (0, 1, 1, 2000, "answered", "old"), (1, 1, 2, 3000, "answered", "new"), (1, 1, 2, 4000, "answered", "again"),
        (0, 2, 1, 0, "asked", None), (0, 2, 1, 10, "answered", "a"), (1, 2, 2, 3000, "asked", None), (2, 2, 1, 5000, "answered", "late"), (2, 2, 2, 6000, "answered", "b"),
        (0, 3, 7, 0, "answered", "nobody asked")]
    got = run(spark, tmp_path, [(b, u, s, START * 1000 + ms, k, x) for b, u, s, ms, k, x in rows], "user_id long, request_seq long, ms long, input string, result string", tracking.latest_answers, "latest")
    assert sorted((r.user_id, r.request_seq, r.result) for r in got) == [(1, 2, "new"), (2, 1, "a"), (2, 2, "b")]


def test_impressions_once(spark, tmp_path):
    rows = [(0, 1, "t", "p", START * 1000), (0, 1, "t", "p", START * 1000 + 5), (0, 1, "t", "q", START * 1000), (0, 1, "u", "p", START * 1000), (0, 2, "t", "p", START * 1000)]
    got = run(spark, tmp_path, rows, "user_id long, requested_at string, path_key string, ms long", tracking.impressions_once, "impressions")
    want = [(1, "t", "p"), (1, "t", "q"), (1, "u", "p"), (2, "t", "p")]
    assert sorted((r.user_id, r.requested_at, r.path_key) for r in got) == want
    again = tracking.impressions_once(spark.createDataFrame([r[1:] for r in rows], "user_id long, requested_at string, path_key string, ms long"))
    assert sorted((r.user_id, r.requested_at, r.path_key) for r in again.collect()) == want
