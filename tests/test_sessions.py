from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from confab.operators import session_numbers, sessionize
from confab.plans.catalogue import timed_events
from confab.streaming import stream_sessions

SCHEMA = "k bigint, ord bigint, id bigint, t bigint"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400)), min_size=1, max_size=40), gap=st.integers(0, 60))
def test_cuts(spark, rows, gap):
    df = spark.createDataFrame([(k, t, i, t) for i, (k, t) in enumerate(rows)], SCHEMA)
    got = {r.id: r.session_no for r in session_numbers(df, ["k"], ["ord", "id"], gap=gap).collect()}
    for key in {k for k, _ in rows}:
        own, no, last = sorted((t, i) for i, (k, t) in enumerate(rows) if k == key), 0, None
        for t, i in own:
            no += last is not None and t - last > gap
            last = t
            assert got[i] == no


def test_gap_is_strict(spark):
    df = spark.createDataFrame([(1, t, i, t) for i, t in enumerate((0, 43200, 86401))], SCHEMA)
    assert sorted((r.start, r.n) for r in sessionize(df, ["k"], ["ord", "id"]).collect()) == [(0, 2), (86401, 1)]
    assert sorted((r.start, r.n) for r in stream_sessions(df, ["k"]).collect()) == [(0, 2), (86401, 1)]


def test_one_exchange(spark, sf_dir):
    plan = sessionize(timed_events(spark, sf_dir), ["user_id"], ["ord", "event_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_stream_agrees_with_batch(spark, sf_dir, tmp_path):
    events = timed_events(spark, sf_dir).select("user_id", "t")
    events.write.parquet(str(tmp_path / "in"))
    batch = {(r.user_id, r.start, r.end, r.n) for r in stream_sessions(events, ["user_id"]).collect()}
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream_sessions(source, ["user_id"], watermark="1 hour").writeStream.outputMode("complete").format("memory").queryName("s").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.user_id, r.start, r.end, r.n) for r in spark.sql("select * from s").collect()} == batch
    assert events.agg(F.count("*")).first()[0] == sum(x[3] for x in batch)
