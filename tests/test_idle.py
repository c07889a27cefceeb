"""Sessions that end: what is kept of idle ones goes, and what was told of them stays as it was."""

from pyspark.sql import functions as F
from test_models import log_of

from turnscope.functions import vocab as V
from turnscope.session import scratch_path
from turnscope.sources import catalogue as C
from turnscope.streaming import jobs


def run(spark, parts, idle_s):
    """Rows told, and the rows of state left after every part."""
    policies, left = jobs.catalogue_policies(C.packaged(spark)), []
    source, sink, checkpoint = (scratch_path(spark, n) for n in ("idle-in", "idle-out", "idle-checkpoint"))
    for part in parts:
        part.write.mode("append").parquet(source)
        told = jobs.route_session(
            spark.readStream.schema(part.schema).parquet(source), policies, 3, V.DEFAULT_PARAMS, idle_s=idle_s, delay="1 minute")
        query = told.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start()
        query.awaitTermination()
        left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return {tuple(r) for r in spark.read.parquet(sink).select("sid", "idx", "kind", "rule", "key").collect()}, left


def test_idle_sessions_leave_no_state(spark):
    jobs.stateful(spark)
    hour, parts = 3600, []
    for h in range(4):
        rows = [(sid, s, "message", None, None, f"see {sid} /clients/cases {s}") for sid in (f"a{h}", f"b{h}") for s in range(8)]
        rows += [("steady", 9, "message", None, None, f"still here {h}")] if h in (0, 2) else []
        log = log_of(spark, rows).drop("chunk")
        moved = log.withColumn("us", F.col("us") + h * hour * 1_000_000).withColumn("seq", F.col("seq") + 100 * h)
        parts.append(moved.withColumn("ts", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")))
    kept, grown = run(spark, parts, None)
    told, left = run(spark, parts, 2.5 * hour)
    assert kept and told == kept  # the ended sessions had nothing more to say, and the steady one never ended
    assert grown[2] == left[2] and grown[3] > left[3]
    # a session that comes back after its end begins anew
    again, few = run(spark, parts[:3], 600)
    steady = lambda rows: sorted(r[1] for r in rows if r[0] == "steady" and r[3] == "R03")
    assert steady(kept) == [1] and few[2] == grown[0]  # state of the last hour alone, as many sessions as in the first
    assert {r[1] for r in again if r[0] == "steady"} == {1}
