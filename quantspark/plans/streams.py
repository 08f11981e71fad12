"""Streams with keyed state, fed with files that land out of order."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.plans import derived as dv
from quantspark.plans.base import query
from quantspark.session import stage, staging_folder
from quantspark.streaming import stateful

#: Rows up to here are known before the stream starts; the stream lands in slices by arrival.
CUT, SLICES, SLICE_DAYS, JITTER_DAYS = "2024-01-06", 3, 9, 2
#: A slice may be read in any order, and a row may arrive a jitter after its time.
LATE_DAYS = SLICE_DAYS + JITTER_DAYS
DROP = 0.2


def _place(t, name: str) -> str:
    return f"{staging_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def landed(t, rows: DataFrame, shuffle: str) -> DataFrame:
    """A stream over files of ``rows``; rows arrive up to JITTER_DAYS late, by a hash of the column ``shuffle``."""
    folder = _place(t, "landed")
    late = F.pmod(F.xxhash64(shuffle), F.lit(JITTER_DAYS * 24)).cast("int")
    day = F.datediff(F.col("ts") + F.make_interval(hours=late), F.lit(CUT))
    sliced = stage(rows.withColumn("_slice", F.least(F.floor(day / SLICE_DAYS).cast("int"), F.lit(SLICES - 1))))
    for i in range(SLICES):  # each landing is later than the one before
        sliced.filter(F.col("_slice") == i).drop("_slice").write.mode("append").parquet(folder)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(folder)


def finished(t, stream: DataFrame, name: str) -> tuple[DataFrame, str]:
    """What a stream appends until its input ends, and its checkpoint."""
    stateful.use_rocksdb(t.spark)
    out, checkpoint = _place(t, name), _place(t, f"{name}-state")
    job = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out), checkpoint


@query("stream_dip_alerts", "R5", "ticker s,ts t,close f,ret f",
       f"""WITH b AS (SELECT *, close/LAG(close) OVER (PARTITION BY ticker ORDER BY ts)-1 AS ret FROM bars_hourly)
       SELECT * FROM b WHERE ret<=-{DROP}::DOUBLE AND ts>=TIMESTAMP '{CUT}' AND ts<(SELECT MAX(ts) FROM bars_hourly) - INTERVAL {LATE_DAYS} DAY""")
def stream_dip_alerts(t):
    """Bars in any order against the bar before them; what the watermark has not passed is not judged yet."""
    bars = stage(dv.bars_hourly(t).select("ticker", F.col("ts").cast("timestamp").alias("ts"), "close"))
    before = F.col("ts") < F.lit(CUT).cast("timestamp")
    alerts = stateful.dip_alerts(landed(t, bars.filter(~before), "ts"), DROP, f"{LATE_DAYS} days", bars.filter(before))
    return finished(t, alerts, "alerts")[0]


@query("stream_card_marks", "R4 J19", "user_id s,card s", "SELECT user_id, card FROM marks GROUP BY 1,2 HAVING arg_max(op,(ts,seq))='mark'")
def stream_card_marks(t):
    """Cards that are marked in the end, whatever order the changes land in."""
    changes = stage(dv.marks(t).select(
        F.lit("read").alias("kind"), F.col("user_id").cast("string").alias("user_id"), "card", "op", F.col("ts").cast("timestamp").alias("ts"), "seq"))
    before = F.col("ts") < F.lit(CUT).cast("timestamp")
    known = changes.filter(before)
    flips, _ = finished(t, stateful.card_marks(landed(t, changes.filter(~before), "seq"), f"{LATE_DAYS} days", known), "flips")
    newest = F.max_by("op", F.struct("ts", "seq")).alias("op")
    last = known.unionByName(flips).groupBy("user_id", "card").agg(newest)
    return last.filter("op = 'mark'")
