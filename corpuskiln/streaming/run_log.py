"""Event logs of runs: an append-only sink that a restart does not double and that takes no secrets, the runs that events tell of, and their compaction.

Events have run_id, kind, label, event (RUN, START, END, FAIL, DONE or ABORT), key (of a step), detail (a text) and seq, which
orders the events of a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Keys that no event may carry, and the most characters of an error.
SECRET_KEYS = ("cookie", "cookies", "password", "token", "api_key", "authorization", "localstorage", "sessionstorage", "dom")
LONGEST_ERROR = 1200
#: Runs that a compacted log keeps.
KEPT = 50


def carries_secret(row: Column) -> Column:
    """Whether the JSON of a struct has a key that must not be logged, at any depth, escaped inside a text too."""
    return F.lower(F.to_json(row)).rlike('"(?:' + "|".join(SECRET_KEYS) + r')\\*"')


def write_batch(rows: DataFrame, batch: int, path: str) -> None:
    """Writes a batch's events to a folder of its own number, and those with secrets, without their details, to the refused ones.

    A batch that is written again replaces itself, so a restart leaves no doubles.
    """
    told = rows.withColumn("refused", carries_secret(F.struct(*rows.columns)))
    told.filter(~F.col("refused")).drop("refused").write.mode("overwrite").parquet(f"{path}/events/batch={batch}")
    told.filter("refused").select("run_id", "seq", F.lit("SECRET_KEY").alias("reason")).write.mode("overwrite").parquet(f"{path}/refused/batch={batch}")


def append_events(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts appending a stream's events to the log at `path`, until all that is there now is taken."""
    return stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_events(spark: SparkSession, path: str, kind: str = "events") -> DataFrame:
    """The events of the log, or with kind refused what it did not take."""
    return spark.read.parquet(f"{path}/{kind}")


STEPS = "array<struct<key:string,status:string,started:bigint,ended:bigint,error:string>>"


def runs(events: DataFrame) -> DataFrame:
    """run_id, kind, label, status, started, ended, error and steps (key, status, started, ended, error; in order) of each run.

    START opens a step; END and FAIL close the last open step of their key, and nothing if none is open; DONE and ABORT end the
    run, the last of them in order counting. Errors are held at 1,200 characters. A run's kind and label are those of its first
    event. Events of one run are folded in the order of seq; a run's events are as many as its steps, so they fit in a row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "event", "key", F.substring(F.coalesce("detail", F.lit("")), 1, LONGEST_ERROR).alias("detail"))))
    told = events.groupBy("run_id").agg(F.min_by("kind", "seq").alias("kind"), F.min_by("label", "seq").alias("label"), F.min("seq").alias("started"), ordered.alias("events"))

    def step(steps: Column, e: Column) -> Column:
        opened = F.concat(steps, F.array(F.struct(e["key"].alias("key"), F.lit("RUNNING").alias("status"), e["seq"].cast("bigint").alias("started"), F.lit(None).cast("bigint").alias("ended"), F.lit("").alias("error"))))
        mine = F.transform(steps, lambda s, i: F.when((s["status"] == "RUNNING") & (s["key"] == e["key"]), i))
        last = F.array_max(mine)
        failed = e["event"] == "FAIL"

        def closed(s: Column, i: Column) -> Column:
            here = i == last
            return F.struct(
                s["key"].alias("key"),
                F.when(here, F.when(failed, "FAILED").otherwise("SUCCESS")).otherwise(s["status"]).alias("status"),
                s["started"].alias("started"),
                F.when(here, e["seq"].cast("bigint")).otherwise(s["ended"]).alias("ended"),
                F.when(here & failed, e["detail"]).otherwise(s["error"]).alias("error"),
            )

        return F.when(e["event"] == "START", opened).when(e["event"].isin("END", "FAIL") & last.isNotNull(), F.transform(steps, closed)).otherwise(steps)

    end = F.element_at(F.filter("events", lambda e: e["event"].isin("DONE", "ABORT")), -1)
    end = F.when(F.exists("events", lambda e: e["event"].isin("DONE", "ABORT")), end)
    return told.select(
        "run_id",
        "kind",
        "label",
        F.when(end["event"] == "DONE", "SUCCESS").when(end["event"] == "ABORT", "FAILED").otherwise("RUNNING").alias("status"),
        F.col("started").cast("bigint").alias("started"),
        end["seq"].cast("bigint").alias("ended"),
        F.when(end["event"] == "ABORT", end["detail"]).otherwise("").alias("error"),
        F.aggregate("events", F.array().cast(STEPS), step).alias("steps"),
    )


def compacted(found: DataFrame, key: str = "kind", most: int = KEPT) -> DataFrame:
    """The last `most` runs of each key, by start and then id."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(F.col("started").desc(), F.col("run_id").desc()))
    return found.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")


def compact(spark: SparkSession, path: str, version: int, most: int = KEPT) -> DataFrame:
    """Writes the last runs of each kind as the given version of the compacted log, whole or not at all, and reads it.

    A version's folder counts once its write has committed; writing it again replaces it.
    """
    compacted(runs(read_events(spark, path).drop("batch")), most=most).write.mode("overwrite").parquet(f"{path}/runs/version={version}")
    return spark.read.parquet(f"{path}/runs/version={version}")
