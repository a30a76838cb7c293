"""Stateful streams: folders that settle, rate limits, edit sessions, files taken once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from loomline.sources.shared import cut

# Fixed values.
SETTLE_S, FREE_TRIES, MOST_WAIT_S, FORGET_S = 30, 3, 900, 3600


def settled(observations: DataFrame, key: str, fingerprint: str, at: str, settle: int = SETTLE_S) -> DataFrame:
    """Rows (key, fingerprint, since, ready_at): when each fingerprint of a folder had not changed for ``settle``. For tables.

    Every change starts the clock anew; a fingerprint that comes back later settles again.
    """
    w = W.partitionBy(key).orderBy(at, fingerprint)
    changed = F.when(F.col(fingerprint).eqNullSafe(F.lag(fingerprint).over(w)) & F.lag(at).over(w).isNotNull(), 0).otherwise(1)
    rows = observations.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    since = F.min(at).over(W.partitionBy(key, "_run"))
    return rows.withColumn("since", since).where(F.col(at) - F.col("since") >= settle).groupBy(key, "_run", fingerprint, "since").agg(F.min(at).alias("ready_at")).select(key, fingerprint, "since", "ready_at")


def settled_stream(observations: DataFrame, key: str, fingerprint: str, at: str, settle: int = SETTLE_S) -> DataFrame:
    """The same for a stream: what was last seen of each folder, since when and whether it was told is state.

    Time is that of the observations, which a poll makes again and again, so no timer is needed and a replay gives the
    same rows. Observations of one folder come in order from one micro-batch to the next. A folder's rows of a
    micro-batch are held in Python at once; ``settle_stream`` holds none.
    """
    kinds = dict(observations.dtypes)

    def run(name: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, since, told = state.get if state.exists else (None, None, False)
        out = []
        for now, held in pd.concat(parts).sort_values([at, fingerprint])[[at, fingerprint]].itertuples(index=False):
            if since is None or held != seen:
                seen, since, told = held, int(now), False
            if not told and now - since >= settle:
                out.append((name[0], seen, since, int(now)))
                told = True
        state.update((seen, since, told))
        if out:
            yield pd.DataFrame(out, columns=[key, fingerprint, "since", "ready_at"])

    return observations.select(key, fingerprint, at).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {fingerprint} {kinds[fingerprint]}, since long, ready_at long", f"seen {kinds[fingerprint]}, since long, told boolean", "append", "NoTimeout")


def settle_batch(batch: DataFrame, state: DataFrame, key: str, fingerprint: str, at: str, settle: int = SETTLE_S) -> tuple[DataFrame, DataFrame]:
    """(what settled, the state after) of one micro-batch, as ``settled`` says it; state has a row (key, fingerprint, since, told) per folder.

    A folder's state stands before its observations, which windows take in order, so a folder of any number of
    observations is sorted and spilled by Spark, and none is held in Python. Null keys are a folder, null times are left out.
    """
    before = state.select(F.col(key).alias("k"), F.col(fingerprint).alias("f"), F.col("since").alias("t"), F.lit(0).alias("late"), F.coalesce("told", F.lit(False)).alias("told"))
    fresh = batch.where(F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(fingerprint).alias("f"), F.col(at).cast("long").alias("t"), F.lit(1).alias("late"), F.lit(False).alias("told"))
    w = W.partitionBy("k").orderBy("late", "t", "f")
    same = F.col("f").eqNullSafe(F.lag("f").over(w)) & F.lag("t").over(w).isNotNull()
    rows = before.unionByName(fresh).withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("since", F.min("t").over(W.partitionBy("k", "run")))
    ready = F.min(F.when((F.col("late") == 1) & (F.col("t") - F.col("since") >= settle), F.col("t")))
    runs = cut(rows.groupBy("k", "run", "f", "since").agg(F.max("told").alias("told"), ready.alias("ready_at")))
    out = runs.where("NOT told AND ready_at IS NOT NULL").select(F.col("k").alias(key), F.col("f").alias(fingerprint), "since", "ready_at")
    last = runs.groupBy("k").agg(F.max_by(F.struct("f", "since", (F.col("told") | F.col("ready_at").isNotNull()).alias("told")), "run").alias("s"))
    return out, last.select(F.col("k").alias(key), F.col("s.f").alias(fingerprint), F.col("s.since").alias("since"), F.col("s.told").alias("told"))


def settle_stream(observations: DataFrame, folder: str, key: str, fingerprint: str, at: str, settle: int = SETTLE_S) -> DataStreamWriter:
    """A stream of observations whose settled folders are written below ``folder``/out, to be started by the caller.

    Each micro-batch reads the state that the one before wrote and writes its own under its own number. A batch that is
    run again after a crash reads the same state and writes the same rows over, so each is there once.
    """
    spark = observations.sparkSession
    kinds = dict(observations.dtypes)
    schema = f"{key} {kinds[key]}, {fingerprint} {kinds[fingerprint]}, since long, told boolean"

    def each(batch: DataFrame, number: int) -> None:
        state = spark.read.schema(schema).parquet(f"{folder}/state/{number - 1}") if number else spark.createDataFrame([], schema)
        out, after = settle_batch(batch, state, key, fingerprint, at, settle)
        after.write.mode("overwrite").parquet(f"{folder}/state/{number}")
        out.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return observations.select(key, fingerprint, at).writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint")


def rate_limits(failures: DataFrame, key: str, at: str, tie: str, free: int = FREE_TRIES, most: int = MOST_WAIT_S, forget: int = FORGET_S) -> DataFrame:
    """Adds n, how many failures stand against the key, and wait, the seconds to wait after this one.

    The first ``free`` cost nothing, then the wait doubles up to ``most``; ``forget`` without a failure clears the count.
    """
    w = W.partitionBy(key).orderBy(at, tie)
    fresh = F.coalesce((F.col(at) - F.lag(at).over(w) > forget).cast("int"), F.lit(1))
    rows = failures.withColumn("_f", fresh).withColumn("_s", F.sum("_f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy(key, "_s").orderBy(at, tie)).cast("long"))
    wait = F.when(F.col("n") < free, 0).otherwise(F.least(F.lit(float(most)), F.pow(F.lit(2.0), F.least(F.col("n"), F.lit(60)) - free + 1))).cast("long")
    return rows.withColumn("wait", wait).drop("_f", "_s")


def edit_sessions_stream(edits: DataFrame, owner: str, key: str, at: str, gap: str = "1.5 seconds", late: str = "1 minute") -> DataFrame:
    """Steps of a stream of edits: those of one owner and key within ``gap`` of the last, sent once the watermark has passed them."""
    return edits.withWatermark(at, late).groupBy(owner, key, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n")).select(owner, key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def taken_once(files: DataFrame, content: str, at: str, late: str = "1 day") -> DataFrame:
    """A stream of files of which each content passes once within the watermark, so that an import repeated after a crash adds nothing."""
    return files.withWatermark(at, late).dropDuplicatesWithinWatermark([content])
