"""Status, merging, change capture and plans of what to do, as tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def status(skip: Column, locked: Column, uploaded_key: Column, key: Column, uploaded_meta: Column, meta: Column, reviewed: Column) -> Column:
    """skipped, uploaded, changed, reviewed or new; a locked item that was uploaded stays so."""
    uploaded = uploaded_key.isNotNull()
    same = uploaded_key.eqNullSafe(key) & uploaded_meta.eqNullSafe(meta)
    return F.when(skip, "skipped").when(uploaded & (locked | same), "uploaded").when(uploaded, "changed").when(reviewed, "reviewed").otherwise("new")


def three_way_merge(raw: DataFrame, base: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """What was changed between ``base`` and ``new``, put onto ``raw``: rows by key, values by column.

    A row that ``new`` dropped goes; one that only ``new`` has comes; one that ``raw`` alone has stays. A value that
    ``new`` left as in ``base`` is raw's.
    """
    side = lambda df, p: df.select(*keys, F.lit(True).alias(f"_{p}"), *[F.col(c).alias(f"_{p}_{c}") for c in columns])
    rows = side(raw, "r").join(side(base, "b"), list(keys), "full_outer").join(side(new, "n"), list(keys), "full_outer")
    stays = F.col("_n").isNotNull() | F.col("_r").isNotNull() & F.col("_b").isNull()

    def merged(c: str) -> Column:
        untouched = F.col(f"_n_{c}").eqNullSafe(F.col(f"_b_{c}")) & F.col("_b").isNotNull() & F.col("_r").isNotNull()
        return F.when(F.col("_n").isNull() | untouched, F.col(f"_r_{c}")).otherwise(F.col(f"_n_{c}")).alias(c)

    return rows.where(stays).select(*keys, *[merged(c) for c in columns])


def upsert(df: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last change of each key over the table's row; rows without a change stay."""
    last = changes.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r", order)
    return df.join(last.select(*keys), list(keys), "left_anti").unionByName(last.select(*df.columns))


def pulled(ours: DataFrame, remote: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key what to take over from the remote side: fields that differ from what was last pushed, and how many."""
    r = remote.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in columns])
    both = ours.join(r, list(keys))
    change = {c: ~F.col(f"_r_{c}").eqNullSafe(F.col(f"pushed_{c}")) for c in columns}
    return both.select(*keys, *[F.when(change[c], F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c) for c in columns], sum((change[c].cast("int") for c in columns), F.lit(0)).alias("changed")).where("changed > 0")


def merged_suggestions(old: DataFrame, new: DataFrame, owned: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Suggestions after a new run: decided ones keep their state and get the new confidence, open ones not repeated go, owned values are accepted."""
    o = old.select(*keys, value, F.col("state").alias("_state"), F.col("confidence").alias("_old"))
    n = new.select(*keys, value, F.col("confidence").alias("_new"))
    w = owned.select(*keys, value, F.lit(True).alias("_own")).distinct()
    rows = o.join(n, [*keys, value], "full_outer").join(w, [*keys, value], "left")
    decided = F.col("_state").isin("accepted", "dismissed")
    state = F.when(decided, F.col("_state")).when(F.coalesce(F.col("_own"), F.lit(False)), "accepted").otherwise("suggested")
    return rows.where(decided | F.col("_new").isNotNull()).select(*keys, value, F.coalesce("_new", "_old").alias("confidence"), state.alias("state"))


def upload_plan(df: DataFrame, status_col: str, has_meta_change: Column, lost: Column) -> DataFrame:
    """Adds ``action``: upload, meta_only, lost or none."""
    s = F.col(status_col)
    return df.withColumn("action", F.when(s == "skipped", "none").when(lost, "lost").when(s == "changed", F.when(has_meta_change, "meta_only").otherwise("upload")).when(s == "reviewed", "upload").otherwise("none"))


def split_at(df: DataFrame, keys: Sequence[str], pos: str, items: str, at: Column) -> DataFrame:
    """Rows whose list is cut before place ``at`` (0: not at all); the tail becomes the next row and positions run on."""
    cut_here = (at > 0) & (at < F.size(items))
    parts = F.when(cut_here, F.array(F.struct(F.lit(0).alias("part"), F.slice(items, F.lit(1), at).alias("held")), F.struct(F.lit(1).alias("part"), F.slice(items, at + 1, F.size(items)).alias("held")))).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.col(items).alias("held"))))
    rows = df.withColumn("_p", F.explode(parts))
    number = F.row_number().over(W.partitionBy(*keys).orderBy(pos, F.col("_p.part"))) - 1
    return rows.select(*keys, number.cast("long").alias(pos), F.col("_p.held").alias(items), F.col("_p.part").alias("part"))


def undo_redo(events: DataFrame, key: str, order: str, action: str, value: str, start: str = "") -> DataFrame:
    """The value of each key after edits, undos and redos in order: a new edit clears what could be redone.

    Spark deals out the rows by key and sorts them; a task walks them batch by batch and holds no more of a key than
    what can be undone and redone.
    """
    kind = dict(events.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, undo, redo, first = None, start, [], [], True
        done: list[tuple] = []
        key_type = None

        def rows() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (key_type, pa.string(), pa.int64(), pa.int64()))], [key, value, "undos", "redos"])

        for batch in batches:
            key_type = batch.column(0).type
            for k, a, v in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if first or k != held:
                    if not first:
                        done.append((held, now, len(undo), len(redo)))
                    held, now, undo, redo, first = k, start, [], [], False
                if a == "edit":
                    undo.append(now)
                    now, redo = v, []
                elif a == "undo" and undo:
                    redo.append(now)
                    now = undo.pop()
                elif a == "redo" and redo:
                    undo.append(now)
                    now = redo.pop()
            if done:
                yield rows()
        if not first:
            done.append((held, now, len(undo), len(redo)))
            yield rows()

    sorted_rows = events.repartition(F.col(key)).sortWithinPartitions(F.col(key), F.asc_nulls_last(order))
    return sorted_rows.select(key, action, F.col(value).cast("string").alias(value)).mapInArrow(run, f"{key} {kind}, {value} string, undos long, redos long")


def place_to_keep(own: Column, stored: Column, live: Column, state: Column) -> Column:
    """The place suggestion that stands: none beside an own place, a decided one as it is, else the live one, else the stored one."""
    return F.when(own.isNotNull(), F.lit(None)).when(state.isin("accepted", "dismissed"), stored).otherwise(F.coalesce(live, stored))
