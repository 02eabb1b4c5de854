"""Attributes as they were known at the time of an event.

A version applies from its effective time on and is known from its recorded time on, so it may be used for an event once
both lie before the event. Of the usable versions the current one has the latest effective time, then the latest recorded
time, then the largest id: corrections that became known late replace what was current, late news about the past don't.

Versions are reduced, per entity and day of availability, to the best one (combined before the shuffle, so a hot entity has
at most one row per calendar day), and events and versions are hash-partitioned by entity. In each bucket an embedded
DuckDB turns them into current-state versions, the running best in order of availability, and runs one ASOF LEFT JOIN.
The events of a hot entity are spread over several buckets; its day versions, bounded by the calendar, go to each of them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.session import buckets_for

#: Events that one bucket should hold.
BUCKET_EVENTS = 200_000

_SQL = """
WITH state AS (
    SELECT ent, avail, arg_max(cur, avail_no) AS cur
    FROM (
        SELECT ent, avail, avail_no,
               max({'e': eff, 'r': rec, 'v': ver, 'n': num}) OVER (PARTITION BY ent ORDER BY avail, avail_no ROWS UNBOUNDED PRECEDING) AS cur
        FROM (SELECT *, row_number() OVER (PARTITION BY ent, avail ORDER BY eff, rec, ver, num) AS avail_no FROM versions)
    )
    GROUP BY ent, avail
)
SELECT events.num AS event_no, state.cur.n AS version_no
FROM events ASOF LEFT JOIN state ON events.ent = state.ent AND events.at >= state.avail
"""


def _day(c: Column) -> Column:
    return F.unix_date(c.cast("date"))


def as_known_at(
    events: DataFrame,
    versions: DataFrame,
    *,
    entity: Column,
    event_time: Column,
    version_entity: Column,
    effective: Column,
    recorded: Column,
    version_id: str,
    take: dict[str, str],
    bucket_events: int = BUCKET_EVENTS,
) -> DataFrame:
    """Every row of events with the columns of take (result name -> versions' column) from the version current at its day.

    entity and event_time are expressions over events, the others over versions. The version must be effective on a day
    before the event's and recorded before 00:00 of it. Defined cases: a null entity or event time, or no usable version,
    leaves the taken columns null and keeps the row; versions with a null entity, effective or recorded time never apply;
    repeated events stay repeated; of wholly equal versions any is taken, they don't differ; extra columns pass through,
    and a taken name that events already have replaces that column; empty tables give an empty result or nulls.
    """
    spark = events.sparkSession
    own = [c for c in events.columns if c not in take]
    kinds = {name: versions.schema[column].dataType for name, column in take.items()}
    n = buckets_for(spark, events.count(), bucket_events)

    left = events.select(entity.alias("__ent"), _day(event_time).alias("__at"), F.struct(*own).alias("__row"))
    # Entities with more events than a bucket should hold get several buckets; there are at most rows / bucket_events.
    hot = left.filter("__ent is not null").groupBy("__ent").count().filter(F.col("count") > bucket_events).select("__ent", F.least(F.lit(n), F.ceil(F.col("count") / bucket_events)).cast("int").alias("__parts"))
    hot = F.broadcast(hot)
    left = left.join(hot, "__ent", "left")
    salt = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("__row"), F.col("__parts")).cast("int"))
    left = left.select("__ent", "__at", "__row", F.pmod(F.hash(F.coalesce(F.col("__ent"), F.xxhash64("__row").cast("string")), salt), F.lit(n)).alias("__bucket"))

    state = F.struct(effective.cast("timestamp_ntz").alias("eff"), recorded.cast("timestamp_ntz").alias("rec"), F.col(version_id).alias("ver"), F.struct(*(F.col(c).alias(k) for k, c in take.items())).alias("val"))
    right = versions.select(version_entity.alias("__ent"), F.greatest(_day(effective), _day(recorded)).alias("__day"), state.alias("__state"), effective.isNotNull().alias("__a"), recorded.isNotNull().alias("__b"))
    right = right.filter("__ent is not null and __a and __b").groupBy("__ent", (F.col("__day") + 1).alias("__avail")).agg(F.max("__state").alias("__state"))
    spread = right.join(hot, "__ent", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1)))
    right = spread.select("__ent", "__avail", "__state", F.pmod(F.hash("__ent", "__salt"), F.lit(n)).alias("__bucket"))

    row_type = left.schema["__row"].dataType
    out = T.StructType([T.StructField("__row", row_type), T.StructField("__val", T.StructType([T.StructField(k, t) for k, t in kinds.items()]))])

    def join(events_in: pa.Table, versions_in: pa.Table) -> pa.Table:
        import duckdb

        rows = events_in.column("__row")
        state = versions_in.column("__state").combine_chunks()
        if isinstance(state, pa.ChunkedArray):
            state = state.chunk(0) if state.num_chunks else pa.array([], state.type)
        eff, rec, ver, val = state.flatten()
        value_type = val.type
        if not events_in.num_rows or not versions_in.num_rows:
            return pa.table({"__row": rows, "__val": pa.nulls(events_in.num_rows, value_type)})
        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
        try:
            con.register("events", pa.table({"ent": events_in.column("__ent"), "at": events_in.column("__at"), "num": pa.array(range(events_in.num_rows), pa.int64())}))
            con.register("versions", pa.table({"ent": versions_in.column("__ent"), "avail": versions_in.column("__avail"), "eff": eff, "rec": rec, "ver": ver, "num": pa.array(range(len(eff)), pa.int64())}))
            found = con.sql(_SQL).to_arrow_table()
        finally:
            con.close()
        rows = rows.take(found.column("event_no").combine_chunks())
        return pa.table({"__row": rows, "__val": val.take(found.column("version_no").combine_chunks())})

    joined = left.groupBy("__bucket").cogroup(right.groupBy("__bucket")).applyInArrow(join, out)
    return joined.select("__row.*", "__val.*")
