"""Values as known at event time, on small tables and against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators.asof import as_known_at

EVENTS = "id long, firm string, day date, value string"
VERSIONS = "version_id long, firm string, eff date, rec timestamp, value string"


def run(spark, events, versions, **options):
    out = as_known_at(
        spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS), entity=F.col("firm"), event_time=F.col("day"), version_entity=F.col("firm"),
        effective=F.col("eff"), recorded=F.col("rec"), version_id="version_id", take={"value": "value", "version_id": "version_id"}, **options,
    )
    return sorted((r["id"], r["version_id"], r["value"]) for r in out.collect())


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


def moment(n, seconds=0):
    return dt.datetime(2020, 1, 1) + dt.timedelta(n, seconds)


def brute(events, versions):
    out = []
    for i, firm, at, _ in events:
        usable = [v for v in versions if firm and at and v[1] == firm and v[2] and v[3] and v[2] < at and v[3] < dt.datetime.combine(at, dt.time())]
        best = max(usable, key=lambda v: (v[2], v[3], v[0]), default=None)
        out.append((i, best and best[0], best and best[4]))
    return sorted(out, key=lambda r: r[0])


@pytest.mark.parametrize("bucket", [200_000, 5])
def test_against_brute_force(spark, bucket):
    rng = random.Random(3)
    firms = ["a", "a", "a", "b", "c", None]
    events = [(i, rng.choice(firms), rng.choice([None, *map(day, range(30))]), "last") for i in range(200)]
    versions = [(i, rng.choice(firms), rng.choice([None, *map(day, range(30))]), rng.choice([None, moment(rng.randrange(30)), moment(rng.randrange(30), 5)]), f"v{i}") for i in range(120)]
    assert run(spark, events, versions, bucket_events=bucket) == brute(events, versions)


def test_never_later_knowledge(spark):
    versions = [(1, "a", day(0), moment(0, 1), "x"), (2, "a", day(5), moment(9), "late"), (3, "a", day(5), moment(20), "correction")]
    events = [(1, "a", day(9), "l"), (2, "a", day(10), "l"), (3, "a", day(21), "l"), (4, "a", day(0), "l")]
    assert run(spark, events, versions) == [(1, 1, "x"), (2, 2, "late"), (3, 3, "correction"), (4, None, None)]


def test_late_news_about_the_past_does_not_replace(spark):
    versions = [(1, "a", day(5), moment(5), "new"), (2, "a", day(1), moment(8), "old")]
    assert run(spark, [(1, "a", day(9), "l")], versions) == [(1, 1, "new")]


def test_empty_tables_and_repeats(spark):
    assert run(spark, [], [(1, "a", day(1), moment(1), "x")]) == []
    assert run(spark, [(1, "a", day(3), "l"), (1, "a", day(3), "l")], []) == [(1, None, None)] * 2
    equal = [(1, "a", day(1), moment(1), "x")] * 3
    assert run(spark, [(1, "a", day(3), "l")], equal) == [(1, 1, "x")]


def test_extra_columns_stay(spark):
    events = spark.createDataFrame([(1, "a", day(3), "old", 7)], "id long, firm string, day date, value string, eff int")
    versions = spark.createDataFrame([(1, "a", day(1), moment(1), "x")], VERSIONS)
    out = as_known_at(events, versions, entity=F.col("firm"), event_time=F.col("day"), version_entity=F.col("firm"), effective=F.col("eff"), recorded=F.col("rec"), version_id="version_id", take={"value": "value"})
    assert out.columns == ["id", "firm", "day", "eff", "value"]
    assert out.first() == (1, "a", day(3), 7, "x")
