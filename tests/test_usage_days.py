"""Usage features from the table of days against those from all events."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from conftest import AS_OF, table

from tallyscope.operators.features import usage_features
from tallyscope.operators.usage_days import WORD_BITS, UsageDays

DATES = [AS_OF, AS_OF - timedelta(days=13), date(2023, 6, 1), AS_OF + timedelta(days=40)]


def some_events(spark, seed: int, count: int):
    """A third of the events on one account of many users; missing cells of every kind."""
    draw = random.Random(seed)
    rows = []
    for n in range(count):
        account = draw.choice(["hot", *(f"a{i}" for i in range(12)), None] if n % 3 else ["hot"])
        stamp = datetime(AS_OF.year, AS_OF.month, AS_OF.day) - timedelta(seconds=draw.randrange(-86_400 * 5, 86_400 * 90))
        rows.append(
            dict(
                event_id=f"{seed}-{n}",
                account_id=account,
                user_id=None if draw.random() < 0.05 else f"u{draw.randrange(900 if account == 'hot' else 7)}",
                feature_name=None if draw.random() < 0.1 else f"f{draw.randrange(5)}",
                session_duration_minutes=None if draw.random() < 0.1 else Decimal(draw.randrange(9000)) / 100,
                event_timestamp=None if draw.random() < 0.03 else stamp.replace(hour=0, minute=0, second=0) if draw.random() < 0.1 else stamp,
            )
        )
    return table(spark, "product_usage_events", *rows)


def rows(df) -> Counter:
    return Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())


@pytest.fixture(scope="module")
def checkpoints(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def test_any_date_from_one_written_table(spark, checkpoints):
    events = some_events(spark, 1, 4000)
    days = UsageDays.stored(events)
    for as_of in DATES:
        assert rows(days.usage_features(as_of)) == rows(usage_features(events, as_of)), as_of
    over = days.usage_features_over(DATES)
    for as_of in DATES:
        assert rows(over.where(over["as_of"] == as_of).drop("as_of")) == rows(usage_features(events, as_of))
    assert rows(UsageDays.of(events).usage_features(AS_OF)) == rows(usage_features(events, AS_OF))


def test_later_loads_are_added_without_the_earlier_events(spark, checkpoints):
    loads = [some_events(spark, seed, 900) for seed in (2, 3, 4)]
    days = UsageDays.stored(loads[0])
    everything = loads[0]
    for load in loads[1:]:
        days, everything = days.with_more(load), everything.unionByName(load)
        assert rows(days.usage_features(AS_OF)) == rows(usage_features(everything, AS_OF))
    numbers = [r.user_number for r in days.users.collect()]
    pairs = days.users.select("account_id", "user_id").distinct().count()
    assert len(numbers) == len(set(numbers)) == pairs


def test_users_of_an_account_share_words(spark, checkpoints):
    days = UsageDays.stored(some_events(spark, 5, 3000))
    words = {r.account_id: r["count"] for r in days.days.where("word IS NOT NULL").select("account_id", "word").distinct().groupBy("account_id").count().collect()}
    users = {r.account_id: r["count"] for r in days.users.groupBy("account_id").count().collect()}
    partitions = 8  # an account may begin and end in the middle of a word, and cross partitions
    assert all(words[a] <= users[a] // WORD_BITS + 1 + partitions for a in users)
    assert words["hot"] >= users["hot"] / WORD_BITS


def test_no_events(spark, checkpoints):
    empty = table(spark, "product_usage_events")
    days = UsageDays.stored(empty)
    assert days.usage_features(AS_OF).count() == 0
    more = days.with_more(some_events(spark, 6, 50))
    assert rows(more.usage_features(AS_OF)) == rows(usage_features(some_events(spark, 6, 50), AS_OF))
