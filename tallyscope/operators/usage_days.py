"""Usage features for any day from one table of days, instead of from all events again.

The windows of the usage features begin at midnight, so a day is the finest step that they tell apart.
The table of days has a row per account, day and word: the day's events, session minutes and newest
event, and as 64 bits which users were active. Sums add up and bits are joined by OR, so features on
another day, or with more days, are exact without the events.

Users are numbered once, in the order of account and user, so an account's users share as few words as
hold them and a hot account's bits spread over many rows. Words of 64 bits are used rather than Spark's
bitmaps of 4 KB, which would cost an account of thirty users four kilobytes a day.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.numbers import average_of, days_from
from tallyscope.sources.readers import write_between_stages

WORD_BITS = 64


def _known_users(events: DataFrame) -> DataFrame:
    return events.where(F.col("user_id").isNotNull()).select("account_id", "user_id").distinct()


def _numbered(pairs: DataFrame, first: int = 0) -> DataFrame:
    """account_id, user_id and user_number: from ``first`` up, close together within an account."""
    order = ("account_id", "user_id")
    ranged = pairs.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select(*order, (F.monotonically_increasing_id() + first).alias("user_number"))


def _same_user(left: DataFrame, right: DataFrame):
    return left["account_id"].eqNullSafe(right["account_id"]) & (left["user_id"] == right["user_id"])


def _days(events: DataFrame, users: DataFrame) -> DataFrame:
    """account_id, day, word, users, events, cents, sessions, last_event."""
    by_user = events.groupBy(
        "account_id", "user_id", F.col("event_timestamp").cast("date").alias("day")
    ).agg(
        F.count(F.lit(1)).alias("events"),
        F.sum((F.col("session_duration_minutes") * 100).cast("bigint")).alias("cents"),
        F.count("session_duration_minutes").alias("sessions"),
        F.max("event_timestamp").alias("last_event"),
    )
    numbered = by_user.join(users, _same_user(by_user, users), "left").select(
        by_user["account_id"],
        "day",
        F.expr(f"user_number DIV {WORD_BITS}").alias("word"),
        F.expr(f"shiftleft(1L, CAST(user_number % {WORD_BITS} AS INT))").alias("bit"),
        "events",
        "cents",
        "sessions",
        "last_event",
    )
    return numbered.groupBy("account_id", "day", "word").agg(
        F.coalesce(F.bit_or("bit"), F.lit(0).cast("bigint")).alias("users"),
        F.sum("events").alias("events"),
        F.coalesce(F.sum("cents"), F.lit(0).cast("bigint")).alias("cents"),
        F.sum("sessions").alias("sessions"),
        F.max("last_event").alias("last_event"),
    )


def _features(events: DataFrame) -> DataFrame:
    return events.where(F.col("feature_name").isNotNull()).select("account_id", "feature_name").distinct()


@dataclass(frozen=True)
class UsageDays:
    """The table of days, the numbers of the users, and the features that each account has used.

    Numbers come from the order in which Spark deals out the users: ``of`` is for a single job, ``stored``
    writes the tables to the shared checkpoint folder for many.
    """

    days: DataFrame
    users: DataFrame
    features: DataFrame

    @classmethod
    def of(cls, events: DataFrame) -> UsageDays:
        users = _numbered(_known_users(events))
        return cls(_days(events, users), users, _features(events))

    @classmethod
    def stored(cls, events: DataFrame) -> UsageDays:
        """``of``, with users numbered in a written table first, and all tables written."""
        users = write_between_stages(_numbered(_known_users(events)), "usage-users")
        return cls(
            write_between_stages(_days(events, users), "usage-days"),
            users,
            write_between_stages(_features(events), "usage-features"),
        )

    def with_more(self, events: DataFrame) -> UsageDays:
        """With the events of a later load, of which only this load is read; old rows stay as they are.

        New users are numbered from the next free word. An event must be in one load only.
        """
        largest = self.users.agg(F.max("user_number")).first()[0]
        first = 0 if largest is None else (largest // WORD_BITS + 1) * WORD_BITS
        pairs = _known_users(events)
        fresh = pairs.join(self.users, _same_user(pairs, self.users), "left_anti")
        fresh = write_between_stages(_numbered(fresh, first), "usage-users")
        users = self.users.unionByName(fresh)
        days = write_between_stages(_days(events, users), "usage-days")
        features = write_between_stages(_features(events), "usage-features")
        return UsageDays(
            self.days.unionByName(days), users, self.features.unionByName(features).distinct()
        )

    def usage_features(self, as_of: date) -> DataFrame:
        """The rows of ``features.usage_features`` on ``as_of``."""
        return self.usage_features_over([as_of]).drop("as_of")

    def usage_features_over(self, dates: Sequence[date]) -> DataFrame:
        """The usage features of each account on each of ``dates``, with the date as ``as_of``.

        First by word, which spreads a hot account; then by account, over words and feature counts.
        """
        asked = F.explode(F.array(*[F.lit(d) for d in dates])).alias("as_of")
        week, month = (F.col("day") >= F.date_sub("as_of", n) for n in (7, 30))
        words = (
            self.days.select(asked, "*")
            .groupBy("as_of", "account_id", "word")
            .agg(
                F.bit_count(F.bit_or("users")).cast("bigint").alias("users"),
                F.bit_count(F.bit_or(F.when(month, F.col("users")))).cast("bigint").alias("users_30"),
                F.sum("events").alias("events"),
                F.sum(F.when(month, F.col("events"))).alias("events_30"),
                F.sum(F.when(week, F.col("events"))).alias("events_7"),
                F.sum("cents").alias("cents"),
                F.sum("sessions").alias("sessions"),
                F.max("last_event").alias("last_event"),
            )
        )
        used = self.features.groupBy("account_id").agg(F.count(F.lit(1)).alias("features"))
        together = words.unionByName(used.select(asked, "*"), allowMissingColumns=True)

        def total(name: str):
            return F.coalesce(F.sum(name), F.lit(0).cast("bigint"))

        last = F.max("last_event")
        minutes = F.sum("cents").cast("decimal(22,0)") * F.lit("0.01").cast("decimal(2,2)")
        return together.groupBy("as_of", "account_id").agg(
            total("events").alias("total_usage_events"),
            total("events_30").alias("usage_events_last_30_days"),
            total("events_7").alias("usage_events_last_7_days"),
            total("users").alias("active_users_total"),
            total("users_30").alias("active_users_last_30_days"),
            total("features").alias("distinct_features_used"),
            average_of(minutes, F.sum("sessions")).cast("decimal(10,2)").alias("avg_session_duration_minutes"),
            last.alias("last_product_event_at"),
            days_from(last.cast("date"), F.col("as_of")).alias("days_since_last_product_event"),
        )
