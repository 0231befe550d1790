"""Small business rules: priorities, retries, scores, cursors, discounts, windows."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwatch import constants as K


def instant(as_of: dt.datetime | dt.date | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp")


def day(as_of: dt.datetime | dt.date | str) -> Column:
    return F.lit(str(as_of)[:10]).cast("date")


def since(column: Column, days: int, as_of) -> Column:
    """Trailing window on a date column: the day itself and everything after it count."""
    return column >= F.date_sub(day(as_of), days)


def since_interval(column: Column, as_of, **parts: int) -> Column:
    """Strict trailing window on a timestamp column."""
    span = F.make_dt_interval(
        F.lit(parts.get("days", 0)), F.lit(parts.get("hours", 0)), F.lit(parts.get("minutes", 0))
    )
    return column > instant(as_of) - span


def changed(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def revisit_days(priority: Column) -> Column:
    chain = None
    for level, days in K.REVISIT_DAYS.items():
        chain = F.when(priority == level, days) if chain is None else chain.when(priority == level, days)
    return chain.otherwise(K.REVISIT_DAYS_OTHER)


def crawl_priority(first_seen: Column, new_count: Column, old_count: Column, as_of) -> Column:
    return (
        F.when(since_interval(first_seen, as_of, days=K.NEW_STORE_DAYS), 1)
        .when(new_count > old_count, 1)
        .when(new_count == 0, 5)
        .otherwise(3)
    )


def retry_status(attempts: Column) -> Column:
    return F.when(attempts + 1 >= K.MAX_ATTEMPTS, K.STATUS_ERROR).otherwise(K.STATUS_PENDING)


def active_after_fail(fail_count: Column) -> Column:
    return fail_count + 1 < K.MAX_ATTEMPTS


def feed_score(first_seen: Column, store_count: Column) -> Column:
    """Epoch seconds (rounded) plus two days for every store listing the product."""
    micros = F.unix_micros(first_seen)
    seconds = F.floor((micros + 500000) / 1000000)
    return (seconds + F.coalesce(store_count, F.lit(0)) * K.SECONDS_PER_EXTRA_STORE).cast("long")


def encode_cursor(score: Column, row_id: Column) -> Column:
    text = F.concat_ws(":", score.cast("string"), row_id.cast("string"))
    return F.rtrim(F.translate(F.base64(text.cast("binary")), "+/", "-_"), F.lit("="))


def decode_cursor(cursor: Column) -> Column:
    """(score, id) of a cursor, NULL when it does not parse."""
    standard = F.translate(cursor, "-_", "+/")
    padded = F.rpad(standard, F.ceil(F.length(standard) / 4).cast("int") * 4, "=")
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    score = F.get(F.split(text, ":"), F.lit(0)).try_cast("long")
    row_id = F.get(F.split(text, ":"), F.lit(1)).try_cast("long")
    return F.when(score.isNotNull() & row_id.isNotNull(), F.struct(score.alias("score"), row_id.alias("id")))


def discount_percent(price: Column, compare_at: Column) -> Column:
    share = (compare_at - price) / compare_at * 100
    return F.when((compare_at > price) & (compare_at > 0), F.floor(share + 0.5).cast("int"))
