"""Lenient parsing: bad values become null with an error code, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"
_OFFSET = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def instant(text, zone: str = "UTC") -> Column:
    """ISO text as an instant; a text without offset is taken in ``zone``."""
    t = F.trim(_col(text).cast("string"))
    at = F.try_to_timestamp(F.replace(t, F.lit("T"), F.lit(" ")))
    return F.when(t.rlike(_OFFSET), at).otherwise(F.to_utc_timestamp(at, zone))


def synced_at(text) -> Column:
    """An instant that must carry an offset; else null."""
    t = F.trim(_col(text))
    return F.when(t.rlike(_OFFSET), F.try_to_timestamp(F.replace(t, F.lit("T"), F.lit(" "))))


def instant_or_seconds(text, zone: str = ZONE) -> Column:
    """ISO text as an instant; else its first 19 characters as ``yyyy-MM-dd HH:mm:ss``; local time without an offset."""
    whole = instant(text, zone)
    head = F.try_to_timestamp(F.substring(F.trim(_col(text).cast("string")), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(whole, F.to_utc_timestamp(head, zone))


def epoch_local(seconds, zone: str = ZONE) -> Column:
    """ISO text with offset +08:00 of epoch seconds."""
    at = F.from_utc_timestamp(F.timestamp_seconds(_col(seconds)), zone)
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))


def source_date(text) -> Column:
    """struct(value DATE, error): ``invalid``, ``epoch_placeholder`` or null."""
    t = F.replace(F.trim(F.coalesce(_col(text).cast("string"), F.lit(""))), F.lit("/"), F.lit("-"))
    whole = F.try_to_timestamp(F.replace(t, F.lit("T"), F.lit(" ")))
    local = F.when(t.rlike(r"[0-9]:[0-9]{2}.*" + _OFFSET), F.from_utc_timestamp(whole, ZONE)).otherwise(whole)
    day = F.coalesce(
        F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.to_date(local)),
        F.when(F.substring(t, 1, 10).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.to_date(F.try_to_timestamp(F.substring(t, 1, 10))))
    )
    day = F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t.try_cast("date")).otherwise(day)  # as a rule
    error = F.when(t == "", None).when(day.isNull(), "invalid").when(F.year(day) <= 1970, "epoch_placeholder")
    return F.struct(F.when(error.isNull() & (t != ""), day).alias("value"), error.alias("error"))


def money_minor(value) -> Column:
    """struct(value BIGINT in hundredths, half up; error)."""
    t = F.trim(F.replace(F.coalesce(_col(value).cast("string"), F.lit("")), F.lit(","), F.lit("")))
    amount = t.try_cast("decimal(38,6)")
    return F.struct(F.round(amount * 100, 0).cast("bigint").alias("value"), F.when((t != "") & amount.isNull(), "invalid").alias("error"))


def refund_type(value) -> Column:
    from .lexicons import REFUND_TYPES

    t = F.trim(F.coalesce(_col(value).cast("string"), F.lit("")))
    out = F.when(t.isin("", "0", "正常", "无"), F.lit(None).cast("string"))
    for k, v in REFUND_TYPES.items():
        out = out.when(t == k, v)
    return out.otherwise("other")


def refuse_unless(cond: Column, value: Column, message: str) -> Column:
    """The value, or a failed job where the condition doesn't hold."""
    return F.when(cond, value).otherwise(F.raise_error(F.lit(message)))
