"""Order facts: normalisation with quality flags, summaries, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import parse
from ..functions import text as tx
from ..functions.keys import hmac_id


def quarantine(rows: DataFrame, *, record="record", position="position") -> DataFrame:
    """``rows`` with reject_reason: no object, no id, or an id met before in the file."""
    rid = F.trim(F.coalesce(F.col(f"{record}.record_id"), F.lit("")))
    n = F.row_number().over(
        Window.partitionBy(
            "source_file", F.when(F.col(record).isNull() | (rid == ""), F.col(position).cast("string")).otherwise(F.concat(F.lit("id:"), rid))
        ).orderBy(position)
    )
    return rows.withColumn(
        "reject_reason", F.when(F.col(record).isNull(), "not_object").when(rid == "", "missing_record_id").when(n > 1, "repeated_record_id")
    )


def normalize(rows: DataFrame, *, today: str, secret: str | None = None, namespace="orders", scrub=True) -> DataFrame:
    """Canonical order lines. ``today``: column with the local date of the snapshot.

    Paid only with a valid date that isn't in the future and revenue above zero; what one side
    alone gives is flagged. Future refund dates are flagged and stay.
    """
    made = {
        "paid": parse.source_date("pay_date"), "rev": parse.money_minor("revenue"), "rdate": parse.source_date("refund_date"),
        "rmoney": parse.money_minor("refund_amount")
    }
    # an explode of one element keeps the parsed values from being written out again in each flag
    parsed = F.explode(F.array(F.struct(*(c.alias(k) for k, c in made.items()))))
    rows = rows.withColumn("__parsed", parsed).select(
        *(F.col(f"`{c}`") for c in rows.columns), "__parsed.*"
    ).withColumn("rtype", parse.refund_type("refund_type"))
    day = F.col(today)
    future = F.col("paid.value") > day
    p_ok, r_pos = F.col("paid.value").isNotNull() & ~F.coalesce(future, F.lit(False)), F.coalesce(F.col("rev.value") > 0, F.lit(False))
    valid = p_ok & r_pos
    bad_refund = F.col("rmoney.error").isNotNull() | F.coalesce(F.col("rmoney.value") < 0, F.lit(False))
    rows = rows.withColumns(
        {
            "paid_on": F.when(valid, F.col("paid.value")), "revenue_minor": F.when(valid, F.col("rev.value")),
            "refund_minor": F.when(~bad_refund, F.col("rmoney.value"))
        }
    )
    returns = F.col("rtype").isin("return", "return_taro")
    status = F.nullif(F.trim(F.coalesce("return_status", F.lit(""))), F.lit(""))
    yes = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name)
    flags = F.array_sort(F.array_compact(F.array(
        yes(F.col("paid.error").isNotNull(), "invalid_paid_on"), yes(F.col("rev.error").isNotNull(), "invalid_revenue"),
        yes(future, "future_paid_on"),
        yes(~valid & (p_ok | r_pos), "incomplete_customer_payment"), yes(F.col("rdate.error").isNotNull(), "invalid_refund_on"),
        yes(bad_refund, "invalid_refund_amount"),
        yes(F.col("rdate.value") > day, "future_refund_on"), yes(returns & F.col("rdate.value").isNull(), "missing_refund_on"),
        yes(returns & F.col("refund_minor").isNull(), "missing_refund_amount"),
        yes(F.col("refund_minor") > F.col("revenue_minor"), "refund_exceeds_revenue"), yes(F.lower(status).isin(*lx.OPEN_RETURN), "aftersale_open"),
    )))
    cols = [
        F.col("record_id"), F.col("paid_on"), F.col("revenue_minor"), F.col("rtype").alias("refund_type"),
        F.col("refund_minor").alias("refund_amount_minor"), F.col("rdate.value").alias("refund_on"), status.alias("return_status"),
        flags.alias("quality_flags")
    ]
    if secret:
        cols += [
            hmac_id(secret, "order-line", F.lit(namespace), "record_id").alias("order_line_id"),
            F.when(tx.normalize_phone("phone").isNotNull(), hmac_id(secret, "phone", tx.normalize_phone("phone"))).alias("phone_hmac")
        ]
    if scrub and "refund_reason" in rows.columns:
        rows = rows.withColumn("__reason", _scrubbed(rows))
        rows = tx.with_redaction(rows, "__reason", "__red")
        cols.append(F.when(F.trim(F.coalesce("refund_reason", F.lit(""))) != "", F.col("__red.text")).alias("refund_reason"))
    return rows.select(*cols)


def _scrubbed(rows: DataFrame):
    out = F.trim("refund_reason")
    # What a row's own identifiers become in its reason.
    for field, label in (("customer_name", "[客户姓名]"), ("address", "[地址]"), ("phone", "[手机号]"), ("tracking_no", "[单号]"), ("customer_info", "[客户信息]")):
        if field in rows.columns:
            own = F.trim(F.coalesce(field, F.lit("")))
            out = F.when(F.length(own) >= 2, F.replace(out, own, F.lit(label))).otherwise(out)
    return out


def quality_summary(lines: DataFrame) -> DataFrame:
    """(kind, name, rows): flags, refund types and totals in long form."""
    entry = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    flags = F.transform("quality_flags", lambda f: entry("flag", f))
    own = F.array_compact(F.array(
        F.when(F.col("refund_type").isNotNull(), entry("refund_type", F.col("refund_type"))), entry("total", F.lit("lines")),
        F.when(F.col("paid_on").isNotNull(), entry("total", F.lit("paid"))),
        F.when(F.col("refund_on").isNotNull(), entry("total", F.lit("refunded"))),
    ))
    # one pass: a line's few entries are counted within its task before anything is shuffled
    each = lines.select(F.explode(F.concat(own, flags)).alias("e")).select("e.*")
    return each.groupBy("kind", "name").agg(F.count("*").alias("rows"))


def import_summary(lines: DataFrame, *, source: int, quarantined: int, envelope: int | None) -> DataFrame:
    """:func:`quality_summary` of an import, with lines without a refund type, lines with a phone, and the counts of its envelope.

    The envelope's own total, if it names one, is ``envelope_total``; ``envelope_total_matches`` is 1 if it is that of the records, else 0.
    """
    told = [("total", "source_records", source), ("total", "quarantined_records", quarantined), ("total", "envelope_total_matches", int(envelope == source))]
    if envelope is not None:
        told.append(("total", "envelope_total", envelope))
    one = lines.agg(F.count("phone_hmac").alias("p"), F.count_if(F.col("refund_type").isNull()).alias("n"))
    entry = lambda kind, name, n: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), F.col(n).alias("rows"))
    more = one.select(F.inline(F.array(entry("total", "phone_hmac", "p"), entry("refund_type", "none", "n")))).filter("rows > 0")
    return quality_summary(lines).unionByName(more).unionByName(lines.sparkSession.createDataFrame(told, "kind string, name string, rows long"))


def snapshot_id(secret: str, namespace: str, source_hash: str, synced_at: str, rule_version: str):
    """Same input and rules: same id, so that activating again changes nothing."""
    return hmac_id(secret, "snapshot", F.lit(namespace), F.lit(source_hash), F.lit(synced_at), F.lit(rule_version))


def balanced(accepted: int, rejected: int, source: int) -> None:
    if accepted + rejected != source:
        raise ValueError(f"{accepted} accepted and {rejected} rejected of {source} rows")
