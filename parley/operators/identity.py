"""Entity resolution: shared identifiers, binding lists and the evidence ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import text as tx
from ..functions.keys import hmac_id, phone_hmac
from ..sources.readers import ladder

APPROVE_FROM = "0.95"


def identifier_states(rows: DataFrame, *, key: str, ids: str) -> DataFrame:
    """(key, identifier, state) from an array of identifiers per row.

    missing: the key has none. ambiguous_shared: another key has it too. candidate_unique:
    the key's only one. review: one of several.
    """
    pairs = rows.select(F.col(key), F.explode(ids).alias("identifier")).distinct()
    by_id = pairs.groupBy("identifier").agg(F.count("*").alias("keys"))
    by_key = pairs.groupBy(key).agg(F.count("*").alias("own"))
    state = F.when(F.col("keys") > 1, "ambiguous_shared").when(F.col("own") == 1, "candidate_unique").otherwise("review")
    found = pairs.join(by_id, "identifier").join(by_key, key).select(key, "identifier", state.alias("state"))
    none = rows.select(key).distinct().join(by_key.select(key), key, "left_anti")
    return found.unionByName(none.select(key, F.lit(None).cast("string").alias("identifier"), F.lit("missing").alias("state")))


def classify_eligibility(name):
    """order_customer before album_customer before order_ineligible."""
    c = F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))
    return F.when(F.contains(c, F.lit("下单客户")), "order_customer").when(F.contains(c, F.lit("相册客户")), "album_customer").otherwise("order_ineligible")


def binding_rows(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of a binding list with reject_reason; registry: (alias, account_id)."""
    conf = F.col("confidence").try_cast("decimal(5,4)")
    rows = rows.join(F.broadcast(registry), F.col("account") == F.col("alias"), "left").withColumns(
        {"conf": conf, "id": tx.raw_identifier("raw_id"), "mobile": tx.normalize_phone("phone")}
    )
    reason = ladder(
        ("unknown_accounts", F.col("account_id").isNull()), ("missing_raw_id", F.col("raw_id") == ""), ("invalid_raw_id", F.col("id").isNull()),
        ("invalid_phones", F.col("mobile").isNull()), ("invalid_confidence", F.col("conf").isNull() | (F.col("conf") < 0) | (F.col("conf") > 1)),
    )
    return rows.withColumn("reject_reason", reason)


def binding_links(rows: DataFrame, secret: str) -> DataFrame:
    """One row per account and contact: several phones conflict; else the least confidence decides."""
    ok = rows.filter("reject_reason is null")
    g = ok.groupBy("account_id", "id").agg(F.array_sort(F.collect_set("mobile")).alias("phones"), F.min("conf").alias("confidence"))
    state = F.when(F.size("phones") > 1, "conflict").when(
        F.col("confidence") >= F.lit(APPROVE_FROM).cast("decimal(5,4)"), "approved"
    ).otherwise("review")
    one = F.when(F.size("phones") == 1, phone_hmac(secret, F.get("phones", F.lit(0))))
    return g.select("account_id", raw_hash(secret).alias("raw_hash"), one.alias("phone_hmac"), "confidence", state.alias("state"))


def raw_hash(secret: str, account="account_id", raw_id="id"):
    """What identifies a contact of an account without naming it."""
    return hmac_id(secret, "raw-wechat-id", account, raw_id)


def confidence_histogram(rows: DataFrame) -> DataFrame:
    """(confidence, rows) as written, before anything is rejected."""
    written = F.trim(F.coalesce("confidence", F.lit("")))
    return rows.groupBy(F.when(written == "", "missing").otherwise(written).alias("confidence")).agg(F.count("*").alias("rows"))


def registry(accounts: DataFrame) -> DataFrame:
    """(alias, account_id) of approved accounts; fails if an alias repeats or names no account."""
    rows = accounts.filter("state = 'approved'").select(
        F.trim("binding_account_alias").alias("alias"), F.trim("account_id").alias("account_id")
    ).filter("alias <> ''")
    each = rows.groupBy("alias").agg(F.count("*").alias("n"), F.min("account_id").alias("account_id"))
    fine = (F.col("n") == 1) & (F.coalesce("account_id", F.lit("")) != "")
    return each.select(
        "alias", parse.refuse_unless(fine, F.col("account_id"), "binding aliases must be unique and name an account").alias("account_id")
    )


def import_bindings(
    candidates: DataFrame, refs: DataFrame, old: DataFrame, secret: str, source_hash: str, *, version: str = "binding-v1"
) -> tuple[DataFrame, DataFrame]:
    """Links of the candidates that a conversation has, and (matched, unmatched) counts.

    refs: (customer_key, profile_id, account_id, raw_hash). A human's decision among the old
    links stays if contact, phone and source file are what they were.
    """
    met = candidates.join(refs, ["account_id", "raw_hash"], "left")
    counts = met.agg(F.count_if(F.col("customer_key").isNotNull()).alias("matched"), F.count_if(F.col("customer_key").isNull()).alias("unmatched"))
    links = met.filter("customer_key is not null").select(
        hmac_id(secret, "conversation-link", "customer_key", F.lit(version)).alias("link_id"), "customer_key", "profile_id", "raw_hash", "phone_hmac",
        F.lit("account_raw_exact").alias("match_method"), "confidence", "state", F.lit(source_hash).alias("source_hash"),
        F.lit(version).alias("version"),
    )
    reviewed = old.filter(F.col("reviewed_at").isNotNull() & (F.col("version") == version))
    guards = [F.col(f"n.{g}").eqNullSafe(F.col(f"o.{g}")) for g in ("raw_hash", "phone_hmac", "source_hash")]
    kept = links.alias("n").join(reviewed.alias("o"), (F.col("n.link_id") == F.col("o.link_id")) & guards[0] & guards[1] & guards[2], "left")
    state = F.coalesce("o.state", "n.state").alias("state")
    return kept.select(*(state if c == "state" else F.col(f"n.{c}") for c in links.columns), F.col("o.reviewed_at").alias("reviewed_at")), counts


def evidence_rows(analysed: DataFrame, secret: str, *, key="customer_key") -> DataFrame:
    """(evidence_key, key, kind, message_keys) of each reason that names messages."""
    each = analysed.select(key, F.explode("reasons").alias("r")).filter(F.size("r.evidence") > 0)
    name = hmac_id(secret, "evidence", key, "r.code", F.array_join("r.evidence", ","))
    return each.select(name.alias("evidence_key"), key, F.col("r.code").alias("kind"), F.col("r.evidence").alias("message_keys"))


def keep_reviews(
    fresh: DataFrame, old: DataFrame, *, key="link_id", guards=("raw_hash", "phone_hmac", "source_hash"), state="state",
    human=("approved_human", "rejected")
) -> DataFrame:
    """Fresh rows; a human's state stays if all guards are as they were."""
    o = old.filter(F.col(state).isin(*human)).select(F.col(key).alias("__k"), F.col(state).alias("__s"), *(F.col(g).alias(f"__{g}") for g in guards))
    same = F.lit(True)
    for g in guards:
        same &= F.col(g).eqNullSafe(F.col(f"__{g}"))
    return fresh.join(o, F.col(key) == F.col("__k"), "left").withColumn(
        state, F.when(F.col("__k").isNotNull() & same, F.col("__s")).otherwise(F.col(state))
    ).select(*fresh.columns)


def tracking_phones(orders: DataFrame) -> DataFrame:
    """(tracking, phones) of order lines with (phone, tracking_no)."""
    rows = orders.select(
        tx.normalize_tracking("tracking_no").alias("tracking"), tx.normalize_phone("phone").alias("phone")
    ).filter("tracking is not null and phone is not null")
    return rows.groupBy("tracking").agg(F.array_sort(F.collect_set("phone")).alias("phones"))


def evidence_ladder(conversations: DataFrame, orders: DataFrame) -> DataFrame:
    """State of each conversation (key, direct, trackings) from phones and tracking numbers.

    direct: phones the customer wrote; trackings likewise, of which those of orders count.
    Several phones conflict; so does one that leads elsewhere than the trackings do, whether
    an order has it or not. Columns: key, state, rule, phone, confidence; rule is null where
    nothing links.
    """
    both = orders.select(
        tx.normalize_phone("phone").alias("phone"), tx.normalize_tracking("tracking_no").alias("tracking")
    ).filter("phone is not null").distinct()
    phones = both.select(F.col("phone").alias("p")).distinct()
    hit = conversations.select("key", F.explode("direct").alias("p")).join(phones, "p").groupBy("key").agg(
        F.array_sort(F.collect_set("p")).alias("known")
    )
    by = both.filter("tracking is not null").groupBy("tracking").agg(F.array_sort(F.collect_set("phone")).alias("phones"))
    track = conversations.select("key", F.explode("trackings").alias("tracking")).join(by, "tracking")
    track = track.groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("phones")))).alias("via"), F.max(F.size("phones") != 1).alias("ambiguous")
    )
    empty = F.array().cast("array<string>")
    rows = conversations.join(hit, "key", "left").join(track, "key", "left").select(
        "key", F.array_sort(F.array_distinct("direct")).alias("direct"), F.coalesce("known", empty).alias("known"),
        F.coalesce("via", empty).alias("via"),
        F.coalesce("ambiguous", F.lit(False)).alias("amb"),
    )
    n, known, m = F.size("direct"), F.size("known"), F.size("via")
    elsewhere = (m > 0) & (F.col("via") != F.col("direct"))
    rule = (
        F.when(n > 1, "customer_phone_order_conflict").when((known == 1) & (F.col("amb") | elsewhere), "customer_evidence_conflict")
        .when(known == 1, "customer_phone_order_exact").when((n > 0) & elsewhere, "customer_evidence_conflict")
        .when((n == 0) & ~F.col("amb") & (m == 1), "customer_tracking_order_exact").when(F.col("amb") | (m > 1), "customer_tracking_order_conflict")
    )
    rows = rows.withColumn("rule", rule)
    fine = F.col("rule").endswith("_exact")
    return rows.select(
        "key", F.when(fine, "approved").when(F.col("rule").isNotNull(), "conflict").alias("state"), "rule",
        F.when(fine, F.coalesce(F.get("known", F.lit(0)), F.get("via", F.lit(0)))).alias("phone"),
        F.when(F.col("rule") == "customer_phone_order_exact", F.lit("1.00")).when(
            F.col("rule") == "customer_tracking_order_exact", F.lit("0.98")
        ).when(F.col("rule").isNotNull(), F.lit("0.00")).cast("decimal(5,4)").alias("confidence"),
    )


def identity_events(events: DataFrame, accounts: DataFrame, *, text_type="文本") -> DataFrame:
    """First event of each id that is a private text from or to a known account's customer.

    events: columns of a live event with ``ordinal``. Unlike the inbox, empty texts and bad
    times are no reason to leave one out: only names, phones and numbers are read.
    """
    flat = lambda c: F.coalesce(F.trim(c), F.lit(""))
    ok = events.withColumn("event_id", flat("event_id")).filter("event_id <> ''")
    first = ok.groupBy("event_id").agg(F.min_by(F.struct(*ok.columns), "ordinal").alias("r")).select("r.*")
    known = accounts.select(F.col("account_profile"), "account_id", "self_sender")
    rows = first.withColumn("account_profile", flat("account_profile")).join(F.broadcast(known), "account_profile")
    sender, raw = F.coalesce("sender", F.lit("")), tx.raw_identifier("conversation_id")
    mine = (F.col("chat_type") == "private") & (F.col("message_type") == text_type) & ((sender == "") | (sender == F.col("self_sender")))
    return rows.withColumns({"sender": sender, "raw_id": raw}).filter(mine & F.col("raw_id").isNotNull())


def evidence_links(
    events: DataFrame, refs: DataFrame, orders: DataFrame, secret: str, *, target: str, version: str = "evidence-v1"
) -> tuple[DataFrame, DataFrame]:
    """(customer_key, eligibility) of the conversations that refs know, and the target profile's links.

    events: see :func:`identity_events`; refs: (customer_key, profile_id, raw_hash).
    """
    rows = events.withColumns({"key": F.struct("account_profile", "raw_id"), "raw_hash": raw_hash(secret, raw_id="raw_id")})
    by = conversation_evidence(rows, key="key", name="conversation_name", ordinal="ordinal")
    hashes = rows.groupBy("key").agg(F.first("raw_hash").alias("raw_hash"))
    of = refs.select("customer_key", "profile_id", "raw_hash")
    known = by.join(hashes, "key").withColumn("profile_id", F.col("key.account_profile")).join(of, ["profile_id", "raw_hash"])
    eligible = known.filter((F.col("profile_id") == target) & (F.col("eligibility") != "order_ineligible"))
    ladder_rows = evidence_ladder(eligible.select(F.col("customer_key").alias("key"), "direct", "trackings"), orders).filter("rule is not null")
    links = ladder_rows.select(
        hmac_id(secret, "conversation-link", "key", F.lit(version)).alias("link_id"), F.col("key").alias("customer_key"),
        phone_hmac(secret, "phone").alias("phone_hmac"),
        F.col("rule").alias("match_method"), "confidence", "state", F.lit(version).alias("version"),
    )
    return known.select("customer_key", "eligibility"), links


def conversation_evidence(
    messages: DataFrame, *, key="conversation_id", name="conversation_name", ordinal="ordinal", sender="sender", text="text"
) -> DataFrame:
    """(key, eligibility, direct, trackings): the last name decides; only the customer's texts count."""
    said = F.when(F.col(sender) == "", F.col(text))
    rows = messages.groupBy(F.col(key).alias("key")).agg(
        F.max_by(classify_eligibility(name), F.col(ordinal)).alias("eligibility"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(tx.mainland_phones(said))))).alias("direct"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(tx.tracking_numbers(said))))).alias("trackings"),
    )
    return rows


def binding_summary(customers: DataFrame, bindings: DataFrame, *, key="customer_key") -> DataFrame:
    """(key, state, phones): the state of highest standing, unmatched if there is none; active phones."""
    order = ["approved", "ambiguous_shared", "review", "candidate_unique", "rejected", "missing"]
    rank = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("state"))
    best = bindings.groupBy(key).agg(
        F.min_by("state", rank).alias("state"),
        F.count_distinct(F.when(~F.col("state").isin("rejected", "missing"), F.col("identifier"))).alias("phones")
    )
    return customers.select(key).join(best, key, "left").select(
        key, F.coalesce("state", F.lit("unmatched")).alias("state"), F.coalesce("phones", F.lit(0)).cast("long").alias("phones")
    )
