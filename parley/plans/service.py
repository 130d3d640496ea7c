"""Queries of the read side, imports and outcomes, with their SQL; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicons, parse
from ..functions import text as tx
from ..operators import cards, detail, identity, orders, outcomes, retrieval, sampling, serving
from ..sources import readers, sinks
from .catalogue import _BI, _CONV, _EVID, _LINES, _TOK, _event_turns, _lines, _t, _TURNS, query

AS_OF = "2024-01-28 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as back, count(*) over (partition by user_id) as n from events)
select user_id, event_id, cast(least(n, 50) - back + 1 as int) as place from r where back <= 50""")
def newest_messages(spark, sf):
    return detail.newest(_t(spark, sf, "events"), key="user_id", order=["ts", "event_id"], n=50).select("user_id", "event_id", "place")


@query("""select c_custkey as customer_key, case when c_custkey % 4 = 0 then '未命名客户' else c_name end as display_name, case when c_custkey % 5 = 0 then 'low' else c_mktsegment end as opportunity_level,
 '' as summary, 'unmatched' as identity_binding_state, case when c_custkey % 3 = 0 then 0 else c_nationkey end as opportunity_score, 0 as identity_candidate_count, 'unavailable' as order_binding_state from customer""")
def public_customers(spark, sf):
    k = F.col("c_custkey")
    c = _t(spark, sf, "customer").select(
        k.alias("customer_key"), F.when(k % 4 == 0, "").otherwise(F.col("c_name")).alias("display_name"),
        F.when(k % 5 != 0, F.col("c_mktsegment")).alias("opportunity_level"),
        F.when(k % 3 != 0, F.col("c_nationkey")).alias("opportunity_score"), F.col("c_name").alias("conversation_username"),
    )
    return detail.public_customers(c)


@query(
    """select conv_id * 1000 + turn as pair_id, '' as trigger_text, text as reply_text, 'unknown' as intent_stage, 'pending' as review_status, 'unassigned' as split from conversations"""
)
def public_pairs(spark, sf):
    c = _t(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("reply_text"), F.lit("").alias("split"),
        F.col("role").alias("raw_sender")
    )
    return detail.public_pairs(c)


@query("""select c_custkey as k, case when c_custkey % 3 = 0 then '客户-' || right('customer_' || lpad(cast(c_custkey as varchar), 12, '0'), 8)
 else substr(trim(regexp_replace(regexp_replace(c_name || ' ' || c_mktsegment, '[0-9]{6,}', '[编号]', 'g'), '\\s+', ' ', 'g')), 1, 80) end as label from customer""")
def display_names(spark, sf):
    k = F.col("c_custkey")
    c = _t(spark, sf, "customer").select(
        k.alias("k"), F.concat(F.lit("customer_"), F.lpad(k.cast("string"), 12, "0")).alias("key"),
        F.when(k % 3 == 0, " ，").otherwise(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("remark")
    )
    return c.select("k", tx.display_name("key", ["remark"]).alias("label"))


@query("""select c_custkey as k, replace(replace('an ' || c_name || ' von ' || c_mktsegment || '.', case when length(c_name) >= length(c_mktsegment) then c_name else c_mktsegment end, '[姓名]'),
 case when length(c_name) >= length(c_mktsegment) then c_mktsegment else c_name end, '[姓名]') as said from customer""")
def name_scrub(spark, sf):
    said = F.concat(F.lit("an "), "c_name", F.lit(" von "), "c_mktsegment", F.lit("."))
    return _t(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), tx.scrub_tokens(said, tx.known_names(["c_name", "c_mktsegment"]), "[姓名]").alias("said")
    )


@query(
    """select c_custkey as k, '1' || '******' || right('138' || lpad(cast(c_custkey as varchar), 8, '0'), 4) as hint, case when c_custkey % 4 = 0 then null else '138' || lpad(cast(c_custkey as varchar), 8, '0') end as phone from customer"""
)
def phone_forms(spark, sf):
    k = F.col("c_custkey")
    digits = F.concat(F.lit("138"), F.lpad(k.cast("string"), 8, "0"))
    written = F.when(k % 4 == 0, F.substring(digits, 1, 10)).when(k % 4 == 1, F.concat(F.lit("+86 "), digits)).when(
        k % 4 == 2, F.concat(F.lit("（"), F.substring(digits, 1, 3), F.lit("）"), F.substring(digits, 4, 4), F.lit("-"), F.substring(digits, 8, 4))
    ).otherwise(digits)
    return _t(spark, sf, "customer").select(k.alias("k"), tx.masked_phone(digits).alias("hint"), tx.normalize_phone(written).alias("phone"))


@query(
    """select event_id, case when event_id % 4 = 3 then null else epoch_us(ts) // 1000000 - case when event_id % 4 = 0 then 0 else 28800 end end as s from events"""
)
def api_times(spark, sf):
    k, ts = F.col("event_id"), F.col("ts")
    written = F.when(k % 4 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 4 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(
        k % 4 == 2, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" (local)"))
    ).otherwise(F.lit("soon"))
    return _t(spark, sf, "events").select(k, F.unix_seconds(parse.instant_or_seconds(written)).alias("s"))


@query(
    """select event_id, strftime(ts + interval 8 hour, '%Y-%m-%dT%H:%M:%S') || '+08:00' as local, epoch_us(ts) // 1000000 as utc, case when event_id % 2 = 0 then epoch_us(ts) // 1000000 - 28800 end as synced from events"""
)
def local_times(spark, sf):
    e = _t(spark, sf, "events")
    naive = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    told = F.when(F.col("event_id") % 2 == 0, F.concat(naive, F.lit("+08:00"))).otherwise(naive)
    return e.select(
        "event_id", parse.epoch_local(F.unix_seconds("ts")).alias("local"), F.unix_seconds(parse.instant(naive)).alias("utc"),
        F.unix_seconds(parse.synced_at(told)).alias("synced")
    )


_STYLES = f"""with p as (
  select conv_id * 1000 + turn as pair_id, conv_id % 50 as customer, text, turn * 100000 + conv_id as created_at, case when conv_id % 3 = 0 then 'pending' else 'approved' end as status, case when turn % 4 = 0 then 'high' else 'low' end as risk
  from conversations where role = 'user'
), c as (select *, {_BI.format(_CONV)} as b from (select * from p where status = 'approved' order by created_at desc, pair_id limit 200) where risk = 'low'),
q as (select item_id, item_id % 50 as customer, {_BI.format(_CONV)} as b from benchmark),
s as (select item_id, pair_id, created_at, len(list_intersect(q.b, c.b)) / (len(q.b) + len(c.b) - len(list_intersect(q.b, c.b))) + case when q.customer = c.customer then 0.08 else 0 end as s from q, c)"""


@query(_STYLES + """, r as (select *, row_number() over (partition by item_id order by round(s, 9) desc, created_at desc, pair_id) as k from s)
select item_id, pair_id, round(s, 6) as score, cast(k as int) as rank from r where k <= 5""")
def style_examples(spark, sf):
    conv, turn = F.col("conv_id"), F.col("turn")
    p = _t(spark, sf, "conversations").filter("role = 'user'").select(
        (conv * 1000 + turn).alias("pair_id"), (conv % 50).alias("customer_key"), F.col("text").alias("trigger_text"),
        (turn * 100000 + conv).alias("created_at"),
        F.when(conv % 3 == 0, "pending").otherwise("approved").alias("review_status"),
        F.when(turn % 4 == 0, "high").otherwise("low").alias("risk_level"),
    )
    q = _t(spark, sf, "benchmark").select("item_id", (F.col("item_id") % 50).alias("customer_key"), F.col("text").alias("request_text"))
    return detail.style_examples(q, p, qid="item_id")


_SOURCES = """so as (
  select cast(s_suppkey as varchar) as id, s_name as title, s_suppkey % 5 <> 0 as enabled, s_suppkey % 7 <> 0 as configured,
    case when s_suppkey % 11 <> 0 then timestamp '2024-01-27 00:00:00' - to_days(cast(s_suppkey % 4 as int)) end as modified, case when s_suppkey % 3 = 0 then 0 else 172800 end as max_age from supplier
), st as (select *, case when not enabled then 'disabled' when not configured then 'unconfigured' when modified is null then 'missing_cache'
  when max_age > 0 and epoch_us(timestamp '2024-01-28 00:00:00') // 1000000 - epoch_us(modified) // 1000000 > max_age then 'stale' else 'ready' end as status from so)"""


def _sources(spark, sf):
    k = F.col("s_suppkey")
    at = F.lit("2024-01-27 00:00:00").cast("timestamp") - F.make_interval(days=(k % 4).cast("int"))
    return _t(spark, sf, "supplier").select(
        k.cast("string").alias("id"), F.col("s_name").alias("title"), (k % 5 != 0).alias("enabled"), (k % 7 != 0).alias("configured"),
        F.when(k % 11 != 0, at).alias("modified"), F.when(k % 3 == 0, 0).otherwise(172800).alias("max_age_seconds")
    )


@query(f"with {_SOURCES} select id, status from st")
def source_status(spark, sf):
    return retrieval.source_status(_sources(spark, sf), _as_of()).select("id", "status")


_SAID = "regexp_replace(lower(said), '\\s+', '', 'g')"


@query(f"""with {_SOURCES}, it as (
  select item_id, cast(1 + item_id % (select count(*) from supplier) as varchar) as source_id, text, case when item_id % 6 = 0 then timestamp '2024-01-20 00:00:00' end as expires from benchmark
), i as (select item_id, source_id, title || ' ' || trim(text) as said, substr(trim(text), 1, 1200) as content, title from it join st on it.source_id = st.id where status = 'ready' and (expires is null or expires >= timestamp '2024-01-28 00:00:00')),
f as (select item_id, source_id, content, title, {_TOK.format('said')} as t, {_BI.format(_SAID)} as b from i),
q as (select conv_id * 1000 + turn as query_id, {_TOK.format('text')} as t, {_BI.format(_CONV)} as b from conversations where role = 'user'),
s as (select query_id, item_id, source_id, content, title, len(list_intersect(q.t, f.t)) / greatest(len(q.t), 1) * 0.45 + len(list_intersect(q.b, f.b)) / greatest(len(q.b), 1) * 0.55 as s from q, f),
r as (select *, row_number() over (partition by query_id order by round(s, 9) desc, item_id) as k from s where s > 0)
select query_id, item_id, round(s, 6) as score, cast(k as int) as rank, 'knowledge:' || source_id || ':' || substr(sha256(source_id || chr(31) || title || chr(31) || content), 1, 16) as ref from r where k <= 8""")
def knowledge_search(spark, sf):
    n = _t(spark, sf, "supplier").count()
    k = F.col("item_id")
    raw = _t(spark, sf, "benchmark").select(
        "item_id", (1 + k % n).cast("string").alias("source_id"),
        F.to_json(F.array(F.struct(F.col("text").alias("answer"), F.when(k % 6 == 0, "2024-01-20").alias("effective_until")))).alias("value")
    )
    items = readers.flatten_items(raw)
    q = _t(spark, sf, "conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query")
    )
    hits, _ = detail.knowledge_search(q, items, _sources(spark, sf), _as_of())
    return hits.select("query_id", "item_id", "score", "rank", detail.reference_id("source_id", "title", "content").alias("ref"))


@query(
    """select quality as label, doc_id from labels join documents using (doc_id) where toxic is null or toxic = 1 order by quality, doc_id limit 200"""
)
def calibration_list(spark, sf):
    rows = _t(spark, sf, "labels").select(
        F.col("doc_id").alias("calibration_id"), F.col("doc_id").alias("message_key"), F.lit(1).alias("customer_key"),
        F.when(F.col("toxic") == 0, "studio").alias("reviewer_role"), "quality"
    )
    people = spark.createDataFrame([(1, "x")], "customer_key int, display_name string")
    said = _t(spark, sf, "documents").select(F.col("doc_id").alias("message_key"), F.lit("").alias("timestamp"), "text")
    shown = detail.calibration_list(rows, people, said, pending=True)
    return serving.page(shown, ["quality", "calibration_id"], limit=200).select(
        F.col("quality").alias("label"), F.col("calibration_id").alias("doc_id")
    )


@query("""select doc_id, case when toxic = 1 then 'customer' when quality = 1 then 'studio' end as reviewer_role, toxic = 1 as now from labels""")
def label_updates(spark, sf):
    rows = _t(spark, sf, "labels").select(
        F.col("doc_id").alias("calibration_id"), F.when(F.col("quality") == 1, "studio").alias("reviewer_role"),
        F.lit(None).cast("timestamp").alias("reviewed_at")
    )
    new = _t(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("calibration_id"), F.lit("customer").alias("reviewer_role"))
    out = detail.apply_labels(rows, new, _as_of())
    return out.select(F.col("calibration_id").alias("doc_id"), "reviewer_role", F.col("reviewed_at").isNotNull().alias("now"))


def _scored(spark, sf):
    k = F.col("c_custkey")
    return _t(spark, sf, "customer").select(
        k.alias("customer_key"), F.when(k % 4 == 0, None).otherwise(F.concat(F.lit("P"), (k % 3).cast("string"))).alias("aftersales_priority"),
        (k % 101).alias("opportunity_score"),
        F.when(k % 101 >= 60, "high").when(k % 101 >= 35, "medium").otherwise("low").alias("opportunity_level"),
        F.lpad((k % 97).cast("string"), 3, "0").alias("last_active_at"),
    )


_SCORED = """with s as (select c_custkey as customer_key, case when c_custkey % 4 <> 0 then 'P' || (c_custkey % 3) end as aftersales_priority, c_custkey % 101 as opportunity_score,
 case when c_custkey % 101 >= 60 then 'high' when c_custkey % 101 >= 35 then 'medium' else 'low' end as opportunity_level, lpad(cast(c_custkey % 97 as varchar), 3, '0') as last_active_at from customer)"""


@query(
    _SCORED + " select customer_key, aftersales_priority from s where aftersales_priority is not null order by aftersales_priority, opportunity_score desc, customer_key limit 1000"
)
def aftersales_order(spark, sf):
    return detail.aftersales_order(_scored(spark, sf)).select("customer_key", "aftersales_priority")


@query(
    _SCORED + " select customer_key, opportunity_score from s where opportunity_level = 'medium' and aftersales_priority is not null order by opportunity_score desc, last_active_at desc, customer_key limit 100 offset 20"
)
def customer_filters(spark, sf):
    return serving.customer_list(
        _scored(spark, sf), level="medium", aftersales=True, limit=100, offset=20
    ).select("customer_key", "opportunity_score")


@query(
    "select o_orderkey as pair_id, o_orderstatus as review_status from orders order by case o_orderstatus when 'O' then 0 else 1 end, o_orderdate desc, o_orderkey limit 200 offset 0"
)
def style_list(spark, sf):
    o = _t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pair_id"),
        F.when(F.col("o_orderstatus") == "O", "pending").otherwise(F.col("o_orderstatus")).alias("review_status"),
        F.col("o_orderdate").alias("created_at")
    )
    return serving.style_list(o, limit=200).select(
        "pair_id", F.when(F.col("review_status") == "pending", "O").otherwise(F.col("review_status")).alias("review_status")
    )


@query("""select 'degraded' as status, 3 as snapshot_age_days, false as snapshot_stale, (select count(*) from customer) as customers, (select count(*) from events) as events,
 case when (select count(*) >= 200 and count(toxic) = count(*) and count(*) filter (quality = 1 - toxic) / count(toxic) >= 0.99 from labels) then 'weak_hmac_secret' else 'weak_hmac_secret,role_calibration_required' end as warnings""")
def health_warnings(spark, sf):
    counts = serving.health(customers=_t(spark, sf, "customer"), events=_t(spark, sf, "events"))
    cal = serving.calibration(_t(spark, sf, "labels").withColumn("human", 1 - F.col("toxic")), predicted="quality", human="human")
    h = detail.health(counts, cal, F.lit("2024-01-24 10:00:00").cast("timestamp"), _as_of(), default_secret=False, weak_secret=True)
    return h.select(
        "status", "snapshot_age_days", "snapshot_stale", F.col("counts")["customers"].alias("customers"), F.col("counts")["events"].alias("events"),
        F.array_join("warnings", ",").alias("warnings")
    )


_CONFUSION = """with b as (select cast(1 - toxic as varchar) as h, cast(quality as varchar) as p from labels where toxic is not null and quality is not null), l as (select h as label from b union select p from b),
n as (select label, count(*) filter (h = label and p = label) as tp, count(*) filter (h <> label and p = label) as fp, count(*) filter (h = label and p <> label) as fn from l, b group by label),
m as (select round(tp / nullif(tp + fp, 0), 6) as p, round(tp / nullif(tp + fn, 0), 6) as r, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f from n)"""


@query(_CONFUSION + """ select round(avg(coalesce(p, 0)), 6) as macro_precision, round(avg(coalesce(r, 0)), 6) as macro_recall, round(avg(coalesce(f, 0)), 6) as macro_f1,
 (select count(*) from b) as compared, (select round(count(*) filter (h = p) / count(*), 6) from b) as agreement from m""")
def macro_scores(spark, sf):
    rows = _t(spark, sf, "labels").withColumn("human", 1 - F.col("toxic"))
    return detail.macro_scores(serving.confusion(rows, predicted="quality", human="human"), rows, predicted="quality", human="human")


@query(_LINES + """, g as (select o_custkey as k, count(*) filter (revenue_minor > 0) as paid, count(*) filter (revenue_minor > 0 and (refund_type is null or refund_type not in ('return', 'return_taro', 'cancel'))) as retained,
 sum(revenue_minor) filter (revenue_minor > 0) as a, sum(least(coalesce(refund_amount_minor, 0), revenue_minor)) filter (revenue_minor > 0) as l from f join orders on f.record_id = cast(o_orderkey as varchar) group by 1)
select k, paid, retained, case when paid > 0 then round(retained / paid, 6) end as retained_ratio, case when a > 0 then round(l / a, 6) end as refund_loss_ratio from g""")
def outcome_ratios(spark, sf):
    owner = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("record_id"), F.col("o_custkey").alias("k"))
    return detail.outcome_ratios(_lines(spark, sf).join(owner, "record_id"), key="k")


@query(_TURNS + """, g as (select user_id, turn_no, any_value(event_type) as role, string_agg(event_type, chr(10) order by ts, event_id) as text from t group by user_id, turn_no),
c as (select user_id, turn_no, role, list(turn_no || role || text) over (partition by user_id order by turn_no rows between 8 preceding and 1 preceding) as before from g)
select user_id, cast(turn_no as bigint) as turn_no, coalesce(len(before), 0) as n, md5(array_to_string(coalesce(before, []), '|')) as context_md5 from c where role = 'view'""")
def decision_cards(spark, sf):
    rows = cards.cards(_event_turns(spark, sf), "s", key="user_id", asker="view")
    said = F.array_join(F.transform("context", lambda c: F.concat(c["turn_no"].cast("string"), c["role"], c["text"])), "|")
    return rows.select("user_id", "turn_no", F.size("context").cast("long").alias("n"), F.md5(said).alias("context_md5"))


@query("""select event_id, case when event_type = 'purchase' and value > 50 then 'paid' when event_type = 'error' then 'aftersale' when value > 80 then 'exchange' else 'unattributed' end as state,
 array_to_string(list_filter([case when event_type = 'purchase' and value > 50 then 'paid' end, case when event_type = 'error' then 'aftersale' end, case when value > 80 then 'exchange' end], lambda x: x is not null), ',') as flags from events""")
def attribution(spark, sf):
    e = _t(spark, sf, "events")
    found = {
        "paid": (F.col("event_type") == "purchase") & (F.col("value") > 50), "aftersale": F.col("event_type") == "error",
        "exchange": F.col("value") > 80
    }
    state, flags = cards.attribution(found, ["paid", "aftersale", "exchange"])
    return e.select("event_id", state.alias("state"), F.array_join(flags, ",").alias("flags"))


@query("select item_id from benchmark where item_id % 3 <> 0 or item_id % 2 = 0")
def unexpired_items(spark, sf):
    k = F.col("item_id")
    items = _t(spark, sf, "benchmark").withColumn(
        "expires_at", F.when(k % 3 != 0, "").when(k % 2 == 0, "2024-01-28").otherwise("2024-01-27T23:59:59Z")
    )
    return retrieval.fresh(items, _as_of()).select("item_id")


@query(
    """with h as (select distinct item_id from benchmark where item_id % 4 <> 0) select benchmark.item_id, h.item_id is null as grounding_missing from benchmark left join h on benchmark.item_id = h.item_id"""
)
def grounding_missing(spark, sf):
    b = _t(spark, sf, "benchmark")
    hits = b.filter("item_id % 4 <> 0").select("item_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
    return retrieval.grounding_missing(b, hits, qid="item_id")


@query(
    """select c_custkey as customer_key, list_filter([c_mktsegment, null, c_name], lambda x: x is not null)[1] as first_ref, 2 as n from customer"""
)
def grounding_refs(spark, sf):
    ref = lambda c: F.struct(c.alias("id"), F.lit("fact").alias("type"))
    c = _t(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_key"), F.array(ref(F.col("c_mktsegment")), ref(F.lit(""))).alias("order_refs"),
        F.array(ref(F.col("c_name"))).alias("current_facts")
    )
    return detail.grounding_refs(c, "order_refs", "current_facts").select(
        "customer_key", F.col("refs")[0]["id"].alias("first_ref"), F.size("refs").alias("n")
    )


@query("""with o as (select o_custkey as customer_key, o_orderkey as binding_id, case when o_orderkey % 6 = 0 then 'missing' else 'review' end as state from orders),
a as (select min(binding_id) as b, arg_min(customer_key, binding_id) as k from o)
select binding_id, case when binding_id = b then 'approved' when customer_key = k and state <> 'missing' then 'rejected' else state end as state from o, a""")
def approve_binding(spark, sf):
    o = _t(spark, sf, "orders").select(
        F.col("o_custkey").alias("customer_key"), F.col("o_orderkey").alias("binding_id"),
        F.when(F.col("o_orderkey") % 6 == 0, "missing").otherwise("review").alias("state")
    )
    first = o.agg(F.min("binding_id")).first()[0]
    return serving.approve_binding(o, first).select("binding_id", "state")


@query("""select k, source from (select c_custkey as k, 'new' as source from customer where c_custkey % 3 = 0 union all
 select o_custkey, 'old' from orders where o_custkey % 3 <> 0 and o_custkey in (select c_custkey from customer where c_nationkey < 10) group by o_custkey)""")
def restore_valid(spark, sf):
    c = _t(spark, sf, "customer")
    fresh = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("source"))
    old = _t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.lit("old").alias("source")).distinct()
    return sinks.restore(fresh, old, ["k"], {"k": c.filter("c_nationkey < 10").select(F.col("c_custkey").alias("k"))})


@query("""with p as (select o_custkey as key, o_orderkey % 900 as raw, min((o_orderkey % 100) / 100.0) as confidence, count(distinct o_orderstatus) as n from orders group by all)
select cast(key as varchar) as account_id, cast(raw as varchar) as id, case when n > 1 then 'conflict' when confidence >= 0.95 then 'approved' else 'review' end as state from p""")
def binding_states(spark, sf):
    k = F.col("o_orderkey")
    phone = F.concat(F.lit("1380000000"), F.translate("o_orderstatus", "FOP", "123"))
    rows = _t(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("account"), phone.alias("phone"), (k % 900).cast("string").alias("raw_id"),
        F.format_string("%.2f", (k % 100) / 100).alias("confidence")
    )
    known = _t(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("alias"), F.col("o_custkey").cast("string").alias("account_id")
    ).distinct()
    checked = identity.binding_rows(rows, known)
    links = identity.binding_links(checked, "s")
    names = checked.select("account_id", "id", identity.raw_hash("s").alias("raw_hash")).distinct()
    return links.join(names, ["account_id", "raw_hash"]).select("account_id", "id", "state")


@query(f"""with {_EVID}, e as (select k, unnest(direct) as phone from c) select 'phone' as kind, count(distinct phone) as values_met, count(distinct k) as keys from e union all
select 'tracking', count(distinct t), count(distinct k) from (select k, unnest(trackings) as t from c)""")
def conversation_evidence(spark, sf):
    k = F.col("c_custkey")
    phone = lambda n: F.concat(F.lit("138"), F.lpad(n.cast("string"), 8, "0"))
    said = F.when(k % 3 == 0, "").when(k % 11 == 0, F.concat_ws("，", phone(k % 700), phone((k + 1) % 700))).otherwise(phone(k % 1400))
    number = F.when(k % 2 == 0, F.concat(F.lit(" 单号SF"), F.lpad((k % 1800).cast("string"), 10, "0"))).otherwise("")
    rows = _t(spark, sf, "customer").select(
        k.alias("conversation_id"), F.lit("n").alias("conversation_name"), F.lit(1).alias("ordinal"), F.lit("").alias("sender"),
        F.concat(F.lit("号"), said, number).alias("text")
    )
    got = identity.conversation_evidence(rows)
    one = lambda kind, c: got.select("key", F.explode(c).alias("v")).filter(F.lit(kind == "phone") | F.col("v").startswith("SF")).agg(
        F.count_distinct("v").alias("values_met"), F.count_distinct("key").alias("keys")
    ).select(F.lit(kind).alias("kind"), "values_met", "keys")
    return one("phone", "direct").unionByName(one("tracking", "trackings"))


@query("""with r as (select o_orderkey as k, o_custkey % 50 as id, o_orderkey % 40 = 0 as bad, o_orderkey % 60 = 7 as blank from orders),
n as (select *, row_number() over (partition by case when bad or blank then 'x' || k else 'i' || id end order by k) as n from r)
select case when bad then 'not_object' when blank then 'missing_record_id' when n > 1 then 'repeated_record_id' else 'accepted' end as reason, count(*) as rows from n group by 1""")
def order_quarantine(spark, sf):
    k = F.col("o_orderkey")
    rid = F.when(k % 60 == 7, "").otherwise((F.col("o_custkey") % 50).cast("string"))
    rows = _t(spark, sf, "orders").select(
        F.lit("f").alias("source_file"), k.alias("position"), F.when(k % 40 != 0, F.struct(rid.alias("record_id"))).alias("record")
    )
    return readers.accounting(orders.quarantine(rows))


@query("""with a as (select user_id as p, max(ts) as last from events group by 1), s as (
  select p, last, case when p % 7 = 1 then null else p % 7 <> 2 end as ready, case when p % 7 = 3 then 'x' else '' end as err,
    case when p % 7 = 1 or p % 7 = 4 then null when p % 7 = 5 then last - interval 1 second when p % 7 = 6 then timestamp '2024-02-20 00:00:00' else greatest(last, timestamp '2024-02-01 00:00:00') end as polled from a
)
select cast(p as varchar) as p, case when p % 7 = 1 then 'missing_profile_observation' when not ready then 'profile_not_initialized' when err <> '' then 'profile_observation_error' when polled is null then 'invalid_profile_observation'
  when polled < last then 'profile_observation_before_message' when abs(epoch_us(polled) // 1000000 - epoch_us(timestamp '2024-02-01 00:00:00') // 1000000) > 86400 then 'profile_global_observation_skew' end as reason,
  case when p % 7 in (0, 6) then epoch_us(polled) // 1000000 end as seen from s""")
def observation_reasons(spark, sf):
    last = _t(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("account_profile")).agg(F.max("ts").alias("last_ts"))
    k = F.col("account_profile").cast("long") % 7
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    late = F.lit("2024-02-01 00:00:00").cast("timestamp")
    polled = F.when(k == 4, "soon").when(
        k == 5, iso(F.col("last_ts") - F.expr("interval 1 second"))
    ).when(k == 6, "2024-02-20T00:00:00Z").otherwise(iso(F.greatest("last_ts", late)))
    state = last.filter(k != 1).select(
        "account_profile", (k != 2).alias("initialized"), polled.alias("last_poll_at"), F.when(k == 3, "x").otherwise("").alias("last_error")
    )
    got = readers.observations(last.select("account_profile"), state, last, late)
    return got.select(F.col("account_profile").alias("p"), "reason", F.unix_seconds("observed_until").alias("seen"))


@query(
    "select 'src/' || doc_id as path, case when doc_id % 3 = 0 then 'messages.jsonl' when doc_id % 3 = 1 then 'conversations/' || doc_id || '.txt' else 'a/' || doc_id end as file from documents"
)
def source_files(spark, sf):
    k = F.col("doc_id")
    p = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("/data/in/"), k, F.lit(".txt"))).otherwise(F.concat(F.lit("a/"), k))
    return _t(spark, sf, "documents").select(F.concat(F.lit("src/"), k).alias("path"), tx.source_file(p).alias("file"))


@query("""with m as (select event_id, user_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') as stamp from events), a as (select *, substr(stamp, 1, 7) as month, row_number() over (partition by substr(stamp, 1, 7), event_type, user_id order by stamp, event_id) as a from m),
b as (select *, row_number() over (partition by month, event_type order by a, user_id) as b from a) select event_id, month from b order by b, month, event_type limit 200""")
def calibration_sample(spark, sf):
    m = _t(spark, sf, "events").select(
        F.col("event_id").alias("message_key"), F.col("user_id").alias("customer_key"), F.col("event_type").alias("role"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")
    )
    return detail.calibration_sample(m).select(F.col("message_key").alias("event_id"), "month")


@query("""with d as (select conv_id * 1000 + turn as draft_id, text, turn from conversations where length(trim(text)) > 0)
select draft_id, length(trim(text)) as n, turn % 3 = 0 as needs_human, case when turn % 3 = 0 then case when turn % 2 = 0 then 'price,grounding_missing' else 'price,grounding_missing' end else 'price' end as risks, case when turn % 4 = 0 then 2 else 1 end as refs from d""")
def normalized_drafts(spark, sf):
    turn = F.col("turn")
    ref = lambda i: F.struct(F.lit(i).alias("id"))
    none = F.array().cast("array<string>")
    d = _t(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + turn).alias("draft_id"), F.col("text").alias("draft_text"), F.lit("").alias("intent"), F.lit(False).alias("needs_clarification"), F.lit(None).cast("boolean").alias("needs_human"),
        F.when(turn % 2 == 0, F.array(F.lit("price"), F.lit("grounding_missing"))).otherwise(F.array(F.lit("price"))).alias("all_risks"),
        F.when(turn % 4 == 0, none).otherwise(F.array(F.lit("b"))).alias("wanted_refs"), F.array(ref("a"), ref("b")).alias("grounding_refs"), (turn % 3 == 0).alias("grounding_missing"), turn,
    )
    d = d.withColumn("risk_flags", F.when(turn % 3 == 0, F.col("all_risks")).otherwise(F.array(F.lit("price"))))
    got = detail.normalized_drafts(d)
    return got.select("draft_id", F.length("draft_text").alias("n"), "needs_human", F.array_join("risk_flags", ",").alias("risks"), F.size("grounding_refs").alias("refs"))


@query("""select c_custkey as k, case when c_custkey % 3 = 0 then 'order_customer' when c_custkey % 3 = 1 then 'album_customer' else 'order_ineligible' end as eligibility from customer""")
def order_eligibility(spark, sf):
    k = F.col("c_custkey")
    name = F.concat("c_name", F.when(k % 3 == 0, " 相册客户 下单客户").when(k % 3 == 1, "相册客户").otherwise(""))
    return _t(spark, sf, "customer").select(k.alias("k"), identity.classify_eligibility(name).alias("eligibility"))


@query("""select doc_id, regexp_replace(lower(text), '[0-9]+', '#', 'g') <> lower(text) as has_digits, length(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '[^0-9a-z#]+', '', 'g')) as n from documents where not regexp_matches(text, '[^\\x00-\\x7f]') and not contains(text, '[')""")
def template_form(spark, sf):
    d = _t(spark, sf, "documents").filter(~F.col("text").rlike(r"[^\x00-\x7f]") & ~F.contains("text", F.lit("[")))
    level = F.regexp_replace(F.regexp_replace(F.lower("text"), "[0-9]+", "#"), "[^0-9a-z#]+", "")
    same = tx.template_key("text") == tx.template_key_plain("text")
    return d.select("doc_id", (F.regexp_replace(F.lower("text"), "[0-9]+", "#") != F.lower("text")).alias("has_digits"), F.when(same, F.length(level)).alias("n"))


@query("""select doc_id, regexp_matches(lower(text), 'price|stock|refund|shipping|价格|库存|退款|发货') as dynamic from documents where text is not null""")
def dynamic_questions(spark, sf):
    return _t(spark, sf, "documents").filter("text is not null").select("doc_id", tx.asks_for_facts("text").alias("dynamic"))


_KINDS = "case cast(event_id % 13 as int) when 1 then 'cancel' when 2 then 'return' when 3 then 'return_taro' when 4 then 'exchange' when 5 then 'compensation' when 6 then 'other' when 7 then 'return' end"
_ORDERS = f"""select user_id % 40 as key, cast(ts + interval 8 hour as date) as paid_on, cast(floor(value * 100) as bigint) as revenue_minor, {_KINDS} as refund_type,
 cast(case when event_id % 13 in (2, 3, 4) then floor(value * 100) when event_id % 13 = 7 then floor(value * 30) end as bigint) as refund_minor,
 case when event_id % 13 in (2, 7) then cast(ts + interval 8 hour as date) + cast(event_id % 45 as int) end as refund_on, event_id % 17 = 0 as aftersale_open, event_id % 19 = 0 as anomalous
 from events where event_type = 'purchase' and event_id % 5 = 0"""
SEEN = "2024-02-04 17:00:00"


@query(f"""with o as (select *, paid_on + 30 < date '2024-02-05' as over, refund_type in ('return', 'return_taro') as ret,
 coalesce(refund_minor between 0 and revenue_minor and revenue_minor > 0 and refund_on is not null and not aftersale_open, false) as whole,
 case when refund_type is null or refund_on > paid_on + 30 then 'none' else refund_type end as kind from ({_ORDERS}) where revenue_minor > 0),
f as (select *, case when kind = 'cancel' then false when kind in ('return', 'return_taro') then case when whole and refund_minor >= revenue_minor then false when whole and over then true end
  when kind = 'exchange' then case when coalesce(refund_minor, 0) = 0 and not aftersale_open and over then true end when kind = 'other' then null when over then true end as retained,
 case when kind in ('none', 'other') then case when kind = 'none' and over then false end else true end as aftersale,
 case when kind = 'exchange' then true when kind <> 'other' and over then false end as exchange, case when kind = 'compensation' then true when kind <> 'other' and over then false end as compensation,
 case when kind in ('return', 'return_taro') then case when whole then refund_minor end when kind in ('none', 'exchange', 'compensation') and over then 0 end as lost from o),
c as (select event_id as card_id, user_id % 40 as key, user_id as customer_key, cast(ts + interval 8 hour as date) as day, user_id % 7 <> 3 and user_id % 40 <> 9 as ok from events where event_type = 'signup'),
j as (select c.*, (select min(f.paid_on) from f where f.key = c.key and f.paid_on between c.day and c.day + 7) as first from c where ok),
d as (select j.card_id, j.customer_key, j.day, j.first,
  (select count(*) from f where f.key = j.key and f.paid_on between j.day and j.day + 7) as orders,
  (select count(*) from c x where x.ok and x.key = j.key and x.day between j.first - 7 and j.first) as met,
  (select count(distinct x.customer_key) from c x where x.ok and x.key = j.key and x.day between j.first - 7 and j.first) as people,
  count(*) filter (f.key is not null) as n, bool_or(f.anomalous) as bad, bool_and(f.retained) as kept, count(f.retained) as nk,
  bool_or(f.aftersale) as aft, count(f.aftersale) as na, bool_or(f.exchange) as exc, count(f.exchange) as ne, bool_or(f.compensation) as com, count(f.compensation) as nc,
  sum(f.lost) as lost, count(f.lost) as nl, sum(f.revenue_minor) as paid
  from j left join f on f.key = j.key and f.paid_on = j.first group by all),
g as (select *, list_filter([case when first = day then 'same_day' end, case when met > 1 then 'multiple_cards' end, case when orders > 1 then 'multiple_orders' end,
  case when people > 1 then 'shared_phone_multiple_conversations' end], lambda x: x is not null and first is not null) as flags from d)
select c.card_id, case when g.first <= c.day + 1 then true when c.ok and date '2024-02-05' > c.day + 1 then false end as paid_1d,
 case when g.first <= c.day + 3 then true when c.ok and date '2024-02-05' > c.day + 3 then false end as paid_3d,
 case when g.first <= c.day + 7 then true when c.ok and date '2024-02-05' > c.day + 7 then false end as paid_7d,
 case when not kept then false when n > 0 and nk = n then true end as retained_30d, case when aft then true when n > 0 and na = n then false end as aftersale_30d,
 case when exc then true when n > 0 and ne = n then false end as exchange_30d, case when com then true when n > 0 and nc = n then false end as compensation_30d,
 case when n > 0 and nl = n then round(lost / paid, 6) end as refund_loss_ratio,
 case when not c.ok then 'identity_unverified' when first is null then 'none' when bad then 'quality_unknown' when len(flags) > 0 then 'ambiguous' else 'associated' end as attribution_state,
 array_to_string(coalesce(flags, []), '|') as attribution_flags
from c left join g using (card_id)""")
def card_outcomes(spark, sf):
    e = _t(spark, sf, "events")
    k, day = F.col("event_id"), F.to_date(F.from_utc_timestamp("ts", "Asia/Shanghai"))
    m, cents = k % 13, F.floor(F.col("value") * 100)
    kind = F.element_at(F.array(*(F.lit(x) for x in (None, "cancel", "return", "return_taro", "exchange", "compensation", "other", "return"))), (m + 1).cast("int"))
    paid = e.filter("event_type = 'purchase' and event_id % 5 = 0").select(
        (F.col("user_id") % 40).alias("key"), day.alias("paid_on"), cents.cast("long").alias("revenue_minor"), F.when(m < 8, kind).alias("refund_type"),
        F.when(m.isin(2, 3, 4), cents).when(m == 7, F.floor(F.col("value") * 30)).cast("long").alias("refund_minor"),
        F.when(m.isin(2, 7), F.date_add(day, (k % 45).cast("int"))).alias("refund_on"), (k % 17 == 0).alias("aftersale_open"), (k % 19 == 0).alias("anomalous"),
    )
    u = F.col("user_id")
    met = e.filter("event_type = 'signup'").select(
        k.alias("card_id"), F.when(u % 40 != 9, u % 40).alias("key"), u.alias("customer_key"), F.col("ts").alias("at"), (u % 7 != 3).alias("verified")
    )
    out = outcomes.card_outcomes(met, paid, observed_until=F.lit(SEEN).cast("timestamp"))
    return out.select(
        "card_id", "paid_1d", "paid_3d", "paid_7d", *outcomes.OUTCOMES, "refund_loss_ratio", "attribution_state",
        F.array_join("attribution_flags", "|").alias("attribution_flags"),
    )
