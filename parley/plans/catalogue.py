"""All queries of the analytics side, by name, with their SQL.

The tables are generic, so operators run with vocabularies that occur in them; rules and
parameters are the same as elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys, lexicons, parse
from ..functions import text as tx
from ..operators import cards, identity, orders, ranking, retrieval, sampling, scoring, serving
from ..operators import turns as tn
from ..session import shared_path, stored
from ..sources import readers

SECRET = "test-secret"
LEXICON = lexicons.Lexicon(
    purchase=("purchase",), urgency=("click",), repeat=("signup",), rejection=("error",), objection=("error",), preference=("view",),
    commitment=("view",),
    question=("?", "que", "the"), open_question=("view",), low_value=("ok",), p0=("error",), p1=("signup",), p2=("click",), closure=("purchase",),
    presales=("view",),
    risk=(
        ("price", ("tion", "ción")), ("refund", ("worthless", "stupid")), ("complaint", ("idiot", "trash")), ("quality", ("ung ", "ment ")),
        ("compensation", ("loser",))
    ),
)
QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    if name == "events":
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


# Event turns: one kind of event after the other within a quarter of an hour.
_TURNS = """
with m as (
  select *, case when lag(event_id) over w is null or event_type <> lag(event_type) over w or epoch_us(ts) - epoch_us(lag(ts) over w) > 900000000 then 1 else 0 end as fresh
  from events window w as (partition by user_id order by ts, event_id)
), t as (
  select *, sum(fresh) over (partition by user_id order by ts, event_id) - 1 as turn_no from m
)"""


def _event_turns(spark, sf):
    return tn.merge_turns(
        _t(spark, sf, "events"), key="user_id", role="event_type", stamp="ts", at="ts", ordinal="event_id", text="event_type", message_key="event_id"
    )


@query(_TURNS + """
select user_id, cast(turn_no as bigint) as turn_no, any_value(event_type) as role, count(*) as messages, epoch_us(min(ts)) as start_us, epoch_us(max(ts)) as end_us
from t group by user_id, turn_no""")
def turns_by_gap(spark, sf):
    t = _event_turns(spark, sf)
    return t.select(
        "user_id", "turn_no", "role", F.size("message_keys").cast("long").alias("messages"), F.unix_micros("start_ts").alias("start_us"),
        F.unix_micros("end_ts").alias("end_us")
    )


def _role_turns(spark, sf):
    c = _t(spark, sf, "conversations").withColumn("at", F.lit(None).cast("timestamp")).withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    return tn.merge_turns(c, key="conv_id", role="role", stamp="turn", at="at", ordinal="turn", text="text", message_key="key", minutes=None)


_ROLE_TURNS = """
with m as (
  select *, case when lag(turn) over w is null or role <> lag(role) over w then 1 else 0 end as fresh from conversations window w as (partition by conv_id order by turn)
), n as (
  select *, sum(fresh) over (partition by conv_id order by turn) - 1 as turn_no from m
), t as (
  select conv_id, cast(turn_no as bigint) as turn_no, any_value(role) as role, string_agg(text, chr(10) order by turn) as text, count(*) as n, min(turn) as started_at, max(turn) as ended_at from n group by conv_id, turn_no
)"""


@query(_ROLE_TURNS + " select conv_id, turn_no, role, n as messages, started_at, ended_at, md5(text) as text_md5 from t")
def turns_by_role(spark, sf):
    return _role_turns(spark, sf).select(
        "conv_id", "turn_no", "role", F.size("message_keys").cast("long").alias("messages"), "started_at", "ended_at", F.md5("text").alias("text_md5")
    )


def _pairs(spark, sf):
    return tn.pair_turns(_role_turns(spark, sf), key="conv_id", asker="user", answerer="assistant", minutes=None, redacted=False, lexicon=LEXICON)


_QUALITY = """(case when length(a) between 4 and 500 then 3 else 0 end) + (case when length(b) between 5 and 500 then 4 else 0 end) + (case when b <> 'ok' then 3 else 0 end)
 + (case when contains(text, '?') or contains(text, 'que') or contains(text, 'the') then 1 else 0 end) + (case when len(list_distinct(string_split(b, ''))) >= 4 then 1 else 0 end)"""
_PAIRS = _ROLE_TURNS + f""", p as (
  select *, lead(role) over w as r_role, lead(text) over w as r_text, lead(ended_at) over w as r_end,
         lag(text, 1) over w as c1, lag(text, 2) over w as c2 from t window w as (partition by conv_id order by turn_no)
), q as (
  select *, regexp_replace(text, '\\s+', '', 'g') as a, regexp_replace(r_text, '\\s+', '', 'g') as b from p where role = 'user' and r_role = 'assistant'
), s as (select *, {_QUALITY} as quality from q),
d as (select *, row_number() over (partition by conv_id, lower(a || b) order by turn_no) as k from s where quality >= 8)"""


@query(
    _PAIRS + " select conv_id, turn_no, cast(quality as int) as quality_score, md5(text) as trigger_md5, md5(r_text) as reply_md5, r_end as at from d where k = 1"
)
def reply_pairs(spark, sf):
    return _pairs(spark, sf).select(
        "conv_id", "turn_no", "quality_score", F.md5("trigger_text").alias("trigger_md5"), F.md5("reply_text").alias("reply_md5"),
        F.col("timestamp").alias("at")
    )


@query(
    _PAIRS + " select conv_id, turn_no, md5(concat_ws('|', c2, c1)) as context_md5, cast((c1 is not null)::int + (c2 is not null)::int as int) as turns_before from d where k = 1"
)
def pair_context2(spark, sf):
    return _pairs(spark, sf).select(
        "conv_id", "turn_no", F.md5(F.concat_ws("|", F.transform("context", lambda c: c["text"]))).alias("context_md5"),
        F.size("context").alias("turns_before")
    )


@query(_PAIRS + " select cast(quality as int) as quality_score, count(*) as pairs from s group by 1")
def pair_quality(spark, sf):
    t = _role_turns(spark, sf)
    w = Window.partitionBy("conv_id").orderBy("turn_no")
    t = t.withColumn("r", F.lead(F.struct("role", "text")).over(w)).filter("role = 'user' and r.role = 'assistant'")
    return t.select(
        tn.pair_quality(F.col("text"), F.col("r.text"), LEXICON).alias("quality_score")
    ).groupBy("quality_score").agg(F.count("*").alias("pairs"))


@query("select conv_id, turn, role from conversations where role in ('user', 'assistant') and trim(replace(coalesce(text, ''), chr(0), '')) <> ''")
def eligible_messages(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.withColumn("text", tx.strip("text")).filter(
        F.col("role").isin("user", "assistant") & (F.col("text") != "")
    ).select("conv_id", "turn", "role")


_LADDER = """case when user_id % 10 = 3 then 'unknown_profile' when event_type = 'error' then 'non_text' when value < 2 then 'empty_text'
 when cast(regexp_extract(props, '"k": ([0-9]+)', 1) as int) > 90 then 'invalid_timestamp' else 'accepted' end"""


@query(f"select {_LADDER} as reason, count(*) as rows from events group by 1")
def reject_accounting(spark, sf):
    e = _t(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    reason = readers.ladder(
        ("unknown_profile", F.col("user_id") % 10 == 3), ("non_text", F.col("event_type") == "error"), ("empty_text", F.col("value") < 2),
        ("invalid_timestamp", k > 90)
    )
    return readers.accounting(e.withColumn("reject_reason", reason))


def _hmac_sql(message: str, secret: str = SECRET) -> str:
    key = secret.encode().ljust(64, b"\0")
    pad = lambda b: "unhex('" + bytes(x ^ b for x in key).hex() + "')"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({message}))))"


@query(
    f"select c_custkey, 'customer_' || substr({_hmac_sql('concat_ws(chr(31), ' + chr(39) + 'customer' + chr(39) + ', c_name, c_custkey)')}, 1, 24) as customer_key from customer"
)
def hmac_customer_key(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", keys.hmac_id(SECRET, "customer", "c_name", "c_custkey").alias("customer_key"))


@query(f"""with b as (select cast('0x' || substr({_hmac_sql('c_name')}, 1, 8) as bigint) % 100 as b from customer)
select case when b < 70 then 'train' when b < 85 then 'validation' else 'test' end as split, count(*) as customers from b group by 1""")
def stable_split_counts(spark, sf):
    return _t(spark, sf, "customer").groupBy(keys.stable_split(SECRET, "c_name").alias("split")).agg(F.count("*").alias("customers"))


@query("select substr(sha256(text), 1, 24) as digest, min(doc_id) as first, count(*) as copies from documents group by 1")
def content_digest_dedup(spark, sf):
    return sampling.digest_groups(_t(spark, sf, "documents"), keys.content_digest("text"), "doc_id")


def _any(col, words):
    return "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


_RISK_SQL = ", ".join(f"case when {_any('text', w)} then '{n}' end" for n, w in LEXICON.risk)


@query(f"""with f as (select doc_id, list_sort(list_filter([{_RISK_SQL}], lambda x: x is not null)) as f from documents where text is not null)
select doc_id, array_to_string(f, ',') as flags, case when list_contains(f, 'complaint') and (list_contains(f, 'compensation') or list_contains(f, 'refund')) then 'critical'
 when list_has_any(f, ['refund', 'compensation', 'inventory', 'delivery_promise', 'complaint']) then 'high' when len(f) > 0 then 'medium' else 'low' end as level from f""")
def risk_profile(spark, sf):
    d = _t(spark, sf, "documents").filter("text is not null").withColumn("f", tx.risk_flags("text", None, LEXICON.risk))
    return d.select("doc_id", F.array_join("f", ",").alias("flags"), tx.risk_level(F.col("f")).alias("level"))


@query(
    "select event_id, case when event_type in ('error', 'signup', 'click') then 'aftersales' when event_type = 'view' then 'presales' else 'general' end as intent from events"
)
def intent_class(spark, sf):
    return _t(spark, sf, "events").select("event_id", tx.intent("event_type", LEXICON).alias("intent"))


def _messages(spark, sf):
    e = _t(spark, sf, "events")
    role = F.when(F.get_json_object("props", "$.k").cast("int") % 3 == 0, "studio").otherwise("customer")
    return e.select("user_id", role.alias("role"), "ts", "event_id", F.col("event_type").alias("text"))


_MESSAGES = """m as (
  select user_id, case when cast(regexp_extract(props, '"k": ([0-9]+)', 1) as int) % 3 = 0 then 'studio' else 'customer' end as role, ts, event_id, event_type as text from events
)"""
_SCORE = f"""with {_MESSAGES}, w as (
  select *, case when lag(role) over o is null or role <> lag(role) over o or epoch_us(ts) - epoch_us(lag(ts) over o) > 900000000 then 1 else 0 end as fresh,
         row_number() over (partition by user_id, role order by ts desc, event_id desc) as back,
         row_number() over (partition by user_id order by ts desc, event_id desc) as last
  from m window o as (partition by user_id order by ts, event_id)
), g as (
  select user_id, count(*) filter (role = 'customer' and text = 'purchase') as buys, count(*) filter (role = 'customer' and text = 'click') as urgent,
         count(*) filter (role = 'customer' and text = 'signup') as again, count(*) filter (role = 'customer' and back <= 10 and text = 'error') as no,
         count(*) filter (role = 'customer') as cust, sum(fresh) as turns, max(ts) as t1, min(ts) as t0,
         max(case when last = 1 then role end) as last_role, max(case when role = 'customer' and back = 1 then text end) as last_text
  from w group by user_id
), p as (
  select *, greatest(0, cast(floor((epoch_us(timestamp '2024-02-01 00:00:00') // 1000000 - epoch_us(t1) // 1000000) / 86400.0) as int)) as rec,
         greatest(0, cast(floor((epoch_us(t1) // 1000000 - epoch_us(t0) // 1000000) / 86400.0) as int)) as span from g
), q as (
  select user_id, least(35, buys * 9) as purchase_points,
         case when rec <= 3 then least(20, least(20, urgent * 10) + 8) when rec <= 14 then least(20, least(20, urgent * 10) + 4) else least(20, urgent * 10) end as urgency_points,
         least(15, cust // 3 + least(8, turns // 4)) as interaction_points,
         least(15, (case when last_role = 'customer' then 8 else 0 end) + (case when buys > 0 and (last_role = 'customer' or last_text = 'view') then 7 else 0 end)) as followup_points,
         least(15, again * 7 + (case when span >= 30 then 4 else 0 end)) as recurrence_points, case when no > 0 then 30 else 0 end as rejection_penalty
  from p
)"""


@query(_SCORE + """ select user_id, cast(purchase_points as int) as purchase_points, cast(urgency_points as int) as urgency_points, cast(interaction_points as int) as interaction_points,
  cast(followup_points as int) as followup_points, cast(recurrence_points as int) as recurrence_points, cast(rejection_penalty as int) as rejection_penalty,
  cast(greatest(0, least(100, purchase_points + urgency_points + interaction_points + followup_points + recurrence_points - rejection_penalty)) as int) as opportunity_score from q""")
def opportunity_score(spark, sf):
    a = _analyzed(spark, sf)
    return a.select(
        "user_id", "purchase_points", "urgency_points", "interaction_points", "followup_points", "recurrence_points", "rejection_penalty",
        "opportunity_score"
    )


def _analyzed(spark, sf):
    return scoring.analyze(
        _messages(spark, sf), "2024-02-01 00:00:00", key="user_id", stamp="ts", at="ts", ordinal="event_id", text="text", message_key="event_id",
        lexicon=LEXICON
    )


def _scores(a):
    return a.select(
        "user_id", "purchase_points", "urgency_points", "interaction_points", "followup_points", "recurrence_points", "rejection_penalty",
        "opportunity_score"
    )


_NAMES = {"key": "user_id", "stamp": "ts", "at": "ts", "ordinal": "event_id", "text": "text", "message_key": "event_id", "lexicon": LEXICON}


@query(ORACLE["opportunity_score"])
def scores_by_day(spark, sf):
    """Scores carried on from the days before the middle of the events' span: the same as scores of all."""
    m = _messages(spark, sf)
    ends = m.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    noon = ends["a"] + (ends["b"] - ends["a"]) / 2 if ends["a"] else None
    after = F.coalesce(F.col("ts") >= F.lit(noon), F.lit(False))
    early = stored(scoring.carry(m.filter(~after), **_NAMES), "states")
    points = lambda rows: _scores(scoring.score(rows, "2024-02-01 00:00:00", key="user_id"))
    late = stored(points(scoring.go_on(early, m.filter(after), m, **_NAMES)), "late")
    rest = early.join(late.select(F.col("user_id").alias("k")).hint("shuffle_hash"), "k", "left_anti")
    return late.unionByName(points(rest))


@query(f"""with {_MESSAGES}, l as (
  select user_id, list({{'c': text = 'purchase', 'r': case text when 'error' then 0 when 'signup' then 1 when 'click' then 2 else 9 end}} order by ts, event_id) as x from m where role = 'customer' group by user_id
), f as (
  select user_id, list_reduce(list_transform(x, lambda e: case when e.c then 100 else 0 end + e.r),
    lambda s, e: case when s < 9 and e >= 100 then 9 when e % 100 < 9 and e % 100 <= s then e % 100 else s end, 9) as s from l
)
select u.user_id, case when coalesce(s, 9) < 9 then 'P' || s end as priority from (select distinct user_id from events) u left join f on u.user_id = f.user_id""")
def priority_fold(spark, sf):
    return _analyzed(spark, sf).select("user_id", F.col("aftersales_priority").alias("priority"))


@query(f"""with {_MESSAGES}, r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from m where role = 'customer')
select user_id, count(*) filter (text = 'error') as hits from r where k <= 10 group by user_id""")
def last_n_keyword(spark, sf):
    return scoring.last_n_hits(
        _messages(spark, sf), key="user_id", order=["ts", "event_id"], n=10, hit=F.col("text") == "error", where=F.col("role") == "customer"
    )


_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
_RUNS = "list_sort(list_distinct(list_filter(regexp_extract_all({0}, '[0-9]+'), lambda x: length(x) between 10 and 24)))"


@query(
    f"with e as (select doc_id, list_sort(list_distinct(regexp_extract_all(text, '{_EMAIL}'))) as e from documents) select doc_id, array_to_string(e, ',') as emails from e where len(e) > 0"
)
def email_extract(spark, sf):
    return _t(spark, sf, "documents").withColumn("e", tx.emails("text")).filter(F.size("e") > 0).select(
        "doc_id", F.array_join("e", ",").alias("emails")
    )


@query(
    f"with e as (select doc_id, {_RUNS.format('text')} as e from documents) select doc_id, array_to_string(e, ',') as tokens from e where len(e) > 0"
)
def digit_token_extract(spark, sf):
    return _t(spark, sf, "documents").withColumn("e", tx.digit_tokens("text")).filter(F.size("e") > 0).select(
        "doc_id", F.array_join("e", ",").alias("tokens")
    )


_STATES = f"""with e as (select source, unnest(regexp_extract_all(text, '{_EMAIL}')) as id from documents),
p as (select distinct source, id from e), s as (
  select *, count(*) over (partition by id) as ks, count(*) over (partition by source) as own from p
), b as (
  select source, id as identifier, case when ks > 1 then 'ambiguous_shared' when own = 1 then 'candidate_unique' else 'review' end as state from s
  union all select distinct source, null, 'missing' from documents where source not in (select source from p)
)"""


def _states(spark, sf):
    return identity.identifier_states(_t(spark, sf, "documents").select("source", tx.emails("text").alias("ids")), key="source", ids="ids")


@query(_STATES + " select * from b")
def shared_id_state(spark, sf):
    return _states(spark, sf)


@query(_STATES + """, r as (select source, state, identifier, list_position(['approved', 'ambiguous_shared', 'review', 'candidate_unique', 'rejected', 'missing'], state) as k from b)
select source, arg_min(state, k) as state, count(distinct case when state not in ('rejected', 'missing') then identifier end) as phones from r group by source""")
def binding_summary(spark, sf):
    return identity.binding_summary(_t(spark, sf, "documents").select("source").distinct(), _states(spark, sf), key="source")


@query()
def redact_text(spark, sf):
    d = _t(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text").unionByName(
        _t(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("url").alias("text"))
    )
    r = tx.with_redaction(d, "text", "r")
    return r.select("id", F.md5("r.text").alias("text_md5"), F.length("r.text").alias("n"), F.array_join("r.flags", ",").alias("flags"))


@query("""with w as (
  select doc_id, list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) between 10 and 24) || list_filter(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: regexp_full_match(x, '[A-Za-z]{1,5}[0-9]{7,24}')) as r from documents
), n as (
  select doc_id, list_distinct(list_filter(list_transform(r, lambda x: upper(x)), lambda x: regexp_full_match(x, '[A-Z0-9]{8,30}') and not regexp_full_match(x, '(0086)?1[3-9][0-9]{9}'))) as r from w
), k as (
  select doc_id, list_sort(list_filter(r, lambda x: len(list_filter(r, lambda y: y <> x and contains(y, x))) = 0)) as r from n
)
select doc_id, array_to_string(r, ',') as trackings from k where len(r) > 0""")
def tracking_tokens(spark, sf):
    return _t(spark, sf, "documents").withColumn("t", tx.tracking_numbers("text")).filter(F.size("t") > 0).select(
        "doc_id", F.array_join("t", ",").alias("trackings")
    )


def _phone(n):
    return F.concat(F.lit("138"), F.lpad(n.cast("string"), 8, "0"))


_EVID = """o as (select '138' || lpad(cast(o_custkey % 700 as varchar), 8, '0') as phone, 'SF' || lpad(cast(o_orderkey % 900 as varchar), 10, '0') as tracking from orders),
c as (
  select c_custkey as k, case when c_custkey % 3 = 0 then [] when c_custkey % 11 = 0 then ['138' || lpad(cast(c_custkey % 700 as varchar), 8, '0'), '138' || lpad(cast((c_custkey + 1) % 700 as varchar), 8, '0')]
    else ['138' || lpad(cast(c_custkey % 1400 as varchar), 8, '0')] end as direct,
    case when c_custkey % 2 = 0 then ['SF' || lpad(cast(c_custkey % 1800 as varchar), 10, '0')] else [] end as trackings from customer
)"""


def _evidence(spark, sf):
    k = F.col("c_custkey")
    direct = F.when(k % 3 == 0, F.array().cast("array<string>")).when(
        k % 11 == 0, F.array(_phone(k % 700), _phone((k + 1) % 700))
    ).otherwise(F.array(_phone(k % 1400)))
    sf_no = lambda n: F.concat(F.lit("SF"), F.lpad(n.cast("string"), 10, "0"))
    conv = _t(spark, sf, "customer").select(
        k.alias("key"), direct.alias("direct"),
        F.when(k % 2 == 0, F.array(sf_no(k % 1800))).otherwise(F.array().cast("array<string>")).alias("trackings")
    )
    lines = _t(spark, sf, "orders").select(_phone(F.col("o_custkey") % 700).alias("phone"), sf_no(F.col("o_orderkey") % 900).alias("tracking_no"))
    return identity.evidence_ladder(conv, lines)


@query(f"""with {_EVID}, ph as (select distinct phone from o), tp as (select tracking, list_sort(list_distinct(list(phone))) as ps from o group by tracking),
d as (select k, list_sort(list_distinct(list(x.p))) as known from (select k, unnest(direct) as p from c) x join ph on ph.phone = x.p group by k),
t as (select k, list_sort(list_distinct(flatten(list(tp.ps)))) as via, bool_or(len(tp.ps) <> 1) as amb from (select k, unnest(trackings) as t from c) x join tp on tp.tracking = x.t group by k),
j as (select c.k, list_sort(list_distinct(direct)) as dir, coalesce(known, []) as known, coalesce(via, []) as via, coalesce(amb, false) as amb from c left join d on c.k = d.k left join t on c.k = t.k),
r as (select *, case when len(dir) > 1 then 'customer_phone_order_conflict' when len(known) = 1 and (amb or (len(via) > 0 and via <> dir)) then 'customer_evidence_conflict'
  when len(known) = 1 then 'customer_phone_order_exact' when len(dir) > 0 and len(via) > 0 and via <> dir then 'customer_evidence_conflict'
  when len(dir) = 0 and not amb and len(via) = 1 then 'customer_tracking_order_exact' when amb or len(via) > 1 then 'customer_tracking_order_conflict' end as rule from j)
select k as key, case when rule like '%_exact' then 'approved' when rule is not null then 'conflict' end as state, rule, case when rule like '%_exact' then coalesce(known[1], via[1]) end as phone,
  cast(case when rule = 'customer_phone_order_exact' then 1.0 when rule = 'customer_tracking_order_exact' then 0.98 when rule is not null then 0.0 end as double) as confidence from r""")
def evidence_ladder(spark, sf):
    return _evidence(spark, sf).withColumn("confidence", F.col("confidence").cast("double"))


def _lines(spark, sf):
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = _t(spark, sf, "orders").select(
        k.cast("string").alias("record_id"),
        F.when(k % 13 == 0, "1970-01-01").when(k % 17 == 0, "soon").when(
            k % 5 == 0, F.replace(day, F.lit("-"), F.lit("/"))
        ).otherwise(day).alias("pay_date"),
        F.when(k % 19 == 0, "n/a").when(k % 7 == 0, None).otherwise(F.format_string("%.2f", "o_totalprice")).alias("revenue"),
        F.when(k % 4 == 0, "退").when(k % 9 == 0, "换").when(k % 10 == 0, "其他").otherwise("").alias("refund_type"),
        F.when(k % 8 == 0, day).alias("refund_date"),
        F.when(k % 12 == 0, "999999.99").when(k % 8 == 0, "10.005").when(k % 23 == 0, "-1").alias("refund_amount"),
        F.when(k % 6 == 0, "pending").otherwise("").alias("return_status"), F.lit(None).cast("string").alias("phone"),
    )
    return orders.normalize(o.withColumn("today", F.lit("2000-06-01").cast("date")), today="today", scrub=False)


_LINES = """with s as (
  select o_orderkey as k, strftime(o_orderdate, '%Y-%m-%d') as day, o_totalprice from orders
), i as (
  select k, case when k % 13 = 0 then 'epoch' when k % 17 = 0 then 'bad' end as pe, case when k % 13 = 0 or k % 17 = 0 then null else cast(day as date) end as pd,
    case when k % 19 = 0 then 'invalid' end as re, case when k % 19 = 0 or k % 7 = 0 then null else cast(round(cast(printf('%.2f', o_totalprice) as decimal(20, 2)) * 100) as bigint) end as rv,
    case when k % 4 = 0 then 'return' when k % 9 = 0 then 'exchange' when k % 10 = 0 then 'other' end as rt, case when k % 8 = 0 then cast(day as date) end as rd,
    case when k % 12 = 0 then 99999999 when k % 8 = 0 then 1001 when k % 23 = 0 then -100 end as rm, k % 6 = 0 as open
  from s
), v as (
  select *, pd is not null and pd <= date '2000-06-01' as pok, coalesce(rv > 0, false) as rpos from i
), n as (
  select *, pok and rpos as valid, case when rm >= 0 then rm end as rf from v
), f as (
  select cast(k as varchar) as record_id, case when valid then pd end as paid_on, case when valid then rv end as revenue_minor, rt as refund_type, cast(rf as bigint) as refund_amount_minor, rd as refund_on,
    list_sort(list_filter([case when pe is not null then 'invalid_paid_on' end, case when re is not null then 'invalid_revenue' end, case when pd > date '2000-06-01' then 'future_paid_on' end,
      case when not valid and (pok or rpos) then 'incomplete_customer_payment' end, case when rm < 0 then 'invalid_refund_amount' end, case when rd > date '2000-06-01' then 'future_refund_on' end,
      case when rt = 'return' and rd is null then 'missing_refund_on' end, case when rt = 'return' and rf is null then 'missing_refund_amount' end,
      case when valid and rf > rv then 'refund_exceeds_revenue' end, case when open then 'aftersale_open' end], lambda x: x is not null)) as flags
  from n
)"""


@query(
    _LINES + " select record_id, strftime(paid_on, '%Y-%m-%d') as paid_on, revenue_minor, refund_type, refund_amount_minor, strftime(refund_on, '%Y-%m-%d') as refund_on, array_to_string(flags, ',') as flags from f"
)
def order_normalize(spark, sf):
    return _lines(spark, sf).select(
        "record_id", F.date_format("paid_on", "yyyy-MM-dd").alias("paid_on"), "revenue_minor", "refund_type", "refund_amount_minor",
        F.date_format("refund_on", "yyyy-MM-dd").alias("refund_on"), F.array_join("quality_flags", ",").alias("flags")
    )


@query(_LINES + """, x as (select 'flag' as kind, unnest(flags) as name from f union all select 'refund_type', refund_type from f where refund_type is not null union all select 'total', 'lines' from f
 union all select 'total', 'paid' from f where paid_on is not null union all select 'total', 'refunded' from f where refund_on is not null) select kind, name, count(*) as rows from x group by all""")
def order_quality_summary(spark, sf):
    return orders.quality_summary(_lines(spark, sf))


@query(
    """select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1"""
)
def snapshot_dedup_latest(spark, sf):
    return sampling.latest_by(_t(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as k from events where event_type = 'purchase')
select user_id, event_id, row_number() over (order by k, user_id) as rank from r""")
def round_robin_sample(spark, sf):
    e = _t(spark, sf, "events").filter("event_type = 'purchase'").select("user_id", "event_id", "value")
    return sampling.round_robin(e, member="user_id", order=[F.desc("value"), F.col("event_id")]).select("user_id", "event_id", "rank")


@query("""with a as (select *, strftime(ts, '%Y-%m') as month, row_number() over (partition by strftime(ts, '%Y-%m'), event_type, user_id order by ts, event_id) as a from events),
b as (select *, row_number() over (partition by month, event_type order by a, user_id) as b from a)
select month, event_type, user_id, event_id from b order by b, month, event_type limit 200""")
def stratified_sample(spark, sf):
    e = _t(spark, sf, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    return sampling.stratified(
        e, strata=["month", "event_type"], member="user_id", order=["ts", "event_id"], limit=200
    ).select("month", "event_type", "user_id", "event_id")


@query()
def template_select(spark, sf):
    p = _pairs(spark, sf).withColumn("customer_key", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    return sampling.select_pairs(p, secret=SECRET, limit=100).select("conv_id", "turn_no", "split", "quality_score")


@query("""with r as (select *, row_number() over (partition by regexp_replace(name, '[0-9]', '#', 'g') order by q desc, ts, k) as n from (
  select event_id, 'u' || user_id as k, event_type as name, cast(value as bigint) as q, ts from events where value is not null)) select event_id from r where n <= 3""")
def template_cap(spark, sf):
    e = _t(spark, sf, "events").filter("value is not null").select(
        "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("k"), tx.template_key_plain("event_type").alias("t"),
        F.round("value").cast("long").alias("q"), "ts"
    )
    w = Window.partitionBy("t").orderBy(F.desc("q"), "ts", "k")
    return e.withColumn("n", F.row_number().over(w)).filter("n <= 3").select("event_id")


@query("""select count(*) as total, count(toxic) as reviewed, count(*) filter (quality = 1 - toxic) as correct, round(count(*) filter (quality = 1 - toxic) / count(toxic), 6) as accuracy,
 count(*) >= 200 and count(toxic) = count(*) and count(*) filter (quality = 1 - toxic) / count(toxic) >= 0.99 as gate_open from labels""")
def calibration_summary(spark, sf):
    r = _t(spark, sf, "labels").withColumn("human", 1 - F.col("toxic"))
    return serving.calibration(r, predicted="quality", human="human")


@query("""with b as (select cast(1 - toxic as varchar) as h, cast(quality as varchar) as p from labels where toxic is not null and quality is not null), l as (select h as label from b union select p from b),
n as (select label, count(*) filter (h = label and p = label) as tp, count(*) filter (h <> label and p = label) as fp, count(*) filter (h = label and p <> label) as fn from l, b group by label)
select label, tp, fp, fn, case when tp + fp > 0 then round(tp / (tp + fp), 6) end as precision, case when tp + fn > 0 then round(tp / (tp + fn), 6) end as recall, case when 2 * tp + fp + fn > 0 then round(2 * tp / (2 * tp + fp + fn), 6) end as f1 from n""")
def confusion_summary(spark, sf):
    return serving.confusion(_t(spark, sf, "labels").withColumn("human", 1 - F.col("toxic")), predicted="quality", human="human")


@query(
    """select c_custkey, c_name, c_acctbal from customer order by case c_mktsegment when 'BUILDING' then 0 when 'MACHINERY' then 1 else 2 end, c_acctbal desc, c_custkey limit 50 offset 100"""
)
def customer_page(spark, sf):
    c = _t(spark, sf, "customer")
    first = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    return serving.page(c, [first, F.desc("c_acctbal"), F.col("c_custkey")], limit=50, offset=100).select("c_custkey", "c_name", "c_acctbal")


@query("""with r as (select c_custkey, c_acctbal, row_number() over (order by case c_mktsegment when 'BUILDING' then 0 when 'MACHINERY' then 1 else 2 end, c_acctbal desc, c_custkey) - 1 as pos from customer)
select c_custkey, c_acctbal, case when pos < 100 then 'at' else 'after' end as found, pos from r where pos between 70 and 169""")
def keyset_pages(spark, sf):
    """A page by its number, then the page after its last row, from a stored ranking of all customers."""
    c = _t(spark, sf, "customer")
    first = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    r = ranking.write(c.withColumn("rank", first), shared_path(spark, "ranking"), [("rank", True), ("c_acctbal", False), ("c_custkey", True)], rows_per_range=200)
    one = r.page_at(offset=70, limit=30)
    two = r.page_after(r.cursor(one), limit=70)
    cols = ["c_custkey", "c_acctbal", "pos"]
    return one.select(*cols, F.lit("at").alias("found")).unionByName(two.select(*cols, F.lit("after").alias("found")))


@query(
    """select 'customers' as name, count(*) as rows from customer union all select 'orders', count(*) from orders union all select 'events', count(*) from events union all select 'documents', count(*) from documents union all select 'conversations', count(*) from conversations"""
)
def health_rollup(spark, sf):
    return serving.health(
        customers=_t(spark, sf, "customer"), orders=_t(spark, sf, "orders"), events=_t(spark, sf, "events"), documents=_t(spark, sf, "documents"),
        conversations=_t(spark, sf, "conversations")
    )


_TOK = "list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z0-9_\\-]+'), lambda x: lower(x)))"
_BI = "list_distinct(list_transform(range(1, greatest(2, length({0}))), lambda i: substr({0}, i, 2)))"
_CONV = "regexp_replace(lower(text), '\\s+', '', 'g')"


@query(f"""with q as (select item_id, {_TOK.format('text')} as t, {_BI.format(_CONV)} as b from benchmark), d as (
  select conv_id * 1000 + turn as msg_id, {_TOK.format('text')} as t, {_BI.format(_CONV)} as b from conversations where role = 'assistant'
), s as (
  select item_id, msg_id, 0.45 * len(list_intersect(q.t, d.t)) / greatest(len(q.t), 1) + 0.55 * len(list_intersect(q.b, d.b)) / greatest(len(q.b), 1) as s from q, d
), r as (select *, row_number() over (partition by item_id order by round(s, 9) desc, msg_id) as k from s where s > 0)
select item_id, msg_id, round(s, 6) as score, cast(k as int) as rank from r where k <= 5""")
def overlap_search(spark, sf):
    q = _t(spark, sf, "benchmark").select("item_id", F.col("text").alias("query"))
    d = _t(spark, sf, "conversations").filter("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), F.col("text").alias("content")
    )
    return retrieval.overlap_search(q, d, qid="item_id", iid="msg_id", k=5)


@query(f"""with q as (select item_id, {_BI.format(_CONV)} as b from benchmark), d as (select conv_id * 1000 + turn as msg_id, {_BI.format(_CONV)} as b from conversations where role = 'assistant'),
s as (select item_id, msg_id, len(list_intersect(q.b, d.b)) / (len(q.b) + len(d.b) - len(list_intersect(q.b, d.b))) as s from q, d),
r as (select *, row_number() over (partition by item_id order by round(s, 9) desc, msg_id) as k from s where s > 0)
select item_id, msg_id, round(s, 6) as score, cast(k as int) as rank from r where k <= 5""")
def topk_jaccard(spark, sf):
    q = _t(spark, sf, "benchmark").select("item_id", F.col("text").alias("query"))
    d = _t(spark, sf, "conversations").filter("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), F.col("text").alias("content")
    )
    return retrieval.jaccard_search(q, d, qid="item_id", iid="msg_id", k=5)


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def anti_missing(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query(_PAIRS.replace("lag(text, 2) over w as c2", "lag(text, 2) over w as c2, lag(role, 1) over w as r1, lag(role, 2) over w as r2") + """,
u as (select conv_id, turn_no, r_text, case when c1 is null then text else
  concat_ws(chr(10), case when c2 is not null then (case r2 when 'user' then 'U: ' when 'assistant' then 'A: ' else '' end) || c2 end, (case r1 when 'user' then 'U: ' when 'assistant' then 'A: ' else '' end) || c1, 'U: ' || text) end as said from d where k = 1)
select conv_id, turn_no, md5(said) as user_md5, md5(r_text) as reply_md5 from u""")
def chatml_export(spark, sf):
    p = _pairs(spark, sf).withColumn("pair_id", F.concat_ws(":", "conv_id", "turn_no"))
    out = serving.chatml(p, "style", names=(("user", "U: "), ("assistant", "A: ")))
    m = F.from_json("line", "messages array<struct<content:string,role:string>>")["messages"]
    id_ = F.split("pair_id", ":")
    return out.select(
        id_[0].cast("long").alias("conv_id"), id_[1].cast("long").alias("turn_no"), F.md5(m[1]["content"]).alias("user_md5"),
        F.md5(m[2]["content"]).alias("reply_md5")
    )


@query("""with c as (select user_id, event_id, ts from events where event_type = 'signup'), f as (select user_id, ts as f from events where event_type = 'purchase'),
j as (select c.*, min(f.f) as f from c left join f on c.user_id = f.user_id and f.f > c.ts group by all), b as (select *, timestamp '2024-01-28 00:00:00' as seen from j)
select event_id, case when f <= ts + interval 1 day then true when seen >= ts + interval 1 day then false end as paid_1d, case when f <= ts + interval 3 day then true when seen >= ts + interval 3 day then false end as paid_3d,
 case when f <= ts + interval 7 day then true when seen >= ts + interval 7 day then false end as paid_7d from b""")
def tri_state_outcome(spark, sf):
    e = _t(spark, sf, "events")
    c = e.filter("event_type = 'signup'").select("user_id", "event_id", "ts")
    f = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("paid"))
    seen = F.lit("2024-01-28 00:00:00").cast("timestamp")
    out = cards.tri_state(c, f, key="user_id", at="ts", fact_at="paid", days={"paid_1d": 1, "paid_3d": 3, "paid_7d": 7}, observed_until=seen)
    return out.select("event_id", "paid_1d", "paid_3d", "paid_7d")


@query("""with m as (select *, case when lag(ts) over w is null or epoch_us(ts) - epoch_us(lag(ts) over w) > 86400000000 then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
t as (select *, sum(fresh) over (partition by user_id order by ts, event_id) - 1 as episode_no from m)
select user_id, cast(episode_no as bigint) as episode_no, count(*) as events from t group by all""")
def episodes(spark, sf):
    return tn.episodes(
        _t(spark, sf, "events"), key="user_id", order=["ts", "event_id"], at="ts"
    ).groupBy("user_id", "episode_no").agg(F.count("*").alias("events"))


@query(_TURNS + """, g as (select user_id, turn_no, any_value(event_type) as role, min(ts) as s, max(ts) as e from t group by user_id, turn_no),
n as (select *, lead(role) over w as nr, lead(s) over w as ns, lag(role) over w as pr from g window w as (partition by user_id order by turn_no)),
a as (select *, epoch_us(ns) // 1000000 - epoch_us(e) // 1000000 as gap from n)
select user_id, cast(turn_no as bigint) as turn_no, case when role <> 'view' then case when pr = role then 'proactive_followup' end when nr <> 'view' and gap between 0 and 1800 then 'immediate'
 when nr <> 'view' and gap between 0 and 86400 then 'delayed' when epoch_us(timestamp '2024-01-28 00:00:00') // 1000000 >= epoch_us(e) // 1000000 + 86400 then 'no_reply' else 'unobserved' end as action from a""")
def action_state(spark, sf):
    return cards.action_state(
        _event_turns(spark, sf), key="user_id", asker="view", observed_until=F.lit("2024-01-28 00:00:00").cast("timestamp")
    ).select("user_id", "turn_no", "action")


@query("""with p as (select event_type, user_id, max((value > 30)::int) as h from events group by all), n as (select event_type, count(*) as c, sum(h) as s from p group by all),
w as (select *, s / c as p, (s / c + 3.8416 / (2 * c)) / (1 + 3.8416 / c) as mid, 1.96 * sqrt(s / c * (1 - s / c) / c + 3.8416 / (4 * c * c)) / (1 + 3.8416 / c) as half from n)
select event_type, c as customers, cast(s as bigint) as hits, round(p, 6) as rate, round(mid - half, 6) as low, round(mid + half, 6) as high, c >= 30 as enough from w""")
def skill_rates(spark, sf):
    return serving.skill_rates(_t(spark, sf, "events").withColumn("hit", F.col("value") > 30), skill="event_type", customer="user_id", hit="hit")


@query("""with l as (select user_id, case when event_type = 'signup' then 'accepted' else event_type end as outcome, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events)
select user_id as draft_id, outcome from l where k = 1""")
def feedback_latest(spark, sf):
    log = _t(spark, sf, "events").select(
        F.col("user_id").alias("draft_id"), F.when(F.col("event_type") == "signup", "adopted").otherwise(F.col("event_type")).alias("outcome"),
        F.struct("ts", "event_id").alias("at")
    )
    return serving.feedback(log)


@query("""select customer.c_custkey as c_custkey, coalesce(l.state, 'pending') as state from customer left join (
  select o_custkey as c_custkey, arg_max(o_orderstatus, o_orderkey) as state from orders group by 1) l on customer.c_custkey = l.c_custkey""")
def decision_latest(spark, sf):
    log = _t(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("state"), F.col("o_orderkey").alias("decided_at")
    )
    return serving.decided(_t(spark, sf, "customer").select("c_custkey", F.lit("pending").alias("state")), log, key="c_custkey", column="state")


@query(
    """with c as (select cast(o_orderkey as varchar) as k, printf('%.3f', o_totalprice) as m from orders) select k, cast(round(cast(m as decimal(20, 3)) * 100) as bigint) as minor from c"""
)
def money_minor(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.format_string("%.3f", "o_totalprice").alias("m"))
    return o.select("k", parse.money_minor("m")["value"].alias("minor"))
