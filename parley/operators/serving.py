"""Lists, decisions, gates and exports over the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_PAGE, LARGEST_PAGE = 50, 200


def page(rows: DataFrame, order: list, *, limit=DEFAULT_PAGE, offset=0) -> DataFrame:
    """One page; the order must end in a key, so that pages don't overlap."""
    if not 1 <= limit <= LARGEST_PAGE or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset 0 or more")
    return rows.orderBy(*order).offset(offset).limit(limit)


def level_order(col="opportunity_level") -> Column:
    return F.when(F.col(col) == "high", 0).when(F.col(col) == "medium", 1).otherwise(2)


def customer_list(rows: DataFrame, *, level: str | None = None, aftersales: bool | None = None, key="customer_key", **paging) -> DataFrame:
    if level:
        rows = rows.filter(F.col("opportunity_level") == level)
    if aftersales is not None:
        rows = rows.filter(F.col("aftersales_priority").isNotNull() if aftersales else F.col("aftersales_priority").isNull())
    return page(rows, [level_order(), F.desc("opportunity_score"), F.desc("last_active_at"), F.col(key)], **paging)


def style_list(rows: DataFrame, *, status: str | None = None, **paging) -> DataFrame:
    if status:
        rows = rows.filter(F.col("review_status") == status)
    return page(rows, [F.when(F.col("review_status") == "pending", 0).otherwise(1), F.desc("created_at"), F.col("pair_id")], **paging)


def decided(rows: DataFrame, log: DataFrame, *, key: str, column: str, at="decided_at") -> DataFrame:
    """``rows`` with the latest decision of an append-only log in ``column``."""
    last = log.groupBy(key).agg(F.max_by(column, at).alias("__d"))
    return rows.join(last, key, "left").withColumn(column, F.coalesce("__d", column)).drop("__d")


def approve_binding(bindings: DataFrame, binding_id: str, *, key="customer_key") -> DataFrame:
    """One binding approved and its siblings rejected, but for those that name no phone (``missing``)."""
    own = bindings.filter(F.col("binding_id") == binding_id).select(F.col(key).alias("__k"))
    rows = bindings.join(own, F.col(key) == F.col("__k"), "left")
    state = F.when(F.col("binding_id") == binding_id, "approved").when(
        F.col("__k").isNotNull() & (F.col("state") != "missing"), "rejected"
    ).otherwise(F.col("state"))
    return rows.withColumn("state", state).drop("__k")


def calibration(rows: DataFrame, *, predicted: str, human: str, least=200, accuracy=0.99) -> DataFrame:
    """One row: total, reviewed, correct, accuracy and whether the gate is open."""
    one = rows.agg(F.count("*").alias("total"), F.count(human).alias("reviewed"), F.count_if(F.col(human) == F.col(predicted)).alias("correct"))
    acc = F.when(F.col("reviewed") > 0, F.round(F.col("correct") / F.col("reviewed"), 6))
    gate = (F.col("total") >= least) & (F.col("reviewed") == F.col("total")) & (F.coalesce(acc, F.lit(0.0)) >= accuracy)
    return one.select("total", "reviewed", "correct", acc.alias("accuracy"), gate.alias("gate_open"))


def confusion(rows: DataFrame, *, predicted: str, human: str) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1)."""
    both = rows.filter(F.col(human).isNotNull() & F.col(predicted).isNotNull())
    one = both.select(
        F.explode(F.array_distinct(F.array(F.col(human).cast("string"), F.col(predicted).cast("string")))).alias("label"),
        F.col(human).cast("string").alias("h"), F.col(predicted).cast("string").alias("p")
    )
    n = one.groupBy("label").agg(
        F.count_if((F.col("h") == F.col("label")) & (F.col("p") == F.col("label"))).alias("tp"),
        F.count_if((F.col("h") != F.col("label")) & (F.col("p") == F.col("label"))).alias("fp"),
        F.count_if((F.col("h") == F.col("label")) & (F.col("p") != F.col("label"))).alias("fn")
    )
    safe = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select(
        "label", "tp", "fp", "fn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def wilson(hits: Column, n: Column, z=1.96) -> Column:
    """struct(low, high) of a rate; null without rows."""
    p, zz = hits / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.struct(F.round(mid - half, 6).alias("low"), F.round(mid + half, 6).alias("high")))


def skill_rates(rows: DataFrame, *, skill: str, customer: str, hit: str, least=30) -> DataFrame:
    """Rate per skill over independent customers, with its interval and whether there are enough."""
    per = rows.groupBy(skill, customer).agg(F.max(F.col(hit).cast("int")).alias("h"))
    n = per.groupBy(skill).agg(F.count("*").alias("customers"), F.sum("h").alias("hits"))
    ci = wilson(F.col("hits"), F.col("customers"))
    return n.select(
        skill, "customers", "hits", F.round(F.col("hits") / F.col("customers"), 6).alias("rate"), ci["low"].alias("low"), ci["high"].alias("high"),
        (F.col("customers") >= least).alias("enough")
    )


def gates(**results: DataFrame) -> DataFrame:
    """(gate, open) of one-row frames with a column gate_open."""
    out = None
    for name, df in results.items():
        row = df.select(F.lit(name).alias("gate"), F.col("gate_open").alias("open"))
        out = row if out is None else out.unionByName(row)
    return out


def chatml(pairs: DataFrame, system: str, *, id_="pair_id", names=(("customer", "客户："), ("studio", "工作室："))) -> DataFrame:
    """(id, line): approved pairs of low risk as chat records."""
    def line(m):
        who = F.lit("")
        for role, label in names:
            who = F.when(m["role"] == role, F.lit(label)).otherwise(who)
        return F.concat(who, m["text"])
    before = F.array_join(F.transform("context", line), "\n")
    user = F.when(F.size("context") > 0, F.concat(before, F.lit("\n"), F.lit(names[0][1]), F.col("trigger_text"))).otherwise(F.col("trigger_text"))
    msg = lambda role, text: F.struct(text.alias("content"), F.lit(role).alias("role"))
    body = F.struct(F.array(msg("system", F.lit(system)), msg("user", user), msg("assistant", F.col("reply_text"))).alias("messages"))
    return pairs.select(id_, F.to_json(body).alias("line"))


def chatml_ready(pairs: DataFrame, open_gate: bool) -> DataFrame:
    """Approved low-risk pairs, none while the calibration gate is closed."""
    return pairs.filter(F.lit(open_gate) & (F.col("review_status") == "approved") & (F.col("risk_level") == "low"))


def health(**tables: DataFrame) -> DataFrame:
    """(name, rows) of tables."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def feedback(log: DataFrame) -> DataFrame:
    """(draft_id, outcome): the latest outcome; ``adopted`` counts as accepted."""
    one = F.when(F.col("outcome") == "adopted", "accepted").otherwise(F.col("outcome"))
    return log.groupBy("draft_id").agg(F.max_by(one, "at").alias("outcome"))
