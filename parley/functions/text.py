"""Text primitives as column expressions.

Patterns run with ``(?U)`` so that classes are Unicode's, as the rules assume.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import ship
from . import lexicons as lx
from .keys import content_digest


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def java(pattern: str) -> str:
    return "(?U)" + pattern


#: What Python's strip() takes off.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text) -> Column:
    """Without leading and trailing Unicode white space and without NULs; null becomes empty."""
    return F.btrim(F.replace(F.coalesce(_col(text), F.lit("")), F.lit("\x00"), F.lit("")), F.lit(WHITE))


def contains_any(text, words) -> Column:
    """Whether any of the words occurs; null texts hold none."""
    if not words:
        return F.lit(False)
    return F.coalesce(_col(text), F.lit("")).rlike("|".join(re.escape(w) for w in words))


def nfkc(text) -> Column:
    """NFKC has no built-in; batches go over Arrow.

    ASCII is in that form and stays where it is. Of a batch, Python holds one text at a time.
    """

    @F.arrow_udf("string")
    def run(a: pa.Array) -> pa.Array:  # inner, so that workers need no module of ours
        import unicodedata

        import pyarrow as pa

        return pa.array((unicodedata.normalize("NFKC", t.as_py()) if t.is_valid else None for t in a), pa.string(), size=len(a))

    t = _col(text)
    return F.coalesce(run(F.when(t.rlike(r"[^\x00-\x7f]"), t)), t)


def raw_identifier(text) -> Column:
    """A contact's id in normal form, stripped; null if that is empty or holds a control character."""
    t = strip(nfkc(text))
    return F.when((t != "") & ~t.rlike(r"\p{Cntrl}"), t)


def distinct_matches(text, pattern: str) -> Column:
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(java(f"({pattern})")), 1)
    return F.array_sort(F.array_distinct(found))


def mainland_phones(text) -> Column:
    return distinct_matches(text, lx.MOBILE)


def emails(text) -> Column:
    """Only texts with an @ are searched: elsewhere the pattern would try every letter."""
    return distinct_matches(F.when(F.contains(_col(text), F.lit("@")), _col(text)), dict(lx.REDACTIONS)["email"])


def digit_tokens(text) -> Column:
    return distinct_matches(text, lx.NUMERIC_TRACKING)


def normalize_phone(text) -> Column:
    """Eleven digits of a mobile number, or null."""
    bare = F.regexp_replace(strip(text), java(r"[\s()（）-]+"), "")
    bare = F.regexp_replace(bare, r"^(\+86|0086)", "")
    return F.when(bare.rlike(r"^1[3-9][0-9]{9}$"), bare)


def normalize_tracking(text) -> Column:
    """8 to 30 letters and digits, 7 digits at least and no phone number; or null."""
    bare = F.upper(F.regexp_replace(strip(text), java(r"[\s\-]+"), ""))
    digits = F.length(F.regexp_replace(bare, "[^0-9]", ""))
    return F.when(bare.rlike("^[A-Z0-9]{8,30}$") & normalize_phone(bare).isNull() & (digits >= 7), bare)


def tracking_numbers(text) -> Column:
    """Sorted numbers; those that are part of another go."""
    t = F.coalesce(_col(text), F.lit(""))
    raw = F.array_union(
        F.regexp_extract_all(t, F.lit(java(f"({lx.NUMERIC_TRACKING})")), 1), F.regexp_extract_all(t, F.lit(java(f"({lx.ALPHANUM_TRACKING})")), 1)
    )
    found = F.array_compact(F.array_distinct(F.transform(raw, normalize_tracking)))
    return F.array_sort(F.filter(found, lambda x: ~F.exists(found, lambda y: (y != x) & F.contains(y, x))))


#: What a text must hold for a pattern to have any match, by a part of the pattern that tells it from others.
_DIGIT = r"\d"
GATES = {
    "address": ("详细地址|收货地址|所在地区", "[省市州县区]"),
    "phone": ("手机号码|联系电话", _DIGIT, _DIGIT),
    "person_name": ("联系人|收件人|姓名", "联系人|收件人|姓名", "先生|女士|老师|老板"),
    "id_card": (_DIGIT,), "email": ("@",), "url": ("://",), "wechat_id": ("(?i)微信|wx|wechat",), "money": (_DIGIT,), "date": (_DIGIT,),
    "tracking_or_order_id": (_DIGIT,), "inventory_state": ("有现货|现货充足|有货|没货|无货|缺货|补货",), "logistics_state": ("发货|揽收|派送|签收|退回|拦截",),
    "refund_decision": ("退款|退钱|退货",), "delivery_promise": ("保证|肯定|一定",),
}
_PLACE = "省市区县镇街道路号小区楼室"
#: A text without any of these is only stripped, squeezed and cut; Chinese words of all patterns are in the one class.
TOUCHED = r"[\p{Nd}@一-鿿]|://|(?i:w(?:x|echat))"


class Redactor:
    """The fixed patterns, each behind its gate, and the rule for loose addresses."""

    def __init__(self):
        gates = {k: iter(v) for k, v in GATES.items()}
        self.steps = [(label, re.compile(next(gates[label])).search, re.compile(p).sub, lx.LABELS[label]) for label, p in lx.REDACTIONS]
        self.loose, self.place = re.compile(lx.LOOSE_ADDRESS), re.compile(f"[{_PLACE}]")
        self.spaces, self.breaks = re.compile(r"[ \t]+"), re.compile(r"\n{3,}")

    def __call__(self, text: str | None) -> tuple[str, list[str]]:
        """Text and sorted flags. A label may be part of a later match, so two runs differ from one."""
        now, met = (text or "").replace("\x00", "").strip(), set()
        for label, gate, replace, into in self.steps:
            if gate(now) and (after := replace(into, now)) != now:
                now = after
                met.add(label)
        if self.place.search(now):
            whole = lx.LABELS["address"]
            after = self.loose.sub(lambda m: whole if any(map(str.isdecimal, m[0])) else m[0], now)
            if after != now:
                now = after
                met.add("address")
        return self.breaks.sub("\n\n", self.spaces.sub(" ", now))[:4000], sorted(met)


_REDACTOR = Redactor()


def redacted(text: str | None) -> tuple[str, list[str]]:
    return _REDACTOR(text)


def redact(text) -> Column:
    """struct(text, flags); the workers need this package (see :func:`parley.session.ship`).

    As a chain of built-ins each step would stand in two of the next (text and flag), so that
    merged projections double with every pattern; one batch function over Arrow does not. Only
    texts that hold something of ``TOUCHED`` go there; the rest is levelled by built-ins.
    """

    @F.pandas_udf("text string, flags array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        done = [(None, None) if t is None else redacted(t) for t in s]
        return pd.DataFrame({"text": [t for t, _ in done], "flags": [f for _, f in done]})

    t = _col(text)
    through = run(F.when(t.rlike(TOUCHED), t))
    bare = strip(t)  # most texts need no more than that
    level = F.when(bare.rlike(r"[ \t]{2}|\t"), F.regexp_replace(bare, r"[ \t]+", " ")).otherwise(bare)
    level = F.when(F.contains(level, F.lit("\n\n\n")), F.regexp_replace(level, r"\n{3,}", "\n\n")).otherwise(level)
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(through["text"], F.substring(level, 1, 4000)).alias("text"), F.coalesce(through["flags"], none).alias("flags"))


def with_redaction(df, text: str, to: str = "redacted"):
    """``df`` with struct column ``to``."""
    ship(df.sparkSession)
    return df.withColumn(to, redact(F.col(text)))


def template_key(text) -> Column:
    """Digest of a text with placeholders, digits and punctuation levelled."""
    t = F.lower(nfkc(text))
    t = F.regexp_replace(t, r"\[[^\]]+\]", "[值]")
    t = F.regexp_replace(t, java(r"\d+"), "#")
    return content_digest(F.regexp_replace(t, r"[^0-9a-z一-鿿\[\]#]+", ""))


def template_key_plain(text) -> Column:
    """The same for texts known to be in normal form."""
    t = F.regexp_replace(F.lower(_col(text)), r"\[[^\]]+\]", "[值]")
    t = F.regexp_replace(t, r"[0-9]+", "#")
    return content_digest(F.regexp_replace(t, r"[^0-9a-z一-鿿\[\]#]+", ""))


def tokens(text) -> Column:
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(f"({lx.TOKEN})"), 1)
    return F.array_distinct(F.transform(found, F.lower))


def bigrams(text) -> Column:
    """Distinct pairs of characters without white space; a single character stands alone.

    The levelled text is bound once: inside a lambda it would be made anew for each pair.
    """
    bare = F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), java(r"\s+"), "")

    def pairs(t):
        some = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, 2)))
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(some)

    return F.transform(F.array(bare), pairs)[0]


def overlap_similarity(q, c) -> Column:
    """0.45 of the query's tokens and 0.55 of its bigrams found in the candidate."""
    def part(f):
        a, b = f(q), f(c)
        return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    return part(tokens) * 0.45 + part(bigrams) * 0.55


def jaccard_similarity(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def scrub_tokens(text, names: Column, label: str) -> Column:
    """Every one of the array's names replaced, longest first."""
    ordered = F.array_sort(
        names, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    )
    return F.aggregate(ordered, _col(text), lambda acc, n: F.when(F.length(n) > 0, F.replace(acc, n, F.lit(label))).otherwise(acc))


def risk_flags(text, redaction_flags: Column | None = None, risk=tuple(lx.RISK.items())) -> Column:
    found = [F.when(contains_any(text, words), name) for name, words in risk]
    if redaction_flags is not None:
        found.append(F.when(F.size(redaction_flags) > 0, "pii_or_dynamic_value"))
    return F.array_sort(F.array_compact(F.array(*found)))


def risk_level(flags: Column) -> Column:
    has = lambda *names: reduce(lambda a, b: a | b, [F.array_contains(flags, n) for n in names])
    return (
        F.when(has("complaint") & has("compensation", "refund"), "critical")
        .when(has("refund", "compensation", "inventory", "delivery_promise", "complaint"), "high")
        .when(F.size(flags) > 0, "medium").otherwise("low")
    )


def intent(text, lexicon: lx.Lexicon = lx.Lexicon()) -> Column:
    return F.when(
        contains_any(text, lexicon.p0 + lexicon.p1 + lexicon.p2), "aftersales"
    ).when(contains_any(text, lexicon.presales), "presales").otherwise("general")


def masked_phone(phone) -> Column:
    p = _col(phone)
    return F.concat(F.substring(p, 1, 1), F.lit("******"), F.right(p, F.lit(4)))


# ----- names ------------------------------------------------------------------

NAME_FIELDS = ("remark", "display_name", "nick_name")
# What stands for identifiers in a label, in order.
NAME_LABELS = ((lx.MOBILE, "[手机号]"), (r"(?<!\d)\d{6,}(?!\d)", "[编号]"), (dict(lx.REDACTIONS)["email"], "[邮箱]"), (r"(?i)https?://\S+", "[链接]"))


def _printable(field) -> Column:
    return F.regexp_replace(F.coalesce(_col(field), F.lit("")), r"[\x00-\x1f\x7f]", "")


def display_name(key, fields=NAME_FIELDS) -> Column:
    """The first field that is more than an identifier, cleaned, in 80 characters; else the key's end."""
    shown = []
    for f in fields:
        t = _printable(f)
        for pattern, label in NAME_LABELS:
            t = F.regexp_replace(t, java(pattern), label)
        t = F.regexp_replace(F.regexp_replace(t, java(r"\s+"), " "), r"^[ \t\r\n,，;；]+|[ \t\r\n,，;；]+$", "")
        shown.append(F.when((t != "") & ~t.isin("[手机号]", "[邮箱]", "[链接]"), F.substring(t, 1, 80)))
    return F.coalesce(*shown, F.concat(F.lit("客户-"), F.right(_col(key), F.lit(8))))


def known_names(fields=NAME_FIELDS) -> Column:
    """Distinct names of 2 to 40 characters that aren't numbers; :func:`scrub_tokens` takes the longest first."""
    bare = [strip(_printable(f)) for f in fields]
    return F.array_distinct(F.array_compact(F.array(*(F.when(F.length(t).between(2, 40) & ~t.rlike(java(r"^\d+$")), t) for t in bare))))


def scrub_identifiers(text, conversation_id, senders: Column) -> Column:
    """The conversation's id and every configured sender, longest first, become a label."""
    return scrub_tokens(scrub_tokens(text, F.array(F.coalesce(_col(conversation_id), F.lit(""))), "[微信号]"), senders, "[微信号]")


def source_file(path) -> Column:
    """A relative path as it is; of an absolute one the name alone; else the message file."""
    p = F.coalesce(_col(path), F.lit(""))
    return F.when(
        p.startswith("/"), F.concat(F.lit("conversations/"), F.element_at(F.split(p, "/"), -1))
    ).when(p == "", "messages.jsonl").otherwise(p)


def checked_identifier(value: str, name: str = "identifier") -> str:
    """``value`` if it can be an identifier; else an error."""
    if not re.fullmatch(r"[A-Za-z0-9_.:-]{1,160}", value or ""):
        raise ValueError(f"{name} is no identifier")
    return value


def public_json(text, redacted_values: bool = False) -> Column:
    """A JSON text without the keys that are never shown, at any depth; with all its strings redacted if asked for.

    Other texts become null. The workers need this package (see :func:`parley.session.ship`).
    """

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import json

        hidden = re.compile(lx.SENSITIVE_KEY)

        def shown(v):
            if isinstance(v, dict):
                return {k: shown(x) for k, x in v.items() if not hidden.search(k)}
            if isinstance(v, list):
                return [shown(x) for x in v]
            return redacted(v)[0] if redacted_values and isinstance(v, str) else v

        def one(t):
            try:
                return json.dumps(shown(json.loads(t)), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            except (TypeError, ValueError):
                return None

        return s.map(one)

    return run(_col(text))


def asks_for_facts(text) -> Column:
    """Whether an answer needs facts that change: prices, stock, deliveries, refunds."""
    return contains_any(F.lower(F.coalesce(_col(text), F.lit(""))), lx.DYNAMIC_FACT)
