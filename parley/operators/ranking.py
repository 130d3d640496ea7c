"""Rankings kept in order, so that a page reads the ranges that hold it and nothing else.

A ranking is written once, in ranges of its order, with a small table of the ranges: where
each starts, how many rows it has and its first row's key. A page by offset finds its
ranges by their starts, a page after a cursor (the key of the last row shown) by their
first keys. Either reads those ranges alone, however far behind the page is, while a sort
with an offset sorts all rows each time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .serving import DEFAULT_PAGE, LARGEST_PAGE

Order = list[tuple[str, bool]]  # column, ascending; the last column makes rows distinct


def _sorts(order: Order) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in order]


def behind(order: Order, cursor: tuple, prefix: str = "") -> Column:
    """Whether a row comes strictly after ``cursor``. Nulls come first where the order ascends, last where it descends."""
    out, same = F.lit(False), F.lit(True)
    for (name, up), value in zip(order, cursor, strict=True):
        c, v = F.col(prefix + name), F.lit(value)
        if value is None:
            later = c.isNotNull() if up else F.lit(False)
        else:
            later = F.coalesce(c > v, F.lit(False)) if up else F.coalesce(c < v, F.lit(True))
        out |= same & later
        same &= c.eqNullSafe(v)
    return out


@dataclass(frozen=True)
class Ranking:
    spark: SparkSession
    path: str
    order: Order
    schema: StructType  # of the stored rows

    @property
    def ranges(self) -> DataFrame:
        """(range, start, rows, first): one row for each range."""
        return self.spark.read.parquet(f"{self.path}/ranges")

    def _page(self, ranges: DataFrame, where, limit: int) -> DataFrame:
        """The first ``limit`` rows for which where(row position) holds, in the ranges named."""
        found = {r["range"]: r["start"] for r in ranges.select("range", "start").collect()}  # as many as hold a page
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").filter(F.col("range").isin(*found))
        start = F.lit(0).cast("long")
        for r, at in found.items():
            start = F.when(F.col("range") == r, F.lit(at)).otherwise(start)
        rows = rows.withColumn("pos", start + F.col("n"))
        return rows.filter(where).orderBy("pos").limit(limit).drop("n", "range")

    def page_at(self, *, offset: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the order, with their position ``pos``."""
        _check(limit, offset)
        hit = self.ranges.filter((F.col("start") < offset + limit) & (F.col("start") + F.col("rows") > offset))
        return self._page(hit, F.col("pos") >= offset, limit)

    def page_after(self, cursor: tuple, *, limit: int = DEFAULT_PAGE) -> DataFrame:
        """The ``limit`` rows after the key ``cursor``; its own row may be gone."""
        _check(limit)
        r = self.ranges
        # the last range that doesn't begin after the cursor, and what follows until the page is full
        own = r.filter(~behind(self.order, cursor, "first.")).agg(F.max("range")).first()[0]
        own = -1 if own is None else own
        full = r.filter(F.col("range") <= own).agg(F.max(F.col("start") + F.col("rows"))).first()[0] or 0
        hit = r.filter((F.col("range") >= own) & (F.col("start") < full + limit))
        return self._page(hit, behind(self.order, cursor), limit)

    def cursor(self, page: DataFrame) -> tuple | None:
        """The key of a page's last row; None if the page is empty."""
        last: Row | None = page.orderBy(F.desc("pos")).select(*(c for c, _ in self.order)).first()
        return None if last is None else tuple(last)


def _check(limit: int, offset: int = 0) -> None:
    if not 1 <= limit <= LARGEST_PAGE or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset 0 or more")


def write(rows: DataFrame, path: str, order: Order, *, rows_per_range: int = 100_000) -> Ranking:
    """``rows`` in order under ``path``, which must not exist; columns range, n and pos are the ranking's own.

    One shuffle by ranges of the order. Ranges are cut by a sample, so their sizes vary. Rows
    with equal keys keep together, in any order.
    """
    if taken := {"range", "n", "pos"} & set(rows.columns):
        raise ValueError(f"columns are taken: {sorted(taken)}")
    spark = rows.sparkSession
    n = max(1, -(-rows.count() // rows_per_range))
    sorts = _sorts(order)
    parts = rows.repartitionByRange(n, *sorts).sortWithinPartitions(*sorts)
    # the id has the task's number above 33 bits of the row's place in it
    at = F.monotonically_increasing_id()
    parts = parts.withColumn("__at", at).withColumns({"range": F.shiftright("__at", 33).cast("int"), "n": F.col("__at").bitwiseAND((1 << 33) - 1)})
    parts = parts.drop("__at")
    parts.write.partitionBy("range").parquet(f"{path}/rows")
    back = spark.read.schema(parts.schema).parquet(f"{path}/rows")
    sizes = back.groupBy("range").agg(F.count("*").alias("rows"))
    first = back.filter("n = 0").select("range", F.struct(*(c for c, _ in order)).alias("first"))
    before = F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # one row for each range
    ranges = sizes.join(first, "range").withColumn("start", F.coalesce(before, F.lit(0)))
    ranges.coalesce(1).write.parquet(f"{path}/ranges")
    return Ranking(spark, path, order, parts.schema)
