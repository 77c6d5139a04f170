"""Browsing: predicates, keyset pages, look-ups, children, feeds."""

from __future__ import annotations

import base64
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contains_term(columns: list[str], term: str | None) -> Column:
    """The trimmed, lower-cased term stands in any of the columns; no term: true.  % and _ mean themselves."""
    t = (term or "").strip().lower()
    return any_of([F.lower(F.col(c)).contains(t) for c in columns]) if t else F.lit(True)


def between(column: str, low: float | None = None, high: float | None = None) -> Column:
    """Both ends included; an end that is None is open."""
    return all_of([F.col(column) >= low] * (low is not None) + [F.col(column) <= high] * (high is not None))


def one_of(column: str, values: list[str]) -> Column:
    """Equal to one of the values, blanks around and case aside."""
    return F.lower(F.trim(F.col(column))).isin([v.strip().lower() for v in values])


def purchasable(stock: str = "in_stock", price: str = "min_price") -> Column:
    return F.col(stock) & (F.col(price) > 0)


def metric_gates(items: DataFrame, metrics: DataFrame, key: str, gates: dict[str, float]) -> DataFrame:
    """Items whose metrics reach every gate; metrics are joined only if there is a gate, and a missing one fails."""
    if not gates:
        return items
    passing = metrics.where(all_of([F.coalesce(F.col(c) >= v, F.lit(False)) for c, v in gates.items()]))
    return items.join(passing, key)


def gated(df: DataFrame, gates: dict[str, float]) -> DataFrame:
    """Rows of a source that holds its scores itself; a missing score fails, and so does one that is a boolean."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.where(all_of([F.lit(False) if kind.get(c, "boolean") == "boolean" else F.coalesce(F.col(c) >= v, F.lit(False)) for c, v in gates.items()] or [F.lit(True)]))


@dataclass(frozen=True)
class Cursor:
    """A place in the order (price, id)."""

    price: float
    id: str

    def encode(self) -> str:
        return base64.urlsafe_b64encode(f"{float(self.price)}:{self.id}".encode()).decode().rstrip("=")

    @classmethod
    def decode(cls, token: str) -> Cursor:
        try:
            price, sep, item = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)).decode().partition(":")
            value = float(price)
        except ValueError as e:
            raise ValueError(f"no cursor: {token!r}") from e
        if not sep or not item or not math.isfinite(value):
            raise ValueError(f"no cursor: {token!r}")
        return cls(value, item)


def cursor_token(price: Column, item: Column) -> Column:
    """``Cursor.encode`` as a column (for prices below 10 million, whose text has no exponent)."""
    return F.rtrim(F.translate(F.base64(F.concat(price.cast("double").cast("string"), F.lit(":"), item.cast("string")).cast("binary")), "+/", "-_"), F.lit("="))


def keyset_page(df: DataFrame, price: str, key: str, limit: int, after: tuple | None = None, before: tuple | None = None) -> DataFrame:
    """The page of ``limit`` rows after (or before) a place in (price, key), with position, has_next and has_previous.

    One more row than asked is fetched, which tells if there is another page.
    """
    p, k = F.col(price), F.col(key)
    rows = df.where(p.isNotNull())
    if after is not None:
        rows = rows.where((p > after[0]) | ((p == after[0]) & (k > after[1])))
    if before is not None:
        rows = rows.where((p < before[0]) | ((p == before[0]) & (k < before[1])))
    back = before is not None
    order = [p.desc(), k.desc()] if back else [p.asc(), k.asc()]
    fetched = rows.orderBy(*order).limit(limit + 1)
    # At most limit + 1 rows from here on.
    from pyspark.sql import Window

    w = Window.orderBy(*order)
    numbered = fetched.select("*", F.row_number().over(w).alias("_n"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_all"))
    more = F.col("_all") > limit
    size = F.least(F.col("_all"), F.lit(limit))
    place = F.when(F.lit(back), size - F.col("_n") + 1).otherwise(F.col("_n"))
    page = numbered.where(F.col("_n") <= limit)
    return page.withColumns({"position": place.cast("int"), "has_next": F.lit(True) if back else more, "has_previous": more if back else F.lit(after is not None)}).drop("_n", "_all")


def offset_page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def lookup(df: DataFrame, identifier: str, columns: list[str], order: list[str]) -> DataFrame:
    """The first row, in ``order``, whose identifier in any of the columns is the one given, case aside."""
    k = identifier.strip().lower()
    return df.where(any_of([F.lower(F.col(c).cast("string")) == k for c in columns])).orderBy(*order).limit(1)


def with_children(parents: DataFrame, children: DataFrame, key: str, into: str, columns: list[str]) -> DataFrame:
    """Parents with their children as one sorted array of structs, empty where there are none."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(into))
    return parents.join(lists, key, "left").withColumn(into, F.coalesce(F.col(into), F.array().cast(lists.schema[into].dataType)))


def stale(df: DataFrame, checked: str, key: list[str], limit: int) -> DataFrame:
    """What was checked longest ago, never checked ones first."""
    return df.where("is_valid").orderBy(F.col(checked).asc_nulls_first(), *key).limit(limit)


def change_feed(history: DataFrame, offers: DataFrame, items: DataFrame, since: Column, limit: int, store: str | None = None) -> DataFrame:
    """History since a time with its offer and its item, latest first."""
    recent = history.where(F.col("recorded_at") >= since)
    if store is not None:
        recent = recent.where(F.col("store") == store)
    return recent.join(offers, ["item_id", "store"]).join(items, "item_id").orderBy(F.desc("recorded_at"), "item_id", "store", "order_key", "line_no").limit(limit)


def taken_until(df: DataFrame, by: list[str], newest: list[str], hit: Column) -> DataFrame:
    """Each list's rows newer than the newest, by the columns ``newest``, where ``hit`` holds (all, if it never does), with their position.

    What is left is what came since the last crawl; only that is numbered.
    """
    from pyspark.sql import Window

    key = F.struct(*newest)
    stop = df.where(hit).groupBy(*by).agg(F.max(key).alias("_stop"))
    left = df.join(stop, by, "left").where(F.col("_stop").isNull() | (key > F.col("_stop"))).drop("_stop")
    return left.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in newest])))


def compare(items: DataFrame, key: str, better: dict[str, str]) -> DataFrame:
    """Items side by side: a row per metric that differs among them, with its winner.

    ``better`` says ``max`` or ``min`` by metric; of equal ones the smallest key
    wins.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(1 if b == "max" else -1).alias("sign")) for m, b in better.items()]))
    long = items.select(key, pairs.alias("m")).select(key, "m.*").where("value IS NOT NULL")
    best = F.min(F.struct((-F.col("value") * F.col("sign")).alias("o"), F.col(key).alias("k"), F.col("value").alias("v")))
    return long.groupBy("metric").agg(F.count_distinct("value").alias("distinct_values"), best.alias("b")).where("distinct_values > 1").select("metric", "distinct_values", F.col("b.k").alias("winner"), F.col("b.v").alias("best_value"))
