"""Prices over time: roll-ups, transitions, step-function histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.sources.tables import LEAST_PRICE, TIMELINE, timeline


def item_rollup(head: DataFrame, least_price: float = LEAST_PRICE) -> DataFrame:
    """Per item: min and max price, spread, cheapest store, stock and stores, over the best offers there are.

    Valid offers count if there are any, else all; of those the ones in stock if
    there are any.  Of equally cheap stores the first by name is named.
    """
    valid = F.coalesce(F.col("is_valid") & (F.col("price") >= least_price), F.lit(False))
    stocked = F.coalesce(F.col("in_stock"), F.lit(False))
    # 3: valid and in stock, 2: valid, 1: in stock, 0: neither.
    rank = F.when(valid & stocked, 3).when(valid, 2).when(stocked, 1).otherwise(0)
    groups = head.withColumn("_r", rank).groupBy("item_id")
    tiers = []
    for r in range(4):
        # Without stock, offers of the pool count whether in stock or not; with none valid the pool is all offers.
        mine = F.col("_r") == r
        tiers += [
            F.min(F.when(mine, F.col("price"))).alias(f"lo{r}"),
            F.max(F.when(mine, F.col("price"))).alias(f"hi{r}"),
            F.min(F.when(mine, F.struct("price", "store"))).alias(f"at{r}"),
            F.array_sort(F.collect_set(F.when(mine, F.col("store")))).alias(f"in{r}"),
        ]
    wide = groups.agg(F.count(F.lit(1)).alias("n_offers"), F.max("_r").alias("best"), *tiers)

    def chosen(stem: str) -> Column:
        return F.element_at(F.array(*[F.col(f"{stem}{r}") for r in range(4)]), F.col("best") + 1)

    has = F.col("best").isin(1, 3)
    low, high = chosen("lo"), chosen("hi")
    return wide.select(
        "item_id",
        "n_offers",
        low.alias("min_price"),
        high.alias("max_price"),
        F.round(high - low, 2).alias("price_spread"),
        chosen("at")["store"].alias("cheapest_store"),
        has.alias("in_stock"),
        F.when(has, chosen("in")).otherwise(F.array().cast("array<string>")).alias("stores"),
    )


def store_best(offers: DataFrame, least_price: float = LEAST_PRICE) -> DataFrame:
    """Per (item, store) the best offer: valid and in stock, else valid, else the first in time."""
    valid = F.coalesce(F.col("price") >= least_price, F.lit(False))
    rank = F.when(valid & F.col("in_stock"), 0).when(valid, 1).otherwise(2)
    cost = F.when(rank < 2, F.col("price")).otherwise(F.lit(0.0))
    best = F.min(F.struct(rank.alias("rank"), cost.alias("cost"), *TIMELINE, "in_stock")).alias("b")
    return offers.groupBy("item_id", "store").agg(best).select("item_id", "store", "b.price", "b.in_stock")


def overall(best: DataFrame) -> DataFrame:
    """Per item over its stores' best offers: min, max, spread, cheapest store, how many stores."""
    return best.groupBy("item_id").agg(
        F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.round(F.max("price") - F.min("price"), 2).alias("price_spread"), F.min(F.struct("price", "store"))["store"].alias("cheapest_store"), F.count(F.lit(1)).alias("stores_count"),
        F.count_if("in_stock").alias("stores_in_stock"),
    )


def overlap(observed: DataFrame) -> DataFrame:
    """Totals of a combined catalog: raw rows, unique items, items in several stores, their share."""
    per = observed.groupBy("item_id").agg(F.count(F.lit(1)).alias("raw"), F.count_distinct("store").alias("stores"))
    return per.agg(
        F.sum("raw").alias("raw_items"), F.count(F.lit(1)).alias("unique_items"), F.count_if(F.col("stores") > 1).alias("multi_store_items"), F.round(F.count_if(F.col("stores") > 1) * 100.0 / F.count(F.lit(1)), 2).alias("overlap_pct"),
    )


def transition(old: Column, new: Column, was: Column, now: Column, significant: float = 1.0) -> dict[str, Column]:
    """change_type, price_delta, is_drop, is_hike, is_stock_change of one step; stock changes take precedence."""
    stock = was != now
    delta = F.round(new - old, 2)
    moved = F.coalesce(F.abs(delta) >= significant, F.lit(False))
    kind = F.when(stock & now, "RESTOCKED").when(stock, "OUT_OF_STOCK").when(moved & (delta < 0), "PRICE_DROP").when(moved, "PRICE_HIKE").otherwise("UNCHANGED")
    return {
        "change_type": kind,
        "price_delta": F.when(new.isNotNull() & (stock | moved), delta).otherwise(F.lit(0.0)),
        "is_drop": moved & (delta < 0),
        "is_hike": moved & (delta > 0),
        "is_stock_change": stock,
    }


def price_steps(obs: DataFrame, significant: float = 1.0) -> DataFrame:
    """Each observation after a pair's first, with what changed since the one before."""
    w = timeline("item_id", "store")
    steps = obs.withColumns({"old_price": F.lag("price").over(w), "was_in_stock": F.lag("in_stock").over(w)}).where("old_price IS NOT NULL")
    return steps.withColumns(transition(F.col("old_price"), F.col("price"), F.col("was_in_stock"), F.col("in_stock"), significant))


def check_outcome(status: Column, old: Column, new: Column, was: Column, now: Column) -> Column:
    """The kind of change a price check found: gone pages and failed fetches before transitions."""
    return (
        F.when(status.isin(404, 410), F.when(was, "OUT_OF_STOCK").otherwise("UNCHANGED"))
        .when(status.isNull() | (status != 200), "ERROR")
        .when(new.isNull() & (was == now), "ERROR")
        .otherwise(transition(old, new, was, now)["change_type"])
    )


def trusted(obs: DataFrame, least_price: float = LEAST_PRICE) -> DataFrame:
    return obs.where(F.col("price") >= least_price)


def collapsed(points: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Points of a pair's step function: those equal in price and stock to the one before go.

    With prices of two decimals, the one before and the last one kept agree.
    """
    w = timeline("item_id", "store")
    same = (F.abs(F.lag("price").over(w) - F.col("price")) < tolerance) & (F.lag("in_stock").over(w) == F.col("in_stock"))
    return points.withColumn("_same", F.coalesce(same, F.lit(False))).where("NOT _same").drop("_same")


def clipped(points: DataFrame, cutoff: Column) -> DataFrame:
    """The part of each step function from ``cutoff`` on, with the value that holds there as first point."""
    after = points.where(F.col("recorded_at") >= cutoff).select("item_id", "store", "recorded_at", "price", "in_stock", F.lit(False).alias("is_anchor"))
    anchor = points.where(F.col("recorded_at") < cutoff).groupBy("item_id", "store").agg(F.max(F.struct(*TIMELINE, "in_stock")).alias("l"))
    return after.unionByName(anchor.select("item_id", "store", cutoff.alias("recorded_at"), "l.price", "l.in_stock", F.lit(True).alias("is_anchor")))


def baseline(head: DataFrame, history: DataFrame, least_price: float = LEAST_PRICE) -> DataFrame:
    """Two points for each offer that has no trustworthy history: where it began and its latest change.

    ``head`` has created_at, price_updated_at, previous_price besides the head
    state.
    """
    bare = head.join(trusted(history, least_price).select("item_id", "store").distinct(), ["item_id", "store"], "left_anti")
    start = F.when(F.col("previous_price") >= least_price, F.col("previous_price")).otherwise(F.col("price"))
    first = F.struct(F.col("created_at").alias("recorded_at"), start.alias("price"))
    second = F.when(F.col("price_updated_at") > F.col("created_at"), F.struct(F.col("price_updated_at").alias("recorded_at"), F.col("price").alias("price")))
    return bare.select("item_id", "store", "in_stock", F.explode(F.filter(F.array(first, second), lambda p: p.isNotNull())).alias("p")).select("item_id", "store", "p.recorded_at", "p.price", "in_stock")


def live_edge(points: DataFrame, head: DataFrame, least_price: float = LEAST_PRICE) -> DataFrame:
    """A last point for each offer checked after its last point: the head's price if trustworthy, else the last one.

    ``head`` has last_checked_at.
    """
    last = points.groupBy("item_id", "store").agg(F.max(F.struct("recorded_at", "price")).alias("l"))
    both = head.join(last, ["item_id", "store"], "left").where(F.col("last_checked_at").isNotNull() & (F.col("l").isNull() | (F.col("last_checked_at") > F.col("l.recorded_at"))))
    price = F.when(F.col("price") >= least_price, F.col("price")).otherwise(F.coalesce("l.price", "price"))
    return both.select("item_id", "store", F.col("last_checked_at").alias("recorded_at"), price.alias("price"), "in_stock")


def series_stats(points: DataFrame) -> DataFrame:
    """Per pair: lowest, highest, first and last price, change and change in percent."""
    first, last = F.min(F.struct("recorded_at", "price"))["price"], F.max(F.struct("recorded_at", "price"))["price"]
    s = points.groupBy("item_id", "store").agg(F.count(F.lit(1)).alias("n_points"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), first.alias("first_price"), last.alias("last_price"))
    change = F.round(F.col("last_price") - F.col("first_price"), 2)
    return s.withColumns({"price_change": change, "price_change_pct": F.when(F.col("first_price") != 0, F.round(change / F.col("first_price") * 100, 2)).otherwise(F.lit(0.0))})


def cross_store(series: DataFrame) -> DataFrame:
    """Per item over its stores' series (min_price, max_price, current_price, in_stock): extrema, best, order of stores."""
    stocked = F.when(F.col("in_stock"), F.struct("current_price", "store"))
    ordered = F.array_sort(F.collect_list(F.struct((~F.col("in_stock")).alias("out"), F.col("current_price").alias("p"), F.col("store").alias("s"))))
    g = series.groupBy("item_id").agg(
        F.min("min_price").alias("lowest_ever"), F.min(F.struct("min_price", "store"))["store"].alias("lowest_store"), F.max("max_price").alias("highest_ever"),
        F.coalesce(F.min(stocked), F.min(F.struct("current_price", "store"))).alias("best"), F.array_join(F.transform(ordered, lambda x: x["s"]), ",").alias("store_order"),
    )
    return g.select("item_id", "lowest_ever", "lowest_store", "highest_ever", F.col("best.current_price").alias("current_best"), F.col("best.store").alias("cheapest_store"), "store_order")


def significant_events(obs: DataFrame, least_change: float = 1.0) -> DataFrame:
    """Observations worth a history row: a pair's first, a stock flip, or a change of at least ``least_change``."""
    w = timeline("item_id", "store")
    old, was = F.lag("price").over(w), F.lag("in_stock").over(w)
    return obs.withColumns({"old_price": old, "_new": old.isNull() | (was != F.col("in_stock")) | (F.abs(F.round(F.col("price") - old, 2)) >= least_change)}).where("_new").drop("_new")


def tripped(attempts: DataFrame, order: list[str], failed: str, least: int = 5, percent: float = 20.0, streak: int = 10, by: list[str] | None = None) -> DataFrame:
    """The first attempt of each stream at which the breaker opens.

    It opens once at least ``least`` attempts were made and over ``percent`` %
    failed, or when ``streak`` failures follow one another.
    """
    by = by or []
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col(failed).cast("int")
    running = attempts.withColumns({"attempted": F.count(F.lit(1)).over(w), "failures": F.sum(bad).over(w), "_ok": F.sum(1 - bad).over(w)})
    run = Window.partitionBy(*by, "_ok").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = running.withColumn("in_a_row", F.sum(bad).over(run))
    opened = running.where(((F.col("attempted") >= least) & (F.col("failures") * 100.0 / F.col("attempted") > percent)) | (F.col("in_a_row") >= streak))
    first = opened.groupBy(*by).agg(F.min(F.struct("attempted", *order, "failures", "in_a_row")).alias("f"))
    return first.select(*by, "f.*")
