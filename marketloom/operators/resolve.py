"""Entity resolution: blocking, compatibility, clusters, de-duplication, fusion."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.names import slug
from marketloom.functions.parsing import bound
from marketloom.operators.graph import connected_components
from marketloom.operators.merge import first_wins
from marketloom.sources.scratch import written
from marketloom.sources.tables import spread


def unknown_or(a: Column, b: Column, same: Column) -> Column:
    """True if either side is unknown (null, 0 or empty), else ``same``."""
    blank = lambda c: c.isNull() | c.cast("string").isin("", "0", "0.0")
    return blank(a) | blank(b) | F.coalesce(same, F.lit(False))


def compatible(left: str, right: str, exact: list[str], within: dict[str, float]) -> Column:
    """Rows of two aliases may be one item: each known value equal, or within its tolerance."""
    out = F.lit(True)
    for c in exact:
        a, b = F.col(f"{left}.{c}"), F.col(f"{right}.{c}")
        out = out & unknown_or(a, b, a == b)
    for c, t in within.items():
        a, b = F.col(f"{left}.{c}"), F.col(f"{right}.{c}")
        out = out & unknown_or(a, b, F.abs(a - b) <= t)
    return out


def alike_classes(df: DataFrame, key: list[str], position: str, exact: list[str], within: dict[str, float]) -> DataFrame:
    """Rows that agree in block and in all that is compared, as one class: its first row in order, and how many they are."""
    what = [*key, *exact, *within]
    return df.groupBy(*what).agg(F.min(position).alias(position), F.count(F.lit(1)).alias("members"))


def candidate_pairs(df: DataFrame, key: list[str], position: str, exact: list[str], within: dict[str, float]) -> DataFrame:
    """(first, second, first_members, second_members): classes that share a block key and are compatible, by their first rows.

    Members of a class are compatible with each other, and with all members of
    a class that is compatible with theirs, so copies make no pairs.
    """
    df = alike_classes(df, key, position, exact, within)
    a, b = df.alias("a"), df.alias("b")
    block = F.lit(True)
    for k in key:
        block = block & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    pairs = a.join(b, block & (F.col(f"a.{position}") < F.col(f"b.{position}"))).where(compatible("a", "b", exact, within))
    return pairs.select(F.col(f"a.{position}").alias("first"), F.col(f"b.{position}").alias("second"), F.col("a.members").alias("first_members"), F.col("b.members").alias("second_members"))


def key_components(df: DataFrame, node: str, keys: list[list[str]]) -> DataFrame:
    """(node, component) of rows that share any key, directly or through others.

    A key's rows are linked with its first one, so a key that many rows share
    makes as many edges, not pairs.  A key with a null part links nothing.
    """
    edges = None
    for key in keys:
        known = df.dropna(subset=key)
        star = known.join(known.groupBy(*key).agg(F.min(node).alias("_first")), key).where(F.col(node) != F.col("_first")).select(F.col("_first").alias("a"), F.col(node).alias("b"))
        edges = star if edges is None else edges.unionByName(star)
    found = connected_components(edges).withColumnRenamed("node", node)
    return df.select(node).join(found, node, "left").select(node, F.coalesce("component", node).alias("component"))


def guarded_clusters(df: DataFrame, node: str, block: str, order: list[str], accepts: Callable[[pd.Series, pd.Series], bool]) -> DataFrame:
    """Greedy clusters inside blocks: a row joins the first cluster all of whose members accept it.

    Acceptance isn't transitive, so order matters; blocks are independent and
    each is one group of pandas rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        clusters: list[list[int]] = []
        label = [0] * len(pdf)
        rows = [pdf.iloc[k] for k in range(len(pdf))]
        for k, row in enumerate(rows):
            home = next((c for c in clusters if all(accepts(row, rows[m]) for m in c)), None)
            if home is None:
                home = []
                clusters.append(home)
            home.append(k)
            label[k] = home[0]
        return pd.DataFrame({"node": pdf[node].to_numpy(), "cluster": [pdf[node].iloc[m] for m in label]})

    return df.groupBy(block).applyInPandas(run, "node long, cluster long")


def first_of_any_key(df: DataFrame, block: str, order: list[str], keys: list[str]) -> DataFrame:
    """Rows of each block that share no key value with an earlier kept row; ``order`` is unique in a block.

    Decided in rounds: a row that is the first undecided one for all its keys
    stays, and rows that share a key with it go, so no block is gathered in one
    task.  A null key links nothing.
    """
    at = df.withColumns({"_b": F.struct(block), "_p": F.struct(*order)})
    known = lambda c: F.col(c).isNotNull() & ~F.col(c).cast("string").eqNullSafe("NaN")
    entries = F.filter(F.array(*[F.when(known(c), F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v"))) for c in keys]), lambda e: e.isNotNull())
    left = written(at.select("_b", "_p", F.explode(entries).alias("e")).select("_b", "_p", "e.k", "e.v"), "undecided")
    kept = at.where(F.size(entries) == 0).select("_b", "_p")
    while left.take(1):
        heads = left.groupBy("_b", "k", "v").agg(F.min("_p").alias("head"))
        first = left.join(heads, ["_b", "k", "v"]).groupBy("_b", "_p").agg(F.min(F.col("_p") == F.col("head")).alias("all")).where("all").select("_b", "_p")
        first = written(first, "kept")
        taken = left.join(first, ["_b", "_p"], "left_semi").select("_b", "k", "v").distinct()
        gone = left.join(taken, ["_b", "k", "v"], "left_semi").select("_b", "_p").distinct()
        left = written(left.join(gone, ["_b", "_p"], "left_anti"), "undecided")
        kept = kept.unionByName(first)
    return at.join(kept, ["_b", "_p"], "left_semi").select(*df.columns)


def first_per_key(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    return first_wins(df, [key.alias("_key")], order)


def longest_match(df: DataFrame, text: str, key: list[str], patterns: DataFrame, pattern: str, value: str) -> DataFrame:
    """Each row's longest pattern that its text contains (case aside), with the pattern's value; ties by pattern.

    Every stretch of a text that is as long as some pattern is looked up by an
    equi-join, so what is joined are matches alone, whatever the number of
    patterns; of patterns with different lengths there are as many as the
    longest has characters at most.  Equal texts are looked up once, and the
    texts are spread over tasks, since each makes very many stretches.
    """
    lengths = patterns.where(F.length(pattern) > 0).agg(F.collect_set(F.length(pattern)).alias("_lengths"))  # one row
    low = F.col("_low")
    rows = df.select(*key, F.lower(F.col(text)).alias("_low"))
    texts = spread(rows.where(low.isNotNull()).select("_low").distinct(), "_low")
    at = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substring(low, i, n))).otherwise(F.array().cast("array<string>"))
    spans = texts.crossJoin(F.broadcast(lengths)).select("_low", F.explode(F.array_distinct(F.flatten(F.transform("_lengths", at)))).alias("_span"))
    hit = spans.join(patterns.select(pattern, value, F.lower(F.col(pattern)).alias("_span")), "_span")
    best = hit.groupBy("_low").agg(F.max_by(F.struct(pattern, value), F.struct(F.length(pattern), F.col(pattern))).alias("b"))
    return rows.join(best, "_low", "left").select(*key, F.col(f"b.{pattern}").alias("matched"), F.col(f"b.{value}").alias(value))


def verdict(checks: list[Column], must: list[Column]) -> Column:
    """EXACT if all checks hold, VARIANT if the necessary ones do, else NO_MATCH."""
    every = lambda cs: F.forall(F.array(*cs), lambda c: F.coalesce(c, F.lit(False)))
    return F.when(every(checks), "EXACT").when(every(must), "VARIANT").otherwise("NO_MATCH")


def best_title(title: str, strong: str, least: int = 10) -> Column:
    """Of a group's titles one that names strong parts, then the longest, then the first by alphabet."""
    t = F.col(title)
    return F.min(F.when(F.length(t) >= least, F.struct((~t.rlike(strong)).alias("w"), (-F.length(t)).alias("l"), t.alias("t"))))["t"]


def fused(value: str, order: list[str]) -> Column:
    """Of a group's values of a field the most specific: not null, with digits before without, longer, then first."""
    v = F.col(value)
    return F.min(F.when(v.isNotNull() & (v != ""), F.struct((~v.rlike("[0-9]")).alias("d"), (-F.length(v)).alias("l"), *order, v.alias("v"))))["v"]


def numbered_ids(df: DataFrame, base: str, order: list[str], into: str = "unique_id", hz: str | None = None) -> DataFrame:
    """Identifiers made unique: the first of equal ones stays, others get their refresh rate, if known, and then ``_v2``, ``_v3`` ..."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    df = df.withColumn("_n", n).withColumn("_id", F.col(base))
    if hz is not None:
        rate = F.concat(F.col(hz).cast("string"), F.lit("hz"))
        df = df.withColumn("_id", F.when((F.col("_n") > 1) & (F.col(hz) > 0) & ~F.contains(F.col(base), rate), F.concat(F.col(base), F.lit("_"), rate)).otherwise(F.col(base)))
    m = F.row_number().over(Window.partitionBy("_id").orderBy(F.col("_n") > 1, *order))
    return df.withColumn("_m", m).withColumn(into, F.when(F.col("_m") == 1, F.col("_id")).otherwise(F.concat(F.col("_id"), F.lit("_v"), F.col("_m").cast("string")))).drop("_n", "_id", "_m")


#: Processor tiers and graphics numbers that tell listings apart.
CPU_TIERS = ("i3", "i5", "i7", "i9", "ultra_5", "ultra_7", "ultra_9", "ryzen_3", "ryzen_5", "ryzen_7", "ryzen_9")
GPU_NUMBERS = ("2050", "3050", "3060", "3070", "3080", "4050", "4060", "4070", "4080", "4090", "5050", "5060", "5070", "5080", "5090")


def _other_token(a: Column, b: Column, tokens: tuple[str, ...]) -> Column:
    """Both known, neither part of the other, and one has a token where the other has a different one."""
    of = lambda x: F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(x, t))

    def clash(s: Column) -> Column:
        x, y = s["x"], s["y"]
        return (x != "") & (y != "") & ~F.contains(x, y) & ~F.contains(y, x) & F.exists(of(x), lambda t: F.exists(of(y), lambda u: u != t))

    return bound(F.struct(F.coalesce(slug(a), F.lit("")).alias("x"), F.coalesce(slug(b), F.lit("")).alias("y")), clash)


def same_hardware(left: str | Column, right: str | Column) -> Column:
    """Whether two listings (aliases, or columns that are structs) may be one machine; unknown values (null, 0, empty) never speak against it.

    Columns: ram_gb, storage_gb, vram_gb, store, mpn, hz, resolution, panel,
    touch, cpu, gpu.  Equal part numbers overrule what displays say, and one
    store's different part numbers are different machines.
    """
    a, b = [lambda c, side=side: F.col(f"{side}.{c}") if isinstance(side, str) else side[c] for side in (left, right)]
    text = lambda c: F.lower(F.trim(c))
    same_mpn = F.coalesce((a("mpn") != "") & (a("mpn") == b("mpn")), F.lit(False))
    variants = F.coalesce((a("store") != "") & (a("store") == b("store")) & (a("mpn") != "") & (b("mpn") != "") & (a("mpn") != b("mpn")), F.lit(False))
    both = lambda c, same: unknown_or(a(c), b(c), same)
    shown = both("hz", F.abs(a("hz") - b("hz")) <= 10) & both("resolution", text(a("resolution")) == text(b("resolution"))) & both("panel", text(a("panel")).contains("oled") == text(b("panel")).contains("oled")) & F.coalesce(a("touch") == b("touch"), F.lit(True))
    built = both("ram_gb", a("ram_gb") == b("ram_gb")) & both("storage_gb", F.abs(a("storage_gb") - b("storage_gb")) <= 64) & both("vram_gb", a("vram_gb") == b("vram_gb"))
    return built & ~variants & (same_mpn | shown) & ~_other_token(a("cpu"), b("cpu"), CPU_TIERS) & ~_other_token(a("gpu"), b("gpu"), GPU_NUMBERS)


def consolidated(df: DataFrame, key: str, richness: list[Column], order: list[str], lists: list[str], firsts: list[str]) -> DataFrame:
    """Per key the richest row (ties to the first in order), its rows' distinct values of ``lists``, and the first known value of ``firsts``."""
    rank = F.struct(*[(-r.cast("int")).alias(f"r{k}") for k, r in enumerate(richness)], *order)
    others = [c for c in df.columns if c not in (key, *lists, *firsts)]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))
    out = df.groupBy(key).agg(F.min_by(F.struct(*others), rank).alias("_rep"), *[F.coalesce(F.min_by(c, rank), first(c)).alias(c) for c in firsts])
    out = out.select(key, "_rep.*", *firsts)
    for c in lists:  # distinct values first, so only these are gathered
        values = df.where(F.col(c).isNotNull()).groupBy(key, c).agg(F.min(F.struct(*order)).alias("_at"))
        listed = values.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", c))), lambda x: x[c]).alias(c))
        out = out.join(listed, key, "left")
    return out


def target_rollup(df: DataFrame, key: str, order: list[str], lists: list[str], modal: str) -> DataFrame:
    """Per key its first row's order, ordered distinct lists, the modal value (ties to the first seen) and how many rows."""
    per = df.groupBy(key, modal).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(*order)).alias("at"))
    out = per.groupBy(key).agg(F.sum("c").alias("variant_count"), F.min(F.struct((-F.col("c")).alias("c"), "at", modal))[modal].alias(f"modal_{modal}"))
    for c in lists:  # distinct values first, so only these are gathered
        values = df.where(F.col(c).isNotNull()).groupBy(key, F.col(c).cast("string").alias("v")).agg(F.min(F.struct(*order)).alias("at"))
        listed = values.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]), ",").alias(f"{c}_list"))
        out = out.where(F.col(key).isNotNull()).join(listed, key, "left").withColumn(f"{c}_list", F.coalesce(f"{c}_list", F.lit("")))
    return out.select(key, *[f"{c}_list" for c in lists], "variant_count", f"modal_{modal}")
