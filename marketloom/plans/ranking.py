"""Ranking queries; ``topsis_topk`` is the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import ranking as R
from marketloom.operators.browse import purchasable
from marketloom.plans.browse import ITEMS_SQL, items, metrics
from marketloom.registry import query
from marketloom.sources.scratch import written
from marketloom.sources.tables import load

RANK = [R.Criterion("n_obs", 0.3), R.Criterion("avg_qty", 0.2), R.Criterion("avg_disc", 0.2), R.Criterion("min_price", 0.3, benefit=False)]

POOL_SQL = (
    ITEMS_SQL
    + """, metrics AS (SELECT item_id, count(*) AS n_obs, round(avg(qty), 4) AS avg_qty, round(avg(disc), 6) AS avg_disc FROM obs GROUP BY 1),
cand AS (SELECT item_id, brand, family, size, min_price, price_spread, cheapest_store, in_stock, n_obs, avg_qty, avg_disc FROM items JOIN metrics USING (item_id))"""
)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their metrics, written once: a ranking reads its pool for counts, for norms and for scores."""
    pool = items(spark, sf_dir).join(metrics(spark, sf_dir), "item_id").select("item_id", "brand", "family", "size", "min_price", "price_spread", "cheapest_store", "in_stock", "n_obs", "avg_qty", "avg_disc")
    return written(pool, "pool")


def topsis_sql(source: str, crit: list[tuple[str, float, bool]], keep: str) -> str:
    """Score rows of ``source``, straight from the definition: normalise, weigh, distances."""
    total = sum(w for _, w, _ in crit)
    norms = ", ".join(f"sqrt(sum(CAST({c} AS DOUBLE) * {c})) AS n{k}" for k, (c, _, _) in enumerate(crit))
    weighed = ", ".join(f"{c} / (CASE WHEN n{k} = 0 THEN 1 ELSE n{k} END) * {w / total!r} AS v{k}" for k, (c, w, _) in enumerate(crit))
    ideal = ", ".join(f"{'max' if b else 'min'}(v{k}) AS b{k}, {'min' if b else 'max'}(v{k}) AS w{k}" for k, (_, _, b) in enumerate(crit))
    dist = lambda x: "sqrt(" + " + ".join(f"(v{k} - {x}{k}) * (v{k} - {x}{k})" for k in range(len(crit))) + ")"
    return f"""(SELECT {keep}, round(CASE WHEN rows_ = 1 THEN 100 WHEN dn + df > 1e-12 THEN df / (dn + df) * 100 ELSE 50 END, 2) AS score FROM (
  SELECT *, {dist('b')} AS dn, {dist('w')} AS df FROM (SELECT *, {weighed} FROM {source}, (SELECT {norms}, count(*) AS rows_ FROM {source})), (SELECT {ideal} FROM (SELECT {weighed} FROM {source}, (SELECT {norms} FROM {source})))))"""


CRIT = [(c.column, c.weight, c.benefit) for c in RANK]


@query(f"WITH {POOL_SQL}, pool_ AS (SELECT * FROM cand WHERE in_stock AND min_price > 0) SELECT item_id, score FROM {topsis_sql('pool_', CRIT, 'item_id')}")
def topsis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.topsis(candidates(spark, sf_dir).where(purchasable()), RANK).select("item_id", "score")


@query(
    f"""WITH {POOL_SQL}, pool_ AS (SELECT * FROM cand WHERE in_stock AND min_price > 0), s AS (SELECT * FROM {topsis_sql('pool_', CRIT, 'item_id, brand, min_price, cheapest_store')})
SELECT *, CAST(row_number() OVER (ORDER BY score DESC, min_price, item_id) AS INT) AS rank FROM s ORDER BY score DESC, min_price, item_id LIMIT 20"""
)
def topsis_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the 20 best items in stock, by sales, quantity, discount and price."""
    scored = R.topsis(candidates(spark, sf_dir).where(purchasable()), RANK)
    return R.top(scored, 20, "score", [F.col("min_price"), F.col("item_id")]).select("item_id", "brand", "min_price", "cheapest_store", "score", "rank")


def _scoped_sql(base: str, gates: str, budget: float, fallback: str = "in_stock") -> str:
    f60, f45 = round(budget * 0.60, 0), round(budget * 0.45, 0)
    return f"""fl AS (SELECT *, coalesce({base}, FALSE) AS b, coalesce(({base}) AND ({gates}), FALSE) AS g, coalesce({fallback}, FALSE) AND min_price > 0 AS f, coalesce(({fallback}) AND ({gates}), FALSE) AND min_price > 0 AS fg FROM cand),
ct AS (SELECT count(*) FILTER (b) AS nb, count(*) FILTER (g) AS ng, count(*) FILTER (fg) AS nfg, count(*) FILTER (b AND min_price >= {f60}) AS b60, count(*) FILTER (g AND min_price >= {f60}) AS g60, count(*) FILTER (b AND min_price >= {f45}) AS b45, count(*) FILTER (g AND min_price >= {f45}) AS g45 FROM fl),
cx AS (SELECT *, (ng < 3 AND nb >= 3) OR (ng = 0 AND nb > 0) AS relaxed FROM ct),
cy AS (SELECT *, CASE WHEN relaxed THEN nb ELSE ng END AS n, CASE WHEN relaxed THEN b60 ELSE g60 END AS n60, CASE WHEN relaxed THEN b45 ELSE g45 END AS n45 FROM cx),
cz AS (SELECT *, CAST(CASE WHEN n > 5 AND n60 >= 5 THEN {f60} WHEN n > 5 AND n45 >= 5 THEN {f45} ELSE 0 END AS DOUBLE) AS floor FROM cy),
main AS (SELECT fl.*, floor, relaxed, CASE WHEN relaxed THEN 'GATES_RELAXED_FOR_LOW_BUDGET' ELSE 'OK' END AS status, relaxed AS gates_relaxed FROM fl, cz WHERE n > 0 AND CASE WHEN relaxed THEN b ELSE g END AND min_price >= floor),
spare AS (SELECT fl.*, floor, relaxed, 'BUDGET_TOO_LOW_FOR_CATEGORY' AS status, TRUE AS gates_relaxed FROM fl, cz WHERE n = 0 AND CASE WHEN nfg > 0 THEN fg ELSE f END ORDER BY min_price, item_id LIMIT 3),
pool_ AS (SELECT * FROM main UNION ALL SELECT * FROM spare)"""


def _ranked(spark: SparkSession, sf_dir: str, scope: R.Scope, k: int) -> DataFrame:
    pool = R.scoped(candidates(spark, sf_dir), scope, "min_price", ["item_id"])
    return R.top(R.topsis(pool, RANK), k, "score", [F.col("min_price"), F.col("item_id")]).select("item_id", "min_price", "status", "gates_relaxed", "floor", "score", "rank")


def _ranked_sql(base: str, gates: str, budget: float, k: int) -> str:
    return f"""WITH {POOL_SQL}, {_scoped_sql(base, gates, budget)}, s AS (SELECT * FROM {topsis_sql('pool_', CRIT, 'item_id, min_price, status, gates_relaxed, floor')})
SELECT *, CAST(row_number() OVER (ORDER BY score DESC, min_price, item_id) AS INT) AS rank FROM s ORDER BY score DESC, min_price, item_id LIMIT {k}"""


def _base(budget: float) -> R.Column:
    return F.col("in_stock") & (F.col("min_price") > 0) & (F.col("min_price") <= budget)


BASE = "in_stock AND min_price > 0 AND min_price <= {0}"


@query(_ranked_sql(BASE.format(20000.0), "size >= 20", 20000.0, 15))
def topsis_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a budget whose cheap end is cut off."""
    return _ranked(spark, sf_dir, R.Scope(_base(20000.0), F.col("size") >= 20, 20000.0, fallback=F.col("in_stock")), 15)


@query(_ranked_sql(BASE.format(20000.0), "size >= 500", 20000.0, 15))
def topsis_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With gates that nothing passes, which are given up."""
    return _ranked(spark, sf_dir, R.Scope(_base(20000.0), F.col("size") >= 500, 20000.0, fallback=F.col("in_stock")), 15)


@query(_ranked_sql(BASE.format(10.0), "size >= 20", 10.0, 15))
def topsis_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a budget nothing fits: the cheapest instead."""
    return _ranked(spark, sf_dir, R.Scope(_base(10.0), F.col("size") >= 20, 10.0, fallback=F.col("in_stock")), 15)


DECISION_SQL = """d AS (SELECT p_partkey AS id, p_partkey % 97 + 3 AS cpu, p_size * 2 AS gpu, p_partkey % 53 + 40 AS power, p_size % 17 + 60 AS display, p_partkey % 31 + 50 AS mobility, p_partkey % 11 + 70 AS longevity, p_size % 7 + 60 AS ergonomics, p_partkey % 13 + 55 AS connectivity, 75 AS reviews, p_retailprice AS price FROM part)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return load(spark, sf_dir, "part").select(
        k.alias("id"), (k % 97 + 3).alias("cpu"), (s * 2).alias("gpu"), (k % 53 + 40).alias("power"), (s % 17 + 60).alias("display"), (k % 31 + 50).alias("mobility"), (k % 11 + 70).alias("longevity"), (s % 7 + 60).alias("ergonomics"), (k % 13 + 55).alias("connectivity"),
        F.lit(75).alias("reviews"), F.col("p_retailprice").alias("price"),
    )


def _persona_sql() -> str:
    parts = [f"SELECT id, '{p}' AS persona, score FROM {topsis_sql('d', [(c, w, c != 'price') for c, w in zip(R.CRITERIA, ws, strict=True)], 'id')}" for p, ws in R.PERSONAS.items()]
    return f"WITH {DECISION_SQL} " + " UNION ALL ".join(parts)


@query(_persona_sql())
def persona_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's score for every persona."""
    return R.persona_scores(decisions(spark, sf_dir), ["id"], [R.Criterion(c, 1.0, c != "price") for c in R.CRITERIA], R.PERSONAS)


def _blend_sql() -> str:
    two = R.blended(["gaming", "programming"])
    w = R.resolved_weights(two, {"display": 0.2, "unknown": 1.0}, {"cpu": 0.14})
    return f"WITH {DECISION_SQL} SELECT id, score FROM {topsis_sql('d', [(c, v, c != 'price') for c, v in w.items()], 'id')}"


@query(_blend_sql())
def weight_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two personas' weights blended, one overridden, one boosted."""
    w = R.resolved_weights(R.blended(["gaming", "programming"]), {"display": 0.2, "unknown": 1.0}, {"cpu": 0.14})
    return R.topsis(decisions(spark, sf_dir), [R.Criterion(c, v, c != "price") for c, v in w.items()]).select("id", "score")


@query(f"WITH {DECISION_SQL}, g AS (SELECT d.*, p_brand AS brand FROM d JOIN part ON p_partkey = id), " + "b AS (SELECT DISTINCT brand FROM g) SELECT brand, max(score) AS best, CAST(count(*) AS BIGINT) AS n FROM (SELECT brand, CASE WHEN c = 1 THEN 100 WHEN dn + df > 1e-12 THEN round(df / (dn + df) * 100, 2) ELSE 50 END AS score FROM (SELECT brand, c, sqrt(pow((cpu - mx) / n1 * 0.5, 2) + pow((price - pmn) / n2 * 0.5, 2)) AS dn, sqrt(pow((cpu - mn) / n1 * 0.5, 2) + pow((price - pmx) / n2 * 0.5, 2)) AS df FROM (SELECT *, count(*) OVER w AS c, sqrt(sum(cpu * cpu) OVER w) AS n1, sqrt(sum(price * price) OVER w) AS n2, max(cpu) OVER w AS mx, min(cpu) OVER w AS mn, max(price) OVER w AS pmx, min(price) OVER w AS pmn FROM g WINDOW w AS (PARTITION BY brand)))) GROUP BY 1")
def brand_topsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores within each brand's own pool; the best of each."""
    g = decisions(spark, sf_dir).join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand")), "id")
    scored = R.topsis(g, [R.Criterion("cpu", 0.5), R.Criterion("price", 0.5, False)], by=["brand"])
    return scored.groupBy("brand").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"))


BOOSTS = {"cpu": (["the", "con"], 0.14), "display": (["and", "und"], 0.14), "mobility": (["ment"], 0.15)}


@query(
    """WITH p AS (SELECT conv_id, turn, lower(text || ' ' || (conv_id % 70) || 'GB ram ' || (turn % 3) || 'tb oled') AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(^|[^0-9])64 ?(gb|جيجا)') THEN 64 WHEN regexp_matches(t, '(^|[^0-9])32 ?(gb|جيجا)') THEN 32 WHEN regexp_matches(t, '(^|[^0-9])24 ?(gb|جيجا)') THEN 24 WHEN regexp_matches(t, '(^|[^0-9])16 ?(gb|جيجا)') THEN 16 WHEN regexp_matches(t, '(^|[^0-9])8 ?(gb|جيجا)') THEN 8 END AS min_ram,
CASE WHEN regexp_matches(t, '(^|[^0-9])2 ?(tb|تيرا)') THEN 2048 WHEN regexp_matches(t, '(^|[^0-9])1 ?(tb|تيرا)') THEN 1024 WHEN regexp_matches(t, '(^|[^0-9])512 ?(gb)?') THEN 512 END AS min_storage,
contains(t, 'oled') OR contains(t, 'اوليد') AS oled, contains(t, 'touch') OR contains(t, 'لمس') AS touch,
CASE WHEN contains(t, 'the') OR contains(t, 'con') THEN 0.14 ELSE 0 END::DOUBLE AS boost_cpu, CASE WHEN contains(t, 'and') OR contains(t, 'und') THEN 0.14 ELSE 0 END::DOUBLE AS boost_display, CASE WHEN contains(t, 'ment') THEN 0.15 ELSE 0 END::DOUBLE AS boost_mobility FROM p"""
)
def prompt_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wishes read from user turns (with sizes appended, as these texts have none)."""
    users = load(spark, sf_dir, "conversations").where("role = 'user'")
    text = F.concat("text", F.lit(" "), (F.col("conv_id") % 70).cast("string"), F.lit("GB ram "), (F.col("turn") % 3).cast("string"), F.lit("tb oled"))
    return users.select("conv_id", "turn", *[c.alias(n) for n, c in R.prompt_constraints(text, BOOSTS).items()])


@query(f"WITH {POOL_SQL} SELECT item_id, min_price FROM cand WHERE size >= 45 ORDER BY coalesce(min_price, 999999), item_id LIMIT 3")
def cheapest_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).where("size >= 45").orderBy(F.coalesce("min_price", F.lit(999999.0)), "item_id").limit(3).select("item_id", "min_price")


@query(
    f"""WITH {POOL_SQL} SELECT item_id, brand || ' ' || lower(family) || ', size ' || size AS what,
CASE WHEN price_spread >= 1000 THEN 'Best price at ' || cheapest_store || ' (' || format('{{:,}}', CAST(floor(min_price) AS BIGINT)) || '), saving ' || format('{{:,}}', CAST(floor(price_spread) AS BIGINT)) ELSE 'Available at ' || format('{{:,}}', CAST(floor(min_price) AS BIGINT)) || ' via ' || cheapest_store END AS why FROM cand WHERE in_stock"""
)
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an item is named: what it is, and where it is cheapest."""
    n = lambda c: F.format_number(F.floor(c), 0)
    saving = F.concat(F.lit("Best price at "), F.col("cheapest_store"), F.lit(" ("), n("min_price"), F.lit("), saving "), n("price_spread"))
    plain = F.concat(F.lit("Available at "), n("min_price"), F.lit(" via "), F.col("cheapest_store"))
    what = F.concat(F.col("brand"), F.lit(" "), F.lower("family"), F.lit(", size "), F.col("size").cast("string"))
    return candidates(spark, sf_dir).where("in_stock").select("item_id", what.alias("what"), F.when(F.col("price_spread") >= 1000, saving).otherwise(plain).alias("why"))
