"""The whole ranker over the metrics of all items: filters, gates, review scores, floors, fallbacks, fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators import ranking as R
from marketloom.plans.metrics import METRICS_SQL, metrics
from marketloom.plans.ranking import topsis_sql
from marketloom.registry import query
from marketloom.sources.scratch import written
from marketloom.sources.tables import load

BENEFITS = R.CRITERIA[:-1]
_SCORES = {"cpu": "cpu_score", "gpu": "gpu_score", "power": "power_score", "display": "display_score", "mobility": "mobility_score", "longevity": "longevity_score", "ergonomics": "ergonomics_score", "connectivity": "connectivity_score"}
COLUMNS = {"brand": "brand", "ram_gb": "ram_gb", "storage_gb": "storage_gb", "integrated": "integrated", "panel": "panel", "touch": "touch", "refresh_hz": "hz", "cores": "cores", "weight_kg": "weight_kg", "creator": "creator"}

CAND_SQL = f"""{METRICS_SQL}, said AS (SELECT l_partkey AS item, round(50 + avg(l_discount) * 400, 4) AS reviews FROM lineitem GROUP BY 1 HAVING count(*) % 2 = 0),
cand AS (SELECT id AS item_id, {', '.join(f'{m} AS {c}' for c, m in _SCORES.items())}, coalesce(said.reviews, 75) AS reviews, effective_price AS price, effective_price AS min_price, value_score, price_status = 'IN_STOCK_ACTIVE' AS in_stock, lower(trim(coalesce(brand, ''))) AS brand,
  integrated, coalesce(hz, 60) AS hz, coalesce(ram_gb, 0) AS ram, coalesce(storage_gb, 0) AS storage, coalesce(cores, 0) AS cores, coalesce(weight_kg, 2.0) AS kg, upper(coalesce(panel, '')) AS panel, touch, gamut_tier LIKE '100%' AS creator FROM metrics LEFT JOIN said ON item = id)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with metrics and review scores (those of items with an even number of observations are overridden), written once."""
    df = metrics(spark, sf_dir).withColumns({c: F.col(m) for c, m in _SCORES.items()} | {"price": F.col("effective_price"), "creator": F.col("gamut_tier").startswith("100%"), "in_stock": F.col("price_status") == "IN_STOCK_ACTIVE"})
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.round(50 + F.avg("l_discount") * 400, 4).alias("reviews"), F.count(F.lit(1)).alias("n"))
    return written(R.reviewed(df, "id", lines.where("n % 2 = 0")).select("id", *R.CRITERIA, "value_score", "in_stock", *[c for c in dict.fromkeys(COLUMNS.values())]), "persona-pool")


def _ranked(spark: SparkSession, sf_dir: str, persona: str, budget: float, k: int, brands: list[str] | None = None, **filters) -> DataFrame:
    stock = F.col("in_stock") & F.col("price").isNotNull()
    branded, gates = R.hard_filters(COLUMNS, brands), R.PERSONA_GATES[persona].passed(COLUMNS)
    wishes = ((branded,) if brands else ()) + (gates,) + ((~F.coalesce("integrated", F.lit(True)),) if filters.get("discrete") else ())
    scope = R.Scope(stock & (F.col("price") <= budget) & branded & R.hard_filters(COLUMNS, **filters), gates, budget, fallback=stock, preferences=wishes, fallback_rows=min(3, k))
    pool = R.scoped(candidates(spark, sf_dir), scope, "price", ["id"])
    criteria = [R.Criterion(c, w, c != "price") for c, w in zip(R.CRITERIA, R.PERSONAS[persona], strict=True)]
    return R.top(R.topsis(pool, criteria), k, "score", [F.col("price"), F.col("id")]).select("id", "price", "status", "gates_relaxed", "floor", "score", "rank")


def _ranked_sql(persona: str, base: str, gates: str, budget: float, k: int, wishes: list[str]) -> str:
    f60, f45 = round(budget * 0.60, 0), round(budget * 0.45, 0)
    spare = ["w0 AS (SELECT * FROM cand WHERE in_stock AND price > 0)"]
    for n, w in enumerate(wishes):
        spare.append(f"w{n + 1} AS (SELECT * FROM w{n} WHERE ({w}) OR NOT EXISTS (SELECT 1 FROM w{n} WHERE {w}))")
    crit = [(c, w, c != "price") for c, w in zip(R.CRITERIA, R.PERSONAS[persona], strict=True)]
    return f"""WITH {CAND_SQL}, base AS (SELECT *, ({gates}) AS g FROM cand WHERE in_stock AND price <= {budget} AND {base}),
ct AS (SELECT count(*) AS nb, count(*) FILTER (g) AS ng FROM base), cr AS (SELECT *, (ng < 3 AND nb >= 3) OR (ng = 0 AND nb > 0) AS relaxed FROM ct),
kept AS (SELECT base.*, relaxed FROM base, cr WHERE relaxed OR g), kc AS (SELECT count(*) AS n, count(*) FILTER (price >= {f60}) AS n60, count(*) FILTER (price >= {f45}) AS n45 FROM kept),
fl AS (SELECT *, CAST(CASE WHEN n > 5 AND n60 >= 5 THEN {f60} WHEN n > 5 AND n45 >= 5 THEN {f45} ELSE 0 END AS DOUBLE) AS floor FROM kc), {', '.join(spare)},
pool_ AS (SELECT item_id AS id, {', '.join(R.CRITERIA)}, CASE WHEN relaxed THEN 'GATES_RELAXED_FOR_LOW_BUDGET' ELSE 'OK' END AS status, relaxed AS gates_relaxed, floor FROM kept, fl WHERE price >= floor
  UNION ALL SELECT * FROM (SELECT item_id AS id, {', '.join(R.CRITERIA)}, 'BUDGET_TOO_LOW_FOR_CATEGORY', TRUE, floor FROM w{len(wishes)}, fl WHERE n = 0 ORDER BY price, item_id LIMIT 3)),
s AS (SELECT * FROM {topsis_sql('pool_', crit, 'id, price, status, gates_relaxed, floor')})
SELECT *, CAST(row_number() OVER (ORDER BY score DESC, price, id) AS INT) AS rank FROM s ORDER BY score DESC, price, id LIMIT {k}"""


_GAMING = "NOT integrated AND hz >= 120 AND ram >= 8"


@query(_ranked_sql("gaming", "brand IN ('asus', 'hp', 'lenovo') AND ram >= 8 AND storage >= 512 AND NOT integrated", _GAMING, 60000.0, 20, []))
def topsis_persona(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three brands, memory, storage and discrete graphics for gaming within a budget."""
    return _ranked(spark, sf_dir, "gaming", 60000.0, 20, brands=["Asus", "hp ", "Lenovo"], ram_gb=8, storage_gb=512, discrete=True)


@query(_ranked_sql("content_creation", "contains(panel, 'OLED') AND touch", "ram >= 16 AND creator", 30000.0, 12, []))
def topsis_persona_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touch screens of one panel type for creators, with what gates leave."""
    return _ranked(spark, sf_dir, "content_creation", 30000.0, 12, oled=True, touch=True)


@query(_ranked_sql("gaming", "brand IN ('dell') AND NOT integrated", _GAMING, 100.0, 10, ["brand IN ('dell')", _GAMING, "NOT integrated"]))
def topsis_persona_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget that nothing fits: the cheapest of the brand, of the persona, with discrete graphics, as far as there are any."""
    return _ranked(spark, sf_dir, "gaming", 100.0, 10, brands=["Dell"], discrete=True)


def _fits_sql() -> str:
    parts = []
    for p, w in R.PERSONAS.items():
        hw = [(c, x, True) for c, x in zip(BENEFITS, w)]
        both = [*hw, ("value_", w[-1] * 1.5, True)]
        parts.append(f"SELECT h.id, '{p}' AS persona, h.score AS hardware_fit, v.score AS value_fit, h.price FROM {topsis_sql('dm', hw, 'id, price')} h JOIN {topsis_sql('dm', both, 'id')} v ON v.id = h.id")
    return f"""WITH {CAND_SQL}, dm AS MATERIALIZED (SELECT item_id AS id, {', '.join(BENEFITS)}, coalesce(nullif(value_score, 0), 50) AS value_, price FROM cand), f AS ({' UNION ALL '.join(parts)})
SELECT id, persona, hardware_fit, value_fit, CASE WHEN price >= 10000 THEN round(15.0 + 82.5 / (1.0 + exp(greatest(-60.0, least(60.0, -2.5 * (greatest(1, hardware_fit) / (price / 1000.0) - 0.92))))), 2) ELSE 50 END AS persona_value FROM f"""


@query(_fits_sql())
def persona_value_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each item fits each persona by hardware, with value for money, and against its price."""
    return R.persona_fits(candidates(spark, sf_dir), ["id"], BENEFITS, "value_score", "price")
