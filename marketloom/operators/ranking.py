"""Multi-criteria ranking: vector-normalised distance to the ideal, pools, weights and personas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.scoring import calibrated_value

#: Criteria of the catalog ranking; the price is a cost, all others are benefits.
CRITERIA = ["cpu", "gpu", "power", "display", "mobility", "longevity", "ergonomics", "connectivity", "reviews", "price"]

#: The personas' weights, in the order of CRITERIA.
PERSONAS = {
    "gaming": [0.15, 0.30, 0.13, 0.13, 0.03, 0.05, 0.02, 0.03, 0.06, 0.10],
    "ai_and_game_dev": [0.19, 0.26, 0.11, 0.10, 0.03, 0.09, 0.03, 0.03, 0.06, 0.10],
    "programming": [0.24, 0.06, 0.08, 0.10, 0.11, 0.13, 0.07, 0.05, 0.06, 0.10],
    "content_creation": [0.19, 0.21, 0.09, 0.23, 0.05, 0.05, 0.03, 0.03, 0.06, 0.06],
    "student_and_office": [0.15, 0.03, 0.05, 0.10, 0.22, 0.07, 0.11, 0.04, 0.06, 0.17],
    "business_and_mobility": [0.15, 0.03, 0.05, 0.11, 0.28, 0.05, 0.13, 0.06, 0.06, 0.08],
    "balanced": [0.19, 0.17, 0.08, 0.13, 0.09, 0.07, 0.05, 0.04, 0.06, 0.12],
}


@dataclass(frozen=True)
class Gates:
    """What a persona demands; None demands nothing."""

    discrete_gpu: bool = False
    min_refresh_hz: float | None = None
    min_ram_gb: float | None = None
    min_cores: float | None = None
    max_weight_kg: float | None = None
    creator_display: bool = False

    def relaxed_for(self, budget: float | None) -> Gates:
        """Low budgets demand less: below 35 000 memory of 8 GB, below 30 000 neither discrete graphics nor a fast display."""
        from dataclasses import replace

        g = self
        if budget is not None and budget < 35_000 and g.min_ram_gb is not None:
            g = replace(g, min_ram_gb=min(g.min_ram_gb, 8))
        if budget is not None and budget < 30_000:
            g = replace(g, discrete_gpu=False, min_refresh_hz=None)
        return g

    def passed(self, columns: dict[str, str]) -> Column:
        """``columns`` names integrated, refresh_hz, ram_gb, cores, weight_kg, creator; unknown values fail or have the usual default."""
        c = lambda k, d: F.coalesce(F.col(columns[k]), F.lit(d))
        out = F.lit(True)
        if self.discrete_gpu:
            out = out & ~c("integrated", True)
        for k, least, default in (("refresh_hz", self.min_refresh_hz, 60), ("ram_gb", self.min_ram_gb, 0), ("cores", self.min_cores, 0)):
            if least is not None:
                out = out & (c(k, default) >= least)
        if self.max_weight_kg is not None:
            out = out & (c("weight_kg", 2.0) <= self.max_weight_kg)
        return out & c("creator", False) if self.creator_display else out


#: The personas' gates.
PERSONA_GATES = {
    "gaming": Gates(discrete_gpu=True, min_refresh_hz=120, min_ram_gb=8),
    "ai_and_game_dev": Gates(discrete_gpu=True, min_ram_gb=16),
    "programming": Gates(min_ram_gb=16, min_cores=6),
    "content_creation": Gates(min_ram_gb=16, creator_display=True),
    "student_and_office": Gates(min_ram_gb=8, max_weight_kg=2.35),
    "business_and_mobility": Gates(min_ram_gb=8, max_weight_kg=1.90),
    "balanced": Gates(min_ram_gb=8),
}


def resolved_weights(base: dict[str, float], custom: dict[str, float] | None = None, boosts: dict[str, float] | None = None) -> dict[str, float]:
    """Base weights, known custom ones over them, boosts added, scaled to the sum 1, to four digits."""
    w = {k: (custom or {}).get(k, v) for k, v in base.items()}
    w = {k: v + (boosts or {}).get(k, 0.0) for k, v in w.items()}
    total = sum(w.values())
    total = total if total > 0 else 1.0
    return {k: round(v / total, 4) for k, v in w.items()}


def blended(personas: list[str]) -> dict[str, float]:
    """The mean weights of several personas, to four digits."""
    return {c: round(sum(PERSONAS[p][k] for p in personas) / len(personas), 4) for k, c in enumerate(CRITERIA)}


@dataclass(frozen=True)
class Criterion:
    column: str
    weight: float
    benefit: bool = True


def _one_row(df: DataFrame, criteria: list[Criterion], by: list[str]) -> DataFrame:
    """Norm, least and greatest value of each criterion: everything scores need of the whole pool, in one pass."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for k, c in enumerate(criteria):
        x = F.col(c.column).cast("double")
        aggs += [F.sqrt(F.sum(x * x)).alias(f"_n{k}"), F.min(x).alias(f"_a{k}"), F.max(x).alias(f"_z{k}")]
    return df.groupBy(*by).agg(*aggs)


def _deviations(joined: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """Squared distances of each normalised value from the pool's ends, ``_lo`` and ``_hi``, before weights."""
    out = {}
    for k, c in enumerate(criteria):
        x, n = F.col(c.column).cast("double"), F.when(F.col(f"_n{k}") == 0, 1.0).otherwise(F.col(f"_n{k}"))
        out |= {f"_lo{k}": F.pow((x - F.col(f"_a{k}")) / n, 2), f"_hi{k}": F.pow((x - F.col(f"_z{k}")) / n, 2)}
    return joined.withColumns(out)


def _distances(criteria: list[Criterion], weights: list[float]) -> tuple[Column, Column]:
    """Distances to the ideal and the anti-ideal row; a negative weight turns a criterion round."""
    total = sum(weights)
    total = total if total > 0 else 1.0
    near, far = F.lit(0.0), F.lit(0.0)
    for k, (c, w) in enumerate(zip(criteria, weights, strict=True)):
        share = (w / total) ** 2
        up = c.benefit == (w >= 0)
        near, far = near + share * F.col(f"_hi{k}" if up else f"_lo{k}"), far + share * F.col(f"_lo{k}" if up else f"_hi{k}")
    return F.sqrt(near), F.sqrt(far)


def _score(near: Column, far: Column, rows: Column) -> Column:
    """0 to 100: nearness to the ideal row against the anti-ideal one; 100 in a pool of one."""
    return F.round(F.when(rows == 1, 100.0).when(near + far > 1e-12, far / (near + far) * 100).otherwise(50.0), 2)


def topsis(df: DataFrame, criteria: list[Criterion], into: str = "score", by: list[str] | None = None) -> DataFrame:
    """``df`` with a score by distance to the ideal, within groups ``by`` if given.

    One aggregate gives the pool's norms and extremes; as a single row (or one a
    group) it is joined back.  A pool of one row scores 100.
    """
    by = by or []
    stats = _one_row(df, criteria, by)
    joined = _deviations(df.join(stats, by) if by else df.crossJoin(F.broadcast(stats)), criteria)
    near, far = _distances(criteria, [c.weight for c in criteria])
    scored = joined.withColumns({"_near": near, "_far": far}).withColumn(into, _score(F.col("_near"), F.col("_far"), F.col("_rows")))
    return scored.drop("_rows", "_near", "_far", *[f"_{s}{k}" for s in ("n", "a", "z", "lo", "hi") for k in range(len(criteria))])


def persona_scores(df: DataFrame, key: list[str], criteria: list[Criterion], weights: dict[str, list[float]]) -> DataFrame:
    """Scores of every row for every set of weights; the pool is read once, as norms and deviations don't depend on weights."""
    joined = _deviations(df.crossJoin(F.broadcast(_one_row(df, criteria, []))), criteria)
    sets = []
    for p, w in weights.items():
        near, far = _distances(criteria, w)
        sets.append(F.struct(F.lit(p).alias("persona"), near.alias("near"), far.alias("far")))
    rows = joined.select(*key, "_rows", F.explode(F.array(*sets)).alias("p"))
    return rows.select(*key, "p.persona", _score(F.col("p.near"), F.col("p.far"), F.col("_rows")).alias("score"))


def top(df: DataFrame, k: int, score: str, order: list[Column]) -> DataFrame:
    """The ``k`` best, with their rank; ties by ``order``."""
    best = df.orderBy(F.desc(score), *order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *order)))  # of k rows


@dataclass(frozen=True)
class Scope:
    """How the pool to rank is chosen."""

    base: Column
    gates: Column
    max_budget: float
    min_budget: float | None = None
    smart_floor: bool = True
    least_for_floor: int = 5
    least_for_gates: int = 3
    fallback: Column = field(default_factory=lambda: F.lit(True))
    #: What fallback rows should satisfy, first things first; each holds as long as some row is left. The gates, if not given.
    preferences: tuple[Column, ...] | None = None
    fallback_rows: int = 3


def scoped(df: DataFrame, scope: Scope, price: str, order: list[str]) -> DataFrame:
    """The rows to rank, with status, gates_relaxed and floor.

    Gates are given up if they leave too few rows of a sufficient base.  Of a
    pool large enough the cheap end goes: rows below 60 % of the budget, or
    below 45 %, if enough remain.  Without any row the cheapest of the fallback
    rows stand in, with a status that says so.  All counts come from one pass.
    """
    b, g, p = F.coalesce(scope.base, F.lit(False)), F.coalesce(scope.gates, F.lit(False)), F.col(price)
    floors = [round(scope.max_budget * 0.60, 0), round(scope.max_budget * 0.45, 0)]
    wishes = (g,) if scope.preferences is None else tuple(F.coalesce(w, F.lit(False)) for w in scope.preferences)
    met = F.lit(0)
    for k, w in enumerate(wishes):
        met = met + F.when(w, 1 << k).otherwise(0)
    flagged = df.withColumns({"_b": b, "_g": b & g, "_f": F.coalesce(scope.fallback, F.lit(False)) & (p > 0), "_m": met})
    aggs = [F.count_if(c).alias(f"c{c}") for c in ("_b", "_g")]
    # For every set of wishes, how many fallback rows satisfy it.
    aggs.append(F.array(*[F.count_if(F.col("_f") & (F.col("_m").bitwiseAND(k) == k)) for k in range(1 << len(wishes))]).alias("_sets"))
    aggs += [F.count_if(F.col(c) & (p >= f)).alias(f"c{c}{k}") for c in ("_b", "_g") for k, f in enumerate(floors)]
    counts = flagged.agg(*aggs)
    relaxed = ((F.col("c_g") < scope.least_for_gates) & (F.col("c_b") >= scope.least_for_gates)) | ((F.col("c_g") == 0) & (F.col("c_b") > 0))
    counts = counts.withColumn("_relaxed", relaxed)
    pick = lambda s: F.when(F.col("_relaxed"), F.col(f"c_b{s}")).otherwise(F.col(f"c_g{s}"))
    floor = F.lit(float(scope.min_budget or 0.0))
    if scope.min_budget is None and scope.smart_floor:
        for k in (1, 0):
            floor = F.when((pick("") > scope.least_for_floor) & (pick(str(k)) >= scope.least_for_floor), floors[k]).otherwise(floor)
    wanted = F.lit(0)
    for k in range(len(wishes)):
        more = wanted.bitwiseOR(1 << k)
        wanted = F.when(F.get("_sets", more) > 0, more).otherwise(wanted)
    counts = counts.select("_relaxed", pick("").alias("_pool"), floor.alias("floor"), wanted.alias("_wanted"))
    rows = flagged.crossJoin(F.broadcast(counts))
    mine = F.when(F.col("_relaxed"), F.col("_b")).otherwise(F.col("_g")) & (p >= F.col("floor"))
    status = F.when(F.col("_pool") == 0, "BUDGET_TOO_LOW_FOR_CATEGORY").when(F.col("_relaxed"), "GATES_RELAXED_FOR_LOW_BUDGET").otherwise("OK")
    ranked = rows.where((F.col("_pool") > 0) & mine)
    spare = rows.where((F.col("_pool") == 0) & F.col("_f") & (F.col("_m").bitwiseAND(F.col("_wanted")) == F.col("_wanted"))).orderBy(p, *order).limit(scope.fallback_rows)
    out = ranked.unionByName(spare)
    return out.withColumns({"status": status, "gates_relaxed": F.col("_relaxed") | (F.col("_pool") == 0)}).drop("_b", "_g", "_f", "_m", "_relaxed", "_pool", "_wanted")


def hard_filters(columns: dict[str, str], brands: list[str] | None = None, ram_gb: float | None = None, storage_gb: float | None = None, discrete: bool | None = None, oled: bool = False, touch: bool = False) -> Column:
    """What a user insists on; ``columns`` names brand, ram_gb, storage_gb, integrated, panel, touch, and unknown values fail."""
    c = lambda k, d: F.coalesce(F.col(columns[k]), F.lit(d))
    out = F.lit(True)
    if brands:
        out = out & F.lower(F.trim(c("brand", ""))).isin(*[b.lower().strip() for b in brands])
    if ram_gb:
        out = out & (c("ram_gb", 0) >= ram_gb)
    if storage_gb:
        out = out & (c("storage_gb", 0) >= storage_gb)
    if discrete is not None:
        out = out & (~c("integrated", True) if discrete else c("integrated", True))
    if oled:
        out = out & F.upper(c("panel", "")).contains("OLED")
    return out & c("touch", False) if touch else out


def reviewed(df: DataFrame, key: str, overrides: DataFrame | None = None, score: str = "reviews", neutral: float = 75.0) -> DataFrame:
    """``df`` with its review score replaced by that of ``overrides`` (``key``, ``score``; one row a key), and the neutral one where there is none."""
    own = F.col(score) if score in df.columns else F.lit(None).cast("double")
    if overrides is None:
        return df.withColumn(score, F.coalesce(own, F.lit(neutral)))
    given = overrides.select(F.col(key).alias("_key"), F.col(score).cast("double").alias("_given"))
    joined = df.join(given, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(score, F.coalesce("_given", own, F.lit(neutral))).drop("_key", "_given")


def persona_fits(df: DataFrame, key: list[str], benefits: list[str], value: str, price: str) -> DataFrame:
    """hardware_fit, value_fit and persona_value of every row for every persona.

    The first is the score over all benefits, the second has the value for money
    (null counts as 50) beside them with one and a half times the price's
    weight, and the third sets the first against the price.
    """
    rows = df.withColumn("_value", F.coalesce(F.nullif(F.col(value), F.lit(0.0)), F.lit(50.0)))
    shares = {p: dict(zip(CRITERIA, w, strict=True)) for p, w in PERSONAS.items()}
    hardware = persona_scores(rows, [*key, price], [Criterion(c, 1.0) for c in benefits], {p: [w[c] for c in benefits] for p, w in shares.items()})
    both = persona_scores(rows, key, [Criterion(c, 1.0) for c in [*benefits, "_value"]], {p: [*[w[c] for c in benefits], w["price"] * 1.5] for p, w in shares.items()})
    out = hardware.withColumnRenamed("score", "hardware_fit").join(both.withColumnRenamed("score", "value_fit"), [*key, "persona"])
    return out.withColumn("persona_value", calibrated_value(F.greatest(F.lit(1.0), F.col("hardware_fit")), F.col(price))).drop(price)


# Prompts

#: Storage and memory sizes a prompt may ask for, largest first.
RAM_LADDER = (64, 32, 24, 16, 8)


def prompt_constraints(text: Column, boosts: dict[str, tuple[list[str], float]]) -> dict[str, Column]:
    """min_ram, min_storage, oled, touch and the boosts of a free-text wish; ``boosts`` has words and weight by criterion."""
    t = F.lower(text)
    ram, storage = F.lit(None).cast("int"), F.lit(None).cast("int")
    for gb in reversed(RAM_LADDER):
        ram = F.when(t.rlike(rf"(^|[^0-9]){gb} ?(gb|جيجا)( ram| رام)?"), gb).otherwise(ram)
    for words, gb in ((r"(^|[^0-9])512 ?(gb)?", 512), (r"(^|[^0-9])1 ?(tb|تيرا)", 1024), (r"(^|[^0-9])2 ?(tb|تيرا)", 2048)):
        storage = F.when(t.rlike(words), gb).otherwise(storage)
    out = {"min_ram": ram, "min_storage": storage, "oled": t.contains("oled") | t.contains("اوليد"), "touch": t.contains("touch") | t.contains("لمس")}
    for criterion, (words, weight) in boosts.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | t.contains(w)
        out[f"boost_{criterion}"] = F.when(hit, weight).otherwise(0.0)
    return out
