"""Review documents: formats, chunks by source, summaries, profiles and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight and number of chunks taken by kind of source.
SOURCES = {"editorial": (1.10, 10), "transcript": (1.15, 65), "post": (1.00, 25), "comment": (0.95, 5)}


def format_of(columns: list[str]) -> Column:
    """B2 with de-duplicated chunks, B1 with a profile, A with raw sources, else unknown; by what is there."""
    has = lambda c: F.col(c).isNotNull() if c in columns else F.lit(False)
    return F.when(has("deduplicated_chunks"), "B2").when(has("nlp_review_profile"), "B1").when(has("videos") | has("discussions") | has("editorial"), "A").otherwise("unknown")


def chunks(df: DataFrame, key: str, arrays: dict[str, str]) -> DataFrame:
    """One row per chunk: key, source, position, text, weight.

    ``arrays`` names the array column of each kind of source.  Comments weigh
    more with their likes, up to 0.2; blank chunks and those beyond a kind's
    number are left out.
    """
    out = None
    for kind, column in arrays.items():
        weight, most = SOURCES[kind]
        rows = df.select(key, F.posexplode(F.slice(F.col(column), 1, most)).alias("position", "c"))
        gain = F.least(F.lit(0.2), F.col("c.likes") * 0.01) if kind == "comment" else F.lit(0.0)
        rows = rows.select(key, F.lit(kind).alias("source"), "position", F.trim(F.col("c.text")).alias("text"), (weight + gain).alias("weight")).where("text != ''")
        out = rows if out is None else out.unionByName(rows)
    return out


def short_question(text: Column) -> Column:
    return (F.length(text) < 60) & F.trim(text).endswith("?")


def summary(df: DataFrame, arrays: list[str]) -> DataFrame:
    """How many entries a batch has by kind."""
    return df.agg(*[F.sum(F.when(F.col(a).isNotNull(), F.size(a)).otherwise(0)).cast("long").alias(a) for a in arrays])


def fanned_out(profiles: DataFrame, ids: str, position: str, values: list[str]) -> DataFrame:
    """Each matched id's profile; of several the last by position."""
    long = profiles.select(F.explode(ids).alias("id"), position, *values)
    return long.groupBy("id").agg(F.max(F.struct(position, *values)).alias("m")).select("id", *[F.col(f"m.{v}").alias(v) for v in values])


def record(df: DataFrame, key: str, score: str, text: str, order: list[str]) -> DataFrame:
    """Per key the mean score and its distinct texts in order, joined by bars."""
    per = df.groupBy(key, text).agg(F.min(F.struct(*order)).alias("at"), F.sum(score).alias("s"), F.count(score).alias("c"))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct("at", F.col(text).alias("t"))))), lambda x: x["t"])
    mean = F.when(F.sum("c") > 0, F.sum("s") / F.sum("c"))
    return per.groupBy(key).agg(F.round(mean, 2).alias("score"), F.array_join(texts, " | ").alias("document"))


def aligned(en: Column, ar: Column) -> Column:
    """The first list, cut to the length of the second if both have entries and it is longer."""
    both = (F.size(en) > 0) & (F.size(ar) > 0) & (F.size(en) > F.size(ar))
    return F.when(both, F.slice(en, 1, F.greatest(F.size(ar), F.lit(1)))).otherwise(en)


def arabic_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^\\u0600-\\u06FF]", ""))


def hydrated(results: DataFrame, local: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """Results of a remote ranking with local rows beside them; ``fields`` gives each field's precedence over ``r.`` and ``l.``."""
    joined = results.alias("r").join(local.alias("l"), F.col(f"r.{key}") == F.col(f"l.{key}"), "left")
    return joined.select(F.col(f"r.{key}").alias(key), *[c.alias(n) for n, c in fields.items()])


def quarantined(df: DataFrame, errors: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and the others with the names of their errors."""
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in errors.items()]), lambda e: e.isNotNull())
    marked = df.withColumn("errors", found)
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def list_merge(a: Column, b: Column) -> Column:
    """Both lists' entries without repeats, case aside, in order."""
    both = F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    return F.aggregate(both, F.array().cast("array<string>"), lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(x)), kept).otherwise(F.concat(kept, F.array(x))))


#: The order in which kinds of sources are shown; others come last.
SOURCE_ORDER = ("editorial", "youtube", "community")


def ordered_sources(df: DataFrame, group: Column, key: str) -> DataFrame:
    """Sources (url, kind, title, views) with title and URL, the first of each URL, and their rank in their group: by kind, views and title."""
    whole = df.where((F.coalesce(F.length("title"), F.lit(0)) > 0) & (F.coalesce(F.length("url"), F.lit(0)) > 0)).withColumns({"_url": F.rtrim(F.lower("url"), F.lit("/")), "_group": group})
    first = whole.groupBy("_url").agg(F.min(key).alias(key))
    kept = whole.join(first, ["_url", key], "left_semi")
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.col("kind")), F.lit(0)), F.lit(len(SOURCE_ORDER) + 1))
    order = Window.partitionBy("_group").orderBy(place, F.desc("views"), "title", key)
    return kept.withColumn("rank", F.row_number().over(order)).drop("_url", "_group")


def by_platform(targets: DataFrame, posts: DataFrame, key: str, platform: str, platforms: list[str]) -> DataFrame:
    """Every target with the number of each platform's posts for it, 0 if there are none."""
    counts = posts.groupBy(key).agg(*[F.count_if(F.col(platform) == p).alias(p) for p in platforms])
    return targets.join(counts, key, "left").na.fill(0, platforms)
