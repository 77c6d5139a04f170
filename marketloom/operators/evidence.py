"""Text evidence: cleaning, chunks, tags, near-duplicates, selections, audits."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.merge import first_wins


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def stripped(text: Column) -> Column:
    """Without hidden details, code, markup and links."""
    t = text
    for pattern in (r"(?is)<details.*?</details>", r"(?s)```.*?```", r"`[^`]*`", r"<[^>]+>", r"https?://\S+"):
        t = F.regexp_replace(t, pattern, " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def sentence_chunks(text: Column, least: int = 20, longest: int = 45, window: int = 35, most: int = 8) -> Column:
    """Sentences of at least ``least`` characters; long ones in windows of words; the first ``most``."""
    sentences = F.filter(F.transform(F.split(text, r"[.!؟\n]\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)

    def windows(s: Column) -> Column:
        w = F.split(s, " ")
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / window).cast("int")), lambda i: F.array_join(F.slice(w, i * window + 1, window), " "))
        return F.when(F.size(w) > longest, parts).otherwise(F.array(s))

    return F.slice(F.flatten(F.transform(sentences, windows)), 1, most)


def phrase_chunks(text: Column, least_words: int = 6, least: int = 25, longest: int = 45, window: int = 32, most: int = 360) -> Column:
    """Sentences and lines of at least six words and 25 characters, cut at 360; of those of over 45 words, windows of 32."""
    lines = F.split(F.regexp_replace(F.trim(text), r"([.!?؟])\s+", "$1\n"), r"\n+")
    parts = F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: F.size(F.split(s, r"\s+")) >= least_words)

    def windows(s: Column) -> Column:
        w = F.split(s, r"\s+")
        return F.when(F.size(w) > longest, F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / window).cast("int")), lambda i: F.array_join(F.slice(w, i * window + 1, window), " "))).otherwise(F.array(s))

    fine = F.filter(F.flatten(F.transform(parts, windows)), lambda s: (F.length(s) >= least) & (F.size(F.split(s, " ")) >= least_words))
    return F.transform(fine, lambda s: F.substring(s, 1, most))


def aspects(text: Column, keywords: dict[str, list[str]]) -> Column:
    """The aspects, in order, any of whose words the text contains."""
    hits = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.lit(a)) for a, words in keywords.items()]
    return F.filter(F.array(*hits), lambda a: a.isNotNull())


def hits(text: Column, words: list[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def polarity(text: Column, pros: list[str], cons: list[str], explicit: Column | None = None) -> Column:
    """An explicit polarity, else con if more con words than pro words occur, else pro."""
    found = F.when(hits(text, cons) > hits(text, pros), "con").otherwise("pro")
    return found if explicit is None else F.coalesce(explicit, found)


def exact_duplicates(df: DataFrame, by: list[str], text: str, order: list[str], least: int = 8) -> DataFrame:
    """The first of each group's equal normalised texts of at least ``least`` characters."""
    n = normalised(F.col(text))
    return first_wins(df.where(F.length(n) >= least), [*by, n.alias("_t")], order)


#: What separates words for ``features``: all but letters, digits, the underscore and the Arabic block.
_BETWEEN = re.compile(r"[^\w\u0600-\u06ff]+")


def features(text: str) -> Counter:
    """How often each word, and each run of 3 and 4 characters of the padded text without punctuation, occurs; words and runs are told apart."""
    words = _BETWEEN.sub(" ", text.lower()).split()
    t = f" {' '.join(words)} "
    return Counter([(0, w) for w in words] + [t[k : k + n] for n in (3, 4) for k in range(len(t) - n + 1)])


def cosine(a: Counter, b: Counter) -> float:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    dot = sum(v * large[k] for k, v in small.items() if k in large)
    norm = (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    return dot / norm if norm else 0.0


def near_duplicates(df: DataFrame, by: list[str], key: list[str], text: str, order: list[str], above: float = 0.90, least: int = 8) -> DataFrame:
    """Each row's fate in its group: kept, exact or near (cosine over ``above`` with a kept one), or short.

    Greedy in order, so a group is one task; groups are conversations, products
    and the like, and a group's kept set bounds its memory.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        seen: set[str] = set()
        kept: list[Counter] = []
        fate = []
        for t in pdf[text].fillna(""):
            n = " ".join(t.lower().split())
            if len(n) < least:
                fate.append("short")
            elif n in seen:
                fate.append("exact")
            else:
                seen.add(n)
                f = features(n)
                if any(cosine(f, k) > above for k in kept):
                    fate.append("near")
                else:
                    kept.append(f)
                    fate.append("kept")
        return pdf[key].assign(fate=fate)

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in key) + ", fate string"
    return df.groupBy(*by).applyInPandas(run, schema)


def feature_sizes(text: Column) -> Column:
    """How many features a text has: distinct ones, all, and the commonest one's number."""

    @F.pandas_udf("struct<features:long,total:long,most:long>")
    def sizes(texts: pd.Series) -> pd.DataFrame:
        def three(t: str) -> tuple[int, int, int]:
            found = features(t).values()
            return len(found), sum(found), max(found, default=0)

        return pd.DataFrame([three(t or "") for t in texts], columns=["features", "total", "most"])  # one text's features at a time

    return sizes(text)


def text_cosine(a: Column, b: Column) -> Column:
    """Cosine of two texts' features; a null text has those of the empty one."""

    @F.pandas_udf("double")
    def cosines(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([cosine(features(s or ""), features(t or "")) for s, t in zip(x, y, strict=True)], dtype="float64")

    return cosines(a, b)


def next_cosines(df: DataFrame, group: str, position: str, text: str) -> DataFrame:
    """(group, position, cosine) of each row with the one at the next position of its group.

    Rows meet by group and position, so a group of any size is dealt to all
    tasks.  Rows that repeat a position are pairs of their own.
    """
    here = df.select(group, position, F.col(text).alias("_here"))
    following = df.select(group, (F.col(position) - 1).alias(position), F.col(text).alias("_next"))
    return here.join(following, [group, position]).select(group, position, text_cosine(F.col("_here"), F.col("_next")).alias("cosine"))


def best_chunks(df: DataFrame, by: list[str], score: Column, position: str, most: int = 20) -> DataFrame:
    """Each group's ``most`` best chunks, to be read in their first order."""
    w = Window.partitionBy(*by).orderBy(score.desc(), F.col(position))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def diverse(df: DataFrame, by: list[str], position: str, score: str, per_bucket: int = 10, most: int = 24) -> DataFrame:
    """Picks from the head, middle and tail of each group, up to ``per_bucket`` of each, then the best of the rest."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    n = F.row_number().over(Window.partitionBy(*by).orderBy(position))
    bucket = F.when(n * 3 <= size, 0).when(n * 3 <= size * 2, 1).otherwise(2)
    order = [F.desc(score), F.col(position)]
    placed = df.withColumn("bucket", bucket).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "bucket").orderBy(*order)))
    final = Window.partitionBy(*by).orderBy((F.col("_r") > per_bucket).cast("int"), *order)
    return placed.withColumn("_f", F.row_number().over(final)).where(F.col("_f") <= most).drop("_r", "_f")


def merged_bullets(values: Column, least: int = 12, alike: float = 0.55, most: int = 5) -> Column:
    """Bullets in order without short, repeated and alike ones (shared words over all words)."""
    words = lambda s: F.array_distinct(F.split(F.lower(s), r"\s+"))

    def add(kept: Column, b: Column) -> Column:
        near = F.exists(kept, lambda k: F.size(F.array_intersect(words(k), words(b))) / F.size(F.array_union(words(k), words(b))) > alike)
        return F.when((F.length(b) < least) | near | (F.size(kept) >= most), kept).otherwise(F.concat(kept, F.array(b)))

    return F.aggregate(values, F.array().cast("array<string>"), add)


def delta_keys(df: DataFrame, key: str, content: list[str], cache: DataFrame) -> DataFrame:
    """Each key with the hash of its content and whether the cache (key, hash) has it already."""
    now = df.select(key, F.sha2(F.to_json(F.struct(*content)), 256).alias("hash"))
    return now.join(cache.select(key, "hash", F.lit(True).alias("_known")), [key, "hash"], "left").select(key, "hash", F.coalesce("_known", F.lit(False)).alias("unchanged"))


def round_robin(df: DataFrame, order: list[Column], workers: int = 3) -> DataFrame:
    """Ranked rows dealt to workers in turn.

    The ranks come from a global order; ranges are numbered by their own tasks
    and carried on by range totals.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()})
    from marketloom.sources.scratch import written

    fixed = written(ranged, "ranked")
    first = fixed.groupBy("_p").agg(F.min("_i").alias("_lo"), F.count(F.lit(1)).alias("_c"))
    base = first.withColumn("_base", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    rank = F.col("_i") - F.col("_lo") + F.col("_base")
    return fixed.join(base, "_p").withColumns({"rank": (rank + 1).cast("long"), "worker": (rank % workers).cast("int")}).drop("_p", "_i", "_lo", "_c", "_base")


#: An aspect's score before any evidence: (gaming, other), (metal, other), or by battery.
PRIORS = {"thermals": (73.0, 76.0), "acoustics": (66.0, 76.0), "build": (82.0, 73.0), "keyboard": (76.0, 74.0), "battery": (70.0, 77.0, 62.0)}


def aspect_prior(aspect: Column) -> Column:
    """Of an item with category, gpu, battery_whr, verified_metal and material: 70 and 56 watt-hours are taken for unknown batteries of gaming and other machines."""
    gaming = F.coalesce(F.lower("category").contains("gaming"), F.lit(False)) | F.coalesce(F.lower("gpu").rlike(r"rtx\s*[345]0\d\d|gtx|radeon rx"), F.lit(False))
    metal = F.coalesce(F.col("verified_metal"), F.lit(False)) | F.coalesce(F.lower("material").contains("alum"), F.lit(False))
    hours = F.coalesce(F.nullif(F.col("battery_whr"), F.lit(0.0)), F.when(gaming, 70.0).otherwise(56.0))
    of = lambda name, which: F.when(which, PRIORS[name][0]).otherwise(PRIORS[name][1])
    usual, large, small = PRIORS["battery"]
    battery = F.when(~gaming & (hours >= 65), large).when(gaming & (hours <= 58), small).otherwise(usual)
    return F.when(aspect == "thermals", of("thermals", gaming)).when(aspect == "acoustics", of("acoustics", gaming)).when(aspect == "build", of("build", metal)).when(aspect == "keyboard", of("keyboard", metal)).when(aspect == "battery", battery)


def aspect_scores(items: DataFrame, evidence: DataFrame, key: str, keywords: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(key, aspect, score) of every item without a language model: prior, five best similarities to pro and con anchors, words for and against.

    ``items`` has a row a key with what ``aspect_prior`` reads; ``evidence`` has
    key, text and sims, a map from aspect to struct(pro, con).  The best five
    are ranked by group limits, so a task keeps five rows a group and an item
    with any number of rows is no burden.  Items without evidence get their
    prior; null texts have no words; null similarities don't count.  Words weigh
    3.2 exactly, and tenths are rounded on ten times the score: both as SQL with
    a decimal 3.2 does it, so that scores near a border fall on the same side.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    said = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)).cast("int")
    words = F.create_map(*[x for a, (pro, con) in keywords.items() for x in (F.lit(a), F.named_struct(F.lit("yes"), said(pro), F.lit("no"), said(con)))])
    seen = evidence.select(key, F.explode("sims").alias("aspect", "sim"), words.alias("words")).select(key, "aspect", "sim.pro", "sim.con", F.col("words")[F.col("aspect")].alias("w"))

    def best(side: str) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(key, "aspect").orderBy(F.col(side).desc()))
        top = seen.where(F.col(side).isNotNull()).select(key, "aspect", side).withColumn("at", at).where("at <= 5")
        return top.groupBy(key, "aspect").agg(F.avg(side).alias(f"best_{side}"))

    counts = seen.groupBy(key, "aspect").agg(F.count(F.lit(1)).alias("n"), F.sum("w.yes").alias("said_pro"), F.sum("w.no").alias("said_con"))
    every = items.withColumn("aspect", F.explode(F.array(*map(F.lit, PRIORS))))
    met = every.join(counts, [key, "aspect"], "left").join(best("pro"), [key, "aspect"], "left").join(best("con"), [key, "aspect"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    delta = ((zero("best_pro") - zero("best_con")) * 155.0 + (F.col("said_pro") - F.col("said_con")) * 32 / 10.0) * F.least(F.lit(1.0), F.greatest(F.lit(0.35), F.col("n") / 14.0))
    prior = aspect_prior(F.col("aspect"))
    bounded = lambda v, top: F.greatest(F.lit(35.0), F.least(F.lit(top), v))
    score = F.when(F.col("n") > 0, bounded(prior + delta, 95.0)).otherwise(bounded(prior, 98.0))
    return met.select(key, "aspect", (F.round(score * 10) / 10).alias("score"))
