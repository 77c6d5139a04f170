"""Review evidence audited and de-duplicated as one run: typed chunks, kept texts, coverage per chassis, totals."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marketloom.operators import evidence as E
from marketloom.operators.merge import first_wins
from marketloom.sources.scratch import written

#: Kinds of sources in the order in which they are read; the last one isn't scraped.
KINDS = ("editorial", "discussion", "transcript", "comment", "profile")
#: Kinds whose documents count as scraped ones.
DOCUMENTS = ("editorial", "discussion", "transcript")
SYNTHETIC = "[Synthesized from"


class Audit(NamedTuple):
    chunks: DataFrame  # chassis, at, kind, doc, text, fate, polarity, explicit, aspects
    chassis: DataFrame  # one row a chassis
    totals: dict[str, int]  # counted while the two tables were written


def typed_chunks(docs: DataFrame, score: Callable[[Column], Column], most_discussion: int = 5, most_transcript: int = 20, least_comment: int = 20) -> DataFrame:
    """(chassis, at, kind, doc, text, explicit): chunks of ``docs`` (chassis, position, kind, doc, pros, cons, body).

    Of documents of a chassis and kind with one name the first counts (names
    that are null are told apart).  Editorials give their pros and cons and the
    body as a verdict, profiles pros and cons, discussions their first
    sentences, comments the body if it is long enough, transcripts the chunks
    with the highest ``score`` (ties to the first) in order.
    ``at`` orders a chassis' chunks.  A document without chunks has a row with
    a null text.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    name = F.coalesce(F.concat(F.lit("="), "doc"), F.concat(F.lit("#"), F.col("position").cast("string")))
    once = first_wins(docs.where(rank > 0).withColumn("_name", name), ["chassis", "kind", "_name"], ["position"])
    body = F.trim(F.coalesce("body", F.lit("")))
    said = lambda xs, p: F.transform(F.coalesce(F.col(xs), F.array().cast("array<string>")), lambda t: F.struct(t.alias("text"), F.lit(p).alias("explicit")))
    plain = lambda ts: F.transform(ts, lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("explicit")))
    ranked = F.array_sort(F.transform(E.sentence_chunks(body, most=500), lambda c, i: F.struct((-score(c)).alias("s"), i.alias("i"), c.alias("c"))))
    best = F.transform(F.array_sort(F.transform(F.slice(ranked, 1, most_transcript), lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c")))), lambda x: x["c"])
    chunks = (
        F.when(F.col("kind") == "editorial", F.concat(said("pros", "pro"), said("cons", "con"), plain(F.when(body != "", F.array(body)).otherwise(F.array().cast("array<string>")))))
        .when(F.col("kind") == "profile", F.concat(said("pros", "pro"), said("cons", "con")))
        .when(F.col("kind") == "discussion", plain(E.sentence_chunks(body, most=most_discussion)))
        .when(F.col("kind") == "transcript", plain(best))
        .when(F.length(body) >= least_comment, plain(F.array(body)))
    )
    flat = once.select("chassis", "position", rank.alias("r"), "kind", F.col("_name").alias("doc"), F.posexplode_outer(chunks).alias("n", "c"))
    return flat.select("chassis", F.struct("position", "r", F.coalesce("n", F.lit(0)).alias("n")).alias("at"), "kind", "doc", "c.text", "c.explicit")


def audited(docs: DataFrame, catalog: DataFrame, keywords: dict[str, list[str]], pros: list[str], cons: list[str], critical: list[str], above: float = 0.90, most_transcript: int = 20) -> Audit:
    """Evidence of every chassis (see ``typed_chunks``) de-duplicated, tagged and audited, and chassis of ``catalog`` (chassis) without any.

    Transcripts that a model wrote (``SYNTHETIC``) are left out and counted.
    Totals are observed while chunks and chassis are written, so nothing is
    read twice for them.  Rows with a null chassis are left out.  ``gaps`` and
    ``priority`` follow from counts: at most one scraped document is High
    Priority, gaps or critical aspects that nothing covers Medium Priority.
    """
    low = E.normalised
    score = lambda c: F.size(E.aspects(low(c), keywords)) * 3 + E.hits(low(c), cons + pros)
    fake = F.coalesce((F.col("kind") == "transcript") & F.trim("body").startswith(SYNTHETIC), F.lit(False))
    seen = Observation()
    given = docs.where("chassis IS NOT NULL").observe(seen, F.count_if(fake).alias("synthesized_stripped"))
    typed = written(typed_chunks(given.where(~fake), score, most_transcript=most_transcript), "typed")
    fates = _fates(typed, above)
    said = low(F.col("text"))
    counted = Observation()
    kept = F.col("fate") == "kept"
    tagged = typed.join(fates, ["chassis", "at"], "left").withColumns({"polarity": F.when(F.col("text").isNotNull(), E.polarity(said, pros, cons, F.col("explicit"))), "aspects": F.when(kept, E.aspects(said, keywords))})
    chunks = written(
        tagged.observe(
            counted,
            F.count("text").alias("input_chunks"), F.count_if(kept).alias("kept_chunks"), F.count_if(F.col("fate") == "exact").alias("exact_removed"), F.count_if(F.col("fate") == "near").alias("near_removed"),
            F.count_if(kept & F.col("explicit").isNotNull()).alias("explicit_chunks"), F.count_if(kept & F.col("explicit").isNull()).alias("inferred_chunks"),
        ),
        "chunks",
    )
    judged = Observation()
    lacks = [F.count_if(F.array_contains(c, a)).alias(f"{c}_{a}") for c in ("missing", "missing_scraped") for a in critical]
    per = _per_chassis(chunks, catalog, keywords, critical)
    levels = [F.count_if(F.col("priority") == p).alias(n) for p, n in (("High Priority", "high"), ("Medium Priority", "medium"), ("OK", "complete"))]
    chassis = written(per.observe(judged, F.count(F.lit(1)).alias("chassis"), F.count_if(~F.col("reviewed")).alias("unmatched"), F.count_if(F.col("docs") == 0).alias("no_doc"), F.count_if(F.col("docs") == 1).alias("one_doc"), *levels, *lacks), "audit")
    return Audit(chunks.where("text IS NOT NULL"), chassis, {**seen.get, **counted.get, **judged.get})


def _fates(typed: DataFrame, above: float) -> DataFrame:
    flat = typed.where("text IS NOT NULL").select("chassis", "at.*", "text")
    got = E.near_duplicates(flat, ["chassis"], ["chassis", "position", "r", "n"], "text", ["position", "r", "n"], above)
    return got.select("chassis", F.struct("position", "r", "n").alias("at"), "fate")


def _per_chassis(chunks: DataFrame, catalog: DataFrame, keywords: dict[str, list[str]], critical: list[str]) -> DataFrame:
    kept, scraped = F.col("fate") == "kept", F.col("kind") != "profile"
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    # Documents and the comments' number are told apart by name, which is the first stage's key.
    docs = chunks.where(F.col("kind").isin(*DOCUMENTS)).groupBy("chassis", "kind", "doc").agg(F.count("text").alias("n"))
    docs = docs.groupBy("chassis").agg(*[F.count_if((F.col("kind") == k) & ((F.col("n") > 0) | F.lit(k != "transcript"))).alias(f"{k}_docs") for k in DOCUMENTS])
    by = chunks.groupBy("chassis").agg(
        count((F.col("kind") == "comment") & F.col("text").isNotNull(), "comments"), count(kept, "kept"), count(F.col("fate") == "exact", "exact"), count(F.col("fate") == "near", "near"),
        *[count(kept & (F.col("polarity") == p) & (scraped if where else F.lit(True)), f"{where}{p}s") for where in ("", "scraped_") for p in ("pro", "con")],
        *[F.max(kept & F.array_contains("aspects", a) & (scraped if where else F.lit(True))).alias(f"_{where}{a}") for where in ("", "scraped_") for a in keywords],
    )
    both = by.join(docs, "chassis", "left").withColumn("reviewed", F.lit(True)).join(catalog.where("chassis IS NOT NULL").select("chassis").distinct(), "chassis", "full")
    number = ["comments", "kept", "exact", "near", "pros", "cons", "scraped_pros", "scraped_cons", *[f"{k}_docs" for k in DOCUMENTS]]
    both = both.fillna(0, number).withColumns({"reviewed": F.coalesce("reviewed", F.lit(False)), "docs": sum((F.col(f"{k}_docs") for k in DOCUMENTS), F.lit(0))})
    has = lambda where, names, yes: F.filter(F.array(*[F.when(F.coalesce(F.col(f"_{where}{a}"), F.lit(False)) == yes, F.lit(a)) for a in names]), lambda a: a.isNotNull())
    d, ap, ac, sp, sc = (F.col(c) for c in ("docs", "pros", "cons", "scraped_pros", "scraped_cons"))
    gaps = F.array_compact(F.array(
        F.when((sp == 0) & (ap < 2), "Pros").when((d > 0) & (sp == 0), "Scraped Pros"),
        F.when((sc == 0) & (ac < 2), "Cons").when((d > 0) & (sc == 0), "Scraped Cons").when(ac < 2, "Cons (<2)"),
    ))
    out = both.withColumns({"covered": F.array_sort(has("", keywords, True)), "covered_scraped": F.array_sort(has("scraped_", keywords, True)), "missing": has("", critical, False), "missing_scraped": has("scraped_", critical, False), "gaps": gaps})
    poor = (F.size("gaps") > 0) | (F.size("missing") > 0) | (F.size("missing_scraped") > 0)
    out = out.withColumn("priority", F.when(d <= 1, "High Priority").when(poor, "Medium Priority").otherwise("OK"))
    return out.select("chassis", "reviewed", "docs", *number, "covered", "covered_scraped", "missing", "missing_scraped", "gaps", "priority")
