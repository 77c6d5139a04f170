"""Audit and de-duplication of review evidence as one run."""

from marketloom.operators import audit

WORDS = {"thermals": ["thermal", "cooling", "fan"], "battery": ["battery"], "screen": ["display", "screen"], "build_quality": ["chassis", "hinge"], "performance": ["gpu", "gaming"]}
CRITICAL = ["thermals", "battery", "screen", "build_quality"]
SCHEMA = "chassis string, position long, kind string, doc string, pros array<string>, cons array<string>, body string"
PROS, CONS = ["strong", "quiet", "great"], ["flex", "drain", "average"]


def run(spark, rows, catalog=(), **how):
    return audit.audited(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(c,) for c in catalog], "chassis string"), WORDS, PROS, CONS, CRITICAL, **how)


def test_profile_and_editorial_with_a_gap_in_the_catalog(spark):
    loq = "lenovo:loq:15irx9"
    rows = [
        (loq, 0, "editorial", "https://example.com/loq-review", ["Strong cooling thermals under sustained gaming."], ["Plastic chassis flexes slightly near the keyboard."], "Great value gaming laptop with average battery endurance."),
        (loq, 1, "profile", None, ["Strong cooling thermals under sustained gaming.", "تبريد قوي تحت الضغط المستمر."], ["Average battery life when unplugged.", "عمر البطارية متوسط خارج الشاحن."], None),
    ]
    a = run(spark, rows, [loq, "hp:victus:victus-15"])
    got = {r["chassis"]: r for r in a.chassis.collect()}
    assert set(got) == {loq, "hp:victus:victus-15"}
    x = got[loq]
    assert (x["docs"], x["editorial_docs"], x["kept"], x["exact"], x["priority"]) == (1, 1, 6, 1, "High Priority")
    assert x["covered_scraped"] == ["battery", "build_quality", "performance", "thermals"] and x["missing"] == ["screen"]
    y = got["hp:victus:victus-15"]
    assert (y["reviewed"], y["docs"], y["gaps"], y["missing"], y["priority"]) == (False, 0, ["Pros", "Cons"], CRITICAL, "High Priority")
    assert (a.totals["exact_removed"], a.totals["kept_chunks"], a.totals["explicit_chunks"], a.totals["unmatched"], a.totals["no_doc"], a.totals["high"], a.totals["missing_screen"]) == (1, 6, 5, 1, 1, 2, 2)


def test_near_copies_repeated_documents_and_synthetic_transcripts(spark):
    t = "The cooling fans stay remarkably quiet even under sustained heavy gaming workloads."
    rows = [
        ("a", 0, "editorial", "u", [t, t.replace("cooling fans", "cooling   fans"), t.replace("under", "during")], ["Battery drains quickly when rendering video on battery."], ""),
        ("a", 1, "editorial", "u", ["never read"], None, None),
        ("a", 2, "transcript", "v", None, None, "[Synthesized from notes] The display is great and bright."),
        ("a", 3, "transcript", "w", None, None, None),
        ("a", 4, "comment", "c", None, None, "too short"),
        ("a", 5, "comment", None, None, None, "A great display that I look at all day."),
        ("a", 6, "comment", None, None, None, "Its hinge began to flex after a month."),
        (None, 7, "comment", None, None, None, "Nobody knows what this one is about."),
        ("a", 8, "podcast", "p", None, None, "A kind of source that isn't known at all."),
    ]
    a = run(spark, rows)
    x = a.chassis.collect()[0]
    assert (x["docs"], x["editorial_docs"], x["transcript_docs"], x["comments"], x["exact"], x["near"], x["kept"]) == (1, 1, 0, 2, 1, 1, 4)
    assert (x["pros"], x["cons"], x["missing"], x["gaps"]) == (2, 2, [], [])
    assert a.totals["synthesized_stripped"] == 1 and a.totals["input_chunks"] == 6


def test_transcripts_keep_their_best_chunks_in_order_and_nothing_is_nothing(spark):
    body = "We begin with many words about the weather. The battery is great and the screen is great too. Then came somebody else to the door. The gpu is strong while gaming for an hour."
    a = run(spark, [("a", 0, "transcript", "v", None, None, body)], most_transcript=2)
    assert [r["text"][:11] for r in a.chunks.orderBy("at").collect()] == ["The battery", "The gpu is "]
    assert a.chassis.collect()[0]["priority"] == "High Priority"
    none = run(spark, [])
    assert none.chassis.count() == 0 and none.totals["chassis"] == 0
