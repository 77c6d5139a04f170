"""Review evidence on odd rows."""

from marketloom.operators import evidence as E


def test_scores_near_a_border_fall_as_in_sql(spark):
    pro, con = [2, 9, 5, 1, 8, 4, 0], [6, 11, 3, 8, 0, 5, 10]
    rows = [(1, "a tion", {"battery": (p / 16, c / 32)}) for p, c in zip(pro, con, strict=True)]
    evidence = spark.createDataFrame(rows, "id long, text string, sims map<string,struct<pro:double,con:double>>")
    items = spark.createDataFrame([(1, "Office", "GTX 1650", 60.0, None, None)], "id long, category string, gpu string, battery_whr double, verified_metal boolean, material string")
    got = {r["aspect"]: r["score"] for r in E.aspect_scores(items, evidence, "id", {"battery": (["tio"], ["ver"])}).collect()}
    assert got["battery"] == 88.9  # 70 + (0.1 * 155 + 7 * 3.2) / 2, in doubles just below 88.95


def test_feature_sizes_hold_one_text_at_a_time(monkeypatch):
    import weakref
    from collections import Counter

    import pandas as pd

    class Counted(Counter):
        __hash__ = object.__hash__

    alive, most = weakref.WeakSet(), [0]

    def features(text):
        f = Counted(text)
        alive.add(f)
        most[0] = max(most[0], len(alive))
        return f

    taken = {}
    monkeypatch.setattr(E.F, "pandas_udf", lambda schema: lambda f: taken.setdefault("f", f) and (lambda column: None))
    monkeypatch.setattr(E, "features", features)
    E.feature_sizes(None)
    got = taken["f"](pd.Series([f"{'ab' * k}c" for k in range(1, 51)] + [None]))
    assert got.iloc[1].tolist() == [3, 5, 2] and got.iloc[50].tolist() == [0, 0, 0]
    assert most[0] <= 2
