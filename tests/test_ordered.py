"""Ranks, quantiles and sequences against pandas, with few parts and with keys that are in many."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import appearances, keys, ranks, rates, reshape, segments


@pytest.fixture(params=[1, 23], ids=["one part", "many parts"])
def limit(request, spark):
    names = {"spark.sql.shuffle.partitions": str(request.param), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(7)
    n = 900
    d = pd.DataFrame({
        "id": range(n),
        "g": np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abc"), n)),
        # a third of all rows share one value
        "x": np.where(rng.random(n) < 0.33, 5.0, np.round(rng.normal(0, 10, n), 1)),
        "c": np.where(rng.random(n) < 0.5, np.nan, rng.integers(0, 9, n)),
    })
    d.loc[rng.random(n) < 0.05, "x"] = np.nan
    return d


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "c")}).repartition(5).cache()


def frame(result, by="id"):
    return result.toPandas().sort_values(by).reset_index(drop=True)


def test_percentile_rank(df, pdf, limit):
    got = frame(ranks.add_percentile_rank(df, "x", ["g"]))["pct_rank"].astype(float)
    want = pdf.groupby("g")["x"].transform(lambda s: (s.rank() - 1) / (s.notna().sum() - 1))
    assert np.allclose(got, want, equal_nan=True)


def test_strict_percentile(df, pdf, limit):
    got = frame(ranks.add_strict_percentile(df, "x", ["g"], lower_better=True))["pctile"].astype(float)
    want = pdf.groupby("g")["x"].transform(lambda s: s.map(lambda v: np.nan if pd.isna(v) else np.rint((100 - (s.dropna() < v).sum() / s.notna().sum() * 100) * 10) / 10))
    assert np.allclose(got, want, equal_nan=True)


def test_quantiles(df, pdf, limit):
    got = frame(ranks.exact_quantiles(df, "x", ["g"], {"p10": 0.1, "median": 0.5}), "g")
    want = pdf.groupby("g")["x"].quantile([0.1, 0.5]).unstack()
    assert np.allclose(got[["p10", "median"]], want)


def test_leaderboard_puts_missing_last(df, pdf, limit):
    got = frame(ranks.leaderboard(df, "x", ["g"], "id", ascending=False))["rank"]
    want = pdf.sort_values(["x", "id"], ascending=[False, True]).groupby("g").cumcount().sort_index() + 1
    assert (got.values == want.values).all()


def test_index_and_carry(df, pdf, limit):
    got = frame(segments.row_index(df, ["g"], ["id"], "i", "n"))
    assert (got["i"].values == pdf.groupby("g").cumcount().values).all()
    assert (got["n"].values == pdf.groupby("g")["id"].transform("count").values).all()
    got = frame(segments.carry_forward(df, ["g"], ["id"], {"prev": "c"}))["prev"].astype(float)
    assert np.allclose(got, pdf.groupby("g")["c"].transform(lambda s: s.ffill().shift()), equal_nan=True)


def test_a_hot_key_is_in_many_parts(spark, df, limit):
    dealt = segments.deal(df.filter("g = 'hot'"), ["g"], ["id"])
    sizes = [r["count"] for r in dealt.groupBy(segments.PART).count().collect()]
    assert len(sizes) == limit and max(sizes) < 2 * sum(sizes) / limit + 2


def test_rolling_starts(df, pdf, limit):
    base = df.withColumn("start", F.floor(F.col("id") / 10))
    got = frame(rates.rolling_starts(base, "g", ["start"], ["start"], "x"), ["g", "start"])
    p = pdf.assign(start=pdf["id"] // 10).groupby(["g", "start"])["x"].apply(list).reset_index()
    want = []
    for _, grp in p.groupby("g"):
        lists = list(grp["x"])
        for i in range(len(lists)):
            v = pd.Series(sum(lists[max(0, i - 2): i + 1], [])).dropna()
            want.append((v.mean(), v.std()))
    want = np.array(want, dtype=float)
    assert np.allclose(got["mean"].astype(float), want[:, 0], equal_nan=True)
    assert np.allclose(got["std"].astype(float), want[:, 1], equal_nan=True, atol=1e-6)


def test_even_stride(df, pdf, limit):
    got = reshape.even_stride(df, ["g"], ["id"], 50).groupBy("g").count().collect()
    for r in got:
        n = (pdf["g"] == r["g"]).sum()
        assert r["count"] == min(n, 50) or (n > 50 and 45 <= r["count"] <= 51)


def test_pool_of_one_scores_zero(spark):
    d = spark.createDataFrame([(1, "a", 3.0), (2, "a", None), (3, "b", 1.0), (4, "b", 2.0)], "id int, g string, x double")
    got = {r["id"]: r["pct_rank"] for r in ranks.add_percentile_rank(d, "x", ["g"]).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0}


def test_mean_rank_averages_half_without_ties(spark):
    d = spark.range(101).select("id", F.lit("p").alias("g"), (F.col("id") * 7 % 101).cast("double").alias("x"))
    assert abs(ranks.add_percentile_rank(d, "x", ["g"]).agg(F.avg("pct_rank")).first()[0] - 0.5) < 1e-12


def test_lookup_matches_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, w int")
    assert sorted((r["v"], r["w"]) for r in keys.lookup(a, b, ["k"]).collect()) == [(1, 10), (2, 20)]


PITCH = "pitcher long, game_pk long, at_bat_number int, inning int, pitch_number int, strikes int, description string, events string"


@pytest.mark.parametrize("rows,need", [
    ([(0, "foul"), (1, "foul"), (2, "ball")], 2),
    ([(0, "ball"), (1, "called_strike")], 2),
    ([(0, "ball"), (1, "ball")], None),
    ([(0, "ball"), (None, "foul"), (2, "x")], 2),
    ([(2, "x")], 0),
])
def test_two_strike_appearance(spark, rows, need):
    d = spark.createDataFrame([(1, 1, 1, 1, i + 1, s, t, "") for i, (s, t) in enumerate(rows)], PITCH)
    r = appearances.two_strike_appearances(d).collect()
    assert [x["pitches_to_two_strikes"] for x in r] == [need]


def test_starter_is_first_pitch_of_the_half(spark):
    rows = [(9, 1, 2, 1, 1), (7, 1, 1, 1, 1), (7, 1, 1, 1, 2), (8, 1, 1, 2, 1)]
    d = spark.createDataFrame([(*r, "Top") for r in rows], "pitcher long, game_pk long, at_bat_number int, inning int, pitch_number int, inning_topbot string")
    assert [tuple(r) for r in appearances.game_starts(d).collect()] == [(7, 1)]


def test_partials_merge_in_any_order(spark):
    rows = [(1, 2, 1, "a", "x"), (1, 3, 2, "b", ""), (1, 5, 3, "c", "z")]
    d = spark.createDataFrame(rows, "p int, s int, n int, chunk string, name string")
    merged = appearances.merge_partials(d, ["p"], ["s", "n"], {"name": "name"}).first()
    again = appearances.merge_partials(d.orderBy(F.desc("chunk")), ["p"], ["s", "n"], {"name": "name"}).first()
    assert merged == again and (merged["s"], merged["n"], merged["name"]) == (10, 6, "z")


def test_spread_leaves_shuffled_tables_alone(spark, df):
    from statloom.session import spread

    grouped = df.groupBy("g").count()
    assert spread(grouped) is grouped
    many = spark.range(0, 100, 1, 64)
    assert spread(many) is many
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_cut_keeps_schema_and_rows(df):
    from statloom.session import cut

    again = cut(df)
    assert again.columns == df.columns and again.count() == df.count()
