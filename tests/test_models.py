"""Chains, blends, early stopping and measures against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom import session
from statloom.operators import models
from statloom.operators.models import Link


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    n = 1500
    kind = rng.choice(["FF", "FO", "FS", "CH"], n)
    a, b, c = rng.normal(size=(3, n)).round(1)
    y = 2 * a + np.where(kind == "CH", 1.0, -1.0) * b + 0.5 * c + rng.normal(0, 0.05, n)
    data = [(i, str(kind[i]), float(a[i]) if i % 50 else None, float(b[i]) if i % 40 else None, float(c[i]), float(y[i]), i % 5 == 0) for i in range(n)]
    return spark.createDataFrame(data, "i long, pitch_type string, a double, b double, c double, y double, is_test boolean").cache()


LINKS = [Link("stuff", ["a", "pitch_type"], ["pitch_type"], whole_only=False), Link("location", ["b"], per="pitch_type"), Link("tunnel", ["c"])]
FAST = {"most": 12, "maxDepth": 4, "stepSize": 0.5, "subsamplingRate": 1.0}


@pytest.fixture(scope="module")
def chain(rows):
    return models.fit_chain(rows, "y", links=LINKS, prefix="x_", **FAST)


def test_chain_links_fit_what_is_left(chain, rows):
    fitted, scored = chain
    got = scored.toPandas().sort_values("i")
    assert len(got) == rows.count()
    left = got["y"]
    for name in ("x_stuff", "x_location", "x_tunnel"):  # every link takes some of the rest
        assert ((left - got[name]) ** 2).mean() < 0.8 * (left ** 2).mean()
        left = left - got[name]
    assert (got.loc[got["b"].isna(), "x_location"] == 0).all()  # no input, no location score
    assert got["x_stuff"].notna().all()  # all rows are scored, missing inputs or not
    assert got.loc[got["a"].isna(), "a"].isna().all()  # and are as they were
    assert set(fitted.fits["location"]) == {"FF", "FS", "CH"}  # FO goes to the model of FS
    assert (got.loc[(got["pitch_type"] == "FO") & got["b"].notna(), "x_location"] != 0).any()


def test_blend_is_least_squares(chain):
    fitted, scored = chain
    held = scored.filter("is_test").toPandas()
    x = np.column_stack([held[["x_stuff", "x_location", "x_tunnel"]].to_numpy(float), np.ones(len(held))])
    want = np.linalg.lstsq(x, held["y"].to_numpy(float), rcond=None)[0]
    got = [fitted.weights[n] for n in ("stuff", "location", "tunnel", "intercept")]
    assert np.allclose(got, want, rtol=1e-6)
    final = scored.select("x_final", models.blended(fitted.weights, "x_").alias("again")).toPandas()
    assert np.allclose(final["x_final"], final["again"])


def test_chain_scores_new_rows_alike(chain, rows):
    fitted, scored = chain
    again = {r["i"]: r["x_final"] for r in models.score_chain(rows, fitted).select("i", "x_final").collect()}
    for r in scored.select("i", "x_final").collect():
        assert again[r["i"]] == pytest.approx(r["x_final"], abs=1e-5)


def test_fit_stops_early(rows, spark):
    fit = models.fit_early(rows.na.drop(), ["a", "c"], "y", most=60, tolerance=0.05, maxDepth=3, stepSize=0.5, subsamplingRate=1.0)
    assert fit.stopped and 1 <= fit.trees < 60
    # the same end whatever the unit of the label
    again = models.fit_early(rows.na.drop().withColumn("y", F.col("y") * 1e-4), ["a", "c"], "y", most=60, tolerance=0.05, maxDepth=3, stepSize=0.5, subsamplingRate=1.0)
    assert again.trees == fit.trees
    flat = rows.withColumn("y", F.lit(1.0))
    assert models.fit_early(flat, ["a"], "y") is None and models.fit_early(rows.limit(0), ["a"], "y") is None
    assert models.fit_early(rows.filter("NOT is_test"), ["a"], "y") is None


def test_chain_end_is_recorded(chain, spark):
    fitted, _ = chain
    got = {(r["component"], r["type"]): r for r in fitted.stops(spark).collect()}
    assert set(got) == {("stuff", ""), ("tunnel", ""), ("location", "FF"), ("location", "FS"), ("location", "CH")}
    assert all(1 <= r["trees"] <= 12 and r["rows"] > 0 for r in got.values())


def test_blend_of_equal_or_no_components(spark):
    df = spark.createDataFrame([(float(i), float(i), 3.0 * i + 1) for i in range(20)] + [(None, 1.0, 1.0)], "p double, q double, y double")
    got = models.fit_blend(df, ["p", "q"], "y")
    assert got["p"] == pytest.approx(1.5) and got["q"] == pytest.approx(1.5) and got["intercept"] == pytest.approx(1.0)
    assert models.fit_blend(df.limit(0), ["p", "q"], "y") == {"p": 0.0, "q": 0.0, "intercept": 0.0}


def test_measures(spark):
    rng = np.random.default_rng(1)
    data = [(str(rng.choice(list("ab"))), float(y), float(y + rng.normal()), int(rng.random() < 0.4), float(rng.integers(0, 6))) for y in rng.normal(size=400)]
    data += [("c", 1.0, 2.0, 1, 1.0), ("c", 1.0, 0.0, 1, 2.0), ("a", None, 1.0, None, 1.0)]
    df = spark.createDataFrame(data, "g string, y double, p double, label int, score double")
    for r in models.regression_table(df, "y", "p", ["g"]).collect():
        y, p = np.array([[d[1], d[2]] for d in data if d[0] == r["g"] and d[1] is not None]).T
        assert r["n"] == len(y) and r["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
        assert r["r2"] is None if r["g"] == "c" else r["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
        assert r["g"] == "c" or r["r"] == pytest.approx(np.corrcoef(y, p)[0, 1])
    for r in models.auc_table(df, "label", "score", ["g"]).collect():
        one, two = ([d[4] for d in data if d[0] == r["g"] and d[3] == k] for k in (1, 0))
        want = np.mean([(a > b) + (a == b) / 2 for a in one for b in two]) if one and two else None
        assert r["positives"] == len(one) and (r["auc"] == pytest.approx(want) if want is not None else r["auc"] is None)
    assert models.auc_table(df, "label", "score").columns == ["n", "positives", "auc"]


def test_fits_deal_rows_evenly(rows, monkeypatch):
    """A table in one split is trained on in many parts of bounded size; they are given back."""
    seen = []
    fit = models.Pipeline.fit

    def watched(pipe, df):
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        seen.append((df.rdd.getNumPartitions(), sum(sizes), max(sizes)))
        return fit(pipe, df)

    monkeypatch.setattr(models.Pipeline, "fit", watched)
    monkeypatch.setattr(models, "PART_ROWS", 300)
    one = rows.na.drop().withColumn("up", (F.col("y") > 0).cast("int")).coalesce(1)
    n, kept = one.count(), one.sparkSession.sparkContext._jsc.getPersistentRDDs().size()
    few = {"maxDepth": 2}
    models.fit_early(one, ["a", "c"], "y", most=1, **few)
    models.fit_probability_early(one, ["a", "c"], "up", most=1, **few)
    models.train_per_type(one, ["CH"], ["a", "c"], "y", maxIter=1, **few)
    own = one.filter("pitch_type = 'CH'").count()
    assert [s[:2] for s in seen] == [(-(-m // 300), m) for m in (n, n, own)]
    assert max(s[2] for s in seen) <= 310
    assert one.sparkSession.sparkContext._jsc.getPersistentRDDs().size() == kept


def test_chain_writes_what_later_links_read(chain, rows, monkeypatch):
    """Of the columns that are not to be returned, those of earlier links are not written again; scores and weights stay as they are."""
    written, cut = [], models.cut
    monkeypatch.setattr(models, "cut", lambda df, name: written.append(set(df.columns)) or cut(df, name))
    fitted, scored = models.fit_chain(rows, "y", links=LINKS, prefix="x_", keep=["i"], **FAST)
    own = [w & set(rows.columns) for w in written]
    assert own == [{"i", "pitch_type", "a", "b", "c", "y", "is_test"}, {"i", "pitch_type", "b", "c", "y", "is_test"}, {"i", "c", "y", "is_test"}, {"i", "y", "is_test"}]
    assert scored.columns == ["i", "x_stuff", "x_location", "x_tunnel", "x_final"]
    whole = {r["i"]: r["x_final"] for r in chain[1].select("i", "x_final").collect()}
    assert {r["i"]: r["x_final"] for r in scored.select("i", "x_final").collect()} == pytest.approx(whole, abs=1e-6)


def test_chain_gives_its_space_back(rows, monkeypatch, tmp_path):
    """Of all that a chain writes only its last table stays, and a fit leaves no second copy of its rows with the executors."""
    spark, total = rows.sparkSession, rows.count()
    jsc, fit, during = spark.sparkContext._jsc, models.Pipeline.fit, []
    kept = jsc.getPersistentRDDs().size()
    held = [spark.conf.get(k, None) for k in ("spark.sql.codegen.hugeMethodLimit", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")]

    def watched(pipe, df):
        during.append(jsc.getPersistentRDDs().size())
        return fit(pipe, df)

    monkeypatch.setattr(models.Pipeline, "fit", watched)
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    scored = models.fit_chain(rows, "y", links=LINKS, prefix="x_", keep=["i"], most=2, maxDepth=2)[1]
    full = [d.name.rsplit("-", 1)[0] for d in (tmp_path / "statloom").iterdir() if spark.read.parquet(str(d)).count()]
    assert full == ["chain"] and scored.count() == total
    assert set(during) == {kept} and len(during) == 5
    assert held == [spark.conf.get(k, None) for k in ("spark.sql.codegen.hugeMethodLimit", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")]
