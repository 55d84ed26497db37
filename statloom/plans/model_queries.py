"""Training and scoring. Boosted trees have no SQL equivalent; their first tree, splits, scalers, measures, norms and blends do.

Models are trained on all rows that have a label, up to models.MOST_TREES trees, and stop at models.TOLERANCE.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.functions import buckets, physics
from statloom.operators import models, norms
from statloom.plans.join_queries import with_baselines
from statloom.plans.registry import query, r6, r6_sql, table
from statloom.session import cut, fresh_path


def swings(spark, folder):
    """Swing features of every tracked pitch."""
    p = table(spark, folder, "pitches")
    p = p.withColumns({
        **physics.swing_columns(),
        "in_zone": buckets.in_zone("plate_x", "plate_z", "sz_top", "sz_bot").cast("int"),
        "total_movement": physics.total_movement("pfx_x", "pfx_z"),
        "made_contact": buckets.is_contact("description").cast("int"),
        **{f"is_{f}": (buckets.pitch_family("pitch_type") == f).cast("int") for f in ("fastball", "breaking", "offspeed")},
    })
    return norms.over_expected(p, "bat_speed", "plate_x", out="speed_over_expected")


def _imputed(df, features):
    from statloom.operators.rates import impute_medians

    return impute_medians(df.withColumns({f: F.col(f).cast("double") for f in features}), features)


@query("l1_l3_l5_l6_contact_quality")
def l1(spark, folder):
    """Importances of the contact-quality model with its quality on the held rows and its end."""
    data = cut(_imputed(swings(spark, folder).filter(F.col("xwoba_est").isNotNull()), models.QUALITY_FEATURES)
               .select("line_key", "xwoba_est", *models.QUALITY_FEATURES), "quality")
    split = models.key_split(data, ["line_key"])
    fit = models.fit_early(split, models.QUALITY_FEATURES, "xwoba_est", scaled=True)
    scored = fit.model.transform(split.filter("is_test")).withColumn("predicted", F.col("prediction") * fit.scale + fit.mean)
    quality = models.regression_table(scored, "xwoba_est", "predicted").crossJoin(spark.createDataFrame([(fit.trees, fit.stopped)], "trees int, stopped boolean"))  # one row
    return r6(models.importance_table(spark, fit.model).crossJoin(quality), "importance", "r2", "r", "rmse")


@query("l2_l4_l5_contact_probability")
def l2(spark, folder):
    data = cut(_imputed(swings(spark, folder).filter(F.col("bat_speed").isNotNull()), models.CONTACT_FEATURES)
               .select("line_key", "pitcher", "made_contact", *models.CONTACT_FEATURES), "contact")
    split = cut(models.stratified_split(data, "line_key", "made_contact"), "contact-split")
    fit = models.fit_probability_early(split, models.CONTACT_FEATURES, "made_contact", scaled=True)
    scored = cut(models.contact_probability(fit.model.transform(split)).select("pitcher", "made_contact", "is_test", "contact_prob"), "contact-scores")
    auc = models.auc_table(scored.filter("is_test"), "made_contact", "contact_prob").select("auc")
    by = scored.groupBy("pitcher").agg(F.count(F.lit(1)).alias("n"), F.avg("contact_prob").alias("contact_prob"), F.avg("made_contact").alias("actual_contact"))
    return r6(by.crossJoin(auc).withColumn("trees", F.lit(fit.trees)), "contact_prob", "auc")


@query("l4_stratified_split_shares", """
SELECT CAST(CASE WHEN description IN ('hit_into_play','foul') THEN 1 ELSE 0 END AS INT) AS made_contact, (count(*) + 4) // 5 AS tested, count(*) AS n FROM @pitches GROUP BY ALL""")
def l4(spark, folder):
    p = table(spark, folder, "pitches").select("line_key", buckets.is_contact("description").cast("int").alias("made_contact"))
    return models.stratified_split(p, "line_key", "made_contact").groupBy("made_contact").agg(
        F.count_if("is_test").alias("tested"), F.count(F.lit(1)).alias("n"))


def pitch_features(spark, folder):
    """Inputs of the three pitch models beside every pitch."""
    out = with_baselines(table(spark, folder, "pitches"))
    _, horizontal = physics.flight_angles("vx0", "vy0", "vz0", "ax", "ay", "az")
    out = out.withColumns({"haa": horizontal, "total_movement": physics.total_movement("pfx_x", "pfx_z"),
                           "spin_efficiency": physics.spin_efficiency("pfx_x", "pfx_z", "release_spin_rate")})
    out = out.withColumns(physics.fastball_deltas()).withColumns(physics.tunnel_distances())
    return out.withColumns(physics.location_columns())


def _model_rows(spark, folder, features, *more):
    columns = dict.fromkeys(["line_key", "pitcher", "pitch_type", "xrv", *more, *features])
    return models.key_split(pitch_features(spark, folder).select(*columns), ["line_key"])


@query("l7_l8_f8_tunnel_scores")
def l7(spark, folder):
    data = cut(_model_rows(spark, folder, models.TUNNEL_FEATURES), "tunnel")
    fit = models.fit_early(data.na.drop(subset=models.TUNNEL_FEATURES), models.TUNNEL_FEATURES, "xrv", categorical=["pitch_type", "p_throws"])
    scored = models.score_complete(data, fit.model, models.TUNNEL_FEATURES, "xrv_tunnel", None)
    scored = scored.withColumn("xrv_tunnel", F.coalesce(F.col("xrv_tunnel") * fit.scale + fit.mean, F.lit(0.0)))
    by = scored.groupBy("pitcher").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("xrv_tunnel") != 0).alias("scored"), F.avg("xrv_tunnel").alias("xrv_tunnel"))
    return r6(by.withColumn("trees", F.lit(fit.trees)), "xrv_tunnel")


@query("l8_stuff_scores")
def l8(spark, folder):
    """Stuff model over every pitch, pitches without a feature included."""
    data = cut(_model_rows(spark, folder, models.STUFF_FEATURES), "stuff")
    kinds = ["pitch_type", "p_throws"]
    fit = models.fit_early(models.filled(data, models.STUFF_FEATURES, kinds), models.STUFF_FEATURES, "xrv", categorical=kinds)
    scored = models.predicted(data, fit, "xrv_stuff", kinds, models.STUFF_FEATURES)
    by = scored.groupBy("pitcher").agg(F.count(F.lit(1)).alias("n"), F.count("xrv_stuff").alias("scored"), F.avg("xrv_stuff").alias("xrv_stuff"))
    return r6(by.withColumn("trees", F.lit(fit.trees)), "xrv_stuff")


@query("l9_location_models_by_type")
def l9(spark, folder):
    data = cut(_model_rows(spark, folder, models.LOCATION_FEATURES), "location")
    fits = models.fit_per_type_early(data, models.LOCATION_FEATURES, "xrv", categorical=["stand"])
    scored = models.score_per_type(data, fits, models.LOCATION_FEATURES, "xrv_location")
    stops = spark.createDataFrame([(t, f.trees) for t, f in fits.items()], "pitch_type string, trees int")
    by = scored.groupBy("pitch_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("xrv_location") != 0).alias("scored"), F.avg("xrv_location").alias("mean"))
    return r6(by.join(stops, "pitch_type", "left"), "mean")


@query("l10_l12_residual_chain_and_blend")
def l10(spark, folder):
    """Stuff, location by type on what stuff leaves, tunnel on the rest, three weights; models and weights go through storage."""
    features = [f for link in models.PITCH_CHAIN for f in link.features]
    chain, scored = models.fit_chain(_model_rows(spark, folder, features), "xrv", keep=["pitcher", *models.TUNNEL_FEATURES])
    weights = models.load_config(spark, models.save_config(spark, fresh_path(spark, "config"), chain.weights))
    tunnel = chain.fits["tunnel"][""]
    tunnel.model = models.load_model(models.save_model(tunnel.model, fresh_path(spark, "model")))
    again = models.link_score(scored.drop("xrv_tunnel"), chain.links[2], {"": tunnel}, "xrv_tunnel")
    out = again.withColumn("xrv_final", models.blended(weights, "xrv_"))
    mean = [F.avg(f"xrv_{c}").alias(f"xrv_{c}") for c in ("stuff", "location", "tunnel", "final")]
    return r6(out.groupBy("pitcher").agg(F.count(F.lit(1)).alias("n"), *mean), "xrv_stuff", "xrv_location", "xrv_tunnel", "xrv_final")


def _solve_sql():
    """Weights of three components by Cramer's rule on the centred sums of products."""
    def det(cols):
        a = [[f"{r}_{c}" for c in cols] for r in ("s", "l", "t")]
        return " + ".join(f"{sign}{a[0][i]} * ({a[1][j]} * {a[2][k]} - {a[1][k]} * {a[2][j]})".replace("+-", "-")
                          for sign, i, j, k in (("", 0, 1, 2), ("-", 1, 0, 2), ("", 2, 0, 1)))

    cov = lambda a, b: f"(avg({a} * {b}) - avg({a}) * avg({b}))"
    names = {"s": "stuff", "l": "location", "t": "tunnel", "y": "xrv"}
    sums = ", ".join(f"{cov(names[a], names[b])} AS {a}_{b}" for a in "slt" for b in "slty")
    means = ", ".join(f"avg({n}) AS m_{k}" for k, n in names.items())
    return f"""WITH p AS (SELECT CAST(xrv AS DOUBLE) AS xrv, CAST(stuff AS DOUBLE) AS stuff, CAST(location AS DOUBLE) AS location, CAST(tunnel AS DOUBLE) AS tunnel FROM @pitches),
 s AS (SELECT {sums}, {means} FROM p WHERE xrv IS NOT NULL AND stuff IS NOT NULL AND location IS NOT NULL AND tunnel IS NOT NULL),
 w AS (SELECT *, ({det('ylt')}) / ({det('slt')}) AS ws, ({det('syt')}) / ({det('slt')}) AS wl, ({det('sly')}) / ({det('slt')}) AS wt FROM s)
SELECT {r6_sql('ws')} AS stuff, {r6_sql('wl')} AS location, {r6_sql('wt')} AS tunnel, {r6_sql('m_y - ws * m_s - wl * m_l - wt * m_t')} AS intercept FROM w"""


@query("l10_blend_weights", _solve_sql())
def l10_blend(spark, folder):
    """Normal equations of the blend over the given components."""
    found = models.fit_blend(table(spark, folder, "pitches"), ["stuff", "location", "tunnel"], "xrv")
    return r6(spark.createDataFrame([found], "stuff double, location double, tunnel double, intercept double"), *found)


@query("l3_scaler_moments", """
SELECT feature, round_even(avg(v) * 1e6, 0) / 1e6 + 0.0 AS mean, round_even(stddev_samp(v) * 1e6, 0) / 1e6 + 0.0 AS deviation
FROM (UNPIVOT (SELECT CAST(release_speed AS DOUBLE) AS release_speed, CAST(pfx_x AS DOUBLE) AS pfx_x, CAST(pfx_z AS DOUBLE) AS pfx_z, CAST(swing_length AS DOUBLE) AS swing_length FROM @pitches)
  ON release_speed, pfx_x, pfx_z, swing_length INTO NAME feature VALUE v) GROUP BY feature""")
def l3(spark, folder):
    """Moments of the scaler in a fitted pipeline."""
    names = ["release_speed", "pfx_x", "pfx_z", "swing_length"]
    data = table(spark, folder, "pitches").select("xrv", *[F.col(c).cast("double") for c in names])
    fit = models.regression_trees(names, "xrv", scaled=True, maxIter=1, maxDepth=1).fit(data)
    return r6(models.scaler_table(spark, fit), "mean", "deviation")


@query("l5_regression_measures", f"""
WITH p AS (SELECT pitch_type, CAST(xrv AS DOUBLE) AS y, CAST(stuff + tunnel AS DOUBLE) AS f FROM @pitches)
SELECT pitch_type, count(*) AS n, {r6_sql('1 - avg((y - f) * (y - f)) / var_pop(y)')} AS r2, {r6_sql('corr(y, f)')} AS r, {r6_sql('sqrt(avg((y - f) * (y - f)))')} AS rmse
FROM p WHERE y IS NOT NULL AND f IS NOT NULL GROUP BY pitch_type""")
def l5(spark, folder):
    p = table(spark, folder, "pitches").withColumn("given", F.col("stuff") + F.col("tunnel"))
    return r6(models.regression_table(p, "xrv", "given", ["pitch_type"]), "r2", "r", "rmse")


@query("l5_roc_auc", f"""
WITH p AS (SELECT season, CAST(CASE WHEN description IN ('hit_into_play','foul') THEN 1 ELSE 0 END AS INT) AS y, CAST(bat_speed AS DOUBLE) AS f FROM @pitches WHERE bat_speed IS NOT NULL),
 r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY season, f) - 1) / 2e0 AS rk FROM p WINDOW w AS (PARTITION BY season ORDER BY f))
SELECT season, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, {r6_sql('(sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y)))')} AS auc FROM r GROUP BY season""")
def l5_auc(spark, folder):
    p = table(spark, folder, "pitches").filter("bat_speed IS NOT NULL").withColumn("made", buckets.is_contact("description").cast("int"))
    return r6(models.auc_table(p, "made", "bat_speed", ["season"]), "auc")


def split_sql(rows: str, features: list[str], label: str, part: str = "0", categorical: bool = False) -> str:
    """Best first split of a regression tree: the cut that leaves the least squared error, over all features and the cuts between their values; categories
    are put in order of their mean label first. Gives part, f, lm, rm (means on both sides) and x_cut (values up to it go left)."""
    long = " UNION ALL ".join(f"SELECT {part} AS part, '{f}' AS f, CAST({f} AS {'VARCHAR' if categorical else 'DOUBLE'}) AS v, CAST({label} AS DOUBLE) AS y FROM d" for f in features)
    place = "sum(y) / count(*)" if categorical else "any_value(v)"
    return f"""WITH d AS ({rows}), lng AS ({long}),
 c AS (SELECT part, f, v, {place} AS x, count(*) AS n, sum(y) AS s FROM lng GROUP BY part, f, v),
 r AS (SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY part, f) AS nt, sum(s) OVER (PARTITION BY part, f) AS st FROM c WINDOW w AS (PARTITION BY part, f ORDER BY x)),
 g AS (SELECT *, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) AS gain FROM r WHERE nl < nt),
 b AS (SELECT part, f, x AS x_cut, sl / nl AS lm, (st - sl) / (nt - nl) AS rm FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY gain DESC) AS place FROM g) WHERE place = 1)"""


ONE_TREE = {"maxIter": 1, "maxDepth": 1, "subsamplingRate": 1.0, "maxBins": 64, "stepSize": 1.0}
_SPLIT = ["release_speed", "pfx_x", "pfx_z"]
_SPLIT_X = "CASE b.f WHEN 'release_speed' THEN release_speed WHEN 'pfx_x' THEN pfx_x ELSE pfx_z END"


@query("l1_first_tree", split_sql("SELECT * FROM @pitches WHERE xrv IS NOT NULL", _SPLIT, "xrv") + f"""
SELECT pitcher, count(*) AS n, {r6_sql(f'avg(CASE WHEN {_SPLIT_X} <= x_cut THEN lm ELSE rm END)')} AS predicted FROM d, b GROUP BY pitcher""")
def l1_first(spark, folder):
    """The regression pipeline held to its first tree of one split."""
    p = table(spark, folder, "pitches").select("pitcher", "xrv", *[F.col(c).cast("double") for c in _SPLIT])
    fit = models.regression_trees(_SPLIT, "xrv", **ONE_TREE).fit(p)
    return r6(fit.transform(p).groupBy("pitcher").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("predicted")), "predicted")


@query("l6_first_tree_importances", split_sql("SELECT * FROM @pitches WHERE xrv IS NOT NULL", _SPLIT, "xrv") + """
SELECT feature, CASE WHEN feature = b.f THEN 1e0 ELSE 0e0 END AS importance, CAST(row_number() OVER (ORDER BY (feature = b.f) DESC, feature) AS INT) AS rank
FROM b, (SELECT unnest(['release_speed', 'pfx_x', 'pfx_z']) AS feature)""")
def l6(spark, folder):
    p = table(spark, folder, "pitches").select("xrv", *[F.col(c).cast("double") for c in _SPLIT])
    return models.importance_table(spark, models.regression_trees(_SPLIT, "xrv", **ONE_TREE).fit(p))


@query("l2_first_tree_probability", split_sql("SELECT *, CASE WHEN description IN ('hit_into_play','foul') THEN 1 ELSE -1 END AS y FROM @pitches", ["swing_length", "pfx_z", "release_speed"], "y") + f"""
SELECT pitcher, count(*) AS n, {r6_sql("avg(1 / (1 + exp(-2 * CASE WHEN CASE b.f WHEN 'release_speed' THEN release_speed WHEN 'swing_length' THEN swing_length ELSE pfx_z END <= x_cut THEN lm ELSE rm END)))")} AS probability
FROM d, b GROUP BY pitcher""")
def l2_first(spark, folder):
    names = ["swing_length", "pfx_z", "release_speed"]
    p = table(spark, folder, "pitches").select("pitcher", buckets.is_contact("description").cast("int").alias("made"), *[F.col(c).cast("double") for c in names])
    scored = models.contact_probability(models.classification_trees(names, "made", **ONE_TREE).fit(p).transform(p), "probability")
    return r6(scored.groupBy("pitcher").agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("probability")), "probability")


@query("l7_first_tree_on_categories", split_sql("SELECT * FROM @pitches WHERE xrv IS NOT NULL", ["pitch_type", "p_throws"], "xrv", categorical=True) + f"""
, m AS (SELECT c.f, c.v, CASE WHEN c.x <= b.x_cut THEN lm ELSE rm END AS predicted FROM c JOIN b ON c.f = b.f)
SELECT pitch_type, p_throws, count(*) AS n, {r6_sql('avg(predicted)')} AS predicted FROM d JOIN m ON m.v = CASE m.f WHEN 'pitch_type' THEN pitch_type ELSE p_throws END GROUP BY pitch_type, p_throws""")
def l7_first(spark, folder):
    names = ["pitch_type", "p_throws"]
    p = table(spark, folder, "pitches").select("xrv", *names)
    scored = models.regression_trees(names, "xrv", names, **ONE_TREE).fit(p).transform(p)
    return r6(scored.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("predicted")), "predicted")


@query("l8_l9_first_trees_by_type", split_sql("SELECT * FROM @pitches WHERE xrv IS NOT NULL AND pitch_type <> 'CU' AND spin_axis IS NOT NULL AND plate_x IS NOT NULL", _SPLIT, "xrv", part="pitch_type") + f"""
SELECT pitch_type, count(*) AS n, {r6_sql(f'avg(CAST(CASE WHEN b.f IS NULL OR plate_x IS NULL THEN 0 WHEN {_SPLIT_X} <= x_cut THEN lm ELSE rm END AS FLOAT))')} AS predicted
FROM @pitches p LEFT JOIN b ON b.part = p.pitch_type GROUP BY pitch_type""")
def l9_first(spark, folder):
    """A model per type but one; pitches of that type, and pitches without every input, get 0."""
    p = table(spark, folder, "pitches").select("pitch_type", "xrv", "plate_x", *[F.col(c).cast("double") for c in _SPLIT])
    # plate_x is an input that no split can use: it is the same for all who have it
    p = p.withColumn("there", F.when(F.col("plate_x").isNotNull(), 1.0))
    names = [*_SPLIT, "there"]
    fits = models.train_per_type(p.filter("xrv IS NOT NULL"), ["CH", "FF", "FS", "SI", "SL"], names, "xrv", **ONE_TREE)
    scored = models.score_per_type(p, fits, names, "predicted")
    return r6(scored.groupBy("pitch_type").agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("predicted")), "predicted")
