"""Model training and scoring with Spark ML."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, StandardScalerModel, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.numeric import all_present
from statloom.operators.keys import lookup
from statloom.operators.segments import row_index
from statloom.session import FREE_SHUFFLES, cut, fresh_path, give_back, owned, scratch, setting

# Model inputs.
QUALITY_FEATURES = [
    "bat_speed", "swing_length", "ideal_attack_angle", "attack_angle", "swing_path_tilt",
    "directional_match", "speed_over_expected", "speed_differential", "speed_vs_location",
    "squared_up_rate", "release_speed", "plate_x", "plate_z", "in_zone", "location_difficulty",
    "is_fastball", "is_breaking", "is_offspeed", "total_movement",
]
CONTACT_FEATURES = [
    "bat_speed", "swing_length", "attack_angle", "swing_path_tilt", "directional_match",
    "speed_over_expected", "speed_differential", "release_speed", "plate_x", "plate_z", "in_zone",
    "location_difficulty", "is_fastball", "is_breaking", "is_offspeed", "total_movement", "count_leverage",
]
TUNNEL_FEATURES = [
    "tunnel_diff_x", "tunnel_diff_z", "tunnel_distance", "time_after_tunnel", "late_break", "plate_distance",
    "release_diff_x", "release_diff_z", "release_distance", "pitch_type", "p_throws", "release_speed", "delta_velo",
]
LOCATION_FEATURES = [
    "plate_x", "plate_z", "plate_x_adj", "zone_center_dist", "out_of_zone_dist", "in_zone",
    "pfx_x", "pfx_z", "release_speed", "stand", "same_side",
]
STUFF_FEATURES = [
    "release_speed", "pfx_x", "pfx_z", "release_spin_rate", "spin_axis", "release_extension", "release_pos_x", "release_pos_z",
    "vaa", "haa", "total_movement", "spin_efficiency", "delta_velo", "delta_pfx_x", "delta_pfx_z", "delta_spin", "delta_extension",
    "delta_vaa", "movement_separation", "release_diff_x", "release_diff_z", "release_distance", "pitch_type", "p_throws",
]
# The most trees of a model, and what a further tree must gain.
MOST_TREES = 800
TOLERANCE = 0.01
# A missing number in a model that scores every row: below all real ones, so a split can set it apart.
MISSING = -1e9
TREE = {"maxDepth": 7, "stepSize": 0.03, "subsamplingRate": 0.8, "seed": 42}

# Rows of a part that one task trains on: the most, and the fewest for which another task is worth its start.
PART_ROWS = 250_000
LEAST_ROWS = 20_000

# Methods that Spark generates beyond this are left to the interpreter by the JVM; Spark then does without them, which is several times as fast.
METHOD_LIMIT, METHOD_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"

# Fixed value: pitch types scored by another type's model.
TYPE_ALIASES = {"FO": "FS"}


def key_split(df: DataFrame, key: list[str], parts: int = 5) -> DataFrame:
    """is_test for one fifth of the rows, by a hash of the key: the same rows however the data is laid out."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(*key), F.lit(parts)) == 0)


def stratified_split(df: DataFrame, key: str, label: str, parts: int = 5) -> DataFrame:
    """Every fifth row of each class in hash order, so the classes keep their shares."""
    hashed = df.withColumn("__h", F.xxhash64(key))
    at = row_index(hashed, [label], ["__h", key], "__i")
    return at.withColumn("is_test", F.col("__i") % parts == 0).drop("__h", "__i")


def regression_trees(features: list[str], label: str, categorical: list[str] = (), scaled: bool = False, **tree) -> Pipeline:
    return Pipeline(stages=[*_prepare(features, categorical, scaled), GBTRegressor(
        featuresCol="features", labelCol=label, predictionCol="prediction", **{**TREE, **tree})])


def classification_trees(features: list[str], label: str, categorical: list[str] = (), scaled: bool = False, **tree) -> Pipeline:
    return Pipeline(stages=[*_prepare(features, categorical, scaled), GBTClassifier(
        featuresCol="features", labelCol=label, **{**TREE, **tree})])


def _prepare(features, categorical, scaled):
    numeric = [f for f in features if f not in categorical]
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep") for c in categorical]
    cols = [*numeric, *[f"{c}__i" for c in categorical]]
    if scaled:
        stages += [
            VectorAssembler(inputCols=cols, outputCol="unscaled", handleInvalid="keep"),
            StandardScaler(inputCol="unscaled", outputCol="features", withMean=True, withStd=True),
        ]
    else:
        stages.append(VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"))
    return stages


def contact_probability(scored: DataFrame, out: str = "contact_prob") -> DataFrame:
    return scored.withColumn(out, vector_to_array("probability")[1])


def regression_quality(scored: DataFrame, label: str, prediction: str = "prediction") -> dict[str, float]:
    def measure(m):
        return RegressionEvaluator(labelCol=label, predictionCol=prediction, metricName=m).evaluate(scored)

    return {"r2": measure("r2"), "rmse": measure("rmse"), "r": scored.stat.corr(label, prediction)}


def ranking_quality(scored: DataFrame, label: str) -> float:
    return BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC").evaluate(scored)


def importance_table(spark, model: PipelineModel) -> DataFrame:
    """(feature, importance, rank): as many rows as the model has inputs."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    values = model.stages[-1].featureImportances.toArray()
    ranked = sorted(zip(assembler.getInputCols(), map(float, values)), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(ranked)], "feature string, importance double, rank int")


def score_complete(df: DataFrame, model: PipelineModel, features: list[str], out: str, default: float | None = 0.0) -> DataFrame:
    """Prediction for rows that have every feature, the default for the others; all columns of df are kept."""
    kept = df.columns
    whole = all_present(features)
    filled = df.withColumn("__ok", whole)
    for f in features:
        if dict(df.dtypes)[f] != "string":
            filled = filled.withColumn(f"__raw_{f}", F.col(f)).withColumn(f, F.coalesce(F.col(f).cast("double"), F.lit(0.0)))
    scored = model.transform(filled)
    raw = [f for f in features if f"__raw_{f}" in scored.columns]
    return scored.select(
        *[(F.col(f"__raw_{c}").alias(c) if c in raw else F.col(c)) for c in kept],
        F.when(F.col("__ok"), F.col("prediction")).otherwise(default).cast("float").alias(out),
    )


@dataclass
class Trees:
    """Boosted trees of one model with how they came to an end."""

    model: PipelineModel
    mean: float = 0.0
    scale: float = 1.0
    trees: int = 0
    stopped: bool = False
    rows: int = 0


def filled(df: DataFrame, features: list[str], categorical: list[str] = ()) -> DataFrame:
    """Missing numbers as MISSING, missing categories as empty text."""
    return df.withColumns({f: F.coalesce(F.col(f).cast("string"), F.lit("")) if f in categorical else F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in features})


@contextmanager
def dealt(df: DataFrame, rows: int):
    """The rows in parts of equal size, PART_ROWS at most: a fit goes through its rows some hundred times, and a scan of a small file, or of a large one
    that packs well, has few splits. Small tables have a part per core, or fewer. The parts are files of the shared folder, read one by one until the
    fit is done; nothing of them stays on the executors' disks."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    path = fresh_path(spark, "parts")
    try:
        # rows are dealt in the order they are read in: Spark knows when that order can change and then deals all of them again, so no sort is needed
        with setting(spark, FREE_SHUFFLES, "true"), setting(spark, "spark.sql.execution.sortBeforeRepartition", "false"):
            df.repartition(max(1, math.ceil(rows / PART_ROWS), min(cores, math.ceil(rows / LEAST_ROWS)))).write.parquet(path)
        largest = spark.read.schema(df.schema).parquet(path).agg(F.max("_metadata.file_size")).first()[0]
        reader = spark.newSession()  # a part per file: the settings of its splits are its own
        for key, value in (("maxPartitionBytes", largest or 1), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            reader.conf.set(f"spark.sql.files.{key}", value)
        yield reader.read.schema(df.schema).parquet(path)
    finally:
        give_back(spark, path)


def fit_dealt(pipe: Pipeline, df: DataFrame, rows: int) -> PipelineModel:
    with dealt(df, rows) as parts:
        return pipe.fit(parts)


def fit_early(df: DataFrame, features: list[str], label: str, held: str = "is_test", categorical: list[str] = (),
              most: int = MOST_TREES, tolerance: float = TOLERANCE, **tree) -> Trees | None:
    """Regression trees that stop when a further tree takes less than `tolerance` of the error off the rows that `held` marks.

    The label is fitted in units of its deviation, so that the tolerance means the same for every label. All rows with a label are used: those
    that are held stop the fit, the others make the trees. Without rows of both kinds, or with one label value only, there is nothing to stop by: None.
    """
    known = df.filter(F.col(label).isNotNull()).select(*features, label, F.col(held).cast("boolean").alias("__held"))
    m = known.agg(F.avg(label).alias("mean"), F.stddev_pop(label).alias("scale"), F.count(F.lit(1)).alias("n"), F.count_if("__held").alias("held")).first()
    if not m["scale"] or m["scale"] != m["scale"] or not 0 < m["held"] < m["n"]:
        return None
    unit = known.withColumn("__y", (F.col(label) - F.lit(m["mean"])) / F.lit(m["scale"]))
    pipe = regression_trees(features, "__y", categorical, maxIter=most, validationIndicatorCol="__held", validationTol=tolerance, **tree)
    fit = fit_dealt(pipe, unit, m["n"])
    count = fit.stages[-1].getNumTrees
    return Trees(fit, float(m["mean"]), float(m["scale"]), count, count < most, m["n"])


def fit_probability_early(df: DataFrame, features: list[str], label: str, held: str = "is_test", categorical: list[str] = (),
                          most: int = MOST_TREES, tolerance: float = TOLERANCE, scaled: bool = False, **tree) -> Trees:
    """Classification trees with the same stop; the error is the log loss, which needs no units."""
    known = df.filter(F.col(label).isNotNull()).select(*features, label, F.col(held).cast("boolean").alias("__held"))
    pipe = classification_trees(features, label, categorical, scaled, maxIter=most, validationIndicatorCol="__held", validationTol=tolerance, **tree)
    fit = fit_dealt(pipe, known, known.count())
    count = fit.stages[-1].getNumTrees
    return Trees(fit, trees=count, stopped=count < most)


def predicted(df: DataFrame, fit: Trees, out: str, categorical: list[str] = (), features: list[str] | None = None) -> DataFrame:
    """Prediction for every row, missing features or not; all columns of df are kept as they are."""
    kept = df.columns
    names = features or _inputs(fit.model, categorical)
    stand = df.withColumns({f"__raw_{f}": F.col(f) for f in names})
    scored = fit.model.transform(filled(stand, names, categorical))
    return scored.select(*[(F.col(f"__raw_{c}").alias(c) if c in names else F.col(c)) for c in kept],
                         (F.col("prediction") * fit.scale + fit.mean).cast("float").alias(out))


def _inputs(model: PipelineModel, categorical) -> list[str]:
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    return [c.removesuffix("__i") if c.removesuffix("__i") in categorical else c for c in assembler.getInputCols()]


def _at_once(jobs: list, width: int = 4) -> list:
    """Runs several small fits side by side; each is a series of short Spark jobs that would leave cores idle."""
    with ThreadPoolExecutor(max_workers=width) as pool:
        keep = inheritable_thread_target(SparkSession.active())
        return [f.result() for f in [pool.submit(keep(job)) for job in jobs]]


def type_names(df: DataFrame, kind: str) -> list[str]:
    """The types that have a model of their own: a row per type."""
    found = {r[0] for r in df.select(kind).distinct().na.drop().collect()}
    return sorted(t for t in found if TYPE_ALIASES.get(t, t) == t)


def fit_per_type_early(df: DataFrame, features: list[str], label: str, kind: str = "pitch_type", held: str = "is_test", categorical: list[str] = (),
                       types: list[str] | None = None, **options) -> dict[str, Trees]:
    """One model per type from its whole rows. The rows are written by type, so a fit reads its own only."""
    whole = df.filter(all_present([*features, label])).select(*dict.fromkeys([kind, held, *features]), label)
    spark = df.sparkSession
    with scratch(spark):
        path = owned(fresh_path(spark, "by-type"))
        whole.withColumn("__kind", F.col(kind)).write.partitionBy("__kind").parquet(path)
        stored = spark.read.schema(whole.schema.add("__kind", "string")).parquet(path)
        names = types if types is not None else type_names(stored, "__kind")
        jobs = [lambda t=t: fit_early(stored.filter(F.col("__kind") == t), features, label, held, categorical, **options) for t in names]
        return {t: f for t, f in zip(names, _at_once(jobs), strict=True) if f}


def train_per_type(df: DataFrame, types: list[str] | None, features: list[str], label: str, kind: str = "pitch_type",
                   categorical: list[str] = (), **tree) -> dict[str, PipelineModel]:
    """One model per type, each trained on the rows of its type alone; without a list, every type with whole rows has one."""
    pipe = regression_trees(features, label, categorical, **tree)
    whole = df.filter(all_present([*features, label]))
    names = type_names(whole, kind) if types is None else types
    own = {t: whole.filter(F.col(kind) == t) for t in names}
    return dict(zip(names, _at_once([lambda d=d: fit_dealt(pipe, d, d.count()) for d in own.values()]), strict=True))


def score_per_type(df: DataFrame, models: dict[str, PipelineModel | Trees], features: list[str], out: str,
                   kind: str = "pitch_type", default: float = 0.0) -> DataFrame:
    """Routes rows to their type's model; types without a model get the default. Rows are written by type, so a model reads its own only."""
    kinds = F.col(kind)
    for a, b in TYPE_ALIASES.items():
        kinds = F.when(kinds == a, b).otherwise(kinds)
    typed = df.withColumn("__t", kinds)
    path = owned(fresh_path(df.sparkSession, "typed"))
    typed.write.partitionBy("__t").parquet(path)
    routed = df.sparkSession.read.schema(typed.schema).parquet(path)
    parts = []
    for t, m in models.items():
        trees = m if isinstance(m, Trees) else Trees(m)
        part = score_complete(routed.filter(F.col("__t") == t), trees.model, features, out, None)
        parts.append(part.withColumn(out, F.coalesce(F.col(out) * trees.scale + trees.mean, F.lit(default)).cast("float")))
    rest = routed.filter(F.col("__t").isNull() | ~F.col("__t").isin(*models)).withColumn(out, F.lit(default).cast("float"))
    return reduce(lambda a, b: a.unionByName(b), [*parts, rest]).drop("__t")


@dataclass
class Link:
    """One model of a chain. per: a model per value of that column. whole_only: rows without every feature get 0; otherwise all rows are scored."""

    name: str
    features: list[str]
    categorical: list[str] = field(default_factory=list)
    per: str | None = None
    whole_only: bool = True


@dataclass
class Chain:
    links: list[Link]
    fits: dict[str, dict[str, Trees]]  # link -> type ("" for one model) -> trees
    weights: dict[str, float]
    prefix: str = "xrv_"

    def stops(self, spark: SparkSession) -> DataFrame:
        """(component, type, rows, trees, stopped): how every fit of the chain came to an end."""
        rows = [(link, kind, f.rows, f.trees, f.stopped) for link, fits in self.fits.items() for kind, f in fits.items()]
        return spark.createDataFrame(rows, "component string, type string, rows long, trees int, stopped boolean")


# The chain as published: stuff on the value, location per type on what stuff leaves, tunnel on what both leave.
PITCH_CHAIN = [
    Link("stuff", STUFF_FEATURES, ["pitch_type", "p_throws"], whole_only=False),
    Link("location", LOCATION_FEATURES, ["stand"], per="pitch_type"),
    Link("tunnel", TUNNEL_FEATURES, ["pitch_type", "p_throws"]),
]


def link_score(df: DataFrame, link: Link, fits: dict[str, Trees], out: str) -> DataFrame:
    """df with the score of one link of a chain; 0 where the link has no model or, for whole_only links, a feature is missing."""
    if link.per:
        return score_per_type(df, fits, link.features, out, link.per)
    if not fits:
        return df.withColumn(out, F.lit(0.0).cast("float"))
    if not link.whole_only:
        return predicted(df, fits[""], out, link.categorical, link.features)
    scored = score_complete(df, fits[""].model, link.features, out, None)
    return scored.withColumn(out, F.coalesce(F.col(out) * fits[""].scale + fits[""].mean, F.lit(0.0)).cast("float"))


def score_chain(df: DataFrame, chain: Chain) -> DataFrame:
    """df with a column per component and prefix + "final": weighted components plus intercept."""
    for link in chain.links:
        df = link_score(df, link, chain.fits[link.name], f"{chain.prefix}{link.name}")
    return df.withColumn(f"{chain.prefix}final", blended(chain.weights, chain.prefix))


def blended(weights: dict[str, float], prefix: str = ""):
    total = reduce(lambda a, b: a + b, [F.col(f"{prefix}{n}") * F.lit(w) for n, w in weights.items() if n != "intercept"])
    return total + F.lit(weights["intercept"])


def fit_chain(df: DataFrame, target: str, held: str = "is_test", links: list[Link] = PITCH_CHAIN, prefix: str = "xrv_", penalty: float = 0.0,
              keep: list[str] | None = None, **options) -> tuple[Chain, DataFrame]:
    """(chain, df with its scores). Every link is fitted to what the links before it leave of the target, on the rows that are not held; held rows
    stop the fits and give the weights, for the links have not seen them. Scores are written after every link, which cuts the lineage; what a link
    has written for itself and the scores before it are given back then.

    keep: the columns of df to return (all, if None); the others are written only as long as a later link reads them.
    """
    spark = df.sparkSession
    now, last = df.withColumn("__rest", F.col(target).cast("double")), []

    def written(scored: DataFrame, later: list[Link], mine: list[str]) -> DataFrame:
        if keep is not None:
            read = {target, held, "__rest", *keep, *(c for link in later for c in (*link.features, link.per))}
            scored = scored.select(*[c for c in scored.columns if c in read or c not in df.columns])
        place = len(mine)
        with setting(spark, METHOD_LIMIT, METHOD_BYTES):
            stored = cut(scored, "chain")
        fresh = mine.pop(place)  # outlives the scratch, the scores before it do not
        mine.extend(last)
        last[:] = [fresh]
        return stored

    with scratch(spark) as mine:
        now = written(now, links, mine)
    fits = {}
    for at, link in enumerate(links):
        with scratch(spark) as mine:
            out = f"{prefix}{link.name}"
            if link.per:
                fits[link.name] = fit_per_type_early(now, link.features, "__rest", link.per, held, link.categorical, **options)
            else:
                rows = now.filter(all_present(link.features)) if link.whole_only else filled(now, link.features, link.categorical)
                one = fit_early(rows, link.features, "__rest", held, link.categorical, **options)
                fits[link.name] = {"": one} if one else {}
            scored = link_score(now, link, fits[link.name], out)
            now = written(scored.withColumn("__rest", F.col("__rest") - F.col(out)), links[at + 1:], mine)
    owned(*last)
    names = [f"{prefix}{link.name}" for link in links]
    found = fit_blend(now.filter(F.col(held)), names, target, penalty)
    weights = {link.name: found[n] for link, n in zip(links, names, strict=True)} | {"intercept": found["intercept"]}
    chain = Chain(list(links), fits, weights, prefix)
    kept = now.drop("__rest") if keep is None else now.select(*keep, *names)
    return chain, kept.withColumn(f"{prefix}final", blended(weights, prefix))


def residual(df: DataFrame, target: str, prediction: str, out: str) -> DataFrame:
    """Target of the next model in a chain: what the previous prediction left unexplained."""
    return df.withColumn(out, F.col(target) - F.col(prediction))


def blend_sums(components: list[str], target: str) -> dict:
    """Sums of products of (1, components, target): all that a linear fit needs, one partial aggregation whatever the number of rows."""
    terms = {"one": F.lit(1.0), **{c: F.col(c).cast("double") for c in components}, target: F.col(target).cast("double")}
    names = list(terms)
    return {(a, b): F.sum(terms[a] * terms[b]).alias(f"s_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j}


def fit_blend(df: DataFrame, components: list[str], target: str, penalty: float = 0.0) -> dict[str, float]:
    """Weights and intercept of a linear blend of component predictions, by the normal equations.

    penalty: added to the weights' squares per row, not to the intercept. Rows without a component or target are left out. Components that
    say the same share their weight (least norm); without rows all is 0.
    """
    sums = blend_sums(components, target)
    row = df.select(target, *components).na.drop().agg(*sums.values()).first()
    size = len(components) + 1
    names = ["one", *components, target]
    s = np.zeros((size + 1, size + 1))
    for a, b in sums:
        i, j = names.index(a), names.index(b)
        s[i, j] = s[j, i] = row[f"s_{i}_{j}"] or 0.0
    left = s[:size, :size] + penalty * s[0, 0] * np.diag([0.0] + [1.0] * len(components))
    found = np.linalg.lstsq(left, s[:size, size], rcond=1e-12)[0]
    return {**dict(zip(components, map(float, found[1:]), strict=True)), "intercept": float(found[0])}


def regression_table(df: DataFrame, label: str, prediction: str, by: list[str] = ()) -> DataFrame:
    """n, r2, r, rmse per group, from moments: one aggregation, nothing collected. Rows without both values are left out."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    whole = df.filter(y.isNotNull() & p.isNotNull())
    out = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((y - p) * (y - p)).alias("__mse"), F.var_pop(y).alias("__var"), F.covar_pop(y, p).alias("__cov"), F.var_pop(p).alias("__own"))
    return out.select(*by, "n", (1 - F.try_divide("__mse", "__var")).alias("r2"),
                      F.try_divide("__cov", F.sqrt("__var") * F.sqrt("__own")).alias("r"), F.sqrt("__mse").alias("rmse"))


def auc_table(df: DataFrame, label: str, score: str, by: list[str] = ()) -> DataFrame:
    """n, positives, auc per group: exact, by rank sums in which ties share their mean rank; null without both classes.

    Equal scores are counted first and ranked as in operators.ranks, so no group is in one task.
    """
    from statloom.operators.ranks import average_rank, with_positions

    pool = list(by) or ["__all"]
    rows = df.select(*by, F.lit(0).alias("__all"), F.col(score).alias("__score"), F.col(label).cast("int").alias("__label")).filter(
        F.col("__score").isNotNull() & F.col("__label").isNotNull())
    placed = with_positions(rows, "__score", pool)
    pos, n = F.sum("__label"), F.count(F.lit(1))
    area = F.try_divide(F.sum(F.when(F.col("__label") == 1, average_rank())) - pos * (pos + 1) / 2, pos * (n - pos))
    return placed.groupBy(*pool).agg(n.alias("n"), pos.alias("positives"), area.alias("auc")).drop("__all")


def scaler_table(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(feature, mean, deviation) of a pipeline's scaler: as many rows as the model has inputs."""
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    scaler = next(s for s in model.stages if isinstance(s, StandardScalerModel))
    rows = list(zip(assembler.getInputCols(), map(float, scaler.mean), map(float, scaler.std), strict=True))
    return spark.createDataFrame(rows, "feature string, mean double, deviation double")


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_config(spark, path: str, config: dict) -> str:
    """A model's settings (feature lists, medians, exponents, moments) as one JSON row."""
    import json

    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").write.mode("overwrite").json(path)
    return path


def load_config(spark, path: str) -> dict:
    import json

    return json.loads(spark.read.schema("config string").json(path).first()[0])


def attach_baselines(pitches: DataFrame, baselines: DataFrame) -> DataFrame:
    """The pitcher's fastball means beside every pitch; null for a pitcher without any."""
    return lookup(pitches, baselines, ["pitcher"])
