"""The registered queries: each runs one operator, or a chain of them, over
whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import mixframe as mf
from mixframe.plans.experiments import SCORES, long_scores
from mixframe.runtime import cut_model, shared_folder

from . import points as src

Query = Callable[[SparkSession, str], DataFrame]
CFG = src.EVENTS_CFG
BODY = CFG.centre_cols + CFG.spread_cols


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; adding 0 turns -0 into 0."""
    return df.select(
        *[
            (F.round(c, digits) + F.lit(0.0)).alias(c) if c in names else F.col(c)
            for c in df.columns
        ]
    )


def per_point(df: DataFrame, n: int) -> DataFrame:
    """Fitness as a mean over the points, rounded with the rest of the body."""
    scaled = df.drop("log_fitness").withColumn("fitness", F.col("fitness") / F.lit(float(n)))
    return rounded(scaled, "fitness", *BODY)


# --- sources and projections ------------------------------------------------


def points_split(spark, sf):
    dims, pts = src.embeddings(spark, sf)
    return rounded(pts, *dims)


def delimited_scan(spark, sf):
    """Parts written as delimited text and read back by their name in a base
    folder, with the last column as label."""
    name = f"delimited-{uuid.uuid4().hex}"
    wanted = src.table(spark, sf, "part").selectExpr(
        "p_size", "p_retailprice", "CAST(substr(p_brand, 7) AS INT) AS brand"
    )
    wanted.write.option("sep", " ").csv(mf.dataset_uri(name, shared_folder(spark)))
    read = mf.read_delimited(spark, name, n_dims=2, base=shared_folder(spark))
    return read.groupBy("label").agg(
        F.count("*").alias("n"),
        F.sum("x0").alias("sum_size"),
        F.round(F.avg("x1"), 4).alias("avg_price"),
    )


def content_ids(spark, sf):
    """Order lines, which have no key, numbered by their content."""
    source = src.table(spark, sf, "lineitem")
    return mf.as_points(source, ["l_quantity", "l_extendedprice"], "l_returnflag")


def vector_roundtrip(spark, sf):
    """Events packed into vectors and taken apart again."""
    packed = mf.assemble(src.scaled_events(spark, sf), src.DIMS).select("point_id", "features")
    return rounded(mf.model_vectors(packed, "features", src.DIMS), *src.DIMS)


def label_count(spark, sf):
    return mf.label_count(src.events(spark, sf))


def rejected_points(spark, sf):
    """Orders whose second coordinate is missing or not a number by status."""
    source = src.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS point_id", "o_totalprice AS x0",
        "CASE o_orderstatus WHEN 'F' THEN 0D WHEN 'P' THEN double('NaN') END AS x1",
    )
    return mf.rejected_count(source, src.DIMS)


# --- scaling ------------------------------------------------------------------


def domain_bounds(spark, sf):
    return mf.bounds(src.lines(spark, sf), src.DIMS)


def minmax_scale(spark, sf):
    return rounded(mf.minmax_scale(src.parts(spark, sf), src.DIMS), *src.DIMS)


def zscore_scale(spark, sf):
    return rounded(mf.zscore_scale(src.parts(spark, sf), src.DIMS), *src.DIMS)


# --- population ---------------------------------------------------------------


def hash_sample(spark, sf):
    sample = mf.sample_points(src.events(spark, sf), src.SAMPLE_FRACTION, CFG.seed)
    return sample.select("point_id", "label")


def first_population(spark, sf) -> tuple[DataFrame, DataFrame]:
    pts = src.scaled_events(spark, sf)
    return pts, cut_model(mf.init_population(pts, CFG))


def init_random(spark, sf):
    return rounded(first_population(spark, sf)[1], *BODY)


def init_sampled(spark, sf):
    cfg = CFG.with_(sample_fraction=src.SAMPLE_FRACTION, runs=2)
    return rounded(mf.init_population(src.scaled_events(spark, sf), cfg), *BODY)


def init_farthest(spark, sf):
    dims, pts = src.embeddings(spark, sf)
    cfg = src.FARTHEST_CFG.with_(dims=dims)
    return rounded(mf.init_population(pts, cfg).select("run_id", "id", *cfg.centre_cols), *cfg.centre_cols)


def partners(spark, sf):
    drawn = mf.partners(first_population(spark, sf)[1], CFG, 1)
    return drawn.select("run_id", "id", "r1", "r2", "r3")


def vary(spark, sf):
    pop = first_population(spark, sf)[1]
    return rounded(mf.vary(pop, CFG, 1), *BODY)


def rated_generation(spark, sf) -> tuple[int, DataFrame, DataFrame, DataFrame]:
    """Points, their number, and parents and children with fitness."""
    pts = src.scaled_events(spark, sf)
    extent = mf.domain(pts, CFG.dims)
    pop = cut_model(mf.fitness(mf.init_population(pts, CFG, extent), pts, CFG.dims))
    varied = mf.vary(pop, CFG, 1)
    return extent["n"], pts, pop, cut_model(mf.fitness(varied, pts, CFG.dims))


# --- distances, fitness, selection ---------------------------------------------


def point_distance(spark, sf):
    """The three members of a first population of five nearest to each embedding."""
    dims, pts = _whole_embeddings(spark, sf)
    cfg = src.NEAREST_CFG.with_(dims=dims)
    table = mf.point_distances(pts, mf.init_population(pts, cfg), cfg, nearest=3)
    return rounded(table, "distance", digits=3)


def population_distance(spark, sf):
    """Every child against every parent."""
    pop = first_population(spark, sf)[1]
    children = mf.vary(pop, CFG, 1)
    return rounded(mf.pair_distances(children, pop, CFG), "distance", digits=4)


def fitness(spark, sf):
    """Individuals drawn from the parts, measured on all order lines."""
    cfg = src.FITNESS_CFG
    pop = mf.init_population(mf.minmax_scale(src.parts(spark, sf), src.DIMS), cfg)
    lines = src.lines(spark, sf)
    rated = mf.fitness(pop, mf.minmax_scale(lines, src.DIMS), cfg.dims)
    share = F.col("fitness") / F.lit(float(lines.count()))
    return rounded(rated.select("run_id", "id", share.alias("fitness")), "fitness")


def nearest_window(spark, sf):
    pop = first_population(spark, sf)[1]
    children = mf.vary(pop, CFG, 1)
    return rounded(mf.nearest_by_window(mf.pair_distances(children, pop, CFG)), "distance")


def nearest_minby(spark, sf):
    pop = first_population(spark, sf)[1]
    children = mf.vary(pop, CFG, 1)
    return rounded(mf.nearest(children, pop, CFG), "distance")


def _selected(mode: str, slot: str = "self") -> Query:
    def run(spark, sf):
        n, _, parents, children = rated_generation(spark, sf)
        return per_point(mf.select(parents, children, CFG.with_(slot=slot), mode), n)

    return run


def _evolved(generations: int, selection: str = "crowding", runs: int = 1) -> Query:
    def run(spark, sf):
        pts = src.scaled_events(spark, sf)
        n = src.table(spark, sf, "events").count()
        cfg = CFG.with_(generations=generations, selection=selection, runs=runs)
        return per_point(mf.evolve(pts, cfg), n)

    return run


def evolve_sequential(spark, sf):
    """The settings of a long single run, for two generations."""
    pts = src.scaled_events(spark, sf)
    n = src.table(spark, sf, "events").count()
    return per_point(mf.evolve(pts, src.SEQUENTIAL_CFG), n)


# --- representatives and assignment ---------------------------------------------


def leaders(spark, sf):
    return rounded(mf.leaders(first_population(spark, sf)[1], CFG), *BODY)


def close_pairs(spark, sf):
    reps = mf.leaders(first_population(spark, sf)[1], CFG)
    return rounded(mf.close_pairs(reps, CFG), "distance1", "distance2")


def refine_labels(spark, sf):
    pts, pop = first_population(spark, sf)
    return rounded(mf.representatives(pop, pts, CFG), *BODY)


def assign_nearest(spark, sf):
    """Nearest representative or outlier, before small clusters are given away."""
    pts, pop = first_population(spark, sf)
    reps = cut_model(mf.leaders(pop, CFG))
    near = mf.nearest_labels(pts, reps, CFG, ["point_id"])
    return near.select("point_id", "cluster", "alt")


def _assigned(second: str = "own", keep: Sequence[str] = ("point_id",)) -> Query:
    def run(spark, sf):
        pts, pop = first_population(spark, sf)
        reps = cut_model(mf.leaders(pop, CFG))
        assigned = mf.assign(pts, reps, CFG.with_(second=second))
        return assigned.select("point_id", "cluster", F.col("is_outlier").cast("int").alias("is_outlier"))

    return run


def relabel_dense(spark, sf):
    """Minute numbers of the full hours, numbered without gaps per event type."""
    pts = src.events(spark, sf)
    hours = pts.selectExpr("label AS run_id", "point_id", "CAST(floor(x1) * 60 AS BIGINT) AS cluster")
    return mf.relabel_dense(hours)


def relabel_all(spark, sf):
    """Values in steps of a tenth, numbered without gaps over the whole table."""
    tenths = src.events(spark, sf).selectExpr("point_id", "CAST(floor(x0 * 10) AS BIGINT) AS cluster")
    return mf.relabel_dense(tenths, by=())


def predict(spark, sf):
    assigned = mf.predict(src.scaled_events(spark, sf), CFG.with_(runs=2))
    return assigned.select(
        "run_id", "point_id", "cluster", F.col("is_outlier").cast("int").alias("is_outlier")
    )


# --- evaluation -------------------------------------------------------------------


def _labelled(spark, sf) -> DataFrame:
    """Event types against the quarter of the day."""
    return src.events_by_day(spark, sf).selectExpr(
        "day", "label", "CAST(floor(x1 / 6D) AS BIGINT) AS cluster"
    )


def contingency(spark, sf):
    return mf.contingency(_labelled(spark, sf))


def cluster_scores(spark, sf):
    return rounded(mf.cluster_scores(_labelled(spark, sf), by=["day"]), *SCORES, digits=8)


def score_summary(spark, sf):
    """Statistics of the daily scores, as over replicated runs."""
    daily = mf.cluster_scores(_labelled(spark, sf), by=["day"])
    summary = mf.describe_scores(daily.withColumn("algorithm", F.lit("quarter")))
    stats = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return rounded(summary, *stats, digits=8)


def mean_scores(spark, sf):
    daily = mf.cluster_scores(_labelled(spark, sf), by=["day"])
    return rounded(mf.mean_scores(daily.withColumn("algorithm", F.lit("quarter"))), *SCORES, digits=8)


def sorted_results(spark, sf):
    """Days in ascending order of their adjusted Rand index."""
    daily = mf.cluster_scores(_labelled(spark, sf), by=["day"]).select("day", "ari")
    return mf.sorted_results(rounded(daily, "ari", digits=8), "ari")


def predicted_scores(spark, sf):
    cfg = CFG.with_(runs=2, generations=5)
    return rounded(mf.predicted_scores(src.scaled_events(spark, sf), cfg), *SCORES, digits=7)


def compare_algorithms(spark, sf):
    """Distributed evolution, sequential evolution and EM on the same events,
    in ascending order of each score."""
    pts = src.scaled_events(spark, sf)
    with mf.held(pts, ["point_id", "label", *src.DIMS]) as held:
        start = mf.kmeans_start(held, src.DIMS, len(src.EVENT_TYPES), src.COMPARE_CFG.seed)
        comps = mf.em_fit(held, start, src.DIMS)
        fitted = mf.em_predict(held, comps, src.DIMS, ["label"]).withColumnRenamed("prediction", "cluster")
        found = mf.compare_algorithms(
            {
                "distributed": mf.predict(held, src.COMPARE_CFG, keep=["label"]),
                "sequential": mf.predict(held, src.COMPARE_SEQUENTIAL_CFG, keep=["label"]),
                "em": fitted,
            }
        )
        long = cut_model(rounded(found, "value", digits=7))
    return mf.sorted_results(long, "value")


def evolve_resumed(spark, sf):
    """Three generations, of which the first were made by a loop cut short."""
    pts = src.scaled_events(spark, sf)
    log = f"{shared_folder(spark)}/generations-{uuid.uuid4().hex}"
    mf.evolve(pts, CFG.with_(generations=2), log)
    return per_point(mf.evolve(pts, CFG.with_(generations=3), log), src.table(spark, sf, "events").count())


# --- experiments ---------------------------------------------------------------------


def _search(spark, sf) -> DataFrame:
    """The population goes through a snapshot, as between two sessions."""
    dims, pts = _whole_embeddings(spark, sf)
    cfg = src.SEARCH_CFG.with_(dims=dims)
    folder = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    mf.write_population(mf.evolve(pts, cfg).select("run_id", "id", *cfg.centre_cols, *cfg.spread_cols), folder)
    return mf.delta_search(pts, mf.read_population(spark, folder), cfg)


def delta_search(spark, sf):
    report = _search(spark, sf).select("i", "j", "k", "delta1", "delta2", "delta3", "ari")
    return rounded(report, "delta1", "delta2", "delta3", "ari")


def best_deltas(spark, sf):
    # Equal up to the last bits counts as a tie, which goes to the smallest triple.
    report = _search(spark, sf).withColumn("ari", F.round("ari", 9))
    return rounded(mf.best_deltas(report), "delta1", "delta2", "delta3", "ari")


def snapshot_roundtrip(spark, sf):
    """A population written, read back and reported on as JSON."""
    folder = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    pop = mf.init_population(src.scaled_events(spark, sf), CFG.with_(runs=2))
    mf.write_population(pop, f"{folder}/population")
    back = mf.read_population(spark, f"{folder}/population")
    mf.write_report(back, f"{folder}/report")
    report = spark.read.schema(back.schema).json(f"{folder}/report")
    return rounded(report, *BODY)


def _repeated(spark, sf) -> DataFrame:
    pts = src.scaled_events(spark, sf)
    return mf.replicates(pts, src.REPLICATES_CFG, n=src.REPLICATES, k=len(src.EVENT_TYPES))


def replicates(spark, sf):
    """Evolution by the default settings and EM, twenty runs each."""
    return rounded(_repeated(spark, sf), *SCORES, digits=7)


def replicate_means(spark, sf):
    return rounded(mf.mean_scores(_repeated(spark, sf)), *SCORES, digits=7)


def replicate_summary(spark, sf):
    stats = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return rounded(mf.describe_scores(_repeated(spark, sf)), *stats, digits=7)


def replicate_comparison(spark, sf):
    """Every score of every run of both algorithms, in ascending order."""
    long = long_scores(_repeated(spark, sf), ["run_id", "algorithm"])
    return mf.sorted_results(rounded(long, "value", digits=7), "value")


# --- mixtures ---------------------------------------------------------------------------


def _by_type(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Scaled events and one component per event type."""
    pts = src.scaled_events(spark, sf)
    n = F.sum("n").over(Window.partitionBy())
    stats = pts.groupBy("label").agg(
        F.count("*").alias("n"),
        F.array(F.avg("x0"), F.avg("x1")).alias("mean"),
        F.array(
            F.array(F.var_pop("x0"), F.covar_pop("x0", "x1")),
            F.array(F.covar_pop("x0", "x1"), F.var_pop("x1")),
        ).alias("cov"),
    )
    comps = stats.select(
        F.lit(0).cast("bigint").alias("run_id"), F.col("label").alias("comp"), "n", "mean", "cov"
    ).select("run_id", "comp", (F.col("n") / n).alias("weight"), "mean", "cov")
    return pts, comps


def _flat(comps: DataFrame) -> DataFrame:
    flat = comps.select(
        "run_id", "comp", "weight",
        *[F.col("mean")[k].alias(f"m{k}") for k in range(2)],
        *[F.col("cov")[i][j].alias(f"v{i}{j}") for i, j in ((0, 0), (0, 1), (1, 1))],
    )
    return rounded(flat, "weight", "m0", "m1", "v00", "v01", "v11")


def gmm_step(spark, sf):
    """Two EM steps from one component per event type."""
    pts, comps = _by_type(spark, sf)
    return _flat(mf.gmm_step(pts, mf.gmm_step(pts, comps, src.DIMS), src.DIMS))


def kmeans_start(spark, sf):
    """Starting components of two runs on all components of the embeddings: of
    the mean its sum and last entry, of the covariance its sum and a corner."""
    dims, pts = _whole_embeddings(spark, sf)
    comps = mf.kmeans_start(pts, dims, src.START_K, src.START_SEED, runs=2)
    total = "aggregate({}, 0D, (s, v) -> s + v)"
    flat = comps.selectExpr(
        "run_id", "comp", "weight", f"{total.format('mean')} AS mean_sum", "element_at(mean, -1) AS last_mean",
        f"{total.format('flatten(cov)')} AS cov_sum", "element_at(cov, -1)[0] AS corner",
    )
    return rounded(flat, "weight", "mean_sum", "last_mean", "cov_sum", "corner")


def component_ellipse(spark, sf):
    """Of all components that some point was given to."""
    pts, comps = _by_type(spark, sf)
    used = pts.selectExpr("0L AS run_id", "label AS comp")
    return rounded(mf.component_ellipse(comps, used), "x", "y", "width", "height", "angle")


def _whole_embeddings(spark, sf) -> tuple[tuple[str, ...], DataFrame]:
    """All components of the embeddings: their names and the scaled points."""
    dims, pts = src.embeddings(spark, sf)
    return dims, mf.minmax_scale(pts, dims)


def gmm_fit_predict(spark, sf):
    dims, pts = _whole_embeddings(spark, sf)
    model = mf.fit_mixture(pts, dims, k=3, seed=7)
    return mf.predict_mixture(model, pts, dims).groupBy("prediction").agg(
        F.count("*").alias("n")
    )


def gmm_components(spark, sf):
    """Spark ML's mixture against its own components taken out as a table: how
    many there are, their weight, and on how many events both predict the same."""
    pts = src.scaled_events(spark, sf).selectExpr("point_id", "x1 AS x0", "x1 * x1 AS x1")
    model = mf.fit_mixture(pts, src.DIMS, k=2, seed=7)
    comps = mf.mixture_components(model)
    theirs = mf.predict_mixture(model, pts, src.DIMS).select("point_id", F.col("prediction").alias("theirs"))
    ours = mf.em_predict(pts, comps, src.DIMS, ["point_id"])
    same = ours.join(theirs, "point_id").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("theirs")).alias("n_same"))
    whole = comps.agg(F.count("*").alias("k"), F.round(F.sum("weight"), 6).alias("weight")).first()
    return same.select(F.lit(whole.k).cast("bigint").alias("k"), F.lit(whole.weight).alias("weight"), "n", "n_same")


def em_fit_predict(spark, sf):
    """EM from k-means, all steps as passes over the points."""
    dims, pts = _whole_embeddings(spark, sf)
    with mf.held(pts, ["point_id", *dims]) as held:
        start = mf.kmeans_start(held, dims, src.START_K, src.START_SEED)
        comps = mf.em_fit(held, start, dims)
    return mf.em_predict(pts, comps, dims, ["point_id"])


QUERIES: dict[str, Query] = {
    "points_split": points_split,
    "delimited_scan": delimited_scan,
    "content_ids": content_ids,
    "vector_roundtrip": vector_roundtrip,
    "label_count": label_count,
    "rejected_points": rejected_points,
    "domain_bounds": domain_bounds,
    "minmax_scale": minmax_scale,
    "zscore_scale": zscore_scale,
    "hash_sample": hash_sample,
    "init_random": init_random,
    "init_sampled": init_sampled,
    "init_farthest": init_farthest,
    "partners": partners,
    "vary": vary,
    "point_distance": point_distance,
    "population_distance": population_distance,
    "fitness": fitness,
    "nearest_window": nearest_window,
    "nearest_minby": nearest_minby,
    "select_greedy": _selected("greedy"),
    "select_crowding": _selected("crowding"),
    "select_competitor": _selected("crowding", "competitor"),
    "select_nearest_child": _selected("nearest_child"),
    "evolve_1gen": _evolved(1),
    "evolve_3gen": _evolved(3),
    "evolve_greedy": _evolved(2, "greedy", runs=2),
    "evolve_nearest_child": _evolved(2, "nearest_child"),
    "evolve_sequential": evolve_sequential,
    "evolve_resumed": evolve_resumed,
    "leaders": leaders,
    "close_pairs": close_pairs,
    "refine_labels": refine_labels,
    "assign_nearest": assign_nearest,
    "assign_refined": _assigned(),
    "assign_rep1": _assigned("rep1"),
    "relabel_dense": relabel_dense,
    "relabel_all": relabel_all,
    "predict": predict,
    "contingency": contingency,
    "cluster_scores": cluster_scores,
    "score_summary": score_summary,
    "mean_scores": mean_scores,
    "sorted_results": sorted_results,
    "predicted_scores": predicted_scores,
    "compare_algorithms": compare_algorithms,
    "delta_search": delta_search,
    "best_deltas": best_deltas,
    "snapshot_roundtrip": snapshot_roundtrip,
    "replicates": replicates,
    "replicate_means": replicate_means,
    "replicate_summary": replicate_summary,
    "replicate_comparison": replicate_comparison,
    "kmeans_start": kmeans_start,
    "gmm_step": gmm_step,
    "component_ellipse": component_ellipse,
    "gmm_components": gmm_components,
    "gmm_fit_predict": gmm_fit_predict,
    "em_fit_predict": em_fit_predict,
}
