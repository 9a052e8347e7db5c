"""Statistics over experiment runs: seeds, ratios, arms, recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import parse_run, ratio_of, recipe, series


def parsed(metrics: DataFrame) -> DataFrame:
    """metrics (run_name, ...) with kind, detector, generator, pct, filter and seed; other names are dropped."""
    return metrics.withColumn("_r", parse_run(F.col("run_name"))).filter("_r.kind is not null").select("*", "_r.*").drop("_r")


def mean_std(rows: DataFrame, keys: list[str], value: str = "metric") -> DataFrame:
    """keys, n, mean, population and sample deviation (0 and null for one run)."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"), F.stddev_samp(value).alias("std_samp"))


def paired(a: DataFrame, b: DataFrame, keys: list[str], value: str = "metric") -> DataFrame:
    """keys, n, mean difference a - b, its sample deviation and t over shared seeds; t is null without spread."""
    other = b.select(*keys, "seed", F.col(value).alias("_b"))
    d = a.join(other, [*keys, "seed"]).withColumn("d", F.col(value) - F.col("_b"))
    rows = d.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("delta"), F.stddev_samp("d").alias("sd"), F.collect_list("d").alias("differences"))
    return rows.withColumn("t", F.try_divide(F.col("delta"), F.col("sd") / F.sqrt("n")))


def sweep(rows: DataFrame) -> DataFrame:
    """detector, generator, filter, pct, n, hybrid, matched, real means, and hybrid's gains over both, on shared seeds."""
    keys = ["detector", "filter", "seed"]
    real = rows.filter("kind = 'real'").groupBy(*keys).agg(F.avg("metric").alias("real"))
    matched = rows.filter("kind = 'matched'").groupBy("detector", "filter", "generator", "pct", "seed").agg(F.avg("metric").alias("matched"))
    hybrid = rows.filter("kind = 'hybrid'")

    def joined(left: DataFrame, right: DataFrame, on: list[str], value: str) -> DataFrame:
        r = right.select(*(F.col(c).alias(f"_{c}") for c in on), value)
        match = F.lit(True)
        for c in on:
            match &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        return left.join(r, match, "left").drop(*(f"_{c}" for c in on))

    both = joined(joined(hybrid, real, keys, "real"), matched, ["detector", "filter", "generator", "pct", "seed"], "matched")
    return both.groupBy("detector", "generator", "filter", "pct").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("metric").alias("hybrid"),
        F.avg("real").alias("real"),
        F.avg("matched").alias("matched"),
        F.avg(F.col("metric") - F.col("real")).alias("gain_real"),
        F.avg(F.col("metric") - F.col("matched")).alias("gain_matched"),
    )


def best_ratio(sweep_rows: DataFrame) -> DataFrame:
    """detector, generator, filter with the ratio of the highest mean; of equal ones the lowest ratio."""
    top = F.max(F.struct("hybrid", (-F.col("pct")).alias("p"), "gain_real")).alias("top")
    rows = sweep_rows.groupBy("detector", "generator", "filter").agg(top)
    verdict = F.when(F.col("top.gain_real") > 0, "helps").when(F.col("top.gain_real") < 0, "hurts").otherwise("even")
    return rows.select("detector", "generator", "filter", (-F.col("top.p")).alias("pct"), F.col("top.hybrid").alias("hybrid"), verdict.alias("verdict"))


def recovery(rows: DataFrame, keys: list[str], arms: tuple[str, str, str] = ("A", "B", "T")) -> DataFrame:
    """keys, means of the arms and (T - A) / (B - A): of the means, and the mean of seeds; null where B = A.

    rows has keys, generator (the arm), seed and metric; only seeds of all three arms give a seed's value.
    """
    names = ["a", "b", "t"]
    wide = rows.groupBy(*keys, "seed").agg(*(F.avg(F.when(F.col("generator") == arm, F.col("metric"))).alias(n) for arm, n in zip(arms, names)))
    one = F.try_divide(F.col("t") - F.col("a"), F.col("b") - F.col("a"))
    out = wide.withColumn("r", one).groupBy(*keys).agg(*(F.avg(n).alias(n) for n in names), F.avg("r").alias("recovery_seeds"), F.count("r").alias("seeds"))
    return out.withColumn("recovery", F.try_divide(F.col("t") - F.col("a"), F.col("b") - F.col("a")))


def seed_wins(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, wins of a over b on the same seed, and over all pairs of seeds (a few per condition)."""
    other = b.select(*keys, F.col("seed").alias("seed_b"), F.col("metric").alias("metric_b"))
    pairs = a.join(other, keys)
    won, same = F.col("metric") > F.col("metric_b"), F.col("seed") == F.col("seed_b")
    return pairs.groupBy(*keys).agg(F.count_if(same).alias("n_matched"), F.count_if(same & won).alias("won_matched"), F.count(F.lit(1)).alias("n_all"), F.count_if(won).alias("won_all"))


def recipes(log: DataFrame) -> DataFrame:
    """run, peak learning rate, epochs and recipe."""
    return log.groupBy("run").agg(F.max("lr").alias("peak"), F.max("epoch").alias("epochs")).withColumn("recipe", recipe(F.col("peak")))


def disagreement(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys whose runs differ in recipe, with the recipes; with two, the difference of their mean metrics."""
    by = rows.groupBy(*keys, "recipe").agg(F.avg("metric").alias("m"), F.count(F.lit(1)).alias("n"))
    out = by.groupBy(*keys).agg(F.sort_array(F.collect_set("recipe")).alias("recipes"), F.sum("n").alias("n"), (F.max_by("m", "recipe") - F.min_by("m", "recipe")).alias("d"))
    out = out.filter(F.size("recipes") >= 2)
    return out.select(*keys, F.array_join("recipes", "+").alias("recipes"), "n", F.when(F.size("recipes") == 2, F.col("d")).alias("delta"))


def change_flags(rows: DataFrame, keys: list[str], along: str) -> DataFrame:
    """keys, along, recipes, changed: whether the set of recipes differs from that of the step before."""
    by = rows.groupBy(*keys, along).agg(F.array_join(F.sort_array(F.collect_set("recipe")), "+").alias("recipes"))
    before = F.lag("recipes").over(Window.partitionBy(*keys).orderBy(along))
    return by.withColumn("changed", before.isNotNull() & (before != F.col("recipes")))


def contrast(a: Column, b: Column, budget_a: Column, budget_b: Column) -> Column:
    """Verdict on comparing two sets of recipes: 'matched', 'budget' (same recipe, other epochs), or 'mismatch'."""
    return F.when(a != b, "mismatch").when(budget_a != budget_b, "budget").otherwise("matched")


def with_metrics(runs: DataFrame, metrics: DataFrame, splits: list[str], metric: str = "map50", key: str = "run") -> DataFrame:
    """runs with <split>_<metric> for each split, null for runs or splits without a row in metrics (key, split, metric)."""
    wide = metrics.groupBy(key).pivot("split", splits).agg(F.first(metric))
    return runs.join(wide.select(key, *(F.col(s).alias(f"{s}_{metric}") for s in splits)), key, "left")


def class_readout(rows: DataFrame, baseline: str, family: str = "family", value: str = "metric") -> DataFrame:
    """family, cls (null: mean over classes with a value), mean over seeds, delta to the baseline family, n.

    rows has family, cls and value, null where a run has none; such runs are left out of a class's mean.
    """
    by = rows.groupBy(family, "cls").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    every = by.unionByName(by.groupBy(family).agg(F.avg("mean").alias("mean"), F.count("mean").alias("n")).withColumn("cls", F.lit(None).cast("int")))
    base = every.filter(F.col(family) == baseline).select(F.col("cls").alias("_c"), F.col("mean").alias("_b"))
    return every.join(base, F.col("cls").eqNullSafe(F.col("_c")), "left").select(family, "cls", "mean", (F.col("mean") - F.col("_b")).alias("delta"), "n")


def subset_means(ap: DataFrame, subsets: dict[str, list[int]], value: str = "ap", by: str = "bin") -> DataFrame:
    """bin, subset, mean over the present classes of the subset, classes, n_gt."""
    names = F.array_compact(F.array(*[F.when(F.col("cls").isin(*ids), F.lit(name)) for name, ids in subsets.items()]))
    rows = ap.filter(F.col(value).isNotNull()).withColumn("subset", F.explode(names))
    return rows.groupBy(by, "subset").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("classes"), F.sum("n_gt").alias("n_gt"))


def interventions(means: DataFrame, contrasts: list[tuple[str, str, str]], keys: list[str]) -> DataFrame:
    """label, generator, reference, keys, a (the reference's mean), b, delta of each intervention on equal keys; a and delta null where no reference matches.

    means has generator, keys and metric; contrasts are (generator, reference, label).
    """
    table = F.array(*[F.struct(F.lit(g).alias("generator"), F.lit(r).alias("reference"), F.lit(t).alias("label")) for g, r, t in contrasts])
    match = F.filter(table, lambda c: c["generator"] == F.col("generator"))
    rows = means.withColumn("c", F.explode(match)).select("c.label", "generator", "c.reference", *keys, F.col("metric").alias("b"))
    ref = means.select(F.col("generator").alias("_g"), *(F.col(k).alias(f"_{k}") for k in keys), F.col("metric").alias("a"))
    on = F.col("reference") == F.col("_g")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(ref, on, "left").select("label", "generator", "reference", *keys, "a", "b", (F.col("b") - F.col("a")).alias("delta"))


def near_targets(means: DataFrame, targets: list[tuple[str, float, str | None]], tolerance: float) -> DataFrame:
    """label, a, b, delta: pairs of families of one ratio and filter, either way round, whose difference comes within tolerance of a target.

    means has family and metric; targets are (label, target, a word that one of the names must have, or none). Pairs meet
    in an equi-join on the ratio and filter at the end of the names; names without a ratio have no pair.
    """
    rows = means.withColumn("_r", ratio_of(F.col("family"))).filter("_r.pct is not null").select("family", "metric", F.col("_r.pct").alias("pct"), F.coalesce("_r.filter", F.lit(-1)).alias("flt"))
    pairs = rows.select(F.col("family").alias("a"), F.col("metric").alias("_ma"), "pct", "flt").join(rows.select(F.col("family").alias("b"), F.col("metric").alias("_mb"), "pct", "flt"), ["pct", "flt"]).filter("a <> b")
    pairs = pairs.select("a", "b", (F.col("_mb") - F.col("_ma")).alias("delta"))
    wanted = F.array(*[F.struct(F.lit(t).alias("label"), F.lit(float(v)).alias("target"), F.lit(w).cast("string").alias("word")) for t, v, w in targets])
    fits = F.filter(wanted, lambda w: (F.abs(F.col("delta") - w["target"]) <= tolerance) & (w["word"].isNull() | F.contains(F.col("a"), w["word"]) | F.contains(F.col("b"), w["word"])))
    return pairs.withColumn("w", F.explode(fits)).select("w.label", "a", "b", "delta")


def spans(reports: DataFrame, columns: list[str]) -> DataFrame:
    """column, low, high, span, of_high and of_low (the span over each) of columns across arms: reports has a row for each arm."""
    long = reports.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    rows = long.groupBy("column").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    span = F.col("high") - F.col("low")
    return rows.select("column", "low", "high", span.alias("span"), F.try_divide(span, F.col("high")).alias("of_high"), F.try_divide(span, F.col("low")).alias("of_low"))


def curves(metrics: DataFrame, value: str) -> DataFrame:
    """series, detector, ratio, n, mean, std (of the population): what a curve over ratios shows. Names without a seed are left out."""
    rows = metrics.withColumn("_s", series(F.col("run_name"))).filter("_s.seed is not null").select(value, "_s.*")
    return rows.groupBy("series", "detector", "ratio").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def efficiency(models: DataFrame) -> DataFrame:
    """models (detector, params, gflops, preprocess_ms, inference_ms, postprocess_ms, imgsz) as a report: millions of parameters, frames a second."""
    ms = F.col("inference_ms")
    rounded = [F.round(c, 2).alias(c) for c in ("preprocess_ms", "inference_ms", "postprocess_ms")]
    return models.select("detector", F.round(F.nullif(F.col("params"), F.lit(0)) / 1e6, 2).alias("params_M"), F.round("gflops", 1).alias("gflops"), *rounded, F.round(F.try_divide(F.lit(1000.0), ms), 1).alias("fps"), "imgsz")
