"""Queries over experiment runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import CLASSES, optimizer, percent_profile
from ..functions.stats import paired_t_p, signed_rank_p
from ..operators import runs as rn
from .fixtures import SQL, frame_boxes, frames, run_metrics, run_metrics_class, split_metrics, train_log

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _rx(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(run_name, '{pattern}', {group}), '')"


_DET = "(yolo11|yolo26|rtdetrv2)"
_REAL, _HYB, _MAT, _ARM = (
    rf"^realonly_{_DET}(?:_real)?(?:_x(\d+))?_seed(\d+)$",
    rf"^hybrid_{_DET}_(.+?)_r(\d+)(?:_x(\d+))?_seed(\d+)$",
    rf"^matched_{_DET}_(.+?)_r(\d+)(?:_x(\d+))?_seed(\d+)$",
    r"^annotred_(A|B|M|T(?:_.+)?)_([^_]+)_seed(\d+)$",
)


def _parse(table: str, name: str) -> str:
    def pick(real: str, hybrid: str, arm: str) -> str:
        return f"case kind when 'real' then {real} when 'arm' then {arm} when 'hybrid' then {hybrid.format(p=_HYB)} else {hybrid.format(p=_MAT)} end"

    def both(k: int) -> str:
        return "nullif(regexp_extract(run_name, '{p}', " + str(k) + "), '')"

    return (
        f"{name}_k as (select *, case when regexp_matches(run_name, '{_REAL}') then 'real' when regexp_matches(run_name, '{_HYB}') then 'hybrid' when regexp_matches(run_name, '{_MAT}') then 'matched' when regexp_matches(run_name, '{_ARM}') then 'arm' end as kind from {table}), "
        f"{name} as (select *, {pick(_rx(_REAL, 1), both(1), _rx(_ARM, 2))} as detector, {pick('null', both(2), _rx(_ARM, 1))} as generator, {pick('null', both(3), 'null')}::int as pct, {pick(_rx(_REAL, 2), both(4), 'null')}::int as filter, {pick(_rx(_REAL, 3), both(5), _rx(_ARM, 3))}::int as seed from {name}_k where kind is not null)"
    )


def _with(*ctes: str) -> str:
    return f"with recursive {SQL}, " + ", ".join([_parse("run_metrics", "runs"), *ctes]) + " "


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rn.parsed(run_metrics(spark, sf_dir))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(_with() + "select run_name, kind, detector, generator, pct, filter, seed, round(metric, 6) as metric from runs")
def run_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run names taken apart."""
    return _rounded(_runs(spark, sf_dir), "metric")


@query(_with() + "select kind, detector, generator, pct, count(metric) as n, round(avg(metric), 6) as mean, round(stddev_pop(metric), 6) as std_pop, round(stddev_samp(metric), 6) as std_samp from runs group by all")
def seed_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and both deviations over seeds."""
    return _rounded(rn.mean_std(_runs(spark, sf_dir), ["kind", "detector", "generator", "pct"]), "mean", "std_pop", "std_samp")


_SWEEP = "real as (select detector, filter, seed, avg(metric) as real from runs where kind = 'real' group by all), mat as (select detector, filter, generator, pct, seed, avg(metric) as matched from runs where kind = 'matched' group by all), sweep as (select h.detector, h.generator, h.filter, h.pct, count(*) as n, avg(metric) as hybrid, avg(r.real) as real, avg(m.matched) as matched, avg(metric - r.real) as gain_real, avg(metric - m.matched) as gain_matched from runs h left join real r on h.detector = r.detector and h.filter is not distinct from r.filter and h.seed = r.seed left join mat m on h.detector = m.detector and h.filter is not distinct from m.filter and h.generator = m.generator and h.pct = m.pct and h.seed = m.seed where h.kind = 'hybrid' group by all)"


@query(_with(_SWEEP) + "select detector, generator, filter, pct, n, round(hybrid, 6) as hybrid, round(real, 6) as real, round(matched, 6) as matched, round(gain_real, 6) as gain_real, round(gain_matched, 6) as gain_matched from sweep")
def sweep_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid runs against real-only and size-matched ones of the same seed."""
    return _rounded(rn.sweep(_runs(spark, sf_dir)), "hybrid", "real", "matched", "gain_real", "gain_matched")


@query(_with(_SWEEP, "b as (select *, row_number() over (partition by detector, generator, filter order by round(hybrid, 9) desc, pct) as k from sweep)") + "select detector, generator, filter, pct, round(hybrid, 6) as hybrid, case when gain_real > 0 then 'helps' when gain_real < 0 then 'hurts' else 'even' end as verdict from b where k = 1")
def best_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ratio of each generator."""
    return _rounded(rn.best_ratio(rn.sweep(_runs(spark, sf_dir)).withColumn("hybrid", F.round("hybrid", 9))), "hybrid")


@query(_with(_SWEEP) + "select detector, pct, round(avg(hybrid) filter (generator = 'v2'), 6) as v2, round(avg(hybrid) filter (generator = 'v8'), 6) as v8 from sweep group by detector, pct")
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generators beside each other, by ratio."""
    return _rounded(rn.sweep(_runs(spark, sf_dir)).groupBy("detector", "pct").pivot("generator", ["v2", "v8"]).agg(F.avg("hybrid")), "v2", "v8")


def _recovery(table: str, keys: str) -> str:
    return f"wide as (select {keys}, seed, avg(metric) filter (generator = 'A') as a, avg(metric) filter (generator = 'B') as b, avg(metric) filter (generator = 'T') as t from {table} group by {keys}, seed), rec as (select {keys}, avg(a) as a, avg(b) as b, avg(t) as t, avg((t - a) / nullif(b - a, 0)) as recovery_seeds, count((t - a) / nullif(b - a, 0)) as seeds from wide group by {keys})"


_RECOVERED = "round(a, 6) as a, round(b, 6) as b, round(t, 6) as t, round(recovery_seeds, 4) as recovery_seeds, seeds, round((t - a) / nullif(b - a, 0), 4) as recovery from rec"


def _recovered(df: DataFrame) -> DataFrame:
    return _rounded(df, "a", "b", "t").withColumns({n: F.round(n, 4) for n in ("recovery", "recovery_seeds")})


@query(_with("arms as (select * from runs where kind = 'arm')", _recovery("arms", "detector")) + f"select detector, {_RECOVERED}")
def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the gap between two arms a third one closes."""
    return _recovered(rn.recovery(_runs(spark, sf_dir).filter("kind = 'arm'"), ["detector"]))


@query(_with(_parse("run_metrics_class", "cruns"), _recovery("cruns", "cls")) + f"select cls, {_RECOVERED}")
def recovery_perclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by class; absent classes are null."""
    return _recovered(rn.recovery(rn.parsed(run_metrics_class(spark, sf_dir)), ["cls"]))


@query(_with("p as (select a.detector, a.pct, a.seed = b.seed as same, a.metric > b.metric as won from runs a join runs b on a.detector = b.detector and a.pct = b.pct where a.kind = 'hybrid' and b.kind = 'hybrid' and a.generator = 'v8' and b.generator = 'v2')") + "select detector, pct, count(*) filter (same) as n_matched, count(*) filter (same and won) as won_matched, count(*) as n_all, count(*) filter (won) as won_all from p group by all")
def seed_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one generator beats the other, on equal seeds and over all pairs."""
    h = _runs(spark, sf_dir).filter("kind = 'hybrid'")
    return rn.seed_wins(h.filter("generator = 'v8'"), h.filter("generator = 'v2'"), ["detector", "pct"])


@query(_with("d as (select a.detector, a.pct, a.metric - b.metric as d from runs a join runs b on a.detector = b.detector and a.pct = b.pct and a.seed = b.seed where a.kind = 'hybrid' and b.kind = 'hybrid' and a.generator = 'v8' and b.generator = 'v2')", "s as (select detector, pct, count(d) as n, avg(d) as delta, avg(d) / nullif(stddev_samp(d) / sqrt(count(d)), 0) as t from d group by all)") + "select detector, pct, n, round(delta, 6) as delta, round(t, 4) as t, case when n = 3 then round(1 - abs(t) / sqrt(t * t + 2), 6) end as p_closed from s")
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired t of two generators; with three seeds, p has a closed form."""
    h = _runs(spark, sf_dir).filter("kind = 'hybrid'")
    rows = rn.paired(h.filter("generator = 'v8'"), h.filter("generator = 'v2'"), ["detector", "pct"])
    p = F.when(F.col("n") == 3, F.round(1 - F.abs("t") / F.sqrt(F.col("t") * F.col("t") + 2), 6))
    return rows.select("detector", "pct", "n", F.round("delta", 6).alias("delta"), F.round("t", 4).alias("t"), p.alias("p_closed"))


_SIGNS = (
    "d as (select a.detector, a.pct, a.metric - b.metric as d, a.seed from runs a join runs b on a.detector = b.detector and a.pct = b.pct and a.seed = b.seed where a.kind = 'hybrid' and b.kind = 'hybrid' and a.generator = 'v8' and b.generator = 'v2')",
    "s as (select detector, pct, count(d) as n, avg(d) / nullif(stddev_samp(d) / sqrt(count(d)), 0) as t from d group by all)",
    "rk as (select *, rank() over (partition by detector, pct order by abs(d)) + (count(*) over (partition by detector, pct, abs(d)) - 1) / 2.0::double as r, row_number() over (partition by detector, pct order by seed) - 1 as k, count(*) over (partition by detector, pct) as m from d where d <> 0)",
    "w as (select detector, pct, m, least(sum(r) filter (d > 0), sum(r) filter (d < 0), coalesce(sum(r) filter (d > 0), 0), coalesce(sum(r) filter (d < 0), 0)) as w from rk group by all)",
    "u as (select rk.detector, rk.pct, g.g, sum(case when (g.g >> k) & 1 = 1 then r else 0 end) as total from rk join range(65536) as g(g) on g.g < (1 << m) group by all)",
    "p as (select w.detector, w.pct, least(1.0::double, 2 * count(*) filter (total <= w + 1e-9)::double / count(*)) as p from w join u using (detector, pct) group by all)",
)


@query(_with(*_SIGNS) + "select detector, pct, n, case when n = 3 then round(1 - abs(t) / sqrt(t * t + 2), 6) end as t_p, round(p, 6) as wilcoxon_p from s left join p using (detector, pct)")
def paired_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-values of the paired t-test and of the signed-rank test."""
    h = _runs(spark, sf_dir).filter("kind = 'hybrid'")
    rows = rn.paired(h.filter("generator = 'v8'"), h.filter("generator = 'v2'"), ["detector", "pct"])
    return rows.select("detector", "pct", "n", F.round(paired_t_p(F.col("t"), F.col("n")), 6).alias("t_p"), F.round(signed_rank_p(F.col("differences")), 6).alias("wilcoxon_p"))


_RECIPE = "rec as (select run, max(lr) as peak, max(epoch) as epochs from train_log group by run), recipes as (select *, case when peak > 0.02::double then 'MuSGD_lr0.01' when peak > 0.0005::double then 'AdamW_lr0.00111' when peak > 0.00005::double then 'AdamW_lr0.0001' else 'explicit_lr1e-05' end as recipe, run % 5 as condition, run % 7 as ratio, test_map50 as metric, val_map50 from rec left join (select run, avg(map50) filter (split = 'test') as test_map50, avg(map50) filter (split = 'val') as val_map50 from split_metrics group by run) using (run))"


def _recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rn.with_metrics(rn.recipes(train_log(spark, sf_dir)), split_metrics(spark, sf_dir), ["test", "val"])
    return rows.withColumns({"condition": F.col("run") % 5, "ratio": F.col("run") % 7, "metric": F.col("test_map50")})


@query(_with(_RECIPE) + "select run, epochs, recipe, round(metric, 6) as test_map50, round(val_map50, 6) as val_map50 from recipes")
def recipe_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with their recipes and with what they score on each split."""
    return _rounded(_recipes(spark, sf_dir).select("run", "epochs", "recipe", "test_map50", "val_map50"), "test_map50", "val_map50")


@query(_with(_RECIPE) + "select run, round(peak, 9) as peak, epochs, recipe from recipes")
def recipe_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes of runs by their peak learning rate."""
    return rn.recipes(train_log(spark, sf_dir)).withColumn("peak", F.round("peak", 9))


@query(_with(_RECIPE, "by_recipe as (select condition, recipe, avg(metric) as m, count(*) as n from recipes group by all)") + "select condition, string_agg(recipe, '+' order by recipe) as recipes, sum(n)::bigint as n, round(case when count(*) = 2 then arg_max(m, recipe) - arg_min(m, recipe) end, 6) as delta from by_recipe group by condition having count(*) >= 2")
def recipe_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions whose runs were trained by several recipes."""
    return _rounded(rn.disagreement(_recipes(spark, sf_dir), ["condition"]), "delta")


@query(_with(_RECIPE, "sets as (select condition, ratio, string_agg(distinct recipe, '+' order by recipe) as recipes from recipes group by all)") + "select condition, ratio, recipes, coalesce(lag(recipes) over (partition by condition order by ratio) <> recipes, false) as changed from sets")
def recipe_change_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where along the ratios the recipe changes."""
    return rn.change_flags(_recipes(spark, sf_dir), ["condition"], "ratio")


@query(_with(_RECIPE, "sets as (select condition, string_agg(distinct recipe, '+' order by recipe) as s, max(epochs) as e from recipes group by condition)") + "select a.condition as a, b.condition as b, case when a.s <> b.s then 'mismatch' when a.e <> b.e then 'budget' else 'matched' end as verdict from sets a join sets b on a.condition < b.condition")
def contrast_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether conditions can be compared: same recipes, same epochs."""
    s = _recipes(spark, sf_dir).groupBy("condition").agg(F.array_join(F.sort_array(F.collect_set("recipe")), "+").alias("s"), F.max("epochs").alias("e"))
    a, b = s.select(*(F.col(c).alias(f"a_{c}") for c in s.columns)), s.select(*(F.col(c).alias(f"b_{c}") for c in s.columns))
    pairs = a.join(b, F.col("a_condition") < F.col("b_condition"))  # of conditions, a few
    return pairs.select(F.col("a_condition").alias("a"), F.col("b_condition").alias("b"), rn.contrast(F.col("a_s"), F.col("b_s"), F.col("a_e"), F.col("b_e")).alias("verdict"))


@query(_with("n as (select field, count(*) * 100 as images from frames group by field)") + "select field, images, (ceil(images / 64.0::double) * 25)::bigint as steps, case when ceil(images / 64.0::double) * 25 > 10000 then 'MuSGD' else 'AdamW' end as optimizer from n")
def optimizer_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimizer that a training set of each field's size would get."""
    n = frames(spark, sf_dir).groupBy("field").agg((F.count(F.lit(1)) * 100).alias("images"))
    return n.select("field", "images", (F.ceil(F.col("images") / 64) * 25).alias("steps"), optimizer(F.col("images"), F.lit(25)).alias("optimizer"))


_PROFILE = "cnt as (select field, class, count(*) as n from frame_boxes join frames using (frame) where reason is null group by all), tot as (select field, class, n, sum(n) over (partition by field) as total from cnt), prof as (select field, class, round_even(100.0::double * n / total, 0) as p from tot)"


@query(
    _with(_PROFILE, "fields as (select distinct field from prof), classes as (select distinct class from prof)", "full_prof as (select f.field, c.class, coalesce(p, 0) as p from fields f cross join classes c left join prof using (field, class))", "dist as (select a.field, b.field as other, sum(abs(a.p - b.p)) as l1 from full_prof a join full_prof b on a.class = b.class and a.field <> b.field where b.field in ('TOMATO_1/1', 'TOMATO_1/2', 'TOMATO_1/3', 'TOMATO_2/4', 'TOMATO_2/5', 'TOMATO_2/6') group by all)")
    + "select field, other, l1, place from (select *, row_number() over (partition by field order by l1, other)::int as place from dist) where place <= 2"
)
def nearest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each field the two of six reference fields with the most similar mix of classes."""
    from pyspark.sql.window import Window

    n = frame_boxes(spark, sf_dir).filter("reason is null").join(frames(spark, sf_dir).select("frame", "field"), "frame").groupBy("field").pivot("class", list(CLASSES)).count().na.fill(0)
    total = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    p = n.select("field", F.array(*[percent_profile(F.col(c), total) for c in CLASSES]).alias("p"))
    known = p.filter(F.col("field").isin("TOMATO_1/1", "TOMATO_1/2", "TOMATO_1/3", "TOMATO_2/4", "TOMATO_2/5", "TOMATO_2/6")).select(F.col("field").alias("other"), F.col("p").alias("q"))
    d = p.join(F.broadcast(known), F.col("field") != F.col("other"))  # six rows
    l1 = F.aggregate(F.zip_with("p", "q", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    d = d.select("field", "other", l1.alias("l1"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy("l1", "other"))).filter("place <= 2")
