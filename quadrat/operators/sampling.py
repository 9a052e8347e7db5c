"""Seeded sampling and the assembly of training sets. Manifests are bags: repeats mean something."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import draw, uniform
from ..storage import Scratch
from .ranking import dense_index, first_in_groups, first_rows, rank_within


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement, the first by a digest of seed and key; all if there are fewer."""
    return first_rows(df, draw(F.lit(str(seed)), F.col(key).cast("string")), [key], n)


def sample_with_extras(df: DataFrame, n: int, key: str, seed: int = 0, strict: bool = False) -> DataFrame:
    """n rows: without replacement as far as they go, then drawn again with replacement.

    strict makes a pool that is too small an error.
    """
    size = df.count()
    if n <= size:
        return sample(df, n, key, seed)
    if strict:
        raise ValueError(f"{n} rows asked for, {size} there")
    if not size:
        return df
    ranked = dense_index(df, draw(F.lit(str(seed)), F.col(key).cast("string")), [key], "_k")
    extra = df.sparkSession.range(n - size).select((draw(F.lit(f"{seed}+"), F.col("id").cast("string")) % size).alias("_k"))
    return df.unionByName(extra.join(ranked, "_k").drop("_k"))


def hybrid(real: DataFrame, pool: DataFrame, ratio: float, key: str, seed: int = 0, strict: bool = False) -> DataFrame:
    """All real rows and round(ratio * real) of the pool, with is_synth."""
    n = round(ratio * real.count())
    return real.withColumn("is_synth", F.lit(False)).unionByName(sample_with_extras(pool, n, key, seed, strict).withColumn("is_synth", F.lit(True)))


def matched_size(real: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows by repeating real as often as needed, shuffled and cut, with copy (from 0)."""
    size = real.count()
    times = -(-n // size) if size else 0
    rows = real.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max(times - 1, 0)))))
    order = draw(F.lit(str(seed)), F.col(key).cast("string"), F.col("copy").cast("string"))
    return first_rows(rows, order, [key, "copy"], n)


def seasons(frames: DataFrame, prefixes: dict[int, str], name: str = "image") -> DataFrame:
    """frames with year, by the prefix of their name; a name that no prefix covers is an error."""
    year = F.lit(None).cast("int")
    for y, p in prefixes.items():
        year = F.when(F.col(name).startswith(p), y).otherwise(year)
    out = frames.withColumn("year", year)
    if odd := out.filter("year is null").limit(1).collect():
        raise ValueError(f"no season has names like {odd[0][name]}")
    return out


def arms(frames: DataFrame, early: int, late: int, pool: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """arm and rows: A the first season, B both, T the first and as many of the pool as the second has, M the first repeated to B's size.

    A frame of neither season is an error. M's repeats are rows of their own.
    """
    if odd := frames.filter(~F.coalesce(F.col("year").isin(early, late), F.lit(False))).limit(1).collect():
        raise ValueError(f"frame {odd[0][key]} is of neither season")
    a, n = frames.filter(F.col("year") == early), frames.filter(F.col("year") == late).count()
    size = a.count() + n
    parts = {"A": a, "B": frames, "T": a.unionByName(sample_with_extras(pool, n, key, seed)), "M": matched_size(a, size, key, seed).drop("copy")}
    return reduce(DataFrame.unionByName, (rows.withColumn("arm", F.lit(arm)) for arm, rows in parts.items()))


def assert_real(entries: DataFrame) -> None:
    """An error if a synthetic image (is_synth) is in a split other than train."""
    if bad := entries.filter("is_synth and split <> 'train'").limit(1).collect():
        raise ValueError(f"a synthetic image in {bad[0]['split']}")


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def ratio_plan(kinds: list[str], ratios: list[float], seeds: int, spark) -> DataFrame:
    """index, kind, ratio, seed: all runs of a sweep; kind varies slowest, seed fastest."""
    i, many = F.col("index"), len(ratios) * seeds
    names, grid = F.array(*map(F.lit, kinds)), F.array(*[F.lit(float(r)) for r in ratios])
    return spark.range(len(kinds) * many).withColumnRenamed("id", "index").select(
        "index", F.get(names, F.floor(i / many).cast("int")).alias("kind"), F.get(grid, (F.floor(i / seeds) % len(ratios)).cast("int")).alias("ratio"), (i % seeds).cast("int").alias("seed")
    )


def even_levels(target: DataFrame, group: list[str], value: str, k: int, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """group, t, value: k evenly spaced quantiles of a target distribution, which nearest_unused then looks for."""
    levels = [low + (high - low) * i / max(k - 1, 1) for i in range(k)]
    q = target.groupBy(*group).agg(F.percentile(value, F.array(*map(F.lit, levels))).alias("q"))
    return q.select(*group, F.posexplode("q").alias("t", "value"))


def matched_subsample(target: DataFrame, pool: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """Members of pool (group, id, value), at most k in a group, whose values are spread as those of target: for each level the nearest left."""
    return nearest_unused(even_levels(target, group, value, k).withColumnRenamed("value", "_v").select(*group, "t", F.col("_v").alias("value")), pool.select(*group, "id", F.col(value).cast("double").alias("value")), group)


def pick_near_size(wanted: DataFrame, pool: DataFrame, group: list[str], tolerance: float, seed: int = 0, nearest: int = 8) -> DataFrame:
    """wanted (group, w, target) with the id of a pool member (group, id, size) drawn among those of about that size.

    Sizes from target / tolerance to target * tolerance count; where there are none, the nearest few. Pools are cutouts of a class,
    met in an equi-join on the group and ranked by how far off they are; the draw is a digest.
    """
    off = F.abs(F.col("size") - F.col("target"))
    rows = wanted.join(pool, group)
    fits = (F.col("size") >= F.col("target") / tolerance) & (F.col("size") <= F.col("target") * tolerance)
    best = F.row_number().over(Window.partitionBy(*group, "w").orderBy(F.desc("fits"), F.when(~F.col("fits"), F.col("off")), draw(F.lit(str(seed)), F.col("w").cast("string"), F.col("id").cast("string")), "id"))
    rows = rows.withColumns({"fits": fits, "off": off}).withColumn("_k", best)
    near = rows.filter(F.col("fits") | (F.col("_k") <= nearest))
    drawn = F.row_number().over(Window.partitionBy(*group, "w").orderBy(F.desc("fits"), draw(F.lit(str(seed)), F.col("w").cast("string"), F.col("id").cast("string")), "id"))
    return near.withColumn("_k", drawn).filter("_k = 1").select(*wanted.columns, "id", "size")


def placements(items: DataFrame, scene: list[str], tries: int, most: float, seed: int = 0) -> DataFrame:
    """items (scene, k, width, height, scene_width, scene_height) with x and y where they are put, in the order of k; null if no try fits.

    A try fits if it overlaps no item put before by more than the share most of the smaller one. Tries are digests of
    seed, scene, k and number, so that any engine makes the same ones; a scene's few items are folded over in one row.
    """
    def spot(c: str, room: str) -> Column:
        u = [draw(F.lit(f"{seed}{c}"), *(F.col(s).cast("string") for s in scene), F.col("k").cast("string"), F.lit(str(t))) for t in range(tries if most < 1 else 1)]
        return F.array(*[x % (F.greatest(F.col(f"scene_{room}") - F.col(room), F.lit(0)).cast("bigint") + 1) for x in u])

    rows = items.select(*scene, "k", "width", "height", F.arrays_zip(spot("x", "width").alias("x"), spot("y", "height").alias("y")).alias("at"))
    whole = rows.groupBy(*scene).agg(F.sort_array(F.collect_list(F.struct("k", "width", "height", "at"))).alias("list"))
    none = F.expr("cast(array() as array<struct<k:bigint,x:bigint,y:bigint,w:bigint,h:bigint>>)")

    def step(put: Column, i: Column) -> Column:
        def clear(a: Column, p: Column) -> Column:
            w = F.greatest(F.lit(0), F.least(a["x"] + i["width"], p["x"] + p["w"]) - F.greatest(a["x"], p["x"]))
            h = F.greatest(F.lit(0), F.least(a["y"] + i["height"], p["y"] + p["h"]) - F.greatest(a["y"], p["y"]))
            return p["x"].isNull() | (w * h <= most * F.greatest(F.lit(1), F.least(i["width"] * i["height"], p["w"] * p["h"])))

        free = F.get(F.filter(i["at"], lambda a: F.forall(put, lambda p: clear(a, p))), F.lit(0))
        return F.concat(put, F.transform(F.array(free), lambda f: F.struct(i["k"].cast("bigint").alias("k"), f["x"].alias("x"), f["y"].alias("y"), i["width"].cast("bigint").alias("w"), i["height"].cast("bigint").alias("h"))))

    put = whole.select(*scene, F.explode(F.aggregate("list", none, step)).alias("p"))
    return items.join(put.select(*scene, F.col("p.k").alias("k"), "p.x", "p.y"), [*scene, "k"])


def mix(a: DataFrame, b: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """As many rows of each as the smaller has, with provenance 'a' or 'b'."""
    n = min(a.count(), b.count())
    return sample(a, n, key, seed).withColumn("provenance", F.lit("a")).unionByName(sample(b, n, key, seed).withColumn("provenance", F.lit("b")))


def sweep_plan(kinds: list[str], low: int, high: int, step: int, seeds: int, spark) -> DataFrame:
    """index, kind, pct, seed: all runs of a sweep over whole percentages; kind varies slowest, seed fastest."""
    pcts = list(range(low, high + 1, step))
    i = F.col("index")
    names = F.array(*[F.lit(k) for k in kinds])
    ratios = F.array(*[F.lit(p) for p in pcts])
    return spark.range(len(kinds) * len(pcts) * seeds).withColumnRenamed("id", "index").select(
        "index",
        names[F.floor(i / (len(pcts) * seeds)).cast("int")].alias("kind"),
        ratios[(F.floor(i / seeds) % len(pcts)).cast("int")].alias("pct"),
        (i % seeds).cast("int").alias("seed"),
    )


def strata(df: DataFrame, group: list[str], order: list[str], k: int) -> DataFrame:
    """stratum (equal slices by rank) and stage (rank scaled to k), both from 0; they place a remainder differently.

    Rows are ranked task by task and counted by group, so that a large group isn't one task's.
    """
    scratch = Scratch(df.sparkSession, "strata")
    rows = rank_within(scratch, df, group, [F.col(c).asc() for c in order], "_r")
    n = rows.groupBy(*group).agg(F.max("_r").alias("_n"))
    rows = rows.join(n, group)
    return rows.withColumn("stratum", (F.ceil(F.col("_r") * k / F.col("_n")) - 1).cast("int")).withColumn("stage", F.least(F.lit(k - 1), F.floor((F.col("_r") - 1) * k / F.col("_n"))).cast("int")).select(*df.columns, "stratum", "stage")


def inverse_cdf(quantiles: Column, u: Column) -> Column:
    """The value at share u of a distribution given by equally spaced quantiles, linear between them."""
    last = F.size(quantiles) - 1
    at = u * last
    low = F.least(F.floor(at).cast("int"), last - 1)
    a, b = F.get(quantiles, low), F.get(quantiles, low + 1)
    return a + (b - a) * (at - low)


def class_choice(weights: list[tuple[str, float]], u: Column) -> Column:
    """The class whose stretch of the summed weights holds u."""
    total = sum(w for _, w in weights)
    out, done = F.lit(weights[-1][0]), total
    for name, w in reversed(weights):
        out = F.when(u < done / total, name).otherwise(out)
        done -= w
    return out


def uniform_of(key: str, seed: int = 0) -> Column:
    return uniform(F.lit(str(seed)), F.col(key).cast("string"))


def nearest_unused(targets: DataFrame, pool: DataFrame, group: list[str]) -> DataFrame:
    """group, target number t, value and the pool member id chosen for it: nearest that is left, of equally near ones the smallest id, targets in order.

    targets has group, t and value; pool has group, id and value. Rows without a value or id are left out. A group's k targets cut its
    pool into stretches; as no more than k members are taken, only the first k and the last k of a stretch can be nearest
    to a target. So lists that are folded in one row have at most 2 * k * (k + 1) members, however large the pool.
    """
    scratch = Scratch(pool.sparkSession, "nearest")
    listed = targets.filter("value is not null").groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("t", F.col("value").alias("v")))).alias("wanted"))
    wanted = scratch.table(listed, "wanted")
    k = wanted.agg(F.max(F.size("wanted"))).first()[0] or 0
    met = pool.select(*group, "id", F.col("value").alias("v")).filter("id is not null and v is not null").join(wanted, group)
    stretch = F.size(F.filter("wanted", lambda x: x["v"] < F.col("v")))
    # an id that is there more than once stands for the nearest of its rows
    each = met.groupBy(*group, stretch.alias("_s"), "id").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    ends = [first_in_groups(each, [*group, "_s"], [order, "id"], k).select(*group, F.col(c).alias("v"), "id") for c, order in (("low", F.asc("low")), ("high", F.desc("high")))]
    there = ends[0].unionByName(ends[1]).groupBy(*group).agg(F.collect_set(F.struct("v", "id")).alias("there"))
    start = F.expr("named_struct('left', there, 'out', cast(array() as array<struct<t:int,v:double,id:bigint>>))")

    def step(st: Column, x: Column) -> Column:
        def taken(best: Column) -> Column:
            rest = F.filter(st["left"], lambda p: p["id"] != best["id"])
            row = F.struct(x["t"].cast("int").alias("t"), x["v"].alias("v"), best["id"].alias("id"))
            return F.struct(rest.alias("left"), F.concat(st["out"], F.array(row)).alias("out"))

        best = F.array_min(F.transform(st["left"], lambda p: F.struct(F.abs(p["v"] - x["v"]).alias("d"), p["id"].alias("id"))))
        # an array of one, so that the nearest is looked for once and not once for each member left
        return F.when(F.size(st["left"]) > 0, F.get(F.transform(F.array(best), taken), F.lit(0))).otherwise(st)

    rows = wanted.join(there, group).select(*group, F.explode(F.aggregate("wanted", start, step, lambda st: st["out"])).alias("x"))
    return rows.select(*group, "x.t", F.col("x.v").alias("value"), "x.id")


def tightest_window(df: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """group, low, high: of k neighbours by value those with the smallest ratio of highest to lowest."""
    w = Window.partitionBy(*group).orderBy(value)
    rows = df.select(*group, F.col(value).alias("low"), F.lead(value, k - 1).over(w).alias("high")).filter("high is not null and low > 0")
    best = F.min(F.struct((F.col("high") / F.col("low")).alias("ratio"), "low", "high")).alias("m")
    return rows.groupBy(*group).agg(best).select(*group, "m.low", "m.high", "m.ratio")
