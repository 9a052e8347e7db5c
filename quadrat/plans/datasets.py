"""Queries that assemble training sets, and over distributions, hashes and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import perceptual as pc
from ..operators import priors as pr
from ..operators import sampling as sm
from .fixtures import SQL, frames, gt_box, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _with(*ctes: str) -> str:
    return f"with recursive {SQL}, " + ", ".join([_POOL, *ctes]) + " "


def _draw(*keys: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(keys) + "), 1, 8))::bigint"


_POOL = "real as (select frame, field, year from frames where year = 2021), pool as (select frame, field, year from frames where year = 2022), nr as (select (select count(*) from real) as real, (select count(*) from pool) as pool)"


def _real_pool(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = frames(spark, sf_dir).select("frame", "field", "year")
    return f.filter("year = 2021"), f.filter("year = 2022")


@query(_with("want as (select round_even(0.2::double * real, 0)::bigint as n from nr)", f"s as (select frame from (select frame, row_number() over (order by {_draw(chr(39) + '0' + chr(39), 'frame')}, frame) as k from pool), want where k <= n)") + "select false as is_synth, count(*) as n, sum(frame)::bigint as total from real union all select true, count(*), sum(frame)::bigint from s")
def hybrid_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All real frames and a fifth as many of the pool."""
    real, pool = _real_pool(spark, sf_dir)
    h = sm.hybrid(real, pool, 0.2, "frame")
    return h.groupBy("is_synth").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("total"))


@query(
    _with(
        "want as (select 3 * pool as n, pool from nr)",
        f"ranked as (select frame, row_number() over (order by {_draw(chr(39) + '0' + chr(39), 'frame')}, frame) - 1 as k from pool)",
        f"extra as (select {_draw(chr(39) + '0+' + chr(39), 'id')} % pool as k from (select unnest(range(n - pool)) as id, pool from want))",
        "all_rows as (select frame from pool union all select frame from extra join ranked using (k))",
    )
    + "select copies, count(*) as frames, sum(frame)::bigint as total from (select frame, count(*) as copies from all_rows group by frame) group by copies"
)
def sample_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three times the pool: each frame once, the rest drawn again; by number of copies."""
    _, pool = _real_pool(spark, sf_dir)
    s = sm.sample_with_extras(pool, 3 * pool.count(), "frame").groupBy("frame").agg(F.count(F.lit(1)).alias("copies"))
    return s.groupBy("copies").agg(F.count(F.lit(1)).alias("frames"), F.sum("frame").alias("total"))


@query(_with(f"c as (select frame, unnest([0, 1]) as copy from real), s as (select frame, copy from (select *, row_number() over (order by {_draw(chr(39) + '3' + chr(39), 'frame', 'copy')}, frame, copy) as k from c), nr where k <= real + real // 2)") + "select copy, count(*) as n, sum(frame)::bigint as total from s group by copy")
def matched_size_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real frames repeated to one and a half times their number."""
    real, _ = _real_pool(spark, sf_dir)
    n = real.count()
    return sm.matched_size(real, n + n // 2, "frame", 3).groupBy("copy").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("total"))


_ARM_POOL = "tp as (select * from pool where field = 'TOMATO_2/7'), tn as (select count(*) as n from tp)"
_ARM_T = f"once as (select frame from (select frame, row_number() over (order by {_draw(chr(39) + '0' + chr(39), 'frame')}, frame) as k from tp) where k <= (select pool from nr)), ranked as (select frame, row_number() over (order by {_draw(chr(39) + '0' + chr(39), 'frame')}, frame) - 1 as k from tp), extra as (select frame from (select {_draw(chr(39) + '0+' + chr(39), 'i')} % (select n from tn) as k from (select unnest(range((select greatest(pool - (select n from tn), 0) from nr))) as i)) join ranked using (k))"
_ARM_M = f"copies as (select frame, unnest(range((select ceil((real + pool)::double / real)::bigint from nr))) as copy from real), m as (select frame from (select frame, row_number() over (order by {_draw(chr(39) + '0' + chr(39), 'frame', 'copy')}, frame, copy) as k from copies) where k <= (select real + pool from nr))"


@query(_with(_ARM_POOL, _ARM_T, _ARM_M) + "select 'A' as arm, count(*) as n, sum(frame)::bigint as total from real union all select 'B', count(*), sum(frame)::bigint from frames union all select 'T', count(*), sum(frame)::bigint from (select frame from real union all select frame from once union all select frame from extra) union all select 'M', count(*), sum(frame)::bigint from m")
def arms_abtm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms of an annotation study: a season, both, and the first filled up from a pool, or by its own repeats."""
    f = frames(spark, sf_dir).select("frame", "field", "year")
    a = sm.arms(f, 2021, 2022, f.filter("field = 'TOMATO_2/7'"), "frame")
    return a.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("total"))


@query(_with("k as (select least(real, pool) as n from nr)", *(f"s{x} as (select frame from (select frame, row_number() over (order by {_draw(chr(39) + '5' + chr(39), 'frame')}, frame) as k from {t}), k where k.k <= n)".replace("where k.k", "where k_").replace("as k from", "as k_ from") for x, t in (("a", "real"), ("b", "pool")))) + "select 'a' as provenance, count(*) as n, sum(frame)::bigint as total from sa union all select 'b', count(*), sum(frame)::bigint from sb")
def mix_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each of two pools."""
    real, pool = _real_pool(spark, sf_dir)
    return sm.mix(real, pool, "frame", 5).groupBy("provenance").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("total"))


@query("select row_number() over (order by ki, pct, seed) - 1 as \"index\", (['real', 'hybrid', 'matched'])[ki] as kind, pct::int as pct, seed::int as seed from (select unnest([1, 2, 3]) as ki), (select unnest(range(25, 201, 25)) as pct), (select unnest(range(3)) as seed)")
def sweep_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of a sweep."""
    return sm.sweep_plan(["real", "hybrid", "matched"], 25, 200, 25, 3, spark)


_SIDES = "sides as (select cls::varchar as cls, greatest(x2 - x1, y2 - y1) as side, cls as c, tile_id, gid from gt where seed = 0)"


@query(_with(_SIDES, "g as (select unnest(['all', cls]) as cls, side from sides)") + "select cls, count(*) as n, round(count(*)::double / (select count(*) from sides), 6) as share, round(quantile_cont(side, 0.5), 6) as median, " + ", ".join(f"round(quantile_cont(side, {k / 10}), 6) as q{k}" for k in (0, 1, 5, 9, 10)) + " from g group by cls")
def scale_prior_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the longest side, by class and in all."""
    rows = gt_box(spark, sf_dir).filter("seed = 0").select("cls", F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("side"))
    q = pr.quantiles(rows, "cls", "side", [0.0, 0.1, 0.5, 0.9, 1.0])
    return q.select("cls", "n", F.round("share", 6).alias("share"), F.round("median", 6).alias("median"), *(F.round(F.col("q")[i], 6).alias(f"q{k}") for i, k in enumerate((0, 1, 5, 9, 10))))


_BANDS = "long as (select lang, unnest(['n_chars', 'n_words']) as stat, unnest([n_chars::double, length(text)::double - length(replace(text, ' ', '')) + 1]) as v from documents), band as (select lang, stat, count(v) as n, quantile_cont(v, 0.1) as p10, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.9) as p90 from long group by all)"


@query(_with(_BANDS, "r as (select * from band where lang = 'en')") + "select b.lang, b.stat, b.n, round((b.p50 - r.p50) / nullif(abs(r.p50), 0), 6) as gap, abs((b.p50 - r.p50) / nullif(abs(r.p50), 0)) > 0.2 as off, b.p50 between r.p10 and r.p90 as in_band from band b join r using (stat) where b.lang <> 'en'")
def appearance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of two statistics against a reference pool's band."""
    d = table(spark, sf_dir, "documents").select("lang", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1).alias("n_words"))
    rows = pr.against_reference(pr.bands(d, ["lang"], ["n_chars", "n_words"]), F.col("lang") == "en", "lang")
    return rows.withColumn("gap", F.round("gap", 6))


@query(_with(_SIDES, "q as (select cls, [" + ", ".join(f"quantile_cont(side, {k / 20})" for k in range(21)) + "] as q from sides group by cls)", f"u as (select cls, {_draw(chr(39) + '9' + chr(39), 'f.frame')} / 4294967296.0::double as u, q from frames f cross join q)", "v as (select cls, q[least(floor(u * 20)::int, 19) + 1] as a, q[least(floor(u * 20)::int, 19) + 2] as b, u * 20 - least(floor(u * 20)::int, 19) as t from u)") + "select cls, count(*) as n, round(avg(a + (b - a) * t), 4) as mean, round(max(a + (b - a) * t), 4) as largest from v group by cls")
def inverse_cdf_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes drawn from each class's quantiles."""
    rows = gt_box(spark, sf_dir).filter("seed = 0").select("cls", F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("side"))
    q = pr.quantiles(rows, "cls", "side", [k / 20 for k in range(21)]).filter("cls <> 'all'").select("cls", "q")
    f = frames(spark, sf_dir).select("frame")
    v = f.crossJoin(F.broadcast(q)).select("cls", sm.inverse_cdf(F.col("q"), sm.uniform_of("frame", 9)).alias("v"))  # five classes
    return v.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"), F.round(F.max("v"), 4).alias("largest"))


_HASH = "bits as (select vec_id, list_transform(embedding, lambda x: case when x::double > list_sum(list_transform(embedding, lambda y: y::double)) / 64 then '1' else '0' end) as b from embeddings), hashes as (select vec_id as id, array_to_string(b, '') as h from bits)"


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), pc.ahash(F.col("embedding")).alias("hash"))


@query(_with(_HASH) + "select id, h as bits from hashes")
def ahash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average hashes of vectors, as bits."""
    return _hashes(spark, sf_dir).select("id", F.lpad(F.bin("hash"), 64, "0").alias("bits"))


_NEAR = "pairs as (select a.id as a, b.id as b, hamming(a.h, b.h)::int as distance from hashes a join hashes b on a.id < b.id where hamming(a.h, b.h) <= 20)"


@query(_with(_HASH, _NEAR) + "select a, b, distance from pairs")
def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of hashes within 20 bits."""
    return pc.close_pairs(_hashes(spark, sf_dir), 20)


@query(
    _with(
        _HASH,
        _NEAR,
        "nb as (select b as id, list(a) as before from pairs group by b)",
        "o as (select id, row_number() over (order by id) as k, coalesce(before, []) as before from hashes left join nb using (id))",
        "g as (select 0::bigint as k, []::bigint[] as kept union all select o.k, case when list_has_any(g.kept, o.before) then g.kept else list_append(g.kept, o.id) end from g join o on o.k = g.k + 1)",
    )
    + "select unnest(kept) as id from g where k = (select max(k) from g)"
)
def near_dup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that stay when later ones within 20 bits of one that stays are dropped."""
    return pc.keep_unlike(_hashes(spark, sf_dir), 20)


@query(_with() + "select lang, quality >= 1 as passed, count(*) as n, sum(n_chars)::bigint as chars from documents join labels using (doc_id) group by all")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language that pass a quality gate, and those that don't."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return pr.judged(d, "quality", 1).groupBy("lang", "passed").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query(_with() + "select lang, doc_id, n_chars, place from (select lang, doc_id, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id)::int as place from documents where n_chars >= 100) where place <= 5")
def sharpest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest documents of each language, above a floor."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars").filter("n_chars >= 100")
    return pr.best_k(d, ["lang"], [F.desc("n_chars"), F.col("doc_id")], 5)


@query(_with(_SIDES, "r as (select *, row_number() over (partition by cls order by side, tile_id, gid) as rk, count(*) over (partition by cls) as n from sides)") + "select cls, (ceil(rk * 7 / n::double) - 1)::int as stratum, least(6, floor((rk - 1) * 7 / n::double))::int as stage, count(*) as n, sum(side)::bigint as total from r group by all")
def size_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven slices of each class by size, in two ways."""
    rows = gt_box(spark, sf_dir).filter("seed = 0").select(F.col("cls").cast("string").alias("cls"), F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("side"), "tile_id", "gid")
    return sm.strata(rows, ["cls"], ["side", "tile_id", "gid"], 7).groupBy("cls", "stratum", "stage").agg(F.count(F.lit(1)).alias("n"), F.sum("side").cast("bigint").alias("total"))
