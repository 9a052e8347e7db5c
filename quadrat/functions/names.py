"""Run names as keys, recipes and ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names in the order of their ids, the formats of run names, recipe bounds.
CLASSES = ("SOLNI", "POROL", "SETVE", "CYPRO", "ECHCG")
EXCLUDED = ("LYPES", "NR")
DETECTOR = "(yolo11|yolo26|rtdetrv2)"
REAL = rf"^realonly_{DETECTOR}(?:_real)?(?:_x(\d+))?_seed(\d+)$"
HYBRID = rf"^hybrid_{DETECTOR}_(.+?)_r(\d+)(?:_x(\d+))?_seed(\d+)$"
MATCHED = rf"^matched_{DETECTOR}_(.+?)_r(\d+)(?:_x(\d+))?_seed(\d+)$"
ARM = r"^annotred_(A|B|M|T(?:_.+)?)_([^_]+)_seed(\d+)$"
RECIPE_BOUNDS = (("MuSGD_lr0.01", 2e-2), ("AdamW_lr0.00111", 5e-4), ("AdamW_lr0.0001", 5e-5))
LOWEST_RECIPE, NO_RECIPE = "explicit_lr1e-05", "unknown"
BATCH, MANY_STEPS = 64, 10_000


_RUN = rf"^(?:(realonly)_{DETECTOR}(?:_real)?(?:_x(\d+))?|(hybrid|matched)_{DETECTOR}_(.+?)_r(\d+)(?:_x(\d+))?|(annotred)_(A|B|M|T(?:_.+)?)_([^_]+))_seed(\d+)$"
#: Groups of it that hold a field, by format.
_KIND, _FIELDS = (1, 4, 9), {"detector": (2, 5, 11), "generator": (6, 10), "pct": (7,), "filter": (3, 8), "seed": (12,)}
_CUT = "\u0001"


def parse_run(name: Column) -> Column:
    """Struct of kind, detector, generator, pct, filter and seed; null for other names.

    All formats are one expression, which is matched once; fields are its groups.
    """
    parts = F.split(F.regexp_replace(name, _RUN, _CUT.join(f"${k}" for k in range(1, 13))), _CUT, -1)
    kinds = F.create_map(*(F.lit(x) for x in ("realonly", "real", "hybrid", "hybrid", "matched", "matched", "annotred", "arm")))

    def fields(p: Column) -> Column:
        def first(groups: tuple[int, ...]) -> Column:
            return F.coalesce(*(F.nullif(F.get(p, F.lit(k - 1)), F.lit("")) for k in groups))

        values = {c: first(g).cast("int") if c in ("pct", "filter", "seed") else first(g) for c, g in _FIELDS.items()}
        return F.when(F.size(p) == 12, F.struct(kinds[first(_KIND)].alias("kind"), *(v.alias(c) for c, v in values.items())))

    # a list of one and its lambda give the parts a name, so that they are computed once
    return F.transform(F.array(parts), fields)[0]


def ratio_of(family: Column) -> Column:
    """Struct of pct and filter at the end of a run family's name, null for a name without."""
    found = r"_r(\d+)(?:_x(\d+))?$"
    return F.struct(*(F.nullif(F.regexp_extract(family, found, k), F.lit("")).cast("int").alias(c) for k, c in ((1, "pct"), (2, "filter"))))


def series(name: Column) -> Column:
    """Struct of series, detector, ratio and seed, as curves group runs; null seed for names without.

    The series is the generator's family (all of a family's variants are one), else 'matched' or 'real'.
    """
    base = F.regexp_replace(name, r"_seed\d+$", "")
    family = F.nullif(F.regexp_extract(base, "(composite|sd35|flux|gan)", 1), F.lit(""))
    detector = F.nullif(F.regexp_extract(base, "(yolo11|yolo26|rtdetrv2|rtdetr)", 1), F.lit(""))
    pct = F.nullif(F.regexp_extract(base, r"_r(\d+)", 1), F.lit("")).cast("double")
    return F.struct(
        F.coalesce(family, F.when(base.startswith("matched"), "matched").otherwise("real")).alias("series"),
        F.coalesce(detector, F.lit("det")).alias("detector"),
        F.coalesce(pct / 100, F.lit(0.0)).alias("ratio"),
        F.nullif(F.regexp_extract(name, r"_seed(\d+)$", 1), F.lit("")).cast("int").alias("seed"),
    )


def ratio_grid(spec: str) -> list[float]:
    """Ratios of 'low:high:step' with both ends, or of a list with commas."""
    if ":" not in spec:
        return [float(x) for x in spec.split(",")]
    low, high, step = map(float, spec.split(":"))
    return [round(low + k * step, 3) for k in range(int((high - low + 1e-9) / step) + 1)]


def stem(path: Column) -> Column:
    """File name without folder and suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def uid(source: Column, filename: Column) -> Column:
    return F.concat_ws("__", source, stem(filename))


def plot_key(source: Column, plot: Column) -> Column:
    return F.concat_ws("/", source, plot)


def season(source: Column) -> Column:
    return F.when(source == "TOMATO_1", 2021).otherwise(2022)


def class_id(name: Column, strict: bool = True) -> Column:
    """Place of a class name in the frozen order; another name is an error, or null if not strict."""
    place = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), name) - 1
    other = F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(name, F.lit("null")))).cast("int") if strict else F.lit(None).cast("int")
    return F.when(place >= 0, place.cast("int")).otherwise(other)


def is_known(name: Column) -> Column:
    return F.coalesce(name.isin(*CLASSES), F.lit(False))


def from_sources(name: Column, prefixes: list[str] | None) -> Column:
    """Whether a file name begins with one of the prefixes; without a list every name does."""
    if prefixes is None:
        return F.lit(True)
    return F.exists(F.array(*[F.lit(p) for p in prefixes]).cast("array<string>"), lambda p: F.startswith(name, p))


# species' names in captions and their growth form; stages of growth by form; sentences.
DISPLAY = {
    "SOLNI": "Solanum nigrum (nightshade)",
    "POROL": "Portulaca oleracea (purslane)",
    "SETVE": "Setaria verticillata (foxtail)",
    "CYPRO": "Cyperus rotundus (nutsedge)",
    "ECHCG": "Echinochloa crus-galli (barnyardgrass)",
}
FORMS = {"SOLNI": "broadleaf", "POROL": "succulent", "SETVE": "grass", "CYPRO": "grass", "ECHCG": "grass"}
STAGES = {
    "broadleaf": [
        "at the cotyledon stage with a single pair of seed leaves",
        "a young seedling with its first pair of true leaves",
        "at the two to four true-leaf stage",
        "an early vegetative seedling with several small leaves",
    ],
    "succulent": [
        "at the cotyledon stage with two small fleshy seed leaves",
        "a young seedling with a few small fleshy leaves",
        "an early vegetative plant forming a low spreading rosette of fleshy leaves",
    ],
    "grass": [
        "a grass seedling at the one-leaf stage",
        "a young grass seedling with two to three narrow leaves",
        "at the early tillering stage with several thin blades",
    ],
}
CAPTION = "a top-down close-up photo of %s, %s on bare soil"
ANY_STAGE = "a weed seedling"
ISOLATED = ", single isolated plant, centered, plain uniform background, sharp focus"
SCENE = "a top-down aerial photograph of bare agricultural soil in a tomato field, with %s weed seedlings, natural daylight, high detail"
NO_NAMES = "weeds"


def _looked_up(table: dict[str, str], key: Column, other: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key], other)


def caption(name: Column, stage: Column | None = None) -> Column:
    """What a close-up of a class shows; a class without a display name is called by its own."""
    return F.format_string(CAPTION, _looked_up(DISPLAY, name, name), F.coalesce(stage, F.lit(ANY_STAGE)) if stage is not None else F.lit(ANY_STAGE))


def close_up_prompt(name: Column, stage: Column | None = None) -> Column:
    return F.concat(caption(name, stage), F.lit(ISOLATED))


def stages(name: Column) -> Column:
    """Stages of growth that are plausible for a class, an array; unknown classes grow as broadleaves."""
    form, lists = _looked_up(FORMS, name, F.lit("broadleaf")), {k: F.array(*map(F.lit, v)) for k, v in STAGES.items()}
    return F.when(form == "grass", lists["grass"]).when(form == "succulent", lists["succulent"]).otherwise(lists["broadleaf"])


def scene_prompt(names: Column) -> Column:
    """What a scene with the classes of an array shows."""
    listed = F.array_join(F.transform(names, lambda n: _looked_up(DISPLAY, n, n)), ", ")
    return F.format_string(SCENE, F.when(F.coalesce(F.size(names), F.lit(0)) > 0, listed).otherwise(F.lit(NO_NAMES)))


def recipe(peak: Column) -> Column:
    """Name of a training recipe by its peak learning rate, strictly above each bound."""
    out = F.when(peak.isNull(), NO_RECIPE)
    for name, bound in RECIPE_BOUNDS:
        out = out.when(peak > bound, name)
    return out.otherwise(LOWEST_RECIPE)


def optimizer(images: Column, epochs: Column) -> Column:
    """The automatic choice of an optimizer by the number of steps."""
    return F.when(F.ceil(images / BATCH) * epochs > MANY_STEPS, "MuSGD").otherwise("AdamW")


def source_photo(tile: Column) -> Column:
    """Name of the photo that a tile was cut from."""
    return F.regexp_replace(tile, r"_t\d+$", "")


def label_path(image: Column) -> Column:
    """Path of an image's label file: the last folder images becomes labels, the suffix .txt."""
    return F.regexp_replace(F.regexp_replace(image, r"^(.*/)images(/[^/]*(?:/[^/]*)*)$", "$1labels$2"), r"\.[^./]+$", ".txt")


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def percent_profile(count: Column, total: Column) -> Column:
    """Rounded percentage, 0 of nothing."""
    return F.coalesce(F.bround(F.try_divide(100.0 * count, total)), F.lit(0.0))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) drawn by a digest of the keys: the same on every engine and run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def draw(*keys: Column) -> Column:
    """The 32-bit integer behind uniform(), to sort or count by."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 8), 16, 10).cast("long")
