"""Names and manifests of runs: parsing, labels, and three dialects of manifests brought to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The formats of run names, whatever words they hold, and the keys and modes of summaries. Parts that recur are named.
ENCODER = "(?:(?<encoder>jpegli|mozjpeg|jpegxl|webp)_)?"
SAMPLING = "(?<sampling>444|420opt|420)"
TAGGED = "(?:_s(?<sampling>420opt|420|444))?"
OPT = "(?:_(?<optl2>optl2))?"
ORIGIN = "(?:(?:py|rs)_)?"
SPLIT = r"l1q(?<l1q>\d+)_l0q(?<l0q>\d+)"
PAC = "(?:_pac)?"
BASE = r"b(?<baseq>\d+)"
#: (kind, pattern), tried in this order: the first that fits a whole name decides.
NAMES = [
    ("jpeg_baseline", ENCODER + r"jpeg_baseline_q(?<quality>\d+)"),
    ("jp2_baseline", r"jp2_baseline_q(?<quality>\d+)"),
    ("single", ENCODER + r"single_origami_p(?<l1q>\d+)_r(?<l0q>\d+)"),
    ("ycbcr", ENCODER + r"single_ycbcr_y(?<l1q>\d+)_c(?<l0q>\d+)"),
    ("optl2_split", "(?<optl2>optl2)_" + ENCODER + "debug_" + SPLIT + PAC),
    ("optl2_uniform", "(?<optl2>optl2)_" + ENCODER + r"(?:debug_)?j(?<quality>\d+)" + PAC),
    ("split", ORIGIN + ENCODER + "debug_" + SPLIT + TAGGED + OPT + PAC),
    ("uniform", ORIGIN + ENCODER + r"(?:debug_)?j(?<quality>\d+)" + TAGGED + OPT + PAC),
    ("grid_uniform", "rs_" + SAMPLING + OPT + r"_j(?<quality>\d+)"),
    ("grid_split", "rs_" + SAMPLING + OPT + "_" + SPLIT),
    ("delta_sweep", "rs_" + SAMPLING + r"_(?<optl2>optl2)_d(?<delta>\d+)_" + SPLIT),
    ("base_quality", "rs_" + SAMPLING + "_" + BASE + OPT + r"(?:_d(?<delta>\d+))?_" + SPLIT),
    ("sharpened", "rs_" + SAMPLING + "_" + BASE + r"_sharp(?<sharp>\d+)_" + SPLIT),
    ("decode_sharpened", "rs_" + SAMPLING + "_" + BASE + r"_sdec(?<sharp>\d+)_" + SPLIT),
    ("gpu", "gpu_" + SAMPLING + "_" + BASE + OPT + r"(?:_d(?<delta>\d+))?(?:_s(?<strength>[\d.]+))?(?:_saved)?_" + SPLIT),
]
FIELDS = ("encoder", "quality", "l1q", "l0q", "sampling", "optl2", "baseq", "delta", "sharp", "strength")
DEFAULT_ENCODER = "libjpeg-turbo"


def _group(pattern: str, field: str) -> int | None:
    """The number of a named group: regexp_extract takes numbers."""
    at = pattern.find(f"(?<{field}>")
    if at < 0:
        return None
    n, k = 0, 0
    while k <= at:
        if pattern[k] == "\\":
            k += 1
        elif pattern[k] == "(" and (pattern[k + 1] != "?" or pattern[k + 2] == "<"):
            n += 1
        k += 1
    return n


def with_run_fields(df: DataFrame, name: str) -> DataFrame:
    """df with run_kind and the fields of a run's directory name. The kind is found once, and each field by the pattern of that kind alone."""
    kind = df.withColumn("run_kind", F.coalesce(*[F.when(F.col(name).rlike(f"^(?:{p})$"), k) for k, p in NAMES]))
    return kind.withColumns(run_fields(F.col(name), F.col("run_kind")))


def run_fields(name: Column, run_kind: Column) -> dict[str, Column]:
    """The fields of a name of a known kind; null where it has no such field. Sharpening is in tenths in names."""
    out = {"run_kind": run_kind}
    for field in FIELDS:
        found = F.lit(None).cast("string")
        for kind, pattern in reversed(NAMES):
            n = _group(pattern, field)
            if n is not None:
                found = F.when(run_kind == kind, F.regexp_extract(name, f"^(?:{pattern})$", n)).otherwise(found)
        text = F.nullif(found, F.lit(""))
        out[field] = text if field in ("encoder", "sampling") else text.isNotNull() & out["run_kind"].isNotNull() if field == "optl2" else text.cast("double") if field == "strength" else text.cast("int")
    out["sharp"] = out["sharp"] / 10.0
    out["encoder"] = F.when(out["run_kind"].isNotNull() & (out["run_kind"] != "jp2_baseline"), F.coalesce(out["encoder"], F.lit(DEFAULT_ENCODER))).otherwise(out["encoder"])
    return out


def grid_tokens(name: Column) -> tuple[Column, Column]:
    """Quantisation and quality of a folder by its tokens q<n> and j<n>; null unless both are there."""
    q, j = (F.nullif(F.regexp_extract(name, f"(?:^|_){t}([0-9]+)(?:_|$)", 1), F.lit("")).cast("int") for t in "qj")
    both = q.isNotNull() & j.isNotNull()
    return F.when(both, q), F.when(both, j)


PLAIN_MODE = "ingest-jpeg-only"
LEGACY_QUALITY = "residual_jpeg_q_L"


def label(summary: Column, directory: Column, family: str = "Residual") -> Column:
    """A slide's label from its summary's JSON: a plain quality in the plain mode, then base and residual qualities, then the legacy quality, then the
    directory's name (also where the JSON is none). family: the word before residual qualities."""
    number = lambda key: F.coalesce(F.get_json_object(summary, f"$.{key}").try_cast("long"), F.lit(0))
    has = lambda key: F.get_json_object(summary, f"$.{key}").isNotNull()
    return (
        F.when(F.get_json_object(summary, "$.mode") == PLAIN_MODE, F.format_string("JPEG Q%d", number("baseq")))
        .when(has("baseq"), F.format_string(f"{family} %d/%d/%d", number("baseq"), number("l1q"), number("l0q")))
        .when(has(LEGACY_QUALITY), F.format_string(f"{family} Q%d", number(LEGACY_QUALITY))).otherwise(directory)
    )


def disk_megabytes(summary: Column) -> Column:
    """Megabytes of 2^20 that a summary tells: all of them in the plain mode, base and residuals, or the legacy total; 0 where it tells none."""
    number = lambda key: F.coalesce(F.get_json_object(summary, f"$.{key}").try_cast("long"), F.lit(0))
    has = lambda key: F.get_json_object(summary, f"$.{key}").isNotNull()
    total = F.when(F.get_json_object(summary, "$.mode") == PLAIN_MODE, number("total_bytes")).when(has("l2_bytes"), number("l2_bytes") + number("residual_bytes")).when(has("proposed_bytes"), number("proposed_bytes")).otherwise(0)
    return total / 1048576.0


#: Folders that make a directory of no known name a run.
CONTENT = ("images", "compress", "decompress")


def scan_runs(entries: DataFrame) -> DataFrame:
    """Runs among the entries (path) of a folder, each path relative to it: (run, run_kind, fields, has_images, has_compress, has_decompress).

    Directories are known by what lies in them. Those whose name is of no known kind count as runs of kind 'unknown' if they have one of the content folders.
    """
    part = F.split("path", "/")
    held = entries.where(F.size(part) > 1).select(part[0].alias("run"), part[1].alias("own"))
    found = held.groupBy("run").agg(*[F.max(F.col("own") == c).alias(f"has_{c}") for c in CONTENT])
    named = with_run_fields(found, "run").withColumn("run_kind", F.coalesce("run_kind", F.when(F.col("has_images") | F.col("has_compress") | F.col("has_decompress"), "unknown")))
    return named.where("run_kind IS NOT NULL").select("run", "run_kind", *FIELDS, *[f"has_{c}" for c in CONTENT])


MANIFEST = "run string, level string, tx int, ty int, bytes bigint, psnr double"
TILE_NAME = r"^(L[012])_(\d+)_(\d+)$"


def tiles_of_list(runs: DataFrame) -> DataFrame:
    """From manifests with an array `tiles` of (level, tx, ty, residual_bytes, y_psnr_db)."""
    t = runs.select("run", F.explode("tiles").alias("t"))
    return t.select("run", F.col("t.level").alias("level"), F.col("t.tx").cast("int").alias("tx"), F.col("t.ty").cast("int").alias("ty"), F.col("t.residual_bytes").cast("bigint").alias("bytes"), F.col("t.y_psnr_db").cast("double").alias("psnr"))


def tiles_of_map(runs: DataFrame, column: str, size: str = "size", psnr: str = "psnr") -> DataFrame:
    """From manifests with a map of tiles by name, such as L1_3_2, to (size, psnr); names that are none are left out."""
    t = runs.select("run", F.explode(column).alias("name", "t")).where(F.col("name").rlike(TILE_NAME))
    part = lambda k: F.regexp_extract("name", TILE_NAME, k)
    return t.select("run", part(1).alias("level"), part(2).cast("int").alias("tx"), part(3).cast("int").alias("ty"), F.col(f"t.{size}").cast("bigint").alias("bytes"), F.col(f"t.{psnr}").cast("double").alias("psnr"))
