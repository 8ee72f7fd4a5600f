"""Names and numbers as text: patterns, natural order, number formats, quoting."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planeweave.functions.numeric import col


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


# --- file-name patterns ----------------------------------------------------------------


def pattern_to_regex(pattern: str) -> tuple[str, list[str]] | None:
    """``{name}`` captures (shortest match), ``*`` any run, all else literal; None if malformed."""
    regex, names, at = "", [], 0
    for m in re.finditer(r"\{([^}]*)(\}?)|\*", pattern):
        regex += re.escape(pattern[at:m.start()])
        at = m.end()
        if m.group() == "*":
            regex += ".*"
        elif not m.group(2) or not m.group(1).strip():
            return None
        else:
            names.append(m.group(1).strip())
            regex += "(.+?)"
    return f"^{regex}{re.escape(pattern[at:])}$", names


def match_name_pattern(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add the captures of a name pattern as columns; NULL where the name does not match."""
    compiled = pattern_to_regex(pattern)
    if compiled is None:
        return df
    regex, names = compiled
    name = base_name(path)
    hit = name.rlike(regex)
    return df.select("*", *[F.when(hit, F.regexp_extract(name, regex, i + 1)).alias(n)
                            for i, n in enumerate(names)])


# --- wildcard selection ------------------------------------------------------------------


def _braces(pattern: str) -> list[str]:
    """Spell out ``{a,b}`` alternatives, innermost first."""
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return [p for part in m.group(1).split(",") for p in _braces(pattern[:m.start()] + part + pattern[m.end():])]


def glob_to_regex(glob: str) -> str:
    """Case-insensitive regex for one path segment: ``* ? [a-z] [!a] {a,b}``."""
    parts = [re.sub(r"\\[Zz]$", "", fnmatch.translate(p.replace("[^", "[!"))) for p in _braces(glob)]
    return "(?i)^(?:" + "|".join(parts) + ")$"


def select_paths(paths: DataFrame, path: str, glob: str, limit: int | None = None) -> DataFrame:
    """Rows whose path matches segment by segment; with ``limit``, the first so many in natural order."""
    segments = [s for s in glob.split("/") if s]
    have = F.filter(F.split(path, "/"), lambda s: s != "")
    ok = F.size(have) == len(segments)
    for i, s in enumerate(segments):
        ok = ok & F.coalesce(F.get(have, i).rlike(glob_to_regex(s)), F.lit(False))
    out = paths.where(ok)
    return out if limit is None else out.orderBy(natural_key(path), path).limit(limit)


def natural_key(name: Column | str) -> Column:
    """Sort key that compares digit runs as numbers of any length: each run, without leading zeros, follows
    its length in eight digits."""
    runs = F.regexp_extract_all(F.lower(col(name)), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def spelled(run: Column) -> Column:
        digits = F.coalesce(F.nullif(F.ltrim(run, F.lit("0")), F.lit("")), F.lit("0"))
        return F.when(F.substring(run, 1, 1).between("0", "9"), F.concat(F.lpad(F.length(digits).cast("string"), 8, "0"), digits)).otherwise(run)

    return F.array_join(F.transform(runs, spelled), "")


# --- format routing ----------------------------------------------------------------------

# The decoder kinds and the extensions that route to each.
FORMATS = {
    "tiff": ["tif", "tiff", "tf2", "tf8", "btf"],
    "exr": ["exr"],
    "pfm": ["pfm"],
    "netpbm": ["ppm", "pgm", "pbm"],
    "png": ["png", "jpg", "jpeg"],
    "npy": ["npy", "npz"],
    "hdr": ["hdr"],
    "tga": ["tga"],
    "web-image": ["webp", "avif", "bmp", "ico"],
    "jxl": ["jxl"],
    "fits": ["fits", "fit", "fts"],
    "dicom": ["dcm", "dicom"],
    "netcdf": ["nc", "cdf"],
    "czi": ["czi"],
    "nd2": ["nd2"],
    "lif": ["lif"],
    "layered": ["ora", "kra", "psd", "psb", "xcf", "afphoto", "af"],
}


def extension_of(path: Column | str) -> Column:
    """Lower-case extension of the base name; empty without one or for a leading dot only."""
    return F.lower(F.regexp_extract(base_name(path), r"^[^/]+\.([^.]*)$", 1))


def route_formats(files: DataFrame, path: str = "path", hint: str = "hint") -> DataFrame:
    """Decoder kind of each file: a valid hint, else the extension; no extension is DICOM.

    The routing table has a fixed size (about 40 rows), so it is broadcast.
    """
    spark = files.sparkSession
    rows = [(ext, kind) for kind, exts in FORMATS.items() for ext in exts]
    table = F.broadcast(spark.createDataFrame(rows, "ext string, kind_by_ext string"))
    ext = extension_of(path)
    kind = (F.when(F.col(hint).isin(*FORMATS), F.col(hint))
            .when(F.col("ext") == "", F.lit("dicom")).otherwise(F.col("kind_by_ext")))
    return files.withColumn("ext", ext).join(table, "ext", "left").withColumn("kind", kind).drop("kind_by_ext", "ext")


# --- number text -------------------------------------------------------------------------


def number_text(v: Column | str, precision: int = 6, decimal: str = ".") -> Column:
    """Fixed digits without trailing zeros; exponent form outside [1e-4, 1e10).

    NaN and infinities are spelled NaN, Inf and -Inf; whole numbers have no fraction. An
    exact decimal tie in the last digit rounds up, as the JVM formatter does.
    """
    v = col(v).cast("double")
    mag = F.abs(v)
    inf = float("inf")
    if 4 <= precision <= 6:  # what gets here does not round to zero; a decimal is far cheaper to spell than a format
        fixed = F.when(mag < 1e10, v).cast(f"decimal(38,{precision})").cast("string")
        short = F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit("."))
    else:
        short = F.regexp_replace(F.format_string(f"%.{precision}f", v), r"\.?0+$", "")
    expo = F.regexp_replace(F.format_string(f"%.{max(1, precision - 1)}e", v), r"e([+-])0(\d)", "e$1$2")
    whole = (mag < 1e15) & (v == F.floor(F.when(mag < 1e15, v)))
    text = (F.when(v.isNull(), F.lit("")).when(F.isnan(v), F.lit("NaN"))
            .when(v == inf, F.lit("Inf")).when(v == -inf, F.lit("-Inf"))
            .when(whole, F.floor(F.when(mag < 1e15, v)).cast("string"))
            .when((mag != 0) & ((mag < 1e-4) | (mag >= 1e10)), expo)
            .otherwise(F.when(short == "", F.lit("0")).otherwise(short)))
    return F.replace(text, F.lit("."), F.lit(",")) if decimal == "," else text


def quoted(text: Column | str, delimiter: str = ",") -> Column:
    t = col(text)
    need = t.contains(delimiter) | t.contains('"') | t.contains("\n")
    return F.when(need, F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)
