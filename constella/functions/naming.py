"""Column functions of file names, run names, labels and progress figures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from constella.functions.geometry import _c

# What the names of source images look like.
GREEN_NAME = r"(?i)^GB\.(?!.*locations fixed).*\.tiff?$"
RED_NAME = r"(?i)^GB\..*locations fixed.*\.tiff?$"
RED_INDEX = r"redsquare(\d+)"
MILLIMETRES = r"(\d+)mm"


def base_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def parent(path) -> Column:
    return F.regexp_replace(_c(path), r"/[^/]*$", "")


def stem(name) -> Column:
    return F.regexp_replace(_c(name), r"\.[^.]*$", "")


def role(name) -> Column:
    """'red' for templates, 'green' for fields, null for other files."""
    return F.when(_c(name).rlike(RED_NAME), F.lit("red")).when(_c(name).rlike(GREEN_NAME), F.lit("green"))


def extract(text, pattern: str, otherwise) -> Column:
    """The first group of the first match, or ``otherwise``."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(text), pattern, 1), F.lit("")), otherwise)


def red_square(name) -> Column:
    return extract(name, RED_INDEX, F.lit("0"))


def green_square(name) -> Column:
    """The ordinal before 'mm', or the stem where there is none."""
    return extract(name, MILLIMETRES, stem(name))


def millimetres(name) -> Column:
    """The ordinal with its unit, or the stem where there is none."""
    return extract(name, r"(\d+mm)", stem(name))


def short_label(name) -> Column:
    """The last twelve characters of what stands before the first dot."""
    return F.expr("right(split_part(`%s`, '.', 1), 12)" % name) if isinstance(name, str) else F.right(F.split_part(name, F.lit("."), F.lit(1)), F.lit(12))


def cache_path(path) -> Column:
    return F.concat(parent(path), F.lit("/data/"), stem(base_name(path)), F.lit("_processed_data.json"))


def image_cache_path(path) -> Column:
    """The array file beside a cache document; null where the path isn't one's."""
    return F.when(_c(path).endswith("_processed_data.json"), F.regexp_replace(_c(path), "_processed_data[.]json$", "_processed_image.npy"))


def local(path) -> Column:
    """A path without the scheme of local files, which is written with one slash or three."""
    return F.regexp_replace(_c(path), "^file:/+", "/")


def directory_key(path, root) -> Column:
    """Relative to the root where the path lies below it, else as it is."""
    p, r = local(path), F.rtrim(local(root), F.lit("/"))
    return F.when(F.startswith(p, F.concat(r, F.lit("/"))), F.substring(p, F.length(r) + 2, F.lit(1 << 30))).otherwise(p)


def run_id(at) -> Column:
    return F.date_format(_c(at), "yyyy-MM-dd--HH-mm-ss")


def elapsed(seconds) -> Column:
    s = _c(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def duration_seconds(began, ended) -> Column:
    return F.round((F.unix_micros(_c(ended)) - F.unix_micros(_c(began))) / 1e6, 3)


def progress_percent(done, step, steps, images) -> Column:
    """Whole percent of a directory's images, counting the step of the current one; 0 to 100."""
    part = F.coalesce(F.try_divide(_c(step).cast("double"), _c(steps)), F.lit(0.0))
    whole = F.coalesce(F.floor(F.try_divide((_c(done) + part) * 100, _c(images))).cast("int"), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), whole))
