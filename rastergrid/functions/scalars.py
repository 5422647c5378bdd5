"""String, path, rounding and date helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repeat_char(n: Column, c: str) -> Column:
    """``c`` repeated ``n`` times; '' for n <= 0."""
    return F.repeat(F.lit(c), n.cast("int"))


def pad_left(text: Column, width: int, c: str) -> Column:
    """Left-pad to ``width``; unlike lpad, longer text is returned whole."""
    return F.concat(repeat_char(F.lit(width) - F.length(text), c), text)


def path_join(parent: Column, child: Column) -> Column:
    """Two path parts joined by exactly one slash."""
    return F.concat_ws("/", F.rtrim(parent, F.lit("/")), F.ltrim(child, F.lit("/")))


def file_join(parent: Column, child: Column) -> Column:
    """Two path parts joined as local files are: runs of slashes count as one, trailing ones go, an
    empty child gives the parent, and an empty parent the root."""
    def plain(path: Column) -> Column:
        single = F.regexp_replace(path, "/+", "/")
        return F.when(F.length(single) > 1, F.regexp_replace(single, "/$", "")).otherwise(single)

    above, below = plain(F.when(parent == "", F.lit("/")).otherwise(parent)), plain(child)
    rest = F.regexp_replace(below, "^/", "")
    root = F.when(above == "/", F.lit("")).otherwise(above)
    return F.when((below == "") | ((below == "/") & (above == "/")), above).otherwise(F.concat(root, F.lit("/"), rest))


def path_basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def swap_extension(path: Column, extension: str = ".json") -> Column:
    """Replace everything from the last dot on."""
    return F.concat(F.regexp_replace(path, r"\.[^.]*$", ""), F.lit(extension))


def path_stem_glob(path: Column) -> Column:
    """Text before the first dot, then '.*' (a dotted directory cuts early)."""
    return F.concat(F.substring_index(path, ".", 1), F.lit(".*"))


def has_extension(path: Column, extensions: list[str]) -> Column:
    """Case-sensitive suffix test against any of ``extensions``."""
    out = F.lit(False)
    for ext in extensions:
        out = out | F.endswith(path, F.lit(ext))
    return out


def round_at(value: Column, places: int) -> Column:
    """Round to ``places`` decimals with ties toward positive infinity."""
    scale = F.lit(float(10**places))
    return F.floor(value * scale + F.lit(0.5)).cast("double") / scale


def nanos_to_seconds(nanos: Column) -> Column:
    return round_at(nanos.cast("double") / F.lit(1e9), 4)


def size_in_units(n_bytes: Column, power: float) -> Column:
    """A byte count in units of 1024^power, three decimals."""
    return round_at(n_bytes.cast("double") / F.lit(1024.0**power), 3)


def format_timestamp(ts: Column, pattern: str) -> Column:
    return F.date_format(ts, pattern)
