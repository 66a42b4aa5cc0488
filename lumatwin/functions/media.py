"""Column expressions on what is known of a media file: names, formats, sizes, cameras, times.

Empty texts and zeros count as missing wherever a function says "missing".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of folders, extensions and formats.
CACHE_DIRS = [
    ".thumbnails", "thumbnails", ".cache", "cache", "__pycache__", ".git", ".svn", ".hg", "System Volume Information", "$RECYCLE.BIN", ".Trash", ".Trashes",
    "lost+found", "node_modules", ".vscode", ".idea",
]
INCLUDE = [
    "*.jpg", "*.jpeg", "*.png", "*.gif", "*.bmp", "*.tiff", "*.tif", "*.webp", "*.heic", "*.heif", "*.raw", "*.cr2", "*.nef", "*.arw", "*.dng", "*.rw2", "*.orf", "*.pef", "*.srw",
]
SAME_FORMAT = {"jpg": "JPEG", "tif": "TIFF"}
RANKED_FORMATS = {
    "raw": 1, "cr2": 1, "cr3": 1, "nef": 1, "orf": 1, "arw": 1, "dng": 1, "raf": 1, "rw2": 1, "tiff": 2, "tif": 2, "png": 3, "jpg": 4, "jpeg": 4, "webp": 5,
}
FORMAT_CLASSES = ["raw", "tiff", "png", "jpeg", "webp", "other"]
THUMB_FORMATS = ["jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp"]
HEAVY_FORMATS = ["cr2", "nef", "arw", "dng", "rw2", "orf", "pef", "srw", "tif", "tiff"]
TEMPORARY = [".tmp", ".temp", "_temp", ".partial", ".download"]
BROKEN = [".error", ".corrupt", ".failed", ".retry"]
ROTATED = (5, 6, 7, 8)
MIN_SIDE = 256
DAY_S = 86_400


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    """The lower-case extension without its dot; empty if the name has none."""
    return F.lower(F.regexp_extract(name_of(path), r"[^.]\.([^.]+)$", 1))


def glob_regex(patterns: list[str]) -> str:
    """One regular expression for any of several file-name patterns of *, ? and [...]."""
    special = {"*": ".*", "?": "."}
    out = []
    for p in patterns:
        text, k = "", 0
        while k < len(p):
            end = p.find("]", k + 2)
            if p[k] == "[" and end > 0:
                text += "[" + p[k + 1 : end].replace("\\", "\\\\").replace("!", "^", p[k + 1] == "!") + "]"
                k = end
            else:
                text += special.get(p[k]) or ("\\" + p[k] if not p[k].isalnum() else p[k])
            k += 1
        out.append(text)
    return "^(?:" + "|".join(out) + ")$"


def matches(name: Column, patterns: list[str]) -> Column:
    """Whether a file name matches any pattern, whatever its case; no pattern matches nothing."""
    return F.lower(name).rlike(glob_regex([p.lower() for p in patterns])) if patterns else F.lit(False)


def in_cache_dir(path: Column) -> Column:
    """Whether any folder above the file is a cache folder. Names compare in lower case, so a listed name with capitals matches none."""
    return F.arrays_overlap(F.split(F.lower(folder_of(path)), "/"), F.array(*map(F.lit, CACHE_DIRS)))


def format_name(path: Column) -> Column:
    """The format an extension stands for, in capitals."""
    ext = extension(path)
    return reduce(lambda w, kv: w.when(ext == kv[0], kv[1]), SAME_FORMAT.items(), F.when(F.lit(False), "")).otherwise(F.upper(ext))


def format_priority(fmt: Column, path: Column) -> Column:
    """1 (best) to 6: of the format where there is one, else of the path's extension."""
    key = F.ltrim(F.lower(F.when(F.coalesce(fmt, F.lit("")) != "", fmt).otherwise(extension(path))), F.lit("."))
    of = F.create_map(*[F.lit(x) for kv in RANKED_FORMATS.items() for x in kv])
    return F.coalesce(F.try_element_at(of, key), F.lit(6))


def format_class(priority: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, FORMAT_CLASSES)), priority)


def resolution(w: Column, h: Column) -> Column:
    """Pixels, 0 where a side is missing."""
    return F.when((w != 0) & (h != 0), w.cast("long") * h).otherwise(F.lit(0).cast("long"))


def big_enough(w: Column, h: Column, side: int = MIN_SIDE) -> Column:
    """Files of unknown size pass."""
    return w.isNull() | h.isNull() | ((w >= side) & (h >= side))


def present(value: Column) -> Column:
    """A number, null where it is 0 or not a number."""
    return F.when((value != 0) & ~F.isnan(value.cast("double")), value)


def changed(size_a: Column, mtime_a: Column, size_b: Column, mtime_b: Column) -> Column:
    """Whether a file differs from its record: another size, or a time at least one second off. Null counts as equal to null only."""
    return ~size_a.eqNullSafe(size_b) | F.coalesce(F.abs(mtime_a - mtime_b) >= 1.0, mtime_a.isNull() != mtime_b.isNull())


def camera(make: Column, model: Column) -> Column:
    """Make and model, either where one is missing, else null."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.nullif(F.concat_ws(" ", clean(make), clean(model)), F.lit(""))


def camera_full(make: Column, model: Column) -> Column:
    """As camera(), with the make not repeated where the model begins with it."""
    make, model = F.nullif(F.trim(make), F.lit("")), F.nullif(F.trim(model), F.lit(""))
    rest = F.when(F.startswith(model, make), F.trim(F.substring(model, F.length(make) + 1, F.length(model)))).otherwise(model)
    return F.nullif(F.trim(F.concat_ws(" ", make, rest)), F.lit(""))


def same_camera(a: Column, b: Column) -> Column:
    """Equal but for case and outer blanks; two missing ones are equal, a missing and a known one aren't."""
    norm = lambda c: F.coalesce(F.lower(F.trim(c)), F.lit(""))
    return norm(a) == norm(b)


def upright(w: Column, h: Column, orientation: Column) -> tuple[Column, Column]:
    """Width and height as seen: swapped for the rotated orientations. Orientations outside 1 to 8 count as 1."""
    turned = F.coalesce(orientation.isin(*ROTATED), F.lit(False))
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def orientation_steps(orientation: Column) -> Column:
    """What turns a picture upright, as text: a mirroring, a rotation, both or none."""
    steps = {2: "mirror", 3: "rotate 180", 4: "mirror, rotate 180", 5: "mirror, rotate 90", 6: "rotate 270", 7: "mirror, rotate 270", 8: "rotate 90"}
    return reduce(lambda w, kv: w.when(orientation == kv[0], kv[1]), steps.items(), F.when(F.lit(False), "")).otherwise("none")


def flash_fired(value: Column) -> Column:
    return value.bitwiseAND(1) == 1


def thumb_size(w: Column, h: Column, target: int) -> tuple[Column, Column]:
    """The longer side becomes target, the other in proportion, cut to whole pixels and at least 1. Null for missing sides."""
    known, t = (w > 0) & (h > 0), F.lit(target)
    other = lambda a, b: F.greatest(F.lit(1), F.floor(a * (F.lit(float(target)) / b)).cast("int"))
    return F.when(known & (w >= h), t).when(known, other(w, h)), F.when(known & (w >= h), other(h, w)).when(known, t)


def thumb_name(path: Column, size: Column, mtime: Column) -> Column:
    """A name that doesn't show the file's own: 16 digits of a hash over path, size and whole seconds of the time."""
    return F.concat(F.lit("thumb_"), F.substring(F.sha2(F.concat_ws(":", path, size.cast("string"), F.floor(F.coalesce(mtime, F.lit(0.0))).cast("string")), 256), 1, 16), F.lit(".webp"))


def name_pattern(name: Column) -> Column:
    """A name with hash and time suffixes made alike. A date of eight digits is taken for a hash, so the second rule seldom applies."""
    return F.regexp_replace(F.regexp_replace(name, "_[a-f0-9]{8,}", "_HASH"), r"_\d{8}_\d{6}", "_TIMESTAMP")


def _holds(name: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(m)) for m in marks])


def is_temporary(name: Column) -> Column:
    return _holds(name, TEMPORARY)


def is_broken(name: Column) -> Column:
    return _holds(name, BROKEN)


def age_days(now: float, then: Column) -> Column:
    return F.floor((F.lit(now) - then) / DAY_S)


def stripped(text: Column) -> Column:
    """A text without outer white space of any kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def exif_seconds(text: Column) -> Column:
    """A timestamp text of one of four formats as seconds since 1970 UTC, else null."""
    t = stripped(text)
    day = r"(\d{4}):(\d{2}):(\d{2})"
    shapes = [(rf"^{day} (\d{{2}}:\d{{2}}:\d{{2}})$", "$1-$2-$3 $4"), (rf"^{day} (\d{{2}}:\d{{2}}:\d{{2}}\.\d{{1,6}})$", "$1-$2-$3 $4"), (r"^(\d{4})([-/])(\d{2})\2(\d{2}) (\d{2}:\d{2}:\d{2})$", "$1-$3-$4 $5")]
    plain = F.coalesce(*[F.when(t.rlike(p), F.regexp_replace(t, p, to)) for p, to in shapes])
    return F.unix_micros(F.concat(plain, F.lit("Z")).try_cast("timestamp")) / 1e6


def zone_offset(text: Column) -> Column:
    """An offset of the form +HH:MM, else null."""
    return F.nullif(F.regexp_extract(stripped(text), r"^([+-]\d{2}:\d{2})$", 1), F.lit(""))


def char_distance(a: Column, b: Column) -> Column:
    """Characters in which two texts differ, as far as the shorter one goes; null where one is null."""
    n = F.when(a.isNotNull() & b.isNotNull(), F.least(F.length(a), F.length(b)))
    return F.aggregate(F.sequence(F.lit(0), n), F.lit(0), lambda s, k: s + F.when((k > 0) & (F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1))), 1).otherwise(0))


def size_ratio(a: Column, b: Column) -> Column:
    """How much the smaller lacks of the larger, from 0 to 1; null unless both are above 0."""
    return F.when((a > 0) & (b > 0), F.abs(a - b) / F.greatest(a, b))


def dims_compatible(w1: Column, h1: Column, w2: Column, h2: Column, tolerance: float = 0.1) -> Column:
    """Aspect ratio and pixels each off by at most the tolerance; unknown sides are compatible."""
    known = (w1 != 0) & (h1 != 0) & (w2 != 0) & (h2 != 0)
    off = lambda x, y: F.abs(x - y) / F.greatest(x, y)
    ratio = lambda w, h: F.try_divide(w.cast("double"), h.cast("double"))
    fits = (off(ratio(w1, h1), ratio(w2, h2)) <= tolerance) & (off(w1.cast("double") * h1, w2.cast("double") * h2) <= tolerance)
    return F.when(known, fits).otherwise(True)


def times_close(a: Column, b: Column, seconds: float = 60.0) -> Column:
    """At most so many seconds apart; missing times are close."""
    a, b = present(a), present(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= seconds).otherwise(True)


def megabytes(size: Column) -> Column:
    return size / F.lit(1_048_576.0)
