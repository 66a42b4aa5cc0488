"""Sizes, exif fields and perceptual hashes from image contents. Decoding needs Pillow; without it these columns are null."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Numbers of the exif tags that are read.
TAGS = {
    "orientation": 274, "datetime_original": 36867, "datetime_digitized": 36868, "datetime_modified": 306, "camera_make": 271, "camera_model": 272, "iso_speed": 34855, "focal_length": 37386, "f_number": 33437, "exposure_time": 33434,
    "flash": 37385, "timezone_offset": 36881,
}
SCHEMA = (
    "width int, height int, orientation int, taken string, digitized string, modified string, camera_make string, camera_model string, iso_speed int, focal_length double, f_number double, exposure_time string, flash boolean, "
    "timezone_offset string, phash string, dhash string, whash string"
)


def _hex(bits: np.ndarray) -> str:
    return f"{int(''.join('1' if x else '0' for x in bits.ravel()), 2):016x}"


def phash(grey: np.ndarray) -> str:
    """Signs of the 8 x 8 lowest cosine waves of a 32 x 32 grey picture against their median."""
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:8, None] / 64)
    low = basis @ grey.astype(float) @ basis.T
    return _hex(low > np.median(low))


def dhash(grey: np.ndarray) -> str:
    """Whether each of the 8 x 9 grey values is less than the next of its row."""
    return _hex(grey[:, 1:].astype(int) > grey[:, :-1].astype(int))


def whash(grey: np.ndarray) -> str:
    """The coarsest 8 x 8 Haar averages of a square grey picture whose side is 8 times a power of two, against their median; the mean of the whole picture is taken out first."""
    side = len(grey) // 8
    means = grey.astype(float).reshape(8, side, 8, side).mean(axis=(1, 3))
    means = means - means.mean()
    return _hex(means > np.median(means))


def exif_fields(tags: dict) -> dict:
    """The fields of SCHEMA that exif tags (by number) tell; what is missing or can't be read is None, an orientation out of range 1."""
    get = lambda name: tags.get(TAGS[name])

    def read(name, kind):
        try:
            return None if get(name) in (None, "", 0) else kind(get(name))
        except (TypeError, ValueError, ZeroDivisionError):
            return None

    turn, text = read("orientation", int) or 1, lambda v: str(v).strip("\x00 \t\r\n") or None
    offset = re.fullmatch(r"[+-]\d{2}:\d{2}", read("timezone_offset", text) or "")
    return {
        "orientation": turn if 1 <= turn <= 8 else 1, "taken": read("datetime_original", str), "digitized": read("datetime_digitized", str), "modified": read("datetime_modified", str), "camera_make": read("camera_make", text),
        "camera_model": read("camera_model", text), "iso_speed": read("iso_speed", int), "focal_length": read("focal_length", float), "f_number": read("f_number", float), "exposure_time": read("exposure_time", str),
        "flash": None if get("flash") is None else bool(int(get("flash")) & 1), "timezone_offset": offset and offset[0],
    }


def _read(content: bytes) -> tuple:
    import io

    from PIL import Image

    with Image.open(io.BytesIO(content)) as image:
        found = image.getexif()
        fields = exif_fields({**found, **found.get_ifd(0x8769)})
        w, h = image.size if fields["orientation"] < 5 else image.size[::-1]
        grey = image.convert("L")
        at = lambda *size: np.asarray(grey.resize(size))
        side = 8
        while side * 2 <= min(image.size):
            side *= 2
        values = {"width": w, "height": h, **fields, "phash": phash(at(32, 32)), "dhash": dhash(at(9, 8)), "whash": whash(at(side, side))}
        return tuple(values[x.split()[0]] for x in SCHEMA.split(", "))


def described(files: DataFrame) -> DataFrame:
    """files(path, content, ...) with SCHEMA's columns in place of the content; unreadable images have nulls there."""
    try:
        import PIL  # noqa: F401

        known = True
    except ImportError:
        known = False
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rest = [c for c in files.columns if c != "content"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for c in p["content"]:
                try:
                    rows.append(_read(c) if known else (None,) * len(names))
                except Exception:  # noqa: BLE001 - any damage to a file
                    rows.append((None,) * len(names))
            yield pd.concat([p[rest].reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype=object)], axis=1)

    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in rest)
    return files.mapInPandas(run, f"{kinds}, {SCHEMA}")


def merged_exif(first: DataFrame, second: DataFrame) -> DataFrame:
    """first(file_id, orientation, camera_make, camera_model, camera_full) with what a second reader adds, where the first found no turned orientation (1 or none).

    Its orientation counts if it isn't 1; its camera counts, as a whole, if the first found none. Files that only the second has are left out.
    """
    from pyspark.sql import functions as F

    names = ("orientation", "camera_make", "camera_model", "camera_full")
    rows = first.join(second.select("file_id", *[F.col(n).alias(f"_{n}") for n in names]), "file_id", "left")
    own = F.coalesce(F.when(F.col("orientation").between(1, 8), F.col("orientation")), F.lit(1))
    other = F.when(F.col("_orientation").between(2, 8), F.col("_orientation"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    fill = (own == 1) & blank("camera_full") & ~blank("_camera_full")
    values = {"orientation": F.when(own == 1, F.coalesce(other, F.lit(1))).otherwise(own)} | {n: F.when(fill, F.col(f"_{n}")).otherwise(F.col(n)) for n in names[1:]}
    return rows.select("file_id", *[v.alias(n) for n, v in values.items()])
