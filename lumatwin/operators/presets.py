"""Named settings: which one a configuration is, and what one means for a session."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The settings by which a preset is known.
PRESETS = {
    "Ultra-Lite": {"thread_cap": 2, "io_throttle": 1.0, "memory_cap_mb": 512, "enable_orb_fallback": False, "on_demand_thumbs": True, "skip_raw_tiff": True, "cache_size_cap_mb": 256},
    "Balanced": {"thread_cap": 4, "io_throttle": 0.5, "memory_cap_mb": 2048, "enable_orb_fallback": True, "on_demand_thumbs": True, "skip_raw_tiff": False, "cache_size_cap_mb": 1024},
    "Accurate": {"thread_cap": 8, "io_throttle": 0.0, "memory_cap_mb": 8192, "enable_orb_fallback": True, "on_demand_thumbs": False, "skip_raw_tiff": False, "cache_size_cap_mb": 2048},
}
RADIUS = {"Ultra-Lite": 6, "Balanced": 8, "Accurate": 12}


def preset_name(settings: dict[str, Column]) -> Column:
    """The preset whose settings are all equal to the given columns, else Custom; a missing or null setting equals none."""
    none = F.lit(None)
    fits = lambda p: reduce(lambda a, b: a & b, [settings.get(k, none).eqNullSafe(F.lit(v)) for k, v in p.items()])
    return F.coalesce(*[F.when(fits(p), F.lit(n)) for n, p in PRESETS.items()], F.lit("Custom"))


def session_settings(preset: str, low_power: bool = False) -> dict[str, str]:
    """What a preset means here: threads and memory become cores and memory of an executor. On low power every preset is the lightest."""
    p = PRESETS["Ultra-Lite" if low_power else preset]
    return {"spark.executor.cores": str(p["thread_cap"]), "spark.executor.memory": f"{p['memory_cap_mb']}m"}


def radius(preset: str, low_power: bool = False) -> int:
    return RADIUS["Ultra-Lite" if low_power else preset]
