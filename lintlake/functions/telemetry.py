"""Device snapshot text to columns. Field patterns and defaults are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintlake.functions.budget import round_to_cents

BOARD = r"(?d)Board name:\s+(.*)"
DRIVER = r"Driver version:\s*([\d.]+)"
VBIOS = r"VBIOS version:\s+([\w-]+)"
PERFORMANCE = r"(?d)Performance Level:\s+(.*)"
GPU_USE = r"GPU\[\d\]\s+:?\sGPU\suse\s\(%\):\s(\d)"
VRAM_USED = r"GPU\[\d\]\s+:?\sVRAM\sTotal\sUsed\sMemory\s\(B\):?\s(\d*)"
VRAM_TOTAL = r"GPU\[\d\]\s+:?\sVRAM\sTotal\sMemory\s\(B\):?\s(\d*)"
EDGE_TEMPERATURE = r"Temperature \(Sensor edge\) \(C\): (\d+\.\d+)"
POWER_DRAW = r"Average Graphics Package Power \(W\):\s+([\d.]+)"
POWER_CAP = r"Max Graphics Package Power \(W\):\s+([\d.]+)"
DISPLAY_CLOCK = r"dcefclk clock level: \d+: \((\d+)Mhz\)"
MEMORY_CLOCK = r"mclk clock level: \d+: \((\d+)Mhz\)"
SHADER_CLOCK = r"sclk clock level: \d+: \((\d+)Mhz\)"

MIB = 1024.0 * 1024.0


NUMBERS = {
    "_gpu_use": GPU_USE,
    "_used": VRAM_USED,
    "_total": VRAM_TOTAL,
    "_temperature": EDGE_TEMPERATURE,
    "_draw": POWER_DRAW,
    "_cap": POWER_CAP,
    "_display_clock": DISPLAY_CLOCK,
    "_memory_clock": MEMORY_CLOCK,
    "_shader_clock": SHADER_CLOCK,
}


def captures(text: Column, board_text: Column | None = None) -> dict[str, Column]:
    """What the patterns capture: numbers (null when absent) and labels (null when absent)."""

    def label(source: Column, pattern: str) -> Column:
        return F.when(source.rlike(pattern), F.regexp_extract(source, pattern, 1))

    board = board_text if board_text is not None else text
    numbers = {name: F.regexp_extract(text, p, 1).try_cast("double") for name, p in NUMBERS.items()}
    return {
        **numbers,
        "_board": F.trim(label(board, BOARD)),
        "_driver": label(text, DRIVER),
        "_vbios": label(text, VBIOS),
        "_performance": label(text, PERFORMANCE),
    }


def fields() -> dict[str, Column]:
    """Every field from the captured columns, each with its own default."""

    def known(c: Column) -> Column:
        return F.coalesce(c, F.lit(-1.0))

    def whole(name: str) -> Column:
        return known(F.bround(F.col(name), 0))

    used, total = F.col("_used") / MIB, F.col("_total") / MIB
    return {
        "gpu_name": F.coalesce("_board", F.lit("Not found in clinfo output.")),
        "driver_version": F.coalesce("_driver", F.lit("Driver version not found in rocm-smi output.")),
        "vbios_version": F.coalesce("_vbios", F.lit("VBIOS version not found in rocm-smi output.")),
        "p_state": F.coalesce("_performance", F.lit("-1.0")),
        "gpu_utilization": known(round_to_cents(F.col("_gpu_use") / 100.0)),
        "memory_used": known(used),
        "memory_total": known(total),
        "memory_utilization": known(round_to_cents(F.try_divide(used, total))),
        "temperature": whole("_temperature"),
        "power_draw": whole("_draw"),
        "power_default_limit": whole("_cap"),
        "clocks_video": whole("_display_clock"),
        "current_memory_clock": whole("_memory_clock"),
        "current_graphics_clock": whole("_shader_clock"),
        "clocks_sm": whole("_shader_clock"),
    }
