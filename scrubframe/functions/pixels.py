"""Column expressions over one frame's pixels (row-major integer array)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubframe.functions.boxes import let


def overlay_group(overlay: Column) -> Column:
    """Tag group of overlay ``n``: 0x6000, 0x6002, ..."""
    return F.lit(0x6000) + 2 * overlay


def overlay_bit(position: Column) -> Column:
    """Bit of a high-bit overlay, or 0 for a stand-alone overlay."""
    return F.when(F.coalesce(position, F.lit(0)) > 0, position).otherwise(F.lit(0)).cast("int")


def strip_highbits(pixels: Column, bits_stored: Column) -> Column:
    mask = F.expr("shiftleft(1, bits_stored) - 1") if bits_stored is None else F.call_function(
        "shiftleft", F.lit(1), bits_stored.cast("int")) - 1
    return F.transform(pixels, lambda p: p.bitwiseAND(mask))


def extract_bitplane(pixels: Column, bit: int) -> Column:
    return F.transform(pixels, lambda p: p.bitwiseAND(F.lit(1 << bit)))


def contrast_stretch(pixels: Column, invert: Column | None = None) -> Column:
    """Rescale to 0..255 by the frame's own minimum and maximum; a constant frame is unchanged."""
    def within(limits: Column) -> Column:
        low, high, scale = limits["low"], limits["high"], limits["scale"]

        def stretch(p: Column) -> Column:
            up = F.floor((p - low) * scale)
            if invert is not None:
                up = F.when(invert, F.floor((high - p) * scale)).otherwise(up)
            return up.cast("int")

        return F.when(low == high, pixels).otherwise(F.transform(pixels, stretch))

    # The limits are computed once per frame, so the time is linear in its pixels.
    low, high = F.array_min(pixels), F.array_max(pixels)
    scale = F.when(high > low, F.lit(255.0) / (high - low))
    return let(F.struct(low.alias("low"), high.alias("high"), scale.alias("scale")), within)


def blank_frame(pixels: Column) -> Column:
    return F.array_repeat(F.lit(0), F.size(pixels)).cast("array<int>")
