"""Pixel algebra: column expressions for radiometry, masks, indices, radar evidence and fusion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published class and bit meanings, and scale factors of the sensors' products.
#: Scene-classification classes that are unusable: no data, defective, cloud shadow, cloud (two), cirrus, snow.
INVALID_SCL = (0, 1, 3, 8, 9, 10, 11)
#: QA bits 0 to 5: fill, dilated cloud, cirrus, cloud, cloud shadow, snow.
INVALID_QA_BITS = 0b111111
#: sensor: (scale, offset, fill value or None).
RADIOMETRY = {"sentinel-2": (1e-4, 0.0, None), "landsat": (2.75e-5, -0.2, 0), "sentinel-1": (1.0, 0.0, 0)}
#: dB floor, range and weight of the radar bands.
DB_FLOOR = 1e-7
VV = (25.0, 22.0, 0.65)
VH = (32.0, 22.0, 0.35)
OPTICAL_HIGH, SAR_HIGH = 0.70, 0.55


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def finite(x: Column) -> Column:
    """``x``, null where it is NaN or infinite."""
    y = x.cast("double")
    return F.when(~F.isnan(y) & (F.abs(y) != float("inf")), x)


def scl_valid(scl: Column) -> Column:
    return ~scl.isin(*INVALID_SCL)


def qa_valid(qa: Column) -> Column:
    return qa.bitwiseAND(INVALID_QA_BITS) == 0


def quality_valid(sensor: Column, quality: Column) -> Column:
    """The mask that belongs to the sensor; an unknown sensor is an error."""
    return (
        F.when(sensor == "sentinel-2", scl_valid(quality))
        .when(sensor == "landsat", qa_valid(quality))
        .otherwise(F.raise_error(F.concat(F.lit("no quality mask for sensor "), F.coalesce(sensor, F.lit("null")))).cast("boolean"))
    )


def masked(band: Column, valid: Column) -> Column:
    return F.when(valid, band)


def reflectance(sensor: Column, dn: Column) -> Column:
    """Scale and offset of the sensor; fill values become null."""
    out = F.lit(None).cast("float")
    for name, (scale, offset, fill) in RADIOMETRY.items():
        value = (dn * scale + offset).cast("float")
        out = F.when(sensor == name, value if fill is None else F.when(dn != fill, value)).otherwise(out)
    return out


def model_input(dn: Column, quantification: float, valid: Column) -> Column:
    """DN to [-1, 1]; 0 where invalid."""
    return F.when(valid, clip(dn / quantification, 0.0, 1.0) * 2 - 1).otherwise(F.lit(0.0))


def rgb_input(v: Column) -> Column:
    """uint8 to [-1, 1]; other values are an error."""
    whole = (v >= 0) & (v <= 255) & (v == F.floor(v))
    return F.when(whole, v / 127.5 - 1).otherwise(F.raise_error(F.lit("not an 8-bit value")).cast("double"))


def to_uint8(v: Column) -> Column:
    """Reflectance to 0..255, half to even; NaN and null to 0."""
    y = F.when(F.isnan(v), F.lit(0.0)).otherwise(F.coalesce(v, F.lit(0.0)))
    return F.rint(clip(y, 0.0, 1.0) * 255).cast("short")


def ndvi(red: Column, nir: Column) -> Column:
    return F.when(nir + red != 0, (nir - red) / (nir + red))


def threshold_mask(p: Column, t: float, valid: Column | None = None) -> Column:
    """1 where the probability, a float, reaches the threshold as a float; 0 where it does not or is invalid."""
    hit = p >= F.lit(t).cast("float")
    if valid is not None:
        hit = hit & valid
    return F.coalesce(hit, F.lit(False)).cast("tinyint")


def decibel(v: Column) -> Column:
    return 10 * F.log10(F.greatest(v, F.lit(DB_FLOOR)))


def sar_evidence(vv: Column, vh: Column) -> Column:
    def one(v: Column, shift: float, span: float) -> Column:
        return clip((decibel(v) + shift) / span, 0.0, 1.0)

    return clip(VV[2] * one(vv, *VV[:2]) + VH[2] * one(vh, *VH[:2]), 0.0, 1.0)


def agreement(optical: Column, sar: Column) -> Column:
    return 2 * optical * sar / (optical + sar + 1e-6)


def agreement_category(optical: Column, sar: Column) -> Column:
    """3 both, 2 optical only, 1 radar only, 0 neither."""
    o, s = optical >= OPTICAL_HIGH, sar >= SAR_HIGH
    return F.when(o & s, 3).when(o, 2).when(s, 1).otherwise(0)


def fusion_label(optical: Column, sar: Column) -> Column:
    o, s = optical >= OPTICAL_HIGH, sar >= SAR_HIGH
    return F.when(o & s, "HIGH AGREEMENT").when(s, "SAR-ONLY").when(o, "OPTICAL-ONLY").otherwise("NO STRONG EVIDENCE")


def fusion_score(optical: Column, sar: Column, quality: Column) -> Column:
    mix = 0.45 * optical + 0.25 * sar + 0.15 * agreement(optical, sar) + 0.15 * quality
    return F.bround(100 * mix, 1)


def logit(p: Column) -> Column:
    q = clip(p, 1e-7, 1 - 1e-7)
    return F.ln(q / (1 - q))


def softmax2(no: Column, yes: Column) -> Column:
    return 1 / (1 + F.exp(no - yes))


def normalised_difference(x: Column, y: Column) -> Column:
    return (y - x) / (F.abs(x) + F.abs(y) + 1e-8)


def colour_ramp(v: Column, stops: list[tuple[float, tuple[int, int, int, int]]]) -> Column:
    """Piecewise-linear r, g, b, a by ascending stops; ends are held, null is transparent."""
    names = ("r", "g", "b", "a")

    def channel(k: int) -> Column:
        out = F.lit(stops[-1][1][k])
        for (a, low), (b, high) in reversed(list(zip(stops[:-1], stops[1:], strict=True))):
            out = F.when(v < b, F.rint(low[k] + (high[k] - low[k]) * (v - a) / (b - a)).cast("int")).otherwise(out)
        return F.when(v.isNull(), 0).when(v <= stops[0][0], stops[0][1][k]).otherwise(out)

    return F.struct(*(channel(k).cast("int").alias(n) for k, n in enumerate(names)))


def review_priority(score: Column) -> Column:
    return F.when(score >= 90, "high").when(score >= 75, "mid").otherwise("low")
