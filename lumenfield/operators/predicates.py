"""Row predicates and gates on frames, masks, annotations and contents, as columns and small joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = str | Column


def _c(a: C) -> Column:
    return F.col(a) if isinstance(a, str) else a


def dark(mean_gray: C, below: float = 10.0) -> Column:
    """Whether a frame is black; one that could not be read is not."""
    return F.coalesce(_c(mean_gray) < below, F.lit(False))


def foreground(red: C, green: C, blue: C, black: int = 16, white: int = 240) -> Column:
    """Whether a point is neither of a black nor of a white background."""
    r, g, b = map(_c, (red, green, blue))
    return (r + g + b >= black) & ~((r > white) & (g > white) & (b > white))


def chosen_frame(frame: C, choice: C) -> Column:
    """Whether a frame is the one that "number: name" names; a choice without a number is all frames."""
    number = F.try_to_number(F.trim(F.split(_c(choice), ":")[0]), F.lit("999999999"))
    return F.coalesce(_c(frame) == number.cast("long"), F.lit(True))


def masked_confidence(confidence: C, sky: C, least: float = 0.1) -> Column:
    """Confidence where the mask is set, 0 elsewhere; no mask changes nothing."""
    return _c(confidence) * F.when(F.coalesce(_c(sky) > least, F.lit(True)), 1.0).otherwise(0.0)


def good_masks(df: DataFrame, iou: str, stability: str, least_iou: float = 0.8, least_stability: float = 0.95) -> DataFrame:
    return df.filter((F.col(iou) > least_iou) & (F.col(stability) >= least_stability))


def keep_rows(df: DataFrame, keep: DataFrame, ident: str) -> DataFrame:
    """Rows of a table of masks that another table names, with all their columns."""
    return df.join(keep.select(ident).distinct(), ident, "left_semi")


def binarised(mask: C, cls: C) -> Column:
    """1 where a mask of numbered classes has the class (masks count from 1)."""
    return F.when(_c(mask) == _c(cls) + 1, 1).otherwise(0)


def boundary(mask: C) -> Column:
    return F.floor(_c(mask) / 255).cast("int")


def not_crowd(iscrowd: C) -> Column:
    return F.coalesce(_c(iscrowd), F.lit(0)) == 0


def or_first(df: DataFrame, filled: Column, order: list[str], columns: list[str]) -> DataFrame:
    """Rows that are empty take their columns from the table's first row that is not: one row, broadcast."""
    first = df.filter(filled).orderBy(*order).limit(1).select(*[F.col(c).alias(f"{c}_first_") for c in columns])
    out = df.join(F.broadcast(first), F.lit(True), "left")
    for c in columns:
        out = out.withColumn(c, F.when(filled, F.col(c)).otherwise(F.col(f"{c}_first_")))
    return out.drop(*[f"{c}_first_" for c in columns])


def safe_asset(url: C) -> Column:
    """Whether an asset's address is relative or https: no file:, no absolute path, no step upwards."""
    u = _c(url)
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.coalesce(~u.startswith("/") & ~u.contains("..") & ((scheme == "") | (scheme == "https")), F.lit(True))


def rejection(rms: C, confidence: C, most: float = 0.05, least: float = 0.5) -> Column:
    """Why a pose is not taken; null if it is."""
    return F.when(_c(rms) > most, "rms").when(_c(confidence) < least, "confidence")


def invalid_as(value: C, valid: C, instead: float) -> Column:
    """The value where it is valid; NaN, zero or another number elsewhere."""
    return F.when(F.coalesce(_c(valid), F.lit(False)), _c(value)).otherwise(F.lit(float(instead)))
