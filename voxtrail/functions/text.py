"""Label and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The file endings an image identifier may carry.
IMAGE_ENDINGS = ("nii.gz", "nii", "jpg", "jpeg", "png", "bmp", "gif", "tif", "tiff")


def condition_label(source: Column, valence: Column) -> Column:
    return F.when(source == "natural", valence).otherwise(F.concat(valence, F.lit("AI")))


def base_identity(name: Column) -> Column:
    """Last path part without a known file ending (a dotted number stays) and
    without a trailing _<digits>."""
    endings = "|".join(e.replace(".", r"\.") for e in IMAGE_ENDINGS)
    bare = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1),
                            r"(?i)\.(" + endings + r")$", "")
    return F.regexp_replace(bare, r"_[0-9]+$", "")


def subject_number(label: Column, all_digits: bool = False) -> Column:
    digits = (F.regexp_replace(label, r"[^0-9]", "") if all_digits
              else F.regexp_extract(label, r"([0-9]+)", 1))
    return F.when(digits != "", digits.cast("bigint"))


def star_label(p: Column) -> Column:
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
            .otherwise("n.s."))


def safe_name(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def unsided(name: Column) -> Column:
    """Region name without its left/right ending."""
    return F.regexp_replace(name, r"_[LR]$", "")
