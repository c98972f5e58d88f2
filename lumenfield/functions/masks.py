"""Masks as run lengths: column-major runs, the first of them background, runs of length 0 allowed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rle_area(counts: Column) -> Column:
    return F.aggregate(F.filter(counts, lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, x: s + x)


def rle_pixels(counts: Column) -> Column:
    """The mask as an array of 0 and 1, column by column."""
    return F.flatten(F.transform(counts, lambda n, i: F.array_repeat((i % 2).cast("int"), n.cast("int"))))


def encode(mask: np.ndarray) -> list[int]:
    flat = np.asarray(mask, bool).ravel(order="F")
    cuts = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    runs = np.diff(np.concatenate(([0], cuts, [len(flat)]))).tolist() if len(flat) else []
    return [0, *runs] if len(flat) and flat[0] else runs


def decode(counts: list[int], height: int, width: int) -> np.ndarray:
    return np.repeat(np.arange(len(counts)) % 2 == 1, counts).reshape(height, width, order="F")


def stability(score: Column, threshold: float, offset: float) -> Column:
    """An aggregate: pixels above threshold + offset over those above threshold - offset."""
    return F.count_if(score > threshold + offset) / F.nullif(F.count_if(score > threshold - offset), F.lit(0))


def label(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-connected components: labels from 1 (0 outside), and areas by label."""
    height, width = mask.shape
    out = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        wide = np.pad(out, 1)
        best = out.copy()
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                np.maximum(best, wide[dy : dy + height, dx : dx + width], out=best)
        best[~mask] = 0
        if (best == out).all():
            break
        out = best
    _, labels = np.unique(out, return_inverse=True)
    labels = labels.reshape(mask.shape) + (0 if (out == 0).any() else 1)
    return labels, np.bincount(labels.ravel())


def remove_small(mask: np.ndarray, least: int, holes: bool) -> tuple[np.ndarray, bool]:
    """A mask with its holes under an area filled, or its islands under it dropped; and whether it had such.

    Where all islands are that small, the largest stays, the first of equal ones.
    """
    part, area = label(mask != holes)
    stays = area >= least
    stays[0] = False
    any_small = stays.sum() < len(area) - 1
    if not holes and len(area) > 1 and not stays.any():
        stays[1 + area[1:].argmax()] = True
    return (stays[part] if not holes else ~stays[part]), bool(any_small)


def box_xywh(box: Column) -> Column:
    return F.array(box[0], box[1], box[2] - box[0], box[3] - box[1])


def near_crop_edge(box: Column, crop: Column, image: Column, tolerance: float = 20.0) -> Column:
    """Whether a box, within a crop, ends at the crop's edge and not at the image's."""
    out = F.lit(False)
    for k in range(4):
        own = box[k] + crop[k % 2]
        out |= (F.abs(own - crop[k]) <= tolerance) & (F.abs(own - image[k]) > tolerance)
    return out


def point_grid(per_side: int) -> np.ndarray:
    side = (np.arange(per_side) + 0.5) / per_side
    return np.stack(np.meshgrid(side, side), -1).reshape(-1, 2)
