"""Measures of detected faces from their landmarks, in pixels of a picture of a width and a height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measure import clip

#: The lips' distance in eye distances of a mouth that is open; what a half of the measure is at most.
OPEN_GAP, MOST = 0.15, 1.5


def mouth_open(lip_gap: Column, eye_distance: Column, jaw_open: Column, funnel: Column, pucker: Column, close: Column) -> Column:
    """How far a mouth is open: half by the lips' distance against that of the eyes, half by the model's expressions;
    expressions that are missing count as none."""
    none = lambda c: F.coalesce(c, F.lit(0.0))
    by_lips = F.when(eye_distance > 1e-6, lip_gap / eye_distance / OPEN_GAP).otherwise(0.0)
    by_model = none(jaw_open) + none(funnel) + none(pucker) - none(close)
    return clip(by_lips, 0.0, MOST) * 0.5 + clip(by_model, 0.0, MOST) * 0.5


def frontality(facing: Column) -> Column:
    """0 to 1 by the face's turn towards the camera; a half where the turn is not known."""
    return F.when(facing.isNotNull(), clip(facing, 0.0, 1.0)).otherwise(0.5)


def measured(detections: DataFrame) -> DataFrame:
    """detections(track_id, t, width, height, xs, ys (landmarks), right_eye, left_eye, lip_upper, lip_lower (their places),
    blend (map of expressions), facing, sface) with bbox and face_size in shares of the picture, mouth, frontality and
    sface of length 1. Faces without an extent are left out."""
    x0, x1, y0, y1 = F.array_min("xs"), F.array_max("xs"), F.array_min("ys"), F.array_max("ys")
    at = lambda axis, place: F.element_at(axis, F.col(place) + 1)
    eyes = F.hypot(at("xs", "right_eye") - at("xs", "left_eye"), at("ys", "right_eye") - at("ys", "left_eye"))
    gap = at("ys", "lip_lower") - at("ys", "lip_upper")
    blend = lambda name: F.try_element_at("blend", F.lit(name))
    length = F.sqrt(F.aggregate("sface", F.lit(0.0), lambda a, v: a + v * v)) + 1e-9
    return detections.where((x1 > x0) & (y1 > y0)).select(
        "track_id", "t", F.array(x0 / F.col("width"), y0 / F.col("height"), x1 / F.col("width"), y1 / F.col("height")).alias("bbox"), (F.sqrt((x1 - x0) * (y1 - y0)) / F.sqrt(F.col("width") * F.col("height"))).alias("face_size"),
        frontality(F.col("facing")).alias("frontality"), mouth_open(gap, eyes, blend("jawOpen"), blend("mouthFunnel"), blend("mouthPucker"), blend("mouthClose")).alias("mouth"), F.transform("sface", lambda v: v / length).alias("sface"),
    )
