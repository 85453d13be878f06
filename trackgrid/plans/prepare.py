"""Preparation of track data: read, join, combine, cut to a period, outline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.boundary import tracks_extent
from ..operators.tracks import clip_tracks_timerange, merge_tracks_ref
from ..sources.readers import read_ref, read_studies


@dataclass(frozen=True)
class PreparedTracks:
    tracks: DataFrame
    extent: DataFrame


def prepare_tracks(
    spark: SparkSession,
    studies: Sequence,
    ref=None,
    period_of: DataFrame | None = None,
    boundary_shape: str = "rectangular",
    buffer: float = 0,
) -> PreparedTracks:
    """Stacked studies with reference data, within the period of another study.

    ``studies`` and ``ref`` are paths or tables.
    """
    tracks = read_studies(spark, studies)
    if ref is not None:
        tracks = merge_tracks_ref(tracks, read_ref(spark, ref)[0])
    if period_of is not None:
        tracks = clip_tracks_timerange(tracks, period_of)
    return PreparedTracks(tracks, tracks_extent(tracks, boundary_shape, buffer))
