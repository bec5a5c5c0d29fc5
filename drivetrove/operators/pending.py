"""Which entries still need derived data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from drivetrove.catalog import Catalog
from drivetrove.functions import media, words

FRAMES_PER_CLIP = 8
STRIP_FRAMES = 5


def _files(cat: Catalog, exts: list[str], disk_id: int | None) -> DataFrame:
    rows = cat.entries.filter((~F.col("is_folder")) & F.lower("ext").isin([e.lower() for e in exts]))
    return rows if disk_id is None else rows.filter(F.col("disk_id") == disk_id)


def _without(rows: DataFrame, done: DataFrame) -> DataFrame:
    return rows.join(done.select(F.col("entry_id").alias("id")), "id", "left_anti")


def pending(cat: Catalog, kind: str, disk_id: int | None = None, exts: list[str] | None = None,
            model: str | None = None, rebuild: bool = False) -> DataFrame:
    """Entries lacking the derived data of one kind.

    ``thumbnails``, ``video_meta``, ``archives``, ``transcripts``: files of the extension class without a
    row. ``embeddings``: entries with a thumbnail and no vector of ``model`` (all of them on ``rebuild``).
    ``video_embeddings``: clips without a vector that has a frame time.
    """
    classes = words.MEDIA_CLASSES
    of_model = cat.embeddings.filter(F.col("model") == model) if model else cat.embeddings
    if kind == "thumbnails":
        return _without(_files(cat, exts or classes["image"], disk_id), cat.thumbnails)
    if kind == "video_meta":
        return _without(_files(cat, exts or classes["video"], disk_id), cat.video_meta)
    if kind == "archives":
        return _without(_files(cat, exts or classes["archive"], disk_id), cat.archive_entries)
    if kind == "transcripts":
        return _without(_files(cat, exts or classes["video"] + classes["audio"], disk_id), cat.transcripts)
    if kind == "embeddings":
        rows = cat.entries if disk_id is None else cat.entries.filter(F.col("disk_id") == disk_id)
        shown = rows.join(cat.thumbnails.select(F.col("entry_id").alias("id")), "id", "left_semi")
        return shown if rebuild else _without(shown, of_model)
    if kind == "video_embeddings":
        clips = _files(cat, exts or classes["video"], disk_id)
        return clips if rebuild else _without(clips, of_model.filter("frame_ts IS NOT NULL"))
    raise ValueError(f"unknown kind {kind!r}")


def frame_sampling_plan(cat: Catalog, model: str | None = None, frames: int = FRAMES_PER_CLIP) -> DataFrame:
    """Times at which to sample every pending clip with a known duration."""
    n = min(max(frames, 1), 32)
    clips = pending(cat, "video_embeddings", model=model).select("id")
    durations = cat.video_meta.select(F.col("entry_id").alias("id"), "duration_ms")
    return clips.join(durations, "id").select("id", F.posexplode(media.strip_times(F.col("duration_ms"), n))
                                              .alias("frame", "frame_ts"))
