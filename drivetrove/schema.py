"""Table schemas of a storage catalogue.

Times are unix seconds in UTC and NULL means unknown. The last block of ``entries`` is materialised
at ingest by :mod:`drivetrove.operators.tree`, so that no query has to walk parents again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_DDL = {
    "disks": """id bigint, name string, kind string, volume_uuid string, capacity bigint, total_size bigint,
        file_count bigint, folder_count bigint, is_online boolean, mount_path string, location string,
        category string, comment string, scanned_at bigint, cloud_provider string, cloud_root string""",
    "entries": """id bigint, disk_id bigint, parent_id bigint, name string, is_folder boolean,
        size_logical bigint, size_physical bigint, created_at bigint, modified_at bigint, ext string,
        comment string, content_hash string, hash_algo string, hashed_at bigint, cloud_state int,
        gps_lat double, gps_lon double, gps_place string, captured_at bigint, camera_make string,
        camera_model string, light_phase string,
        path string, rel_path string, depth int, ancestor_ids array<bigint>""",
    "entry_tags": "entry_id bigint, tag string",
    "thumbnails": "entry_id bigint, png binary, w int, h int, created_at bigint",
    "video_meta": """entry_id bigint, duration_ms bigint, width bigint, height bigint, fps double,
        vcodec string, acodec string, bitrate bigint, probed_at bigint""",
    "video_frames": "entry_id bigint, pos_ms bigint, png binary",
    "embeddings": "entry_id bigint, model string, frame_ts double, vec array<float>",
    "transcripts": "entry_id bigint, model string, lang string, text string, created_at bigint",
    "archive_entries": """entry_id bigint, path string, name string, is_dir boolean, size bigint,
        modified bigint""",
    "access_log": """ts bigint, device_id string, action string, disk_id bigint, entry_id bigint,
        bytes bigint, result string""",
    "devices": """id string, name string, scopes string, created_at bigint, last_seen bigint,
        revoked boolean""",
    "volumes": """name string, mount_path string, fingerprint string, total_space bigint,
        available_space bigint, kind string, is_removable boolean""",
    "name_postings": "token string, entry_id bigint, disk_id bigint, tf int, doc_len int",
    "text_postings": "token string, entry_id bigint, disk_id bigint, tf int, doc_len int",
    "name_terms": "token string, disk_id bigint, tf int, doc_len int, n bigint",
    "name_stats": "disk_id bigint, n_docs bigint, n_words bigint",
    "text_stats": "disk_id bigint, n_docs bigint, n_words bigint",
}

_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "binary": T.BinaryType(), "array<bigint>": T.ArrayType(T.LongType()),
    "array<float>": T.ArrayType(T.FloatType()),
}


def _struct(columns: str) -> T.StructType:
    """Schema from ``name type, ...``, without needing a session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TABLES: dict[str, T.StructType] = {name: _struct(columns) for name, columns in _DDL.items()}

#: Tables keyed by ``entry_id`` whose rows disappear together with their entry.
DERIVED = (
    "entry_tags", "thumbnails", "video_meta", "video_frames", "embeddings", "transcripts",
    "archive_entries", "name_postings", "text_postings",
)

#: Enrichment columns carried over by a rescan when the file did not change.
ENRICHMENT = (
    "content_hash", "hash_algo", "hashed_at", "gps_lat", "gps_lon", "gps_place", "captured_at",
    "camera_make", "camera_model", "light_phase",
)

#: Columns of ``entries`` derived from the tree itself.
TREE_COLUMNS = ("path", "rel_path", "depth", "ancestor_ids")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto the current schema of ``table``; columns it lacks become typed NULLs."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in TABLES[table]
    ])
