"""Schemas of the catalogue's tables. Times are epoch seconds; 64-bit codes are signed; digests are lower-case hex or binary."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"string": StringType(), "long": LongType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType(), "binary": BinaryType()}

_DDL = {
    "settings": "key string, value string",
    "disks": "id long, uuid string, label string, path string, status string, capacity_bytes long, free_bytes long, error_count int, last_seen double, smart_json string",
    "objects": "id long, key string, size long, state string, created_at double",
    "stripes": "id string, object_id long, seq int, k int, m int, shard_size long, data_offset long, data_len long, state string, last_scrubbed_at double",
    "shards": "stripe_id string, idx int, disk_id long, state string, checksum binary",
    "scrub_runs": "id long, started_at double, finished_at double, stripes int, repaired int, unrecoverable int",
    "rebuild_tasks": "id long, disk_id long, state string, total_stripes int, done_stripes int, bytes_written long, started_at double, finished_at double",
    "files": "id long, sha256 string, size long, filename string, kind string, tier string, mime string, capture_ts double, upload_ts double, camera_make string, camera_model string, lat double, lon double, geohash string, width int, height int, duration double, exif_json string, favorite boolean, trashed_at double, purged_at double, phash long, dhash long, sharpness double, dup_group long, dup_reviewed boolean",
    "batches": "id long, state string, raw_bytes long, live_bytes long, compressed_bytes long, created_at double, first_data_at double",
    "batch_frames": "batch_id long, idx int, raw_start long, raw_len long, comp_start long, comp_len long",
    "chunks": "hash binary, batch_id long, raw_offset long, size long, refcount long",
    "file_chunks": "file_id long, seq int, hash binary",
    "devices": "id long, name string, created_at double, last_seen double",
    "device_items": "device_id long, sha256 string",
    "uploads": "id string, size long, offset long, sha256 string, metadata string, created_at double, expires_at double, completed_at double",
    "ingest_jobs": "id long, sha256 string, state string, attempts int, error string, metadata string, created_at double, updated_at double",
    "albums": "id long, name string, cover_file_id long, created_at double",
    "album_items": "album_id long, file_id long, added_at double",
    "thumbnails": "file_id long, variant string, path string, bytes long, created_at double",
    "refresh_tokens": "id string, family string, created_at double, expires_at double, revoked_at double, replaced_by string",
}

TABLES: dict[str, StructType] = {name: StructType([StructField(c, _TYPES[t]) for c, t in (x.split(" ") for x in ddl.split(", "))]) for name, ddl in _DDL.items()}

#: Defaults of the store, the deduplicator and the services.
DEFAULTS = {
    "k": 4, "m": 2, "max_shard_bytes": 4 << 20, "write_extra": 1, "scrub_days": 30, "error_threshold": 10,
    "batch_bytes": 1 << 30, "batch_age_s": 6 * 3600, "frame_bytes": 4 << 20, "compact_below": 0.5,
    "cdc_min": 16 << 10, "cdc_bits": 16, "cdc_max": 256 << 10, "bloom_items": 10_000_000, "bloom_fpr": 0.01,
    "dup_radius": 10, "trash_days": 30, "upload_days": 7,
}
