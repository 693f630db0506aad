"""Schemas of the catalog tables. Nothing is inferred."""

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES: dict[str, DataType] = {"string": StringType(), "int": IntegerType(), "long": LongType(), "binary": BinaryType(), "boolean": BooleanType(), "timestamp": TimestampType()}


def struct(ddl: str) -> StructType:
    """A schema from `name type, ...`; unlike StructType.fromDDL it needs no session, so data sources can use it."""
    fields = [f.split() for f in ddl.split(", ")]
    return StructType([StructField(n, ArrayType(_TYPES[t[6:-1]]) if t.startswith("array<") else _TYPES[t]) for n, t in fields])


SCAN = struct("path string, canonical string, kind string, len long, modified timestamp, accessed timestamp, created timestamp, symlink_target string, content binary, cid string")
BLOCKS = struct("store string, delta int, cid binary, codec int, content binary, length long, offset long")
INDEX = struct("archive string, cid binary, offset long, length long")
NODES = struct("drive string, revision long, path string, kind string, cids array<binary>, symlink_target string, mime_type string, size long, created timestamp, modified timestamp")
METADATA_VERSIONS = struct("id string, drive string, root_cid string, metadata_cid string, previous_cid string, data_size long, state string, snapshot_id string, created_at timestamp, updated_at timestamp")
SNAPSHOTS = struct("id string, drive string, metadata_id string, size long, created_at timestamp")
DRIVES_LOCAL = struct("local_id string, name string, origin string, remote_id string, metadata_cid string, root_cid string, previous_cid string")
DRIVES_REMOTE = struct("id string, name string, type string, storage_class string")
DRIVE_KEYS = struct("id string, drive string, pem string, fingerprint string, approved boolean")
SHARES = struct("drive string, ref_kind string, fingerprint string, der string, enc_ref string")
LOCATIONS = struct("host string, cid string")

# The domains of the enumerations.
DRIVE_TYPES = ["backup", "interactive"]
STORAGE_CLASSES = ["hot", "warm", "cold"]
METADATA_STATES = ["uploading", "upload_failed", "pending", "current", "outdated", "deleted"]
SYNC_STATES = ["unknown", "unpublished", "unlocalized", "all_synced", "metadata_synced", "behind", "ahead"]
