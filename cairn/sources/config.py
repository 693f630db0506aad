"""The configuration of local drives as pretty JSON, written under another name and renamed."""

from __future__ import annotations

import json
import posixpath
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from cairn.schemas import DRIVES_LOCAL
from cairn.sources.car import filesystem

# Where the remote lives unless the configuration says otherwise.
DEFAULTS = {"endpoint": None, "drives": []}


def load(path: str) -> dict:
    """The configuration; a missing file is the default one."""
    store, at = filesystem(path)
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return json.loads(json.dumps(DEFAULTS))
    with store.open_input_stream(at) as f:
        return DEFAULTS | json.loads(f.read())


def save(path: str, config: dict) -> None:
    store, at = filesystem(path)
    store.create_dir(posixpath.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(json.dumps(config, indent=2, sort_keys=True).encode())
    store.move(part, at)


def drives(spark: SparkSession, config: dict) -> DataFrame:
    """Local drives as rows."""
    return spark.createDataFrame([tuple(d.get(n) for n in DRIVES_LOCAL.names) for d in config["drives"]], DRIVES_LOCAL)


def put_drive(config: dict, drive: dict) -> dict:
    """The configuration with a drive; another one of the same origin goes."""
    rest = [d for d in config["drives"] if d.get("origin") != drive.get("origin")]
    return config | {"drives": [*rest, drive]}


def drop_drive(config: dict, origin: str | None = None) -> dict:
    """The configuration without the drive of an origin, or without any."""
    return config | {"drives": [d for d in config["drives"] if origin is not None and d.get("origin") != origin]}
