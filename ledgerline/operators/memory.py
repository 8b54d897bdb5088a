"""Memory of confirmed presets and mappings: a table with the same column names needs no detection the second time.

Records are kept under a folder that any Hadoop file system holds, by the fingerprint of the columns' names (whatever
their order, case and outer blanks). Each is a new version, a file of its own that takes its name once it is whole, so
readers and other writers never see half of one; the latest holds, and older ones are deleted. It has names, never values.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..functions.display import fingerprint
from ..sources.staging import Files

#: Of the form of a record; records of another are as good as none.
VERSION = 1


@dataclass(frozen=True)
class Remembered:
    preset: str
    mapping: dict[str, str] = field(default_factory=dict)


def _place(folder: str, columns: Sequence[str]) -> str:
    return f"{folder}/{fingerprint(list(columns))}"


def _versions(files: Files, place: str) -> list[str]:
    """The names of the versions, the latest last."""
    return sorted(name for name, *_ in files.list(place) if name.endswith(".json"))


def _add(files: Files, place: str, text: str) -> None:
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.json"
    files.write(f"{place}/{name}", text)
    for old in _versions(files, place):
        if old < name:
            files.delete(f"{place}/{old}")


def remember(spark: SparkSession, folder: str, columns: Sequence[str], preset: str, mapping: Mapping[str, str]) -> None:
    record = {"version": VERSION, "preset": preset, "mapping": dict(mapping), "columns": list(columns)}
    _add(Files(spark, folder), _place(folder, columns), json.dumps(record, sort_keys=True))


def recall(spark: SparkSession, folder: str, columns: Sequence[str]) -> Remembered | None:
    """What was confirmed for these columns, with the fields whose column is still there; None if there are none, and for
    a record that cannot be read."""
    files, place = Files(spark, folder), _place(folder, columns)
    if not (held := _versions(files, place)):
        return None
    try:
        record = json.loads(files.read(spark, f"{place}/{held[-1]}"))
    except ValueError:
        return None
    if not isinstance(record, dict) or record.get("version") != VERSION:
        return None
    mapping = {f: c for f, c in record.get("mapping", {}).items() if c in set(columns)}
    return Remembered(record["preset"], mapping) if mapping else None


def forget(spark: SparkSession, folder: str, columns: Sequence[str]) -> None:
    files, place = Files(spark, folder), _place(folder, columns)
    if files.exists(place):
        files.delete(place)
