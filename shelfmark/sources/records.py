"""JSON form of file and state rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import schemas

_JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "ignoreNullFields": "false"}

# Values a state row falls back to when its JSON lacks a key.
STATE_DEFAULTS = {
    "phase": "init",
    "current_wave": 1,
    "files_processed": 0,
    "files_total": 0,
    "structure_approved": False,
    "backup_confirmed": False,
}

STATE_JSON = (
    "phase string, current_wave int, files_processed int, files_total int, "
    "last_file_processed string, structure_approved boolean, backup_confirmed boolean"
)


def to_record(df: DataFrame) -> Column:
    iso = {f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    cols = [
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if c in iso else F.col(c) for c in df.columns
    ]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def parse_files(records: Column) -> Column:
    return F.from_json(records, schemas.FILE_STATE, _JSON)


def parse_state(records: Column) -> Column:
    """State struct; missing keys take their defaults, corrupt text gives a fresh state."""
    parsed = F.from_json(records, STATE_JSON)
    fields = []
    for name in [f.strip().split(" ")[0] for f in STATE_JSON.split(",")]:
        value = parsed[name]
        if name in STATE_DEFAULTS:
            value = F.coalesce(value, F.lit(STATE_DEFAULTS[name]))
        fields.append(value.alias(name))
    return F.struct(*fields)
