"""Readers and writers: tables, predictions, results log, stage state,
training telemetry."""

from riskframe.sources.tables import (
    read_table, read_optional, nan_to_null, with_row_id, driver_table,
)

__all__ = ["read_table", "read_optional", "nan_to_null", "with_row_id",
           "driver_table"]
