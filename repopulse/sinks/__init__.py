"""Writers: result tables, weekly snapshots, CSV tables."""

from repopulse.sinks.tables import (
    consolidated,
    with_document_keys,
    write_consolidated,
    write_csv,
    write_metric_table,
    write_snapshot,
    write_tables,
)

__all__ = [
    "consolidated",
    "with_document_keys",
    "write_consolidated",
    "write_csv",
    "write_metric_table",
    "write_snapshot",
    "write_tables",
]
