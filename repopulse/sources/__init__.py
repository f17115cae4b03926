"""Readers: landed result pages, result documents, CSV tables, the ranking."""

from repopulse.sources.documents import (
    consolidated_from_document,
    document_metadata,
    document_records,
    read_document,
    records_from_document,
)
from repopulse.sources.pages import explode_nodes, nodes_of, read_pages, take_nodes, total_available
from repopulse.sources.ranking import ranking_from_document, ranking_label, read_ranking_document
from repopulse.sources.tables import (
    quality_columns,
    read_age_table,
    read_consolidated,
    read_merged_prs_table,
    read_releases_table,
    sentinel_number,
)

__all__ = [
    "consolidated_from_document",
    "document_metadata",
    "document_records",
    "explode_nodes",
    "nodes_of",
    "quality_columns",
    "ranking_from_document",
    "ranking_label",
    "read_age_table",
    "read_consolidated",
    "read_document",
    "read_merged_prs_table",
    "read_pages",
    "read_ranking_document",
    "read_releases_table",
    "records_from_document",
    "sentinel_number",
    "take_nodes",
    "total_available",
]
