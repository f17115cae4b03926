"""Whole jobs: collect and profile, reconcile, consolidate and check."""

from repopulse.plans.collect import Collection, collect, run_metadata
from repopulse.plans.consolidate import consolidate, document_report, validation_report
from repopulse.plans.unify import Unified, unify

__all__ = ["Collection", "Unified", "collect", "consolidate", "document_report", "run_metadata", "unify", "validation_report"]
