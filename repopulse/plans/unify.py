"""Reconcile two collections and summarise the union."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repopulse.operators.metrics import with_summary_columns
from repopulse.operators.reconcile import divergence_counts, match_counts, reconcile, reconcile_summary, without_raw
from repopulse.plans.collect import Collection, summarise_records
from repopulse.sinks.tables import write_tables


@dataclass(frozen=True)
class Unified:
    """The reconciled table with its counts and summaries."""

    records: DataFrame
    match_counts: DataFrame
    divergences: DataFrame
    summary: DataFrame
    collection: Collection


def unify(
    a: DataFrame, b: DataFrame, counts_from: str = "a", output: str | None = None, criteria: tuple[str, str] = ("collection a", "collection b")
) -> Unified:
    """Reconcile ``a`` (profiled records) with ``b`` (independent counts).

    The grouped and correlated summaries follow ``counts_from``: ``a`` keeps
    those of collection A, ``reconciled`` computes them on the merged table.

    With ``output`` the merged table is written once, and its counts and summaries are
    computed from it and written beside it, with the criteria of both searches.
    """
    if counts_from not in ("a", "reconciled"):
        raise ValueError("counts_from has to be 'a' or 'reconciled'")
    merged = reconcile(a, b)
    if output is not None:
        write_tables({"reconciled": merged}, output)
        merged = a.sparkSession.read.parquet(f"{output.rstrip('/')}/reconciled")
        if counts_from == "a":
            # Its summaries read a stored table too, never the nodes again.
            write_tables({"collection_a": without_raw(with_summary_columns(a))}, output)
            a = a.sparkSession.read.parquet(f"{output.rstrip('/')}/collection_a")
    unified = Unified(
        merged,
        match_counts(merged),
        divergence_counts(merged),
        reconcile_summary(merged),
        summarise_records(a if counts_from == "a" else merged),
    )
    if output is not None:
        about = unified.match_counts.withColumns({"criterion_a": F.lit(criteria[0]), "criterion_b": F.lit(criteria[1]), "counts_from": F.lit(counts_from)})
        tables = {"match_counts": unified.match_counts, "divergences": unified.divergences, "reconcile_summary": unified.summary, "run_metadata": about}
        write_tables(tables | unified.collection.tables(), output)
    return unified
