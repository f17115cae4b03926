from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from repopulse.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "repopulse-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def node_frame(spark):
    """Nodes from JSON texts: ``pos, raw``."""
    from repopulse.sources.pages import nodes_of

    def build(*texts: str):
        rows = list(enumerate(texts))
        return nodes_of(spark.createDataFrame(rows, "pos long, node string"), "node", "pos")

    return build


def rows_of(df, *order):
    """Rows as dicts, sorted by the given columns."""
    found = [row.asDict() for row in df.collect()]
    return sorted(found, key=lambda r: tuple(str(r[c]) for c in order)) if order else found
