from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from cohortspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session(
        "8",
        app="tests",
        **{"spark.checkpoint.dir": str(folder), "spark.sql.shuffle.partitions": "4"},
    )
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """frame(ddl, rows): a DataFrame; ISO dates in DATE columns may be given as text."""

    def make(ddl: str, rows):
        kinds = [part.strip().split()[1] for part in ddl.split(",")]

        def cell(kind, v):
            return dt.date.fromisoformat(v) if kind == "date" and isinstance(v, str) else v

        return spark.createDataFrame(
            [tuple(cell(k, v) for k, v in zip(kinds, r, strict=True)) for r in rows], ddl
        )

    return make


@pytest.fixture
def rows():
    """rows(df, *columns): sorted tuples, dates as text."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        out = [
            tuple(v.isoformat() if isinstance(v, dt.date) else v for v in r) for r in picked.collect()
        ]
        return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))

    return collect
