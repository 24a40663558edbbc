from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from seriata.session import get_session  # noqa: E402

PANEL = "serie_id string, fecha date, valor double"


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", cpus="8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def panel(spark):
    """Rows ``(series, 'YYYY-MM[-DD]', value)`` as a long panel."""

    def build(rows, schema=PANEL):
        def day(text):
            if text is None:
                return None
            return date.fromisoformat(text if len(text) == 10 else f"{text}-01")

        return spark.createDataFrame([(s, day(d), *rest) for s, d, *rest in rows], schema)

    return build


def months(first: str, n: int) -> list[str]:
    year, month = map(int, first.split("-"))
    out = []
    for _ in range(n):
        out.append(f"{year:04d}-{month:02d}")
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
    return out


def rows(df, *columns):
    """Rows as sorted tuples, with dates as ISO text."""
    picked = df.select(*columns) if columns else df
    plain = [
        tuple(v.isoformat() if isinstance(v, date) else v for v in r) for r in picked.collect()
    ]
    return sorted(plain, key=repr)
