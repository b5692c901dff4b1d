import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from lodestrata.session import get_session, ship

    s = get_session("tests", 4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    ship(s)
    return s


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples."""

    def get(df, *cols):
        df = df.select(*cols) if cols else df
        return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))

    return get
