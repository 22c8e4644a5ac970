import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from docloom.session import local_session

    warehouse = tempfile.mkdtemp(prefix="docloom-warehouse-")
    session = local_session("tests", cpus=min(8, os.cpu_count() or 2),
                            **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": warehouse})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA)
