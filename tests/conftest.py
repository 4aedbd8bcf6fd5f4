import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from weftgraph.session import local_session

    s = local_session("8", **{"spark.sql.shuffle.partitions": "2", "spark.default.parallelism": "4", "spark.sql.execution.arrow.maxRecordsPerBatch": "50"})
    yield s


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
