import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from docketlake.session import local_session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, "4g")
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s


@pytest.fixture
def rows():
    """Collected rows as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
