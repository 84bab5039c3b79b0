import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pitspark.session import local_session  # noqa: E402

SF = os.environ.get("PIT_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", shuffle_partitions=4, app="pitspark-tests")
    session.sparkContext.setLogLevel("ERROR")
    # tiny inputs: compiling stages costs more than running them interpreted
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
