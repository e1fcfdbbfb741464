import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import letters  # noqa: E402
from concordat.session import build_session  # noqa: E402
from pyspark import cloudpickle  # noqa: E402

# Python workers do not see this folder; send the responders along.
cloudpickle.register_pickle_by_value(letters)


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
