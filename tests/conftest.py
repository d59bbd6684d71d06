import pytest

from quillspark.session import build


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build("local[4]", 4, **{"spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    session.sparkContext.setLogLevel("ERROR")
    return session
