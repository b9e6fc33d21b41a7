import pytest

from gneiss.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    yield local_session("4", 4, {"spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
