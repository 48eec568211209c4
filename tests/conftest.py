import pytest

from tidemark.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", "local[4]", spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")), spark_sql_shuffle_partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
