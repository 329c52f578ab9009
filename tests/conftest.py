import pytest

from fillsight.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, 4)
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df, places=7):
    """Order-free, rounded rows with columns in name order."""
    cols = sorted(df.columns)

    def norm(v):
        if isinstance(v, float):
            return round(v, places) + 0.0
        if isinstance(v, (list, tuple)):
            return tuple(norm(x) for x in v)
        return v

    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
