import pytest

from partloom.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session(
        "tests",
        **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.default.parallelism": "4", "spark.sql.warehouse.dir": "/tmp/partloom-test-warehouse"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *columns):
    """The rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
