"""Every registered query of the library against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
import checks
from tests.compare import check, oracle

SF = "/root/testdata/sf0.001"
entry._load()
NAMES = sorted(checks.QUERIES)
# fixed values: queries that SQL cannot say; tests hold them against plain loops
WITHOUT_TWIN = {"moment_reasons", "live_track_links"}


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    status = check(spark, con, SF, name)[3]
    assert status == ("rows-only" if name in WITHOUT_TWIN else "ok"), status
