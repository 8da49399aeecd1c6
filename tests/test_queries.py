"""Every registered query against its SQL on the smallest tables."""

import pytest

from check_oracle import compare, connect
from tarnfield.plans import ORACLES, QUERIES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# These have no rows at the smallest size.
NEED_MORE = {"g17_block_concentration", "a19_connectivity", "w5_nearest_to_bin_centre", "r1_event_feed", "r1_event_feed_stream",
             "t8_events_after_cursor", "a27_missing_durations"}


@pytest.fixture(scope="module")
def connections():
    return {folder: connect(folder) for folder in (SMALL, LARGER)}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connections, name):
    folder = LARGER if name in NEED_MORE else SMALL
    result = compare(spark, connections[folder], folder, name, QUERIES[name], ORACLES[name])
    assert result.startswith("ok"), result
