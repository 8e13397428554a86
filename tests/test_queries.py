"""Every query of the catalogue against its SQL, or for its rows where there is none."""

from __future__ import annotations

import pytest

from tagmill.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, same):
    frame = QUERIES[name](spark, data)
    if name in ORACLES:
        same(frame, ORACLES[name])
    else:
        assert frame.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
