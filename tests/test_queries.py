"""Every registered query against its SQL on the generic tables."""

import checks
import pytest

from wardwise import catalog

catalog.load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return checks.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(name, spark, sf_dir, con):
    problem = checks.compare(catalog.QUERIES[name](spark, sf_dir), con, catalog.SQL[name])
    assert problem in (None, "both empty"), problem


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_gives_rows(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
