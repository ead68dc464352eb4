import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(os.path.dirname(HERE))
sys.path[:0] = [ROOT, HERE, os.path.dirname(HERE)]


@pytest.fixture(autouse=True)
def importable(spark):
    """Python tasks import the package from the repository."""
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
