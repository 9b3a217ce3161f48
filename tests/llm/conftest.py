import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from samples import DOCS, odd_rows  # noqa: E402


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def clash(odd):
    """Columns whose names clash with those that operators make."""
    from pyspark.sql import functions as F

    names = "score kept component_id held_out tokens topic n_tokens probability sampled lines_removed form count key a b salt value text_ hit shard y row unit".split()
    return odd.select("*", *[F.lit(1).alias(n) for n in names])
