import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from llm_fixtures import documents, edge_rows  # noqa: E402


@pytest.fixture
def docs(spark):
    return documents(spark, edge_rows(), clash=True)


@pytest.fixture
def no_docs(spark):
    return documents(spark, [])
