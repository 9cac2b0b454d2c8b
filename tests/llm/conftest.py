from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def hostile_docs(spark):
    import hostile

    return hostile.documents(spark)


@pytest.fixture(scope="session")
def no_docs(spark):
    import hostile

    return hostile.empty(spark)
