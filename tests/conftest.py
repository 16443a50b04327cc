import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from compare import session

    return session()


@pytest.fixture(scope="session")
def con():
    from compare import SMALL, duck

    return duck(SMALL)


@pytest.fixture(scope="session")
def fx(spark):
    from compare import SMALL

    from foreslate.sources.fixtures import fixture

    return fixture(spark, SMALL)
