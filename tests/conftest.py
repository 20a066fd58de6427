import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pitlens.session import local_session
    return local_session(8, "pitlens-tests")


@pytest.fixture(scope="session")
def tables(spark):
    from pitlens.sources.bindings import Tables
    return Tables(spark, SF)


@pytest.fixture(scope="session")
def con():
    from compare import connect
    return connect(SF)
