from __future__ import annotations

import os
import sys

os.environ.setdefault("CORPUSLAB_DRIVER_MEMORY", "4g")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from corpuslab.session import session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("tests", f"local[{os.environ.get('TEST_CPUS', '4')}]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
