from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from corpuscope.session import build_session

    session = build_session("local[8]", 8, spark__sql__ansi__enabled="true")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from corpuscope.plans.bindings import Tables

    return Tables(spark, "/root/testdata/sf0.001")
