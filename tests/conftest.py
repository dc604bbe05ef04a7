import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from churnlens.session import get_session

    s = get_session("churnlens-tests", master="local[4]",
                    conf={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
