import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caseweave.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores="4", partitions=4)


@pytest.fixture(scope="session")
def make_log(spark):
    """Log from {case: activities}; every event one second apart, attributes optional."""

    def make(traces, attrs=None, closed=True, gap=1):
        rows, n = [], 0
        for case, acts in traces.items():
            for i, activity in enumerate(acts):
                bag = attrs(case, i, activity) if attrs else {}
                rows.append((case, activity, 1_700_000_000 + n * gap, n, bag, closed and i == len(acts) - 1))
                n += 1
        df = spark.createDataFrame(
            rows, "case_id string, activity string, t long, seq long, attrs map<string,string>, is_end boolean"
        )
        return df.selectExpr("case_id", "activity", "timestamp_seconds(t) AS ts", "seq", "attrs", "is_end")

    return make
