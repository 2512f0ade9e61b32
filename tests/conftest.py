import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from leadsmith.session import build_session
    ckpt = tempfile.mkdtemp(prefix="leadsmith-test-ckpt-")
    s = build_session("leadsmith-tests", master="local[4]", shuffle_partitions=4, checkpoint_dir=ckpt)
    yield s
    s.stop()


def terms_df(spark, terms, column="term"):
    return spark.createDataFrame([(t,) for t in terms], f"{column} string")


def rows(df, *cols):
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is None, str(x)) for x in t))
