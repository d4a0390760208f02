import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from cohortlens.session import build_session  # noqa: E402
from cohortlens.sources.tables import EVENTS_SCHEMA, GEOGRAPHY_SCHEMA, USER_INFO_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("COHORTLENS_LOCAL_CHECKPOINT_DIR", tempfile.mkdtemp(prefix="cohortlens-test-ckpt-"))
    s = build_session("local[4]", shuffle_partitions=4, app="cohortlens-tests")
    yield s
    s.stop()


D = dt.date
T = dt.datetime


def accounts(spark, rows):
    """rows: dicts with any subset of user_info columns; id auto-filled."""
    out = []
    for i, r in enumerate(rows):
        full = {f.name: None for f in USER_INFO_SCHEMA.fields}
        full["id"] = i + 1
        full["mp_country_code"] = "1"
        full.update(r)
        out.append(tuple(full[f.name] for f in USER_INFO_SCHEMA.fields))
    return spark.createDataFrame(out, USER_INFO_SCHEMA)


def events(spark, rows):
    out = []
    for i, r in enumerate(rows):
        full = {f.name: None for f in EVENTS_SCHEMA.fields}
        full["id"] = i + 1
        full["volume"] = 1.0
        full.update(r)
        if full.get("date") is None and full.get("datetime") is not None:
            full["date"] = full["datetime"].date()
        if full.get("fee") is not None and not isinstance(full["fee"], Decimal):
            full["fee"] = Decimal(str(full["fee"]))
        out.append(tuple(full[f.name] for f in EVENTS_SCHEMA.fields))
    return spark.createDataFrame(out, EVENTS_SCHEMA)


def geography(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], GEOGRAPHY_SCHEMA)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]
