import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from palimpsest.session import build_session, ship

    s = build_session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    return s


@pytest.fixture
def atom(spark):
    """Builds an atoms frame from (id, payload, embedding, triples, seconds, epoch) tuples."""
    from palimpsest.schema import ATOMS

    def build(*rows):
        t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
        full = []
        for r in rows:
            i, payload, vec, triples, sec, epoch = (*r, *[None] * (6 - len(r)))
            full.append((i, payload, vec, [dict(zip(("subj", "pred", "obj"), t)) for t in triples or []], t0 + dt.timedelta(seconds=sec or 0), 0, epoch or "e1"))
        return spark.createDataFrame(full, ATOMS)

    return build
