from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kapspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture()
def csv_ledger(spark, tmp_path_factory):
    """Write ledger export text (latin1, ``;``) to a fresh folder and scan it."""
    from kapspark.sources.ledger import read_ledger_csv

    def make(text: str, account="A", **kw):
        d = Path(tempfile.mkdtemp(prefix="ledger-", dir=tmp_path_factory.getbasetemp()))
        p = d / "transactions.csv"
        p.write_bytes(text.encode("latin1"))
        return read_ledger_csv(spark, str(p), account_literal=account, **kw)

    return make
