from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))

from check_oracle import compare, duck  # noqa: E402
from touchpath.llm.queries import ORACLE, QUERIES  # noqa: E402


def test_one_query_per_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_duckdb(spark, sf_dir, name):
    assert compare(spark, duck(sf_dir), sf_dir, name) is None
