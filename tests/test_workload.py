"""The registered queries: well formed, and equal to DuckDB on the smallest tables."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, duck  # noqa: E402
from workload.queries import ORACLE, QUERIES  # noqa: E402

#: A query from every family; ``tools/check_oracle.py`` runs them all.
SAMPLE = (
    "attribution_record_ties", "attribution_per_record", "attribution_first_version", "report_day_channel_interval",
    "report_step", "kpi", "qc_report", "composition_all", "route_exclusive_steps", "route_z_test", "topk_across_waves",
    "attribution_in_batches", "composition_index_measures", "csv_round_trip", "event_export", "export_twice", "match_rate_with_sample",
    "nearest_profile", "reach_of_interval", "report_step_variation_interval", "sliced_by_dimension", "sales_conversions", "treatas_step", "calendar", "z_test",
)
ROWS_ONLY = {"approx_reach", "preview_rows"}


def test_every_query_has_an_equivalent_or_a_reason():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_read_whole_tables():
    for name, sql in ORACLE.items():
        assert not re.search(r"\bLIMIT\b|TABLESAMPLE|USING SAMPLE", sql, re.IGNORECASE), name


def test_other_queries_stand_without_the_text_operators():
    code = "import sys; sys.modules['touchpath.llm'] = None; import __spark_entry__ as e; from workload.queries import QUERIES; assert set(e.queries()) == set(QUERIES)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(entry.__file__).parent)


def test_entry_runs(spark, sf_dir):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_duckdb(spark, sf_dir, name):
    problem = compare(spark, duck(sf_dir), sf_dir, name)
    if problem == "no rows":  # the smallest tables hold no case of it
        larger = sf_dir.replace("sf0.001", "sf0.01")
        problem = compare(spark, duck(larger), larger, name)
    assert problem is None
