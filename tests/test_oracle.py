"""Every registered query against its reference SQL on the smallest driver tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_mod
from check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
#: Queries that SQL does not express here; tests/test_planted.py holds them to brute force or planted shapes.
WITHOUT_SQL = {"g3_split_by_shape", "g4_split_by_intensity", "g5_count_maxima",
               "j8_mask_contours", "p12_colour_adjustments"}
ROOT = os.path.dirname(os.path.abspath(entry_mod.__file__))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry_mod.plans.registry.QUERIES))
def test_query(spark, con, name):
    message, _, _ = compare(spark, con, name, SF)
    assert message.startswith("rows-only" if name in WITHOUT_SQL else "ok"), message


def test_entry(spark):
    assert entry_mod.entry(spark).count() > 0


def test_workers_import_the_package_from_any_folder(tmp_path):
    """A query with a Python kernel, started elsewhere and without PYTHONPATH."""
    code = (f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; from planeweave.session import local_session; "
            f"print('rows', e.queries()['t2_isodata'](local_session(2, 2), {SF!r}).count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
