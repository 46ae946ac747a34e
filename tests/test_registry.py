import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from relforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def comparable(pdf):
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 9) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(repr([plain(v) for v in row]) for row in pdf[sorted(pdf.columns)].astype(object).values.tolist())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", ["column_profile_orders", "fd_matrix_customer", "transitive_deps_flat", "ind_coverage_all", "foreign_keys_detected", "surrogate_key_lineitem", "explode_url_segments", "rejoin_lossless", "sanitize_identifiers", "default_suggestion", "exceptions_of_a_split", "references_of_a_split", "minimal_dependencies_nation", "composite_constraints", "lists_of_values", "sketched_profiles", "exact_medians", "schema_script"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert comparable(registry.QUERIES[name](spark, SF).toPandas()) == comparable(con.execute(registry.ORACLE_SQL[name]).df())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q and not [n for n in q if n.startswith('op')]"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            os.remove(tmp_path / "copy" / name)
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
