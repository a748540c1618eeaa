"""Every query with SQL against DuckDB over the smallest tables; the others give rows with the same content for any number of partitions."""

import decimal
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestream.plans import catalog, documents, jobs, ranking, scalars, tables  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if hasattr(v, "item"):
        v = v.item()
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


def content(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)
    return [columns, *sorted((tuple(plain(x) for x in r) for r in frame[columns].itertuples(index=False)), key=repr)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, duck, name):
    assert content(catalog.QUERIES[name](spark, SF).toPandas()) == content(duck.execute(catalog.ORACLES[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["C3_trend_boost", "C4_topic_clusters", "C5_capped_clusters", "W5_capped_many_caps"])
def test_any_partitioning(spark, name):
    found = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(content(catalog.QUERIES[name](spark, SF).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and len(found[0]) > 1


@pytest.mark.parametrize("known", ["a", None])
def test_content_dedup_of_rows_without_text(spark, tmp_path, known):
    rows = [(1, "b"), (2, None), (3, ""), (5, "b"), (None, "c"), (6, "c"), (7, "a"), (4, "a"), (13, known), (22, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = content(catalog.QUERIES["D3_content_dedup"](spark, str(tmp_path)).toPandas())
    assert found == content(c.execute(catalog.ORACLES["D3_content_dedup"]).df())
    assert len(found) == (3 if known else 1)


def test_entry_imports_without_a_session_or_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "lodestream", tmp_path / "lodestream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0 and not said.stderr and int(said.stdout.split()[0]) == len(catalog.QUERIES)
