import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["newest_version", "merge_et_al", "triplet_cleanup", "cluster_by_subject", "fair_group_sizes", "diameter_all"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    df = __spark_entry__.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, rel.fetchall()))


def test_entry_works_without_the_corpus_modules(tmp_path):
    for x in ROOT.iterdir():
        if x.name in ("__spark_entry__.py", "tricorpus"):
            subprocess.run(["cp", "-r", str(x), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tricorpus/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'domain_filter' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
