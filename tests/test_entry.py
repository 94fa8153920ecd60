import subprocess
import sys

import __spark_entry__ as E


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["source", "target", "weight"] and df.count() > 0


def test_sql_is_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_works_without_the_llm_folders():
    code = "import sys; sys.modules['lodestone.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'graph_edges' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=E.__file__.rpartition("/")[0])
