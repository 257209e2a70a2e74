"""The driver's contract."""

import subprocess
import sys

import __spark_entry__ as entry


def test_names_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 100 and set(sql) <= set(queries)


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_stands_without_the_corpus_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("quarry.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 100 and not [q for q in e.queries() if q.startswith("op")]
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rpartition("/")[0]).returncode == 0
