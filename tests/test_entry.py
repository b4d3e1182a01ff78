import subprocess
import sys

from tests.conftest import ROOT


def test_queries_can_be_read_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q), set(o) - set(q); print(len(q), len(o))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-500:]
    total, with_sql = map(int, done.stdout.split())
    assert total > 190 and with_sql > 160
