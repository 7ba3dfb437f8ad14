import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_library_imports_without_the_corpus_operators():
    hide = "import sys; sys.modules['larder.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", hide], check=True, cwd=ROOT)


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5
