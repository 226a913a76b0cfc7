"""The entry point without the training-data operators or the packages they need."""
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r}:
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as E
print(len(E.queries()), len(E.oracle_sql()), any(q.startswith("op") for q in E.queries()))
"""


def names(missing):
    return subprocess.run([sys.executable, "-c", CODE.format(missing=missing)], cwd=ROOT, capture_output=True, text=True)


def test_library_loads_without_them():
    found = {m: names(m) for m in ("gearlens.llm", "corpus_pipeline", "xxhash", "zstandard", "sentencepiece")}
    counts = {r.stdout for m, r in found.items() if (ROOT / "gearlens" / "llm").exists() or m == "gearlens.llm"}
    assert len(counts) == 1 and "op" not in counts and next(iter(counts)).split()[2] == "False", {m: r.stderr[-300:] for m, r in found.items()}
    assert names("gearlens.plans.score").returncode != 0
