"""The entry module without the training-data operators or what they need, and the shared folder."""

import subprocess
import sys
from types import SimpleNamespace

import pytest

from spokeflow.plans import lineage

HIDE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {hidden!r} or name in {hidden!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
print(len(e.queries()), sorted(q for q in e.queries() if q == "pipeline" or q.startswith("op")))
"""


@pytest.mark.parametrize("hidden", [["xxhash"], ["regex"], ["public_tokenizers"], ["spokeflow.llm"], ["corpus_pipeline", "spokeflow.llm"]])
def test_engine_without_training_data_operators(hidden):
    out = subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden)], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.endswith("[]\n") and int(out.stdout.split()[0]) > 90


def test_a_missing_part_of_the_engine_is_an_error():
    out = subprocess.run([sys.executable, "-c", HIDE.format(hidden=["spokeflow.operators"])], capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "spokeflow.operators" in out.stderr


def test_no_machine_local_folder_on_a_cluster():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(session)
