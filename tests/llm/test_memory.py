"""What a worker that waits for its next task still holds."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from siteweave.llm import set_join
from siteweave.llm.bpe import ByteBPE
from siteweave.llm.queries import tokenizer_path

WORKER = r"""
import re, sys
import pyarrow as pa
from pyspark import cloudpickle
import siteweave.llm.set_join

held = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
f = cloudpickle.load(open(sys.argv[1], "rb"))
of = lambda i: pa.RecordBatch.from_pydict({"doc_id": pa.array(range(500), pa.int64()), "t": [" ".join(f"w{i}x{j}x{k}" for k in range(400)) for j in range(500)]})
list(f(iter([of(0)])))
before, rows = held(), 0
for out in f(of(i) for i in range(1, 9)):
    rows += out.num_rows
del out
print(rows, held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="Linux alone tells it")
def test_a_worker_gives_its_memory_back_at_the_end_of_a_task(spark, tmp_path, monkeypatch):
    from pyspark import cloudpickle

    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    found, plain = [], type(docs).mapInArrow

    def kept(df, f, *args, **more):
        found.append(f)
        return plain(df, f, *args, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", kept)
    set_join.jaccard_components(docs)
    assert {"shingled", "keyed"} <= {f.__name__ for f in found}
    for f in found[:2]:
        (tmp_path / f.__name__).write_bytes(cloudpickle.dumps(f))
        said = subprocess.run([sys.executable, "-c", WORKER, tmp_path / f.__name__], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
        rows, more = said.stdout.split()
        assert int(rows) >= 4000 and float(more) < 12, (f.__name__, said.stdout)


def test_memory_of_a_tokenizer_is_bounded_and_its_ids_do_not_depend_on_it():
    bpe = ByteBPE(tokenizer_path())
    text = " ".join(f"w{i}" for i in range(250_000))
    bpe.ids(text)
    assert len(bpe.ids_of) <= 200_000
    tail = "w249998 w249999 w1 zebra-7"
    assert bpe.ids(tail) == pa.py_buffer(bpe._pack(bpe.whole(tail))).to_pybytes()
