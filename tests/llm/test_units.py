"""Units that the tokenizer's words are made of."""

import random
import subprocess
import sys

import public_tokenizers
import pyarrow as pa
from pyspark import cloudpickle

from terrane.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", "é", "É", "3", "٣", "'s", "'S", "'", ".", ",", ";", "!?", "...", "(", '"', "Á", "İ", "K", "ß", "ͅ.", "Σ", "ς.", "  ", "\n", " ", "　", "don't", "x.y", "e.g.,", "3.14", "漢字", "<|endoftext|>", "a.'s", "b,'ll", "'re."]


def test_units_differ_by_neither_case_nor_punctuation():
    units, n, whole = bpe.split_units(PATH, pa.array(["Word word, word.", "WORD: 3.5"]))
    assert units.dictionary.to_pylist() == ["word", ",", ".", ":", "3", ".5"] and not whole.any()
    assert n.tolist() == [5, 4]


def test_ids_of_mixed_strings_equal_the_library():
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    tok = bpe.tokenizer(PATH)
    assert [x.tolist() for x in bpe.library_ids(PATH, texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


_AS_A_WORKER = """
import pickle, sys
import pyarrow as pa
from terrane.llm import bpe

class Task:
    get = partitionId = staticmethod(lambda: 0)

def fail(*_):
    raise AssertionError("taken whole")

bpe.split_words = fail
task = pickle.load(open(sys.argv[1], "rb"))
task.__globals__["TaskContext"] = type("T", (), {"get": staticmethod(lambda: Task)})
print(sum(b.num_rows for b in task(iter([pa.record_batch({"doc_id": [1], "text": ["Some words, some more."]})]))))
"""


def test_workers_cut_texts_into_units(monkeypatch, tmp_path):
    """In a process of its own the task's function has to know its pattern again, or each text is taken whole."""

    class Source:
        def mapInArrow(self, task, schema):
            return task

    monkeypatch.setattr(bpe, "two", lambda *_: Source())
    monkeypatch.setattr(bpe, "written", lambda task, tag: task)
    (tmp_path / "task").write_bytes(cloudpickle.dumps(bpe.word_blocks(None, PATH)))
    done = subprocess.run([sys.executable, "-c", _AS_A_WORKER, str(tmp_path / "task")], capture_output=True, text=True, check=False)
    assert done.returncode == 0 and int(done.stdout) > 1, done.stderr
