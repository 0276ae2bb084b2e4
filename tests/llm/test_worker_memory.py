"""What a Python worker keeps: the tables of one operator at most, and no text beyond its group."""

import gc
import weakref

import pyarrow as pa
import pytest

from viewlens.llm import common, packing
from viewlens.llm.queries import WORD_BPE


class Table:
    """Tables and a memo that refer to each other, as the tokenizers' do."""

    def __init__(self):
        self.words = common.WordMemo(self.size)

    def size(self, word):
        return len(word)


@pytest.fixture
def no_collection():
    gc.disable()
    yield
    gc.enable()
    common.drop_tables()


def test_tables_of_the_operator_before_are_gone(no_collection):
    first = weakref.ref(common.worker_tables(Table))
    assert common.worker_tables(Table) is first() and first().words["abc"] == 3
    common.drop_tables()
    assert first() is None and not common._TABLES


def test_other_tables_replace_those_of_the_operator_before(no_collection):
    first = weakref.ref(common.worker_tables(Table))
    common.worker_tables(list)
    assert first() is None and len(common._TABLES) == 1


def test_packing_cuts_groups_of_its_own_size_with_equal_pieces(spark, monkeypatch):
    texts = ["It's a TEST, of words", None, "", "x " * 3000, "Straße ÉCOLE!! " * 700] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = sorted(map(tuple, packing.pieces(docs, WORD_BPE).collect()))
    sizes = []
    real = packing.groups

    def seen(batches, **how):
        sizes.append(how["size_of_group"])
        return real(batches, **how)
    monkeypatch.setattr(packing, "groups", seen)
    monkeypatch.setattr(packing, "TEXT_BYTES", 1000)
    t = pa.table({"doc_id": range(len(texts)), "text": texts}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))

    class Docs:  # runs the task's function here
        sparkSession, schema = spark, docs.schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return [tuple(r.values()) for b in run(iter(t.to_batches(max_chunksize=2))) for r in b.to_pylist()]
    assert sorted(packing.pieces(Docs(), WORD_BPE)) == want and sizes == [1000]
