"""What Python workers keep from one task to the next."""

import pyarrow as pa

from blockloom.llm import wordtok
from blockloom.llm.columns import tidied
from blockloom.llm.packing import _cutter


def test_word_ids_go_when_a_task_of_another_operator_begins():
    texts = [pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some words"])], ["doc_id", "text"])]
    cut = _cutter(wordtok.default_vocabulary(), 2048)
    first = list(cut(iter(texts)))
    kept = list(wordtok._LOADED.values())
    assert len(kept) == 1
    assert list(cut(iter(texts))) == first and list(wordtok._LOADED.values()) == kept  # the next task of packing has them
    seen = list(tidied(lambda batches: (wordtok._LOADED.copy() for _ in batches))(iter(texts)))
    assert seen == [{}] and not wordtok._LOADED
    assert list(cut(iter(texts))) == first
