"""What a Python worker keeps when one operator's stage follows another's."""

import pyarrow as pa

from llm import common, minhash, suffix


def test_a_worker_keeps_the_memos_of_one_operator():
    text = " ".join(f"word{k}" for k in range(300))
    described = pa.RecordBatch.from_pydict({"doc_id": [1], "th": [2], "text": [text]})
    first = list(minhash._described(iter([described])))
    assert len(minhash._words) == 300
    data = pa.RecordBatch.from_pydict({"rid": [1], "data": pa.array([text.encode()], pa.binary())})
    found = list(suffix._anchored(iter([data])))
    assert found and suffix._powers and not minhash._words
    again = list(minhash._described(iter([described])))
    assert again == first and not suffix._powers and len(minhash._words) == 300


def test_memos_stay_from_task_to_task_of_one_operator():
    memo = {1: 1}
    for _ in range(2):
        common.remember("one", memo)
        assert memo
    common.remember("two")
    assert not memo and "one" not in common._remembered
