"""The round trip of op6 is tried per unit, once, and stays that of the whole text."""

import public_tokenizers
import pytest

from llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a b", "  a\t ﬁé \r\n ", "bar ▁ inside", "▁", "x" * 500, "日本語 text \U0001f600", "a\nb  c\n", "word " * 50, "� \u0000"]


def encoded(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return {r.doc_id: r for r in pieces.encode_documents(docs, PATH).collect()}


def test_round_trip_is_that_of_the_whole_text(spark):
    table, rows = pieces.Model(PATH).decoder(), encoded(spark)
    for k, t in enumerate(TEXTS):
        assert rows[k].round_trip == (pieces.decode(list(rows[k].ids), table) == (t or "")) == ("▁" not in (t or "")), t


@pytest.mark.parametrize("unit", ["▁word", "▁日本語", "▁" * 70])
def test_units_are_tried(unit):
    model = pieces.Model(PATH)
    table = model.decoder()
    pieces._odd.clear()
    pieces._rare(unit, model, table)
    assert not pieces._odd
    pieces._tried(unit, model.merged(unit)[:-4], table)
    assert pieces._odd == {unit}
    pieces._odd.clear()
