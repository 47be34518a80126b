"""Packing holds little at once: small Arrow batches, ids of a few texts, one memory of words and parts."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from citeloom.llm import hist_pack, shared
from citeloom.llm.queries import TOKENIZER


def test_batches_of_texts_are_small(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(hist_pack, "saved", lambda df, name: (seen.append((name, spark.conf.get(shared.BATCH_BYTES))), shared.saved(df, name))[1])
    before = spark.conf.get(shared.BATCH_BYTES)
    docs = spark.createDataFrame([(k, f"words of document {k}") for k in range(20)], "doc_id long, text string")
    assert hist_pack.pack(docs, TOKENIZER).count() == 20
    assert dict(seen)["pieces"] == str(hist_pack.PORTION_BYTES) and dict(seen)["piece-counts"] == before
    assert spark.conf.get(shared.BATCH_BYTES) == before
    seen.clear()
    small = hist_pack.pack(docs, TOKENIZER, portion_bytes=50, cached_words=3)
    assert dict(seen)["pieces"] == "50" and sorted(small.collect()) == sorted(hist_pack.pack(docs, TOKENIZER).collect())


def test_a_batch_ends_at_its_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    docs = spark.range(64, numPartitions=1).selectExpr("repeat('x', 1000) AS text")
    with shared.batches_of(spark, 10_000):
        rows = docs.mapInArrow(sizes, "n long").collect()
    assert sum(r.n for r in rows) == 64 and max(r.n for r in rows) < 16


def test_ids_are_laid_out_for_a_few_texts_at_a_time(monkeypatch):
    monkeypatch.setattr(hist_pack, "LAID_WORDS", 5)
    texts = ["Alpha beta. alpha", "", "one text of more words than are laid out at once", "don't naïve <|x|> °", None, "ALPHA " * 3]
    encode, whole = hist_pack.WordEncoder(TOKENIZER, cached_words=4), Tokenizer.from_file(TOKENIZER)
    for column in (pa.array(["", *texts]).slice(1), pa.array([]).cast(pa.string()), pa.array([*texts[::-1]])):
        column = column.fill_null("")
        found = encode(column)
        assert iter(found) is found  # not all at once
        assert [x.tolist() for x in found] == [whole.encode(x, add_special_tokens=False).ids for x in column.to_pylist()]


def test_the_rules_are_read_without_the_vocabulary():
    rules = hist_pack.rules_of(Tokenizer.from_file(TOKENIZER))
    assert set(rules) == {"normalizer", "pre_tokenizer"} and hist_pack.splits_by_word(rules)
    from tokenizers import models

    assert not hist_pack.splits_by_word(hist_pack.rules_of(Tokenizer(models.BPE())))


def test_steps():
    assert [*hist_pack.steps(np.array([3, 4, 20, 21, 22]), 5)] == [(0, 2), (2, 3), (3, 5)]
    assert [*hist_pack.steps(np.array([], np.int64), 5)] == []
