"""Workers take texts in passes of bounded size, and the passes change nothing."""

import pyarrow as pa

from factloom.operators import ingest


def test_passes_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(ingest, "PASS_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["abcd", None, "abcdef", "", "x" * 50, "é" * 5, "y"])], ["doc_id", "text"])
    cut = list(ingest._in_passes(batch, "text"))
    assert [c.num_rows for c in cut] == [4, 1, 1, 1]
    assert pa.Table.from_batches(cut).to_pylist() == batch.to_pylist()
    assert list(ingest._in_passes(batch.slice(0, 0), "text")) == []


def test_chunks_and_answers_by_small_passes(spark, monkeypatch):
    texts = ["One. " * 300, None, "", "\n \n", "ünï\n\n" * 200, "tail"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    whole = ingest.chunk_documents(docs, 500).collect()
    answered = ingest.run_extractor(docs, ingest.split_lines).collect()
    monkeypatch.setattr(ingest, "PASS_BYTES", 10)
    assert ingest.chunk_documents(docs, 500).collect() == whole and len(whole) == 6
    assert ingest.run_extractor(docs, ingest.split_lines).collect() == answered
    assert [r.response is None for r in answered] == [False, True, False, False, False, False]
