"""What workers hold at a time, and how they learn a tokenizer's pieces."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lumenlake.llm import packing, probminhash, tokens
from lumenlake.llm.common import SLICE_ROWS, slices


def test_workers_get_slices_of_large_batches():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2 * SLICE_ROWS + 3)), "text": [None, "", *(f"t{i}" for i in range(2 * SLICE_ROWS + 1))]})
    got = list(slices([batch, batch.slice(0, 0), batch.slice(5, 7)]))
    assert [b.num_rows for b in got] == [SLICE_ROWS, SLICE_ROWS, 3, 7]
    assert pa.Table.from_batches(got).to_pylist() == batch.to_pylist() + batch.slice(5, 7).to_pylist()


def test_packed_stage_remembers_less_and_packs_alike(spark, monkeypatch):
    asked, pack = [], packing.pack_documents
    monkeypatch.setattr(packing, "pack_documents", lambda docs, **more: asked.append(more) or pack(docs, **more))
    docs = spark.createDataFrame([(i, f"word{i} and *** other{i}### é" * (i % 7)) for i in range(60)] + [(None, None)], "doc_id long, text string")
    got = corpus_pipeline.packed(spark, docs, "").orderBy("doc_id", "piece").drop("sequence_id", "offset").collect()
    assert asked[0]["max_pieces"] < tokens.MAX_PIECES
    few = pack(docs, max_pieces=20).orderBy("doc_id", "piece").drop("sequence_id", "offset").collect()
    assert got == few == pack(docs).orderBy("doc_id", "piece").drop("sequence_id", "offset").collect()


def test_texts_learn_their_pieces_together(monkeypatch):
    texts = [f"word{i} schön*** groß### don't x1y2, Zoë; aд bб! naïve(中) µm ª́ á" * (i % 3) for i in range(200)] + [None, "", "a\tb", "<|endoftext|>c", "é" * 70_000]
    for max_pieces in (50, tokens.MAX_PIECES):
        enc, calls = tokens.PieceEncoder(tokens.default_path(), max_pieces), []
        learn = enc._learn
        enc._learn = lambda new: calls.append(len(new)) or learn(new)
        got = list(enc.encode_all(texts))
        assert got == [enc._whole([t])[0] if t else b"" for t in texts]
        assert len(calls) <= 2  # not once for each text
    assert np.frombuffer(got[1], "<u4").size > 10


def test_a_word_is_one_piece_before_any_mark():
    cut = [tokens._PIECES.findall(t) for t in ("gro### gro*** gro1 gro, gro", "aд1 naïve& \n\nb(c)")]
    assert cut[0] == ["gro", "###", " gro", "***", " gro", "1", " gro", ",", " gro"]
    assert cut[1] == ["aд1", " naïve", "&", " \n\nb", "(c)"]


def test_signatures_are_made_slice_by_slice():
    n = 2 * SLICE_ROWS + 3
    batch = pa.record_batch([pa.array(range(n), pa.int64()), pa.array([b"%d" % i for i in range(n)], pa.binary()), pa.array([None, *(f"some words of text number {i}" for i in range(n - 1))])], names=["doc_id", "node", "text"])
    got = list(probminhash._sign_batches([batch]))
    assert [b.num_rows for b in got] == [SLICE_ROWS, SLICE_ROWS, 3]
    alone = [b for i in range(0, n, 100) for b in probminhash._sign_batches([batch.slice(i, 100)])]
    assert pa.Table.from_batches(got).to_pylist() == pa.Table.from_batches(alone).to_pylist()
