import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postlark.llm.packing import Encoder, pack, piece_lengths, write_buckets

from .fixtures import corpus, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def known():
    return Encoder(PATH)


def test_pieces_rebuild_every_document(spark, tmp_path):
    rows = [(i, t) for i, t in corpus() if i is not None and i >= 300] + [(1, "<|endoftext|> Été, 3.5km don't"), (2, None)]
    tokenizer = Tokenizer.from_file(PATH)
    pieces = pack(frame(spark, rows), PATH)
    got: dict = {}
    for r in pieces.collect():
        assert r.length == len(r.ids) and r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got.setdefault(r.id, []).append(r)
    assert len({r.sequence_id for v in got.values() for r in v}) == sum(map(len, got.values()))
    for i, text in rows:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(got[i], key=lambda r: r.start)
        assert [x for r in parts for x in r.ids] == want and parts[0].doc_tokens == len(want)
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
    write_buckets(pieces, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("bucket <> length").count() == 0


def test_cases(spark):
    assert pack(frame(spark, []), PATH).collect() == []
    docs = spark.createDataFrame([(None, "a", 1), (None, "a", 2)], "doc_id long, text string, start int")
    got = pack(docs, PATH, with_ids=False).collect()
    assert [(r.id, r.start, r.length, r.ids) for r in got] == [(None, 0, 2, None)] * 2
    with pytest.raises(ValueError):
        pack(docs, PATH, longest=1000)


def test_lengths_are_binary_digits():
    for n in range(1, 9000, 7):
        parts = piece_lengths(n)
        assert sum(parts) == n and parts == sorted(parts, reverse=True) and len(set(parts) - {2048}) == len([p for p in parts if p != 2048])


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40))
def test_ids_equal_the_tokenizer(known, text):
    assert known.ids(text).tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids
