import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakeshore.llm import planes

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["It's A   test, isn't it? Ünïcödé’s H̱ ", "", None, "a\x01b <|endoftext|> c", "x" * 3000 + " tail word ́mark", "same same", "same same", "ΣΑΣ σας 12345 ###!?", "x² ¼ ªº don't's ''s Éa\u00a0b\x85c d_e\x1cf\tg ŉ İI"]
DOCS = [(i if i != 3 else None, t, "k", 1) for i, t in enumerate(TEXTS)] + [(5, "same same", "k", 2)]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 24, n).astype("<u4")
    back = planes.from_planes(planes.block_planes(ids, kind, 3), n, kind, 3)
    assert (back == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_documents_come_back_in_order(spark, kind):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, ids string, start int")
    rows = planes.tokenized(docs, PATH, 2, kind=kind, block_ids=50, with_ids=True).collect()
    whole = Tokenizer.from_file(PATH)
    expected = [(d, [*whole.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in DOCS]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.ids) for r in rows], key=key) == sorted(expected, key=key)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ordered = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda d: (d is not None, d or 0))


def test_no_documents(spark):
    assert planes.tokenized(spark.createDataFrame([], "doc_id long, text string"), PATH, 2).collect() == []


def test_pieces_like_the_library():
    """Random texts of awkward characters, by the memory of pieces and by the library on whole texts."""
    encoder, whole = planes.ChunkEncoder(PATH), Tokenizer.from_file(PATH)
    assert encoder.in_parts
    rng = random.Random(5)
    pools = ["abcXYZ'st rel,. 19²½ªº \x85\x1c\x1f\t\n_-#é", "ΣσςАбв日本 ab'", "İİıŉß\u0301\u0307e a1²³ 'll 've", "".join(map(chr, range(0x24F)))]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for pool in pools for _ in range(1500)]
    got = encoder.encode(texts)
    assert [x.tolist() for x in got] == [x.ids for x in whole.encode_batch_fast(texts, add_special_tokens=False)]


def test_other_files_go_whole(tmp_path):
    """A file that cuts texts in another way is not taken apart."""
    whole = Tokenizer.from_file(PATH)
    file = json.loads(whole.to_str())
    file["normalizer"]["normalizers"].pop()  # keeps upper case
    other = tmp_path / "other.json"
    other.write_text(json.dumps(file))
    encoder = planes.ChunkEncoder(str(other))
    assert not encoder.in_parts
    texts = ["It's A Test", None, "UPPER lower"]
    assert [x.tolist() for x in encoder.encode(texts)] == [x.ids for x in Tokenizer.from_file(str(other)).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
