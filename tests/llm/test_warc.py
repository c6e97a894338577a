import hashlib
import random

from lakeshore.llm import warc


def test_archives_match_brute_force(spark):
    body = "<p>" + "y" * 120
    rows = [(k, f"http://h/{k}", f"<html>{k % 7} " + "words and more " * (k % 9), 0) for k in range(300)]
    rows += [(None, "a\r\nb", body, 1), (900, None, body, 1), (901, "u", body, 1), (902, "u", None, 1), (903, "u", "short", 1), (904, "u", "short", 1), (900, None, body, 1), (905, "u", "é" * 60, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    got = warc.archived(pages).collect()
    firsts = {}
    for i, _, h, _ in rows:
        if i is not None and len((h or "").encode()) >= 100:
            firsts[h] = min(i, firsts.get(h, i))
    expected = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        ref = firsts.get(h) if firsts.get(h) != i else None
        expected.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "response" if ref is None else "revisit", str(ref), str(raw if ref is None else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), str(bytes(r.payload) if r.payload is not None else None)) for r in got) == sorted(expected)


def test_dictionary_sees_whole_records():
    rng = random.Random(2)
    noise = lambda n: rng.randbytes(n).hex().encode()
    late = noise(300)  # only at the end of each record
    records = [b"headers " * 20 + noise(3500) + late + noise(300) for _ in range(1000)]
    pieces = warc.training_pieces(records)
    assert warc.TRAIN_BYTES * 0.99 < sum(map(len, pieces)) <= warc.TRAIN_BYTES
    found = [next(r for r in (records[k // (len(pieces) // 1000)],) if p in r) for k, p in enumerate(pieces)]
    assert found == [r for r in records for _ in range(len(pieces) // 1000)]
    raw = warc.dictionary(records).as_bytes()
    assert sum(late[k : k + 16] in raw for k in range(0, 584, 8)) > 60
    assert warc.training_pieces(records[:10]) == records[:10]


def test_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
