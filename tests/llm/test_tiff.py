import hashlib
import struct
import zlib

import numpy as np
import pytest

from lakeshore.llm import tiff


def lzw(data):
    bits, width, table, word = [], 9, {bytes([k]): k for k in range(256)}, b""
    put = lambda code, n: bits.append(format(code, f"0{n}b"))
    put(256, 9)
    size = 258
    for k in data:
        if word + bytes([k]) in table:
            word += bytes([k])
            continue
        put(table[word], width)
        table[word + bytes([k])] = size
        size += 1
        word = bytes([k])
        width = max(9, size.bit_length())
        if size == 4095:
            put(256, 12)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
    put(table[word], width)
    size += 1
    put(257, max(9, min(12, size.bit_length())))
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8))


def packbits(data):
    out = b""
    for k in range(0, len(data), 100):
        part = data[k : k + 100]
        out += bytes([257 - len(part)]) + part[:1] if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
        out += b"\x80"
    return out


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def tile_file(pages, order, compression, predictor=1, tile=None, big=False):
    """Pages of (height, width, samples) arrays as a file with strips of 5 rows or tiles."""
    o = {"<": b"II", ">": b"MM"}[order]
    out = bytearray(o + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    for image in pages:
        h, w, s = image.shape
        th, tw = tile or (5, w)
        places, sizes = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                cell = image[y : y + th, x : x + tw]
                if tile:
                    cell = np.pad(cell, ((0, th - cell.shape[0]), (0, tw - cell.shape[1]), (0, 0)))
                if predictor == 2:
                    cell = np.concatenate([cell[:, :1], np.diff(cell, axis=1)], axis=1).astype(image.dtype)
                raw = PACK[compression](cell.astype(image.dtype.newbyteorder(order)).tobytes())
                places.append(len(out))
                sizes.append(len(raw))
                out += raw
        entries = [(256, [w]), (257, [h]), (258, [image.dtype.itemsize * 8] * s), (259, [compression]), (277, [s]), (317, [predictor])]
        entries += [(322, [tw]), (323, [th]), (324, places), (325, sizes)] if tile else [(273, places), (278, [th]), (279, sizes)]
        letter, kind, word = ("Q", 16, 8) if big else ("I", 4, 4)
        body = b""
        for tag, values in sorted(entries):
            raw = struct.pack(f"{order}{len(values)}{letter}", *values)
            if len(raw) > word:
                place = len(out)
                out += raw
                raw = struct.pack(order + letter, place)
            body += struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, len(values)) + raw
        struct.pack_into(order + letter, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(entries)) + body
        link = len(out)
        out += bytes(word)
    return bytes(out)


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("depth,predictor,big", [("u1", 1, False), ("u1", 2, True), ("u2", 2, False)])
def test_pages_come_back(compression, order, tile, depth, predictor, big):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 50, shape).astype(depth) for shape in ((23, 37, 1), (40, 16, 3), (70, 60, 1))]
    pages[0][4:9] = 7
    found = list(tiff.pages_of(tile_file(pages, order, compression, predictor, tile, big)))
    assert [p.get("error") for p in found] == [None] * 3
    for page, image in zip(found, pages):
        assert np.array_equal(np.frombuffer(page["pixels"], image.dtype.newbyteorder(order)).reshape(image.shape), image)


def test_float_predictor():
    image = np.linspace(-3, 9, 12, dtype="<f4").reshape(2, 6)
    planes = np.ascontiguousarray(image).view(np.uint8).reshape(2, 6, 4)[:, :, ::-1].transpose(0, 2, 1).reshape(2, 24)
    coded = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8)
    data = tile_file([coded[:, :, None]], "<", 8)
    tags = {256: (6,), 257: (2,), 258: (32,), 259: (8,), 277: (1,), 317: (3,), 273: (8,), 278: (5,), 279: (len(zlib.compress(coded.tobytes())),)}
    assert tiff._page(data, tags, "<")["pixels"] == image.tobytes()


def test_lzw_long():
    data = np.random.default_rng(1).integers(0, 4, 60000).astype(np.uint8).tobytes()
    assert tiff.unlzw(lzw(data), len(data)) == data


@pytest.mark.parametrize("form", tiff.FORMS)
def test_stored_forms_come_back(form):
    rng = np.random.default_rng(5)
    for data in (bytes(64), b"ab" * 32 * 700, rng.integers(0, 256, 64 * 300).astype(np.uint8).tobytes(), rng.integers(97, 101, 64 * 2000).astype(np.uint8).tobytes(), b"z" * 64 * 129):
        (page,) = tiff.pages_of(tiff.stored(data, *form))
        assert page["pixels"] == data and page["predictor"] == form[2] and page["compression"] == tiff.COMPRESSION[form[0]]
        assert tiff.unlzw(tiff.lzw(data), len(data)) == data and tiff.unpackbits(tiff.packbits(data), len(data)) == data
    assert {tiff.form_of(str(k).encode()) for k in range(200)} == set(tiff.FORMS)


def test_broken_directories_never_raise():
    rng = np.random.default_rng(7)
    good = [tiff.stored(rng.integers(97, 101, 64 * 40).astype(np.uint8).tobytes(), *form) for form in tiff.FORMS]
    for k in range(3000):
        data = bytearray(good[k % len(good)])
        (at,) = struct.unpack_from("<I", data, 4)
        for _ in range(1 + k % 3):
            entry = at + 2 + 12 * int(rng.integers(0, 10))
            field = int(rng.integers(0, 3))
            value = int(rng.choice([0, 1, 2, 3, 11, 12, 16, 255, 65535, 2_000_000, 1 << 31, (1 << 32) - 1]))
            if entry + 12 <= len(data):
                if field == 0:
                    struct.pack_into("<H", data, entry + 2, value & 0xFFFF)
                else:
                    struct.pack_into("<I", data, entry + 4 * field, value)
        assert all(("error" in p) != ("pixels" in p) for p in tiff.pages_of(bytes(data)))


@pytest.mark.parametrize("kind, value", [(2, b"ab\x00\x00"), (11, struct.pack("<f", 64.0)), (4, struct.pack("<I", 2_000_000))])
def test_width_of_a_wrong_kind_is_an_error(kind, value):
    data = bytearray(tiff.stored(b"z" * 64))
    (at,) = struct.unpack_from("<I", data, 4)
    assert struct.unpack_from("<H", data, at + 2) == (256,)
    struct.pack_into("<HHI", data, at + 2, 256, kind, 4 if kind == 2 else 1)
    data[at + 10 : at + 14] = value
    (page,) = tiff.pages_of(bytes(data))
    assert page["error"]


def test_texts_round_trip(spark):
    texts = ["", None, "a" * 64, "é" * 500, "word " * 9000, "a" * 64]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, tiff_note string")
    rows = sorted(tiff.tiff_pages(tiff.with_tiff(docs)).collect())
    assert rows == sorted(tiff.stored_and_read(docs).collect())
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts):
        raw = (t or "").encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        assert r.n_bytes == len((t or "").encode()) and bytes(r.tiff.pixels) == raw and r.tiff.feature.startswith("64x")
    assert hashlib.sha256(rows[2].media).digest() == hashlib.sha256(rows[5].media).digest()


def test_broken_media(spark):
    good = tiff.stored(b"z" * 640)
    loop = bytearray(good)
    loop[-4:] = struct.pack("<I", struct.unpack_from("<I", good, 4)[0])
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"II*\x00junk"), (4, good[:-30]), (5, bytes(loop)), (6, good[:8] + b"\x00" * 9 + good[17:])], "id int, media binary")
    rows = {r.id: r.tiff for r in tiff.tiff_pages(df).collect()}
    assert rows[5].error is None and rows[5].page == 0
    assert all(rows[k].error and rows[k].pixels is None for k in (1, 2, 3, 4, 6))
