"""TIFF media columns: walk the image directories, decode strips and tiles, undo predictors, one row for each page.

Decodes uncompressed, LZW, deflate and PackBits data of 1 to 64 bits a sample (chunky or planar), predictors 2 and 3,
both byte orders, classic and big files. :func:`stored` writes bytes as an 8-bit greyscale page that decodes to them, in one of
FORMS, which a hash of the bytes picks: each compression, in strips and tiles, with and without a predictor.

Cases: null, empty or broken media (fields of wrong types, sizes that the strips can't hold) give one row with page null and the reason
in ``error``, and pages before the break keep their rows; a directory that points back ends the walk; repeated rows are decoded each; other columns stay, those of added names as name_own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeshore.llm.shared import set_aside, widened

#: Struct letters by field type number.
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Compression numbers.
COMPRESSION = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
#: About the most bytes that one byte of each compression can become.
MOST = {"none": 1, "lzw": 2730, "deflate": 1032, "packbits": 64}
#: Row width, rows to a strip and size of a tile of what :func:`stored` writes.
WIDTH, STRIP_ROWS, TILE = 64, 256, 32
#: (compression, tiled?, predictor) of what :func:`with_tiff` writes, by a hash of the payload.
FORMS = [(c, tiled, predictor) for c in (8, 5, 32773) for tiled in (False, True) for predictor in (1, 2)]


def unpackbits(data: bytes, size: int) -> bytes:
    """PackBits: runs of literal bytes and of one repeated byte."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 if n == 128 else 2
    return bytes(out)


def packbits(data: bytes) -> bytes:
    """Runs of three and more equal bytes as such, all else as literals."""
    x = np.frombuffer(data, np.uint8)
    out, literal = bytearray(), 0
    starts = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))
    many = np.diff(np.append(starts, len(x)))

    def put_literal(end: int) -> None:
        for at in range(literal, end, 128):
            out.append(min(128, end - at) - 1)
            out.extend(data[at : min(end, at + 128)])

    for at, n in zip(starts[many > 2].tolist(), many[many > 2].tolist()):
        put_literal(at)
        literal = at + n
        for k in range(at, at + n, 128):
            run = min(128, at + n - k)
            out += bytes((257 - run, data[k])) if run > 1 else bytes((0, data[k]))
    put_literal(len(data))
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes that :func:`unlzw` reads; the table is cleared before it is full."""
    codes, table, free, key = [256], {}, 258, data[0] if data else -1
    known = table.get
    for byte in data[1:]:
        pair = key << 8 | byte
        code = known(pair)
        if code is not None:
            key = code
            continue
        codes.append(key)
        table[pair] = free
        free += 1
        key = byte
        if free == 4094:
            codes.append(256)
            table.clear()
            free = 258
    if key >= 0:
        codes.append(key)
    x = np.array([*codes, 257], np.uint16)
    # a reader's table has 258 entries at a clear code's next two codes, then one more at each; widths follow that
    clears = np.flatnonzero(x == 256)
    since = np.arange(len(x)) - clears[np.searchsorted(clears, np.arange(len(x)), "left") - 1] - 1
    width = np.clip(np.ceil(np.log2(259 + np.maximum(since, 1))).astype(int), 9, 12)
    width[0] = 9
    bits = np.unpackbits(x.astype(">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[np.arange(16) >= 16 - width[:, None]]).tobytes()


#: Widths of the codes after a clear code: the table grows by one with each but the first, and widths follow that a code early.
_WIDTHS = np.clip(np.ceil(np.log2(259 + np.maximum(np.arange(4096), 1))).astype(np.int64), 9, 12)
#: Codes cut out at a time.
_CUT = 1024


def _codes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All codes before the end code, without clear codes, and of each the number of the first one after the last clear code.

    Widths hang on nothing but the number of codes since that clear code, so codes are cut out of the bits many at once.
    """
    bits = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))).astype(np.int64)
    found, begun, n, at, since = [], [], 0, 0, 0
    while True:
        width = _WIDTHS[np.minimum(np.arange(since, since + _CUT), len(_WIDTHS) - 1)]
        ends = at + np.cumsum(width)
        width = width[: int(np.searchsorted(ends, 8 * len(data), "right"))]
        first = ends[: len(width)] - width
        byte = first >> 3
        held = (bits[byte] << 16) | (bits[byte + 1] << 8) | bits[byte + 2]
        codes = (held >> (24 - (first & 7) - width)) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(stops[0]) if len(stops) else len(codes)
        found.append(codes[:stop])
        begun.append(np.full(stop, n - since))
        n += stop
        if stop == len(codes):
            if stop < _CUT:  # the data end without an end code
                break
            at, since = int(ends[-1]), since + stop
        elif codes[stop] == 257:
            break
        else:
            at, since = int(ends[stop]), 0
    return np.concatenate(found), np.concatenate(begun)


def unlzw(data: bytes, size: int) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits from the high bit on, each width one code early, 256 clears, 257 ends. At least ``size`` bytes, if
    there are so many before a code that is none.

    An entry of the table is what one code put out and the next byte put out, so it is a stretch of the output. No table is kept: each
    output byte points to an earlier one that it equals, or is a letter, and pointers are followed all at once, twice as far each round.
    """
    codes, begun = _codes(data)
    own = np.arange(len(codes))
    letter = codes < 256
    entry = np.where(letter, own, begun + codes - 258)  # the code whose output, and a byte more, this one repeats
    known = letter | ((codes >= 258) & (entry < own) & (entry - begun < 4096 - 258))
    good = len(codes) if known.all() else int(known.argmin())
    letter, entry = letter[:good], entry[:good]
    steps, far, rounds = np.where(letter, 0, 1), entry, 0
    while not letter[far].all():
        steps += steps[far]
        far = far[far]
        rounds += 1
    length = steps + 1
    ends = np.cumsum(length)
    enough = int(np.searchsorted(ends, size)) + 1
    if good < len(codes) and enough > good:
        raise ValueError("LZW code out of range")
    length, ends = length[:enough], ends[:enough]
    begins = ends - length
    place = np.arange(int(ends[-1]) if len(ends) else 0)
    of = np.repeat(np.arange(len(length)), length)
    points = np.where(letter[of], place, begins[entry[of]] + place - begins[of])
    for _ in range(rounds + 2):
        points = points[points]
    return codes[of[points]].astype(np.uint8).tobytes()


def _fields(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    """The fields of the directory at ``at`` and the place of the next one."""
    (n,) = struct.unpack_from(order + ("Q" if big else "H"), data, at)
    at += 8 if big else 2
    entry, word = (20, 8) if big else (12, 4)
    if at + n * entry + word > len(data):
        raise ValueError("directory runs over the end")
    found: dict[int, tuple] = {}
    for k in range(n):
        place = at + k * entry
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), data, place)
        letters = FIELD.get(kind)
        if letters is None:
            continue
        form = f"{order}{count}s" if letters == "s" else order + letters * 1 if count == 1 else f"{order}{count * len(letters)}{letters[0]}"
        value = place + entry - word
        if struct.calcsize(form) > word:
            (value,) = struct.unpack_from(order + ("Q" if big else "I"), data, value)
        if value + struct.calcsize(form) > len(data):
            raise ValueError("field runs over the end")
        found[tag] = struct.unpack_from(form, data, value)
    (following,) = struct.unpack_from(order + ("Q" if big else "I"), data, at + n * entry)
    return found, following


def _block(raw: bytes, scheme: str, size: int) -> bytes:
    if scheme == "deflate":
        raw = zlib.decompressobj().decompress(raw, size)
    elif scheme == "lzw":
        raw = unlzw(raw, size)
    elif scheme == "packbits":
        raw = unpackbits(raw, size)
    if len(raw) < size:
        raise ValueError("strip or tile is too short")
    return raw[:size]


def _page(data: bytes, tags: dict[int, tuple], order: str) -> dict:
    for tag in (256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325):
        if not all(isinstance(v, int) and v >= 0 for v in tags.get(tag, ())):
            raise ValueError(f"type of field {tag}")
    first = lambda tag, default: (*tags.get(tag, ()), default)[0]
    width, height = first(256, 0), first(257, 0)
    bits, samples = tags.get(258, (1,)), first(277, 1)
    scheme = COMPRESSION.get(first(259, 1))
    if scheme is None:
        raise ValueError(f"compression {first(259, 1)}")
    if not width or not height or len(set(bits)) != 1 or bits[0] not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError("size or bits of a sample")
    depth, predictor, planar = bits[0], first(317, 1), first(284, 1) == 2
    tiled = 322 in tags
    across, down = (first(322, 0), first(323, 0)) if tiled else (width, min(first(278, height), height))
    if not across or not down:
        raise ValueError("tile or strip size")
    offsets, counts = tags[324 if tiled else 273], tags[325 if tiled else 279]
    each, planes = (1, samples) if planar else (samples, 1)
    row_bytes = (across * each * depth + 7) // 8
    columns, rows = -(-width // across), -(-height // down)
    if len(offsets) < columns * rows * planes or len(counts) < columns * rows * planes:
        raise ValueError("strips or tiles missing")
    if columns * rows * planes * down * row_bytes > 2 * MOST[scheme] * sum(counts[: columns * rows * planes]) + row_bytes * down:
        raise ValueError("strips or tiles can't hold the page")
    out = np.zeros((planes, height, (width * each * depth + 7) // 8), np.uint8)
    for k in range(columns * rows * planes):
        plane, inner = divmod(k, columns * rows)
        top, left = inner // columns * down, inner % columns * across
        tall = down if tiled else min(down, height - top)
        if offsets[k] + counts[k] > len(data):
            raise ValueError("strip or tile runs over the end")
        cells = np.frombuffer(_block(data[offsets[k] : offsets[k] + counts[k]], scheme, tall * row_bytes), np.uint8).reshape(tall, row_bytes)
        if predictor == 2 and depth >= 8:
            word = np.dtype(f"{order}u{depth // 8}")
            x = np.ascontiguousarray(cells).view(word).reshape(tall, across, each)
            cells = np.ascontiguousarray(np.cumsum(x, axis=1, dtype=word.newbyteorder("=")).astype(word)).view(np.uint8).reshape(tall, row_bytes)
        elif predictor == 3:
            x = cells.reshape(tall, -1, each)
            flat = np.cumsum(x, axis=1, dtype=np.uint8).reshape(tall, depth // 8, across * each)
            cells = flat[:, :: -1 if order == "<" else 1].transpose(0, 2, 1).reshape(tall, row_bytes)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor}")
        tall, start = min(tall, height - top), left * each * depth // 8
        take = min(row_bytes, out.shape[2] - start)
        out[plane, top : top + tall, start : start + take] = cells[:tall, :take]
    pixels = out[0] if planes == 1 else out.reshape(planes, height, width, -1).transpose(1, 2, 0, 3)
    return {"width": width, "height": height, "samples": samples, "bits": depth, "compression": scheme, "predictor": predictor, "n_blocks": columns * rows * planes, "pixels": np.ascontiguousarray(pixels).tobytes()}


def pages_of(data: bytes | None) -> Iterator[dict]:
    """Each page of a file, then, if it breaks, a last dict with only ``error``."""
    try:
        if not data:
            raise ValueError("no data")
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        (magic,) = struct.unpack_from(order + "H", data, 2)
        if magic not in (42, 43):
            raise ValueError("not a TIFF file")
        (at,) = struct.unpack_from(order + "Q", data, 8) if magic == 43 else struct.unpack_from(order + "I", data, 4)
        seen: set[int] = set()
        while at and at not in seen:
            seen.add(at)
            tags, following = _fields(data, at, order, magic == 43)
            yield {"page": len(seen) - 1} | _page(data, tags, order)
            at = following
    except (ValueError, KeyError, IndexError, TypeError, OverflowError, MemoryError, struct.error, zlib.error) as broken:
        yield {"error": f"{type(broken).__name__}: {broken}"}


def _differences(rows: np.ndarray) -> np.ndarray:
    """Predictor 2: each sample less the one before it in its row."""
    return np.diff(rows, axis=1, prepend=np.zeros((len(rows), 1), np.uint8))


def form_of(payload: bytes) -> tuple[int, bool, int]:
    """The one of FORMS that a hash of the bytes picks."""
    return FORMS[zlib.crc32(payload) % len(FORMS)]


def stored(payload: bytes, compression: int = 8, tiled: bool = False, predictor: int = 1, level: int = 4) -> bytes:
    """``payload`` (a multiple of WIDTH bytes) as one greyscale page of strips or tiles, little-endian."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    rows = len(pixels)
    if tiled:
        padded = np.pad(pixels, ((0, -rows % TILE), (0, 0)))
        cells = [padded[y : y + TILE, x : x + TILE] for y in range(0, rows, TILE) for x in range(0, WIDTH, TILE)]
    else:
        cells = [pixels[y : y + STRIP_ROWS] for y in range(0, rows, STRIP_ROWS)]
    if predictor == 2:
        cells = [_differences(c) for c in cells]
    packed = {1: bytes, 5: lzw, 8: lambda raw: zlib.compress(raw, level), 32773: packbits}[compression]
    blocks = [packed(c.tobytes()) for c in cells]
    n, at = len(blocks), 8
    offsets = []
    for x in blocks:
        offsets.append(at)
        at += len(x)
    at += at % 2
    tables = b"" if n == 1 else struct.pack(f"<{2 * n}I", *offsets, *map(len, blocks))
    places = (offsets[0], len(blocks[0])) if n == 1 else (at, at + 4 * n)
    entries = [(256, 4, 1, WIDTH), (257, 4, 1, rows), (258, 3, 1, 8), (259, 3, 1, compression), (262, 3, 1, 1), (277, 3, 1, 1), (317, 3, 1, predictor)]
    entries += [(322, 3, 1, TILE), (323, 3, 1, TILE), (324, 4, n, places[0]), (325, 4, n, places[1])] if tiled else [(273, 4, n, places[0]), (278, 4, 1, STRIP_ROWS), (279, 4, n, places[1])]
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in sorted(entries)) + bytes(4)
    body = b"".join(blocks)
    return struct.pack("<2sHI", b"II", 42, at + len(tables)) + body + bytes(len(body) % 2) + tables + directory


def feature(width: int, height: int, pixels: bytes) -> str:
    """Mean brightness and a 64-bit block hash (is a block brighter than the mean?) of an 8-bit greyscale page."""
    image = np.frombuffer(pixels, np.uint8).reshape(height, width)
    total = np.zeros((9, 9), np.int64)
    ys, xs = np.arange(9) * height // 8, np.arange(9) * width // 8
    sums = np.vstack([np.zeros((1, width), np.int64), np.cumsum(image, axis=0, dtype=np.int64)])[ys]
    total = np.hstack([np.zeros((9, 1), np.int64), np.cumsum(sums, axis=1)])[:, xs]
    cells = np.diff(np.diff(total, axis=0), axis=1)
    area = np.outer(np.diff(ys), np.diff(xs))
    brighter = cells * (width * height) > area * total[-1, -1]
    return f"{width}x{height}:{total[-1, -1] / (width * height):.4f}:{np.packbits(brighter).tobytes().hex()}"


KINDS = {"page": pa.int32(), "width": pa.int64(), "height": pa.int64(), "samples": pa.int32(), "bits": pa.int32(), "compression": pa.string(), "predictor": pa.int32(), "n_blocks": pa.int32(), "pixels": pa.binary(), "feature": pa.string(), "error": pa.string()}
PAGE = "tiff struct<page:int,width:long,height:long,samples:int,bits:int,compression:string,predictor:int,n_blocks:int,pixels:binary,feature:string,error:string>"


Batches = Iterator[pa.RecordBatch]


def _encoded(batches: Batches, keep: list[str]) -> Batches:
    """Batches whose last column is bytes, with n_bytes and media in its place."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            raw = [x or b"" for x in part.column(part.num_columns - 1).to_pylist()]
            padded = [x + bytes(-len(x) % WIDTH or (0 if x else WIDTH)) for x in raw]
            media = [stored(x, *form_of(x)) for x in padded]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])


def _decoded(batches: Batches, media_col: str) -> Batches:
    """A row for each page of each file, with the row's columns and the struct ``tiff``."""
    for batch in batches:
        column = batch.schema.get_field_index(media_col)
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            rows, pages = [], []
            for k, media in enumerate(part.column(column).to_pylist()):
                for page in pages_of(media):
                    if page.get("bits") == 8 and page["samples"] == 1:
                        page["feature"] = feature(page["width"], page["height"], page["pixels"])
                    rows.append(k)
                    pages.append(page)
            own = part.take(pa.array(rows, pa.int64()))
            found = pa.StructArray.from_arrays([pa.array([p.get(n) for p in pages], kind) for n, kind in KINDS.items()], names=list(KINDS))
            yield pa.RecordBatch.from_arrays([*own.columns, found], names=[*batch.schema.names, "tiff"])


def _prepared(docs: DataFrame, text_col: str) -> tuple[DataFrame, list[str], T.StructType]:
    """The rows that :func:`_encoded` reads, their kept columns, and the schema of what it gives."""
    docs = set_aside(docs, *{"n_bytes", "media", "raw"} - {text_col})
    keep = [c for c in docs.columns if c != text_col]
    fields = [docs.schema[c] for c in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]
    return docs.select(*keep, F.col(text_col).cast("binary").alias("raw")), keep, T.StructType(fields)


def with_tiff(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_bytes (its UTF-8 bytes) and ``media``: those, zeros up to a positive multiple of 64, as TIFF."""
    rows, keep, schema = _prepared(docs, text_col)
    return rows.mapInArrow(lambda batches: _encoded(batches, keep), schema)


def tiff_pages(df: DataFrame, media_col: str = "media") -> DataFrame:
    """A row for each page of each file, with the row's other columns and struct ``tiff`` of PAGE."""
    df = set_aside(df, "tiff")
    return df.mapInArrow(lambda batches: _decoded(batches, media_col), widened(df, PAGE))


def stored_and_read(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """What :func:`tiff_pages` reads from what :func:`with_tiff` writes, in one pass of one Python worker."""
    rows, keep, schema = _prepared(set_aside(docs, "tiff"), text_col)
    schema = T.StructType([*schema.fields, *T.StructType.fromDDL(PAGE).fields])
    return rows.mapInArrow(lambda batches: _decoded(_encoded(batches, keep), "media"), schema)
