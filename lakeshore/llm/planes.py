"""Token ids on disk: fixed-size blocks of ids, transposed into bit or byte planes, each plane compressed with zstandard.

A shard file is: ``MAGIC``, the compressed planes of each block one after another, a compressed footer (document
table and chunk index) and a fixed trailer. A block may end inside a document; the document table has the lengths.

Cases: a null or empty text is a document without tokens of its own (only the end id, if one is asked for); null
document ids come first, repeated ids keep all their rows (ties ordered by the ids themselves); extra columns are ignored;
an empty table gives no shards and no rows.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeshore.llm.shared import memory, new_folder, opened, publish, staged, unstaged

MAGIC, TRAILER = b"LSPLANE1", struct.Struct("<QQ8s")
BLOCK_IDS = 1 << 16
#: Encoded chunks of text that a Python worker remembers at most (bounded memory; no effect on results).
REMEMBERED = 1_000_000


class _Lists:
    """Lists of ids by key, kept end to end."""

    def __init__(self) -> None:
        self.index: dict = {}
        self.flat, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def add(self, keys: list, flat: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.index)
        end = self.starts[n]
        while len(self.flat) < end + len(flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while len(self.starts) < n + len(keys) + 1:
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        self.flat[end : end + len(flat)] = flat
        self.starts[n + 1 : n + len(keys) + 1] = end + np.cumsum(sizes)
        self.index.update(zip(keys, range(n, n + len(keys))))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of many keys, end to end."""
        begin = self.starts[rows]
        sizes = self.starts[rows + 1] - begin
        place = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        place += np.arange(len(place))
        return self.flat[place], sizes


class ChunkEncoder:
    """Exact ids of whole texts by a `tokenizers` file whose tokens never cross ASCII white space or PARTS.

    Whether that holds is read from the file: its normalizer, its cuts and the end mark of its words must be the expected
    ones. With any other file each text goes through the library whole.
    Texts are cut at ASCII white space; distinct pieces go through the library once, thousands as one text, and their ids are told
    apart by how many parts each has. Pieces with characters beyond U+024F go through with a separator between them, and
    texts that hold the separator or the start of a special token go through whole.
    """

    SEPARATOR, SPECIAL = "\x01", "<|"
    #: Fixed value: how the tokenizer file cuts a text into words.
    CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: The same for PLAIN text, whose numbers beside digits are these five, and spaces.
    PARTS = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
    #: Such text is its own normal form, lower-cases character by character, and has no character that only one side takes as a space.
    PLAIN = re.compile("[\0-\x1b\x20-\u024f]*")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.in_parts = self._cuts_as_expected()
        if not self.in_parts:
            return
        self.last_of_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last_of_word[[k for w, k in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        (self.mark,) = self._whole([self.SEPARATOR])[0]
        self.forget()

    def _cuts_as_expected(self) -> bool:
        """Is the file's way of cutting texts the one that this class relies on?"""
        file = json.loads(self.tokenizer.to_str())
        kinds = [x.get("type") for x in (file["normalizer"] or {}).get("normalizers", ())]
        cut, *rest = (file["pre_tokenizer"] or {}).get("pretokenizers", ({},))
        return (
            kinds == ["NFC", "Replace", "Lowercase"]
            and file["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and cut.get("pattern") == {"Regex": self.CUTS}
            and cut.get("behavior") == "Removed"
            and cut.get("invert") is True
            and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in rest] == [("ByteLevel", False, False)]
            and file["model"]["type"] == "BPE"
            and file["model"]["end_of_word_suffix"] == "</w>"
            and not file["model"]["dropout"]
            and all(x["content"].startswith(self.SPECIAL) and not x["lstrip"] and not x["rstrip"] for x in file["added_tokens"])
        )

    def forget(self) -> None:
        self.pieces = _Lists()

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_plain(self, new: list[bytes]) -> None:
        """Pieces of PLAIN text, told apart by their parts' last tokens."""
        if not new:
            return
        text = b" ".join(new).decode().lower()
        found = self.PARTS.findall(text)
        spaces = np.flatnonzero(np.fromiter(map(" ".__eq__, found), bool, len(found)))
        before = spaces - np.arange(len(spaces))  # parts up to each space
        ids = np.array(self._whole([text])[0], np.uint32)
        ends = np.concatenate(([0], np.flatnonzero(self.last_of_word[ids]) + 1))
        if len(spaces) != len(new) - 1 or len(ends) - 1 != len(found) - len(spaces):
            self._learn_whole(new)
            return
        self.pieces.add(new, ids, np.diff(ends[np.concatenate(([0], before, [len(ends) - 1]))]))

    def _learn_whole(self, new: list[bytes]) -> None:
        """Pieces of a long text in which the separator stands between them."""
        if not new:
            return
        ids = np.array(self._whole([f" {self.SEPARATOR} ".join(x.decode() for x in new)])[0], np.uint32)
        cuts = np.flatnonzero(ids == self.mark)
        assert len(cuts) == len(new) - 1
        self.pieces.add(new, np.delete(ids, cuts), np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1)

    def _learn(self, new: list[bytes]) -> None:
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            if self.PLAIN.fullmatch(b" ".join(part).decode()):
                self._learn_plain(part)
                continue
            plain = [self.PLAIN.fullmatch(x.decode()) is not None for x in part]
            self._learn_whole([x for x, own in zip(part, plain) if not own])
            self._learn_plain([x for x, own in zip(part, plain) if own])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.in_parts:
            return [np.array(x, np.uint32) for x in self._whole([t or "" for t in texts])]
        if len(self.pieces.index) > REMEMBERED:
            self.forget()
        own: dict[int, np.ndarray] = {}
        flat: list[bytes] = []
        ends = [0]
        for i, text in enumerate(texts):
            if text and (self.SEPARATOR in text or self.SPECIAL in text):
                own[i] = np.array(self._whole([text])[0], np.uint32)
            elif text:
                raw = text.encode()
                # ASCII letters only: lowering them before the library does changes nothing
                flat += (raw.lower() if raw.isascii() else raw).split()
            ends.append(len(flat))
        known = self.pieces.index
        rows = np.fromiter(map(known.get, flat, repeat(-1)), np.int64, len(flat))
        if len(missing := np.flatnonzero(rows < 0).tolist()):
            self._learn(list({flat[k] for k in missing}))
            rows[missing] = [known[flat[k]] for k in missing]
        ids, sizes = self.pieces.take(rows)
        at = np.concatenate(([0], np.cumsum(sizes)))[ends].tolist()
        return [own.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(at, at[1:]))]


def _encoder(tokenizer: str) -> ChunkEncoder:
    """A worker's encoder, which outlives its tasks: looked up here, as what tasks bring along is their own."""
    return memory(f"ids of {tokenizer}", lambda: ChunkEncoder(tokenizer))


def id_type(tokenizer: str) -> str:
    """The smallest unsigned type that holds all ids of a tokenizer file."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None, kind: str = "<u4", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, ids) for each row of ``docs``; ids as little-endian unsigned integers of ``kind`` in a binary column."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [x.astype(kind).tobytes() + end for x in encoder.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, ids binary")


def block_planes(ids: np.ndarray, kind: str, width: int) -> list[bytes]:
    """The bytes of ``ids`` (``width`` bytes each), transposed: one plane for each byte or for each bit."""
    rows = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :width]
    if kind == "byte":
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(width)]
    bits = np.unpackbits(np.ascontiguousarray(rows), axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(8 * width)]


def from_planes(planes: list[bytes], n: int, kind: str, width: int) -> np.ndarray:
    """Inverse of :func:`block_planes`."""
    rows = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k, plane in enumerate(planes):
            rows[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        rows[:, :width] = np.packbits(bits, axis=1, bitorder="little")
    return rows.view("<u4").ravel()


class _ShardWriter:
    def __init__(self, out, kind: str, level: int, block_ids: int, ids_as: str) -> None:
        self.out, self.kind, self.block_ids, self.ids_as = out, kind, block_ids, np.dtype(ids_as)
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at = out.write(MAGIC) or len(MAGIC)
        self.waiting: list[bytes] = []
        self.n_waiting = 0
        self.docs: list[tuple[bool, int, int]] = []
        self.blocks: list[list[int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.ids_as.itemsize
        self.docs.append((doc_id is None, doc_id or 0, n))
        self.waiting.append(ids)
        self.n_waiting += n
        if self.n_waiting >= self.block_ids:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.ids_as)
        whole = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for k in range(0, whole, self.block_ids):
            block = ids[k : min(k + self.block_ids, whole)]
            width = max(1, (int(block.max()).bit_length() + 7) // 8)
            planes = [self.zip.compress(x) for x in block_planes(block, self.kind, width)]
            sizes = [len(x) for x in planes] + [0] * (32 - len(planes))
            self.blocks.append([self.at, len(block), zlib.crc32(block.astype("<u4").tobytes()), width, *sizes])
            for plane in planes:
                self.out.write(plane)
                self.at += len(plane)
        self.waiting, self.n_waiting = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> tuple[int, int]:
        self.flush(True)
        docs, blocks = np.array(self.docs, "<i8").reshape(-1, 3), np.array(self.blocks, "<i8").reshape(-1, 36)
        footer = self.zip.compress(struct.pack("<QQ?", len(docs), len(blocks), self.kind == "bit") + docs.tobytes() + blocks.tobytes())
        self.out.write(footer)
        self.out.write(TRAILER.pack(self.at, len(footer), MAGIC))
        return len(docs), int(docs[:, 2].sum())


def write_shards(tokens: DataFrame, folder: str, kind: str = "byte", level: int = 3, block_ids: int = BLOCK_IDS, ids_as: str = "<u4") -> DataFrame:
    """Write (doc_id, ids) as shard files in ascending doc_id order; returns (shard, uri, n_docs, n_tokens), staged.

    Shards are the partitions of a range partitioning: shard numbers ascend with doc_id.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((x for x in batches if x.num_rows), None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:07d}.planes"

        def body(out):
            writer = _ShardWriter(out, kind, level, block_ids, ids_as)
            batch = first
            while batch is not None:
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                    writer.add(doc_id, ids.as_buffer().to_pybytes())
                batch = next(batches, None)
            return writer.close()

        n_docs, n_tokens = publish(uri, body)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [uri], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    ordered = tokens.select("doc_id", "ids").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), "ids")
    return staged(ordered.mapInArrow(write, "shard long, uri string, n_docs long, n_tokens long"), "shards")


def _documents(file) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """Documents of a shard file with the pieces of their ids, one block in memory at a time."""
    unzip = zstandard.ZstdDecompressor()
    file.seek(file.size() - TRAILER.size)
    at, size, magic = TRAILER.unpack(file.read(TRAILER.size))
    if magic != MAGIC:
        raise ValueError("not a shard of planes")
    file.seek(at)
    footer = unzip.decompress(file.read(size))
    n_docs, n_blocks, bits = struct.unpack_from("<QQ?", footer)
    docs = np.frombuffer(footer, "<i8", 3 * n_docs, 17).reshape(-1, 3)
    blocks = iter(np.frombuffer(footer, "<i8", 36 * n_blocks, 17 + 24 * n_docs).reshape(-1, 36).tolist())
    block = np.zeros(0, "<u4")
    for null, doc_id, length in docs.tolist():
        parts: list[np.ndarray] = []
        while length:
            if not len(block):
                begin, n, crc, width, *sizes = next(blocks)
                file.seek(begin)
                planes = [unzip.decompress(file.read(s)) for s in sizes[: width * (8 if bits else 1)]]
                block = from_planes(planes, n, "bit" if bits else "byte", width)
                if zlib.crc32(block.tobytes()) != crc:
                    raise ValueError("a block's checksum differs")
            parts.append(block[:length])
            length -= len(parts[-1])
            block = block[len(parts[-1]) :]
        yield (None if null else doc_id), parts


def read_shards(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of the shard files, one row each: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 and, ``with_ids``, the ids as array<long>."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
                rows: list[tuple] = []
                held = 0
                with opened(uri) as file:
                    for doc_id, parts in _documents(file):
                        crc, n = 0, 0
                        for part in parts:
                            crc, n = zlib.crc32(part.tobytes(), crc), n + len(part)
                        rows.append((doc_id, start, n, crc, *([np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)] if with_ids else [])))
                        start, held = start + n, held + n
                        if len(rows) >= 5000 or with_ids and held > 1 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[*names, "ids"][: len(kinds)])
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[*names, "ids"][: len(kinds)])

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file only
    placed = shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = max(1, shards.count())
    return placed.select("uri", "start").repartition(parts).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str | None = None, with_ids: bool = False, **how) -> DataFrame:
    """Encode ``docs``, write the shard files and read them back: the whole operator."""
    spark = docs.sparkSession
    ids_as = id_type(tokenizer)
    tokens = staged(encoded(docs, tokenizer, end_id, ids_as), "token-ids")  # range partitioning reads it twice
    shards = write_shards(tokens, folder or new_folder(spark, "planes"), ids_as=ids_as, **how)
    unstaged(tokens)
    return read_shards(shards, with_ids)
