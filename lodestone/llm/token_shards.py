"""Token-id output as sorted-string-table shards.

Documents are range-partitioned by id, sorted, encoded and written one file per partition: blocks of entries with
prefix-compressed keys, a sparse index (first key of each block), a Bloom filter and a footer. A point lookup reads
the footer, asks the filter, finds the block by binary search and scans that block alone.

File: blocks | index | filter | footer. Block: zstd of entries; entry: shared, suffix and value lengths as varints,
key suffix, value. Key: id as 8 bytes, big-endian with the sign bit flipped (so bytes order as numbers); a null id is
the empty key, first of all. Value: ids, little-endian, 2 bytes each if the block needs no more, else 4.

A task writes under a name of its own and the manifest names the files of tasks that succeeded, so lost or repeated
attempts leave at most orphans. Files are written and read through pyarrow.fs by URI, in the shared folder.

Defined cases: null text is empty (the end id alone); very long texts are encoded whole, in pieces; repeated ids are entries side by side, ordered by text; extra
columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

END_ID = 2
BLOCK_BYTES = 1 << 18
BITS_PER_KEY, N_HASHES = 10, 7
MAGIC = b"LSST0001"
FOOTER = struct.Struct("<QQQQQQ8s")  # index offset and length, filter offset and length, documents, ids, magic
#: Pieces of text whose ids a worker keeps; longer pieces are not kept.
CACHE_PIECES, CACHE_CHARS = 1_200_000, 48
#: Marks that a piece may end in.
MARKS = ".,;:!?"
#: Atoms that have white space in no place but for one space before them, and how many go to the tokenizer at once.
PLAIN, LINES = re.compile(r" ?\S+").fullmatch, 4096
#: A space that has another white space, or the text's start or end, beside it.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ODD_SPACE = rf"(?:\A|{SPACE})\x20|\x20(?:\z|{SPACE})"
#: Rows that are taken as Python strings at once, and characters that are encoded together (a longer text alone).
ROWS, CALL_CHARS = 256, 8_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    A byte-level BPE splits before a single space between two other characters whatever stands around it, so a text
    is cut there, and each distinct piece is encoded once per worker by the tokenizer, and looked up once per call.
    """

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.feed = (self.tokenizer.encode("\n", add_special_tokens=False).ids or [-1])[0]
        self.ids: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    @staticmethod
    def pieces(text: str) -> list[str]:
        parts = text.split(" ")
        if all(parts) and list(map(str.strip, parts)) == parts:
            return [parts[0], *[f" {p}" for p in parts[1:]]]
        return re.split(r"(?<=\S)(?= \S)", text)

    @staticmethod
    def atoms(piece: str) -> list[str]:
        """A piece cut where the tokenizer splits too: around a lone line feed, and before a mark after letters."""
        head, feed, tail = piece.partition("\n")
        if feed and head and tail and not head[-1].isspace() and not tail[0].isspace():
            return [*Encoder.atoms(head), feed, *Encoder.atoms(tail)]
        if len(piece) > 2 and piece[-1] in MARKS and piece[1:-1].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            return [piece[:-1], piece[-1]]
        return [piece]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Pieces are told apart in Arrow, looked up once each, and put in order as arrays."""
        whole = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(whole, ODD_SPACE).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for rows, of in ((np.flatnonzero(~odd), self.split), (np.flatnonzero(odd), self.searched)):
            if len(rows):
                pieces, at, counts = of(whole.take(pa.array(rows)))
                for row, ids in zip(rows.tolist(), self.joined(pieces, at, counts), strict=True):
                    out[row] = ids
        return out

    @staticmethod
    def split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Texts that may be cut at every space: pieces, the piece at each place, the number of places of each text."""
        parts = pc.split_pattern(texts, " ")
        flat, starts = parts.flatten().dictionary_encode(), parts.offsets.to_numpy()
        pieces, at = [f" {p}" for p in strings(flat.dictionary)], flat.indices.to_numpy().copy()
        at[starts[:-1] - starts[0]] = len(pieces) + np.arange(len(texts))  # the first piece has no space before it
        return [*pieces, *[t.partition(" ")[0] for t in strings(texts)]], at, np.diff(starts)

    @classmethod
    def searched(cls, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        cut = [cls.pieces(t) for t in strings(texts)]
        flat = pa.array([p for ps in cut for p in ps], pa.large_string()).dictionary_encode()
        return strings(flat.dictionary), flat.indices.to_numpy(), np.array([len(ps) for ps in cut])

    def joined(self, pieces: list[str], at: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The ids of each text from those of its pieces."""
        values = self.values(pieces)
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        ids, n = np.frombuffer(b"".join(values), "<u4"), size[at]
        after = np.cumsum(n)  # ids up to and with each place
        shift = (np.cumsum(size) - size)[at] - after + n
        out = ids[np.repeat(shift, n) + np.arange(n.sum())].tobytes()
        ends = (np.concatenate([[0], after])[np.cumsum(counts)] * 4).tolist()
        return [out[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def values(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces."""
        if len(self.ids) > CACHE_PIECES:
            self.ids.clear()
        out = list(map(self.ids.get, pieces))
        new = dict.fromkeys([p for p, v in zip(pieces, out, strict=True) if v is None])
        cut = {p: atoms for p in new if (p[-1:] in MARKS or "\n" in p) and len(atoms := self.atoms(p)) > 1}
        single = dict.fromkeys(p for p in new if p not in cut)
        single.update((a, None) for atoms in cut.values() for a in atoms if a not in self.ids)
        found = self.tokenized(list(single))
        for piece, atoms in cut.items():
            found[piece] = b"".join([found[a] if a in found else self.ids[a] for a in atoms])
        self.ids.update((p, v) for p, v in found.items() if len(p) <= CACHE_CHARS)
        return [found[p] if v is None else v for p, v in zip(pieces, out, strict=True)]

    def tokenized(self, atoms: list[str]) -> dict[str, bytes]:
        """Ids of distinct atoms. Those without white space go to the tokenizer as lines: it splits at a lone line feed."""
        found, lines, other = {}, [], []
        for a in atoms:
            (lines if PLAIN(a) else other).append(a)
        for i in range(0, len(lines), LINES):
            some = lines[i : i + LINES]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            feeds = np.flatnonzero(ids == self.feed)
            if len(feeds) != len(some) - 1:  # not a tokenizer that does
                other += some
                continue
            starts, ends, raw = [0, *(4 * feeds + 4).tolist()], [*(4 * feeds).tolist(), 4 * len(ids)], ids.tobytes()
            found.update((a, raw[s:e]) for a, s, e in zip(some, starts, ends, strict=True))
        for i in range(0, len(other), LINES):
            some = other[i : i + LINES]
            for a, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                found[a] = np.array(e.ids, "<u4").tobytes()
        return found


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 127) << shift
        shift += 7
        at += 1
        if b[at - 1] < 128:
            return n, at


def bloom_places(key: bytes, n_bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    return [(h + i * ((h >> 32) | 1)) % n_bits for i in range(N_HASHES)]


class Writer:
    """One shard file; entries come in key order. A block, the index and the keys (for the filter) are held."""

    def __init__(self, uri: str):
        self.files, self.path = fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.path)
        self.pack = zstandard.ZstdCompressor(level=1)
        self.block: list[tuple[bytes, bytes]] = []
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.size = self.at = self.n_ids = self.block_ids = 0

    def add(self, key: bytes, ids: bytes) -> None:
        self.block.append((key, ids))
        self.keys.append(key)
        self.size += len(ids)
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.block:
            return
        values = [np.frombuffer(v, "<u4") for _, v in self.block]
        narrow = max(int(v.max()) for v in values) < 65536
        body, last = [b"\x02" if narrow else b"\x04"], b""
        for (key, _), v in zip(self.block, values, strict=True):
            shared = len(os.path.commonprefix([last, key]))
            value = v.astype("<u2").tobytes() if narrow else v.tobytes()
            body += [varint(shared), varint(len(key) - shared), varint(len(value)), key[shared:], value]
            last = key
        packed = self.pack.compress(b"".join(body))
        self.out.write(packed)
        self.index.append((self.block[0][0], self.at, len(packed), self.n_ids))
        self.at += len(packed)
        self.n_ids += sum(map(len, values))
        self.block, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) + varint(ids) for k, at, n, ids in self.index)
        n_bits = max(64, len(self.keys) * BITS_PER_KEY)
        bits = bytearray(-(-n_bits // 8))
        for k in self.keys:
            for p in bloom_places(k, n_bits):
                bits[p >> 3] |= 1 << (p & 7)
        bloom = struct.pack("<Q", n_bits) + bytes(bits)
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.n_ids, MAGIC))
        self.out.close()


class Reader:
    """A shard file: point lookups and scans."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.f = files.open_input_file(path)
        size = self.f.size()
        index_at, index_n, bloom_at, bloom_n, self.n_docs, self.n_ids, magic = FOOTER.unpack(self.f.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard file")
        raw, at, self.index = self.f.read_at(index_n, index_at), 0, []
        while at < len(raw):
            n, at = read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = read_varint(raw, at)
            length, at = read_varint(raw, at)
            ids, at = read_varint(raw, at)
            self.index.append((key, offset, length, ids))
        bloom = self.f.read_at(bloom_n, bloom_at)
        (self.n_bits,), self.bits = struct.unpack("<Q", bloom[:8]), bloom[8:]

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, length, _ = self.index[i]
        raw, at, key = zstandard.ZstdDecompressor().decompress(self.f.read_at(length, offset)), 1, b""
        kind = "<u2" if raw[0] == 2 else "<u4"
        while at < len(raw):
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            n, at = read_varint(raw, at)
            key, at = key[:shared] + raw[at : at + rest], at + rest
            yield key, np.frombuffer(raw[at : at + n], kind)
            at += n

    def scan(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, ids of all documents before it in this file, ids) in key order."""
        for i, (*_, start) in enumerate(self.index):
            for key, ids in self.block(i):
                yield id_of(key), start, ids
                start += len(ids)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in bloom_places(key_of(doc_id), self.n_bits))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document with this id; reads no block if the filter denies it."""
        if not self.may_hold(doc_id):
            return []
        key, out = key_of(doc_id), []
        first = max(0, bisect_right([k for k, *_ in self.index if k < key], key) - 1)
        for i in range(first, len(self.index)):
            if self.index[i][0] > key:
                break
            out += [ids for k, ids in self.block(i) if k == key]
        return out


def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """(ids, texts) of consecutive rows, some CALL_CHARS characters each."""
    keys, texts, chars = [], [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            rows = batch.slice(i, ROWS)
            for key, text in zip(rows.column(0).to_pylist(), strings(rows.column(1)), strict=True):
                text = text or ""
                if chars and chars + len(text) > CALL_CHARS:
                    yield keys, texts
                    keys, texts, chars = [], [], 0
                keys.append(key)
                texts.append(text)
                chars += len(text)
    if keys:
        yield keys, texts


def write_shards(docs: DataFrame, uri: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encodes (doc_id, text) and writes the files under ``uri``; returns their manifest: path, first_id, last_id,
    n_docs, n_ids, part (files in key order by part)."""
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        path, writer, first, last = f"{uri}/shard-{part:06d}-{uuid.uuid4().hex}.sst", None, None, None
        for keys, texts in calls(batches):
            for doc_id, ids in zip(keys, encoder.encode(texts), strict=True):
                if writer is None:
                    writer, first = Writer(path), doc_id
                writer.add(key_of(doc_id), ids + end)
                last = doc_id
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64()), "n_docs": [len(writer.keys)], "n_ids": [writer.n_ids], "part": pa.array([part], pa.int32())})

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return stored(rows.mapInArrow(write, "path string, first_id long, last_id long, n_docs long, n_ids long, part int"), "sst-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32, path."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, start, ids in Reader(path).scan():
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 8192:
                        yield as_batch(rows, path)
                        rows = []
                if rows:
                    yield as_batch(rows, path)

    def as_batch(rows: list[tuple], path: str) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([path] * len(rows))], names=["doc_id", "start", "n_tokens", "ids_crc32", "path"])

    before = F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")  # a row per file
    files = manifest.select("path", before.alias("base"))
    return files.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_shards(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/lodestone/sst-{uuid.uuid4().hex}", default_tokenizer())
    return read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
