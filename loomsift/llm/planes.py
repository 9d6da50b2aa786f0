"""Token ids of documents in ordered shard files of compressed byte or bit planes.

File format, little-endian. A shard holds the ids of documents in ascending order of id, one after the other::

    block 0, block 1, …          per block: its planes, each a zstandard frame
    document table               zstandard frame: per document int64 id, 8-bit null flag, int64 number of ids
    chunk index                  per block: int64 first id, int32 ids, int32 planes, then int64 offset and int32 bytes of each plane
    footer                       int64 offset and bytes of the document table, int64 offset and number of blocks of the chunk
                                 index, int64 documents, int64 ids, 8 bytes magic

Byte plane k of a block holds byte k of each id; bit plane k holds bit k of each id, packed. Planes that are all
zero at the top are left out.
"""

import io
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomsift.llm.common import Published, file_system, id_text, mapped, pieces_of, shared_files
from loomsift.llm.counts import BLANKS, LATIN, PRE_TOKEN, SPECIAL, VOCABULARY, load

MAGIC = b"IDPLANE1"
FOOTER = struct.Struct("<6q8s")
BLOCK = 1 << 16


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of one block of unsigned 32-bit ids, lowest first, without empty ones at the top."""
    top = int(ids.max()) if len(ids) else 0
    if bits:
        rows = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        return [np.packbits(rows[:, k], bitorder="little").tobytes() for k in range(top.bit_length())]
    columns = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return [columns[k].tobytes() for k in range((top.bit_length() + 7) // 8)]


def from_planes(planes: list[bytes], count: int, bits: bool) -> np.ndarray:
    if bits:
        rows = np.zeros((count, 32), np.uint8)
        for k, plane in enumerate(planes):
            rows[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=count, bitorder="little")
        return np.packbits(rows, axis=1, bitorder="little").reshape(-1).view("<u4")
    columns = np.zeros((count, 4), np.uint8)
    for k, plane in enumerate(planes):
        columns[:, k] = np.frombuffer(plane, np.uint8)
    return columns.reshape(-1).view("<u4")


class ShardWriter:
    """Takes documents in order, keeps one block in memory."""

    def __init__(self, folder: str, name: str, bits: bool, block: int = BLOCK):
        self.file, self.bits, self.block = Published(folder, name), bits, block
        self.pending: list[np.ndarray] = []
        self.held = self.total = self.documents = self.blocks = 0
        self.index, self.table = io.BytesIO(), io.BytesIO()
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.table.write(struct.pack("<qBq", doc_id or 0, doc_id is None, len(ids)))
        self.documents += 1
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(whole=True)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint32)
        end = len(ids) // self.block * self.block if whole else len(ids)
        for at in range(0, end, self.block):
            part = ids[at : min(at + self.block, end)]
            planes = [self.pack.compress(p) for p in to_planes(part, self.bits)]
            self.index.write(struct.pack("<qii", self.total, len(part), len(planes)))
            for plane in planes:
                self.index.write(struct.pack("<qi", self.file.write(plane), len(plane)))
            self.total += len(part)
            self.blocks += 1
        self.pending, self.held = [ids[end:]], len(ids) - end

    def close(self) -> tuple[int, int]:
        """Documents and ids of the shard."""
        self._flush(whole=False)
        table = self.pack.compress(self.table.getvalue())
        where = self.file.write(table)
        at = self.file.write(self.index.getvalue())
        self.file.write(FOOTER.pack(where, len(table), at, self.blocks, self.documents, self.total, MAGIC))
        self.file.commit()
        return self.documents, self.total


class ShardReader:
    """Reads a shard through its chunk index; ``ids`` decodes only the blocks that it needs."""

    def __init__(self, path: str, bits: bool):
        system, name = file_system(path)
        self.file, self.bits = system.open_input_file(name), bits
        size = self.file.size()
        where, length, at, blocks, self.documents, self.total, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of id planes")
        self.unpack = zstandard.ZstdDecompressor()
        raw = self.unpack.decompress(self.file.read_at(length, where), max_output_size=max(1, 17 * self.documents))
        table = np.frombuffer(raw, np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<i8")]))
        self.doc_ids = [None if null else int(i) for i, null in zip(table["id"], table["null"])]
        self.counts = table["n"].astype(np.int64)
        index, self.chunks, p = self.file.read_at(size - FOOTER.size - at, at), [], 0
        for _ in range(blocks):
            first, count, planes = struct.unpack_from("<qii", index, p)
            p += 16
            self.chunks.append((first, count, [struct.unpack_from("<qi", index, p + 12 * k) for k in range(planes)]))
            p += 12 * planes
        self.firsts = np.array([c[0] for c in self.chunks] or [0])
        self._last: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))

    def _chunk(self, k: int) -> np.ndarray:
        if self._last[0] != k:
            _, count, planes = self.chunks[k]
            raw = [self.unpack.decompress(self.file.read_at(n, at), max_output_size=count) for at, n in planes]
            self._last = (k, from_planes(raw, count, self.bits))
        return self._last[1]

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start`` of the shard."""
        parts, k = [], max(0, int(np.searchsorted(self.firsts, start, side="right")) - 1)
        while count:
            chunk, at = self._chunk(k), start - self.chunks[k][0]
            part = chunk[at : at + count]
            parts.append(part)
            start, count, k = start + len(part), count - len(part), k + 1
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


class WordIds:
    """Ids of texts, by words whose ids stand one after the other in one buffer.

    Latin texts are cut into pre-tokens here. Of other texts the blank-free strings with other characters, or with ``<|``, go through the
    library whole, as the vocabulary drops white space and joins nothing across it. Many new words are encoded as one text with blanks
    between, which is cut after each token that ends a word. All words are forgotten when there are more than ``limit``.
    """

    def __init__(self, path: str, limit: int = 500_000):
        self.tokenizer, self.ends_word = load(path)
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.starts: list[np.ndarray] = []
        self.buffer, self.used = np.zeros(1 << 20, np.uint32), 0

    def _keep(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Ids of ``words``, one after the other, each up to its end."""
        while self.used + len(ids) > len(self.buffer):
            self.buffer = np.concatenate((self.buffer, np.zeros_like(self.buffer)))
        self.buffer[self.used : self.used + len(ids)] = ids
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words))))
        self.starts.append(np.concatenate(([0], ends[:-1])) + self.used)
        self.used += len(ids)

    def _learn(self, words: set[str]) -> None:
        plain = [w for w in words if w[0] != ODD]
        odd = [w for w in words if w[0] == ODD]
        for at in range(0, len(plain), 1000):  # what the library returns is large
            part = plain[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("a pre-token is not one for the library")
            self._keep(part, ids, ends)
        for at in range(0, len(odd), 1000):
            part = odd[at : at + 1000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w[1:] for w in part], add_special_tokens=False)]
            self._keep(part, np.array([i for own in found for i in own], np.uint32), np.cumsum([len(own) for own in found]))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.place) > self.limit:
            self._forget()
        words = [words_of(t) for t in texts]
        every = [w for own in words for w in own]
        new = set(every).difference(self.place)
        if new:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, every), np.int64, len(every))
        starts = np.concatenate([*self.starts, [self.used]])
        if len(self.starts) > 64:
            self.starts = [starts[:-1]]
        first = starts[at]
        sizes = starts[at + 1] - first
        ends = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.buffer[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
        bounds = ends[np.concatenate(([0], np.cumsum([len(own) for own in words])))].tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]


#: Marks a string that the library encodes whole; no pre-token begins with it.
ODD = "\0"


def words_of(text: str) -> list[str]:
    """Pre-tokens of a text in order, and between them the strings that are left to the library."""
    if SPECIAL not in text and LATIN.fullmatch(text):
        return PRE_TOKEN.findall(text.lower())
    found = []
    for word in BLANKS.split(text):
        if SPECIAL not in word and LATIN.fullmatch(word):
            found += PRE_TOKEN.findall(word.lower())
        else:
            found.append(ODD + word)
    return found


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """What a worker has encoded serves its later tasks too."""
    return WordIds(path)


#: Bytes of text in a shard at most, about; shards are smaller where the shuffle partitions are more than it takes.
SHARD_BYTES = 256 << 20


def write_ids(
    docs: DataFrame, folder: str, vocabulary_path: str | None = None, end_id: int = 1, bits: bool = False, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, and write shards; the manifest ``(shard, file, documents, ids)`` comes back.

    Rows are dealt into ranges of ``doc_id``, as many as it takes for about ``shard_bytes`` of text each; so shard numbers follow the order of ids; rows with equal ids are
    neighbours, in order of text, and null ids come first. Null texts are empty: one end id. An empty table gives no files.
    ``doc_id`` alone decides the range, so one id on a great many rows would meet in one shard, streamed, not held.
    """

    vocabulary_path = vocabulary_path or public_tokenizers.path(VOCABULARY)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = word_ids(vocabulary_path)
        shard, writer, name = TaskContext.get().partitionId(), None, ""
        end = np.array([end_id], np.uint32)
        for part in pieces_of(batches, size=1 << 20):
            if writer is None:
                name = f"ids-{shard:06d}.planes"
                writer = ShardWriter(folder, name, bits)
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.ids(part.column(1).to_pylist())):
                writer.add(doc_id, np.concatenate((ids, end)))
        if writer is not None:
            documents, total = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{folder}/{name}"], "documents": [documents], "ids": [total]})

    total = id_text(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    ordered = id_text(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = mapped(ordered, encode, "shard bigint, file string, documents bigint, ids bigint")
    # written once: the files are written while this small table, a row per shard, is computed
    manifest.write.parquet(f"{folder}/_manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/_manifest")


def read_ids(manifest: DataFrame, bits: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files of a manifest; ``start`` counts the ids of all documents before."""
    before = F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))  # a row per shard
    placed = manifest.select("file", F.coalesce(before, F.lit(0)).alias("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = ShardReader(file, bits)
                starts = np.concatenate(([0], np.cumsum(reader.counts)))
                for lo in range(0, reader.documents, 256):
                    hi = min(lo + 256, reader.documents)
                    ids = [reader.ids(int(starts[k]), int(reader.counts[k])) for k in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.doc_ids[lo:hi], pa.int64()),
                            pa.array(first + starts[lo:hi], pa.int64()),
                            pa.array(reader.counts[lo:hi], pa.int64()),
                            pa.array([np.ascontiguousarray(i).tobytes() for i in ids], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = placed.repartition(parts, "file")
    return mapped(dealt, decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def id_digests(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """Write all documents and read them back: ``(doc_id, start, n_tokens, ids_crc32)``."""
    read = read_ids(write_ids(docs, shared_files(docs.sparkSession, "ids"), vocabulary_path))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
