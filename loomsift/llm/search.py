"""Ranked lexical search with bit-sliced Bloom signatures.

Every document has a Bloom signature of its terms, and of each term once more per level of its count (2, 3, 4, 6, 8, …). Documents
of like size stand together, and a block of them is turned into slices: one bitmap over documents per bit of the signature. Two
slices joined by AND tell where a term may be; they may say too much, never too little. The weights of the terms times these bitmaps, level by level, sum up to
an upper bound of the score of each document for each item. A document is scored exactly from its text unless its bound is below the k-th best exact score.
"""

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomsift.llm.common import mapped, pieces_of, stored
from loomsift.llm.hashing import mixed

#: Letters, digits and all that is not ASCII make terms; A-Z are lowered, everything else parts them.
_TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
#: Counts of a term that have an entry of their own.
LEVELS = [1, *sorted([1 << k for k in range(1, 40)] + [3 << k for k in range(39)])]
#: Bits of a signature per entry at least; two of them are set for each.
BITS_PER_ENTRY = 8
LEAST_BITS, MOST_BITS = 7, 27
#: Documents and bytes of text that are written next to each other, documents of a block when read, and terms that are looked up at once.
RUN, RUN_BYTES, BLOCK, TERMS = 512, 2 << 20, 512, 4096
#: Bits of all signatures of a block, with eight documents at least.
BLOCK_BITS = 1 << 28
#: Different terms a task counts documents of before it writes them.
HELD_TERMS = 500_000
#: Items that are answered in one pass over the index, and terms of them.
ITEMS, ITEM_TERMS = 256, 200_000

INDEX = "doc_id bigint, n bigint, bits int, signature binary, text binary, terms array<binary>, dfs array<bigint>"
_INDEX = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("bits", pa.int32()), ("signature", pa.binary()), ("text", pa.binary()),
    ("terms", pa.list_(pa.binary())), ("dfs", pa.list_(pa.int64())),
])


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return text.translate(_TERM_BYTES).split()


def _hashes(crcs: np.ndarray, level: int) -> np.ndarray:
    return mixed(crcs + np.uint64((level + 1) << 33))


def signature(counts: Counter) -> tuple[int, bytes]:
    """Binary logarithm of the bits of a signature, and the signature."""
    crcs = np.fromiter(map(zlib.crc32, counts), np.uint64, len(counts))
    tfs = np.fromiter(counts.values(), np.int64, len(counts))
    found, level = [], 0
    while len(crcs):
        found.append(_hashes(crcs, level))
        level += 1
        more = tfs >= LEVELS[level]
        crcs, tfs = crcs[more], tfs[more]
    entries = np.concatenate(found)
    log = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_ENTRY * len(entries) - 1).bit_length()))
    mask = np.uint64((1 << log) - 1)
    row = np.zeros(1 << log, np.uint8)
    row[entries & mask] = 1
    row[entries >> np.uint64(32) & mask] = 1
    return log, np.packbits(row).tobytes()


def build_index(docs: DataFrame) -> DataFrame:
    """Rows with a signature and text per document that has terms, and rows with the number of documents per term, partial; stored.

    It depends on the documents alone and serves any items.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[tuple]] = {}
        sizes: Counter = Counter()
        dfs: Counter = Counter()

        def run_of(log: int) -> pa.RecordBatch:
            sizes[log] = 0
            rows = runs.pop(log)
            columns = [list(c) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip([*columns, [None] * len(rows), [None] * len(rows)], _INDEX)], schema=_INDEX
            )

        def counted() -> Iterator[pa.RecordBatch]:
            each = sorted(dfs.items())
            dfs.clear()
            for at in range(0, len(each), 200_000):
                parts = [each[k : k + 2000] for k in range(at, min(at + 200_000, len(each)), 2000)]
                yield pa.RecordBatch.from_pylist([{"terms": [t for t, _ in p], "dfs": [n for _, n in p]} for p in parts], _INDEX)

        for batch in pieces_of(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                terms = terms_of(text)
                if not terms:
                    continue
                counts = Counter(terms)
                dfs.update(counts.keys())
                log, bits = signature(counts)
                runs.setdefault(log, []).append((doc_id, len(terms), log, bits, text))
                sizes[log] += len(text)
                if len(runs[log]) >= RUN or sizes[log] >= RUN_BYTES:
                    yield run_of(log)
            if len(dfs) > HELD_TERMS:
                yield from counted()
        for log in sorted(runs):
            yield run_of(log)
        yield from counted()

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    return stored(mapped(plain, write, INDEX), "signatures")


class Items:
    """What the tasks need to know of a block of items: their terms, and the weight of each."""

    def __init__(self, terms: list[list[bytes]], weight: dict[bytes, int]):
        self.scored = [[(t, weight[t]) for t in own if weight.get(t, 0) > 0] for own in terms]
        known = sorted({t for own in self.scored for t, _ in own})
        place = {t: k for k, t in enumerate(known)}
        self.crcs = np.array([zlib.crc32(t) for t in known], np.uint64)
        self.weights = [(np.array([place[t] for t, _ in own], np.int64), np.array([w for _, w in own], np.int64)) for own in self.scored]
        # sums of whole numbers up to 2^24 are exact in single precision
        self.kind = np.float32 if max([int(w.sum()) for _, w in self.weights], default=0) < 1 << 24 else np.float64

    def table(self, first: int, count: int) -> np.ndarray:
        """Weights (item, term) of ``count`` terms from ``first``."""
        out = np.zeros((len(self.weights), count), self.kind)
        for k, (at, w) in enumerate(self.weights):
            here = (at >= first) & (at < first + count)
            out[k, at[here] - first] = w[here]
        return out


def slices_of(signatures: list[bytes], log: int) -> np.ndarray:
    """Bitmaps over documents, one per bit of their signatures."""
    rows = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)
    if log >= 16 and len(signatures) > 8:  # eight documents at a time, as all bits of long signatures are many bytes
        parts = [slices_of(signatures[k : k + 8], log) for k in range(0, len(signatures), 8)]
        return np.concatenate(parts, axis=1)
    return np.packbits(np.unpackbits(rows, axis=1).T, axis=1)


def upper_bounds(items: Items, slices: np.ndarray, log: int, m: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
    """Bounds (item, document) of the scores of a block; ``m`` are the length factors of its documents."""
    docs, mask = len(m), np.uint64((1 << log) - 1)
    bounds = np.zeros((len(items.weights), docs))
    for number, first in enumerate(range(0, len(items.crcs), TERMS)):
        crcs = items.crcs[first : first + TERMS]
        table = items.table(first, len(crcs)) if tables is None else tables[number]
        left, bits, gain, level = np.arange(len(crcs)), None, np.zeros(docs), 0
        while len(left):
            entry = _hashes(crcs[left], level)
            now = slices[(entry & mask).astype(np.int64)] & slices[(entry >> np.uint64(32) & mask).astype(np.int64)]
            now = now if bits is None else now & bits  # who has it three times has it twice
            some = now.any(axis=1)
            left, bits = left[some], now[some]
            if not len(left):
                break
            most = LEVELS[level + 1] - 1
            before, gain = gain, 1e9 * most / (1000 * most + 20 * m)
            shown = np.unpackbits(bits, axis=1, count=docs).astype(items.kind)
            bounds += (table[:, left] @ shown) * (gain - before)
            level += 1
    return bounds * (1 + 1e-9)


class Best:
    """The ``k`` best documents of each item that a task has seen: highest score, then lowest id, nulls last."""

    def __init__(self, items: Items, k: int):
        self.items, self.k = items, k
        self.heaps: list[list[tuple]] = [[] for _ in items.scored]
        self.rescored = self.seen = 0

    def _floor(self, item: int) -> int:
        heap = self.heaps[item]
        return heap[0][0] if len(heap) == self.k else 1

    def block(self, bounds: np.ndarray, ids: list[int | None], m: list[int], texts: pa.Array) -> None:
        counts: dict[int, Counter] = {}
        self.seen += bounds.size
        floors = np.array([self._floor(k) for k in range(len(self.heaps))], np.float64)
        open_ = bounds >= floors[:, None]
        for item in np.flatnonzero(open_.any(axis=1)).tolist():
            docs = np.flatnonzero(open_[item])
            heap, scored = self.heaps[item], self.items.scored[item]
            for d in docs[np.argsort(-bounds[item, docs], kind="stable")].tolist():
                if bounds[item, d] < self._floor(item):
                    break
                if d not in counts:
                    counts[d] = Counter(terms_of(texts[d].as_py()))
                self.rescored += 1
                score = exact_score(scored, counts[d], m[d])
                if score <= 0:
                    continue
                entry = (score, ids[d] is not None, -(ids[d] or 0))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)


def exact_score(scored: list[tuple[bytes, int]], counts: Counter, m: int) -> int:
    total = 0
    for term, w in scored:
        tf = counts.get(term)
        if tf:
            total += w * (10**9 * tf // (1000 * tf + 20 * m))
    return total


def _answers(index: DataFrame, items: Items, n_docs: int, n_terms: int, k: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, tables = Best(items, k), None
        for batch in batches:
            logs = batch.column(2).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(logs)) + 1).tolist(), len(logs)]
            tables = tables or [items.table(f, min(TERMS, len(items.crcs) - f)) for f in range(0, len(items.crcs), TERMS)]
            for lo, hi in zip(edges, edges[1:]):
                log = int(logs[lo])
                step = max(8, min(BLOCK, BLOCK_BITS >> log))
                for at in range(lo, hi, step):
                    ids, ns, _, rows, texts = batch.slice(at, min(step, hi - at)).columns
                    m = [50 + 50 * n * n_docs // n_terms for n in ns.to_pylist()]
                    bounds = upper_bounds(items, slices_of(rows.to_pylist(), log), log, np.array(m, np.float64), tables)
                    best.block(bounds, ids.to_pylist(), m, texts)
        rows = [(item, -e[2] if e[1] else None, e[0]) for item, heap in enumerate(best.heaps) for e in heap]
        if rows:
            arrays = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(arrays, names=["item", "doc_id", "score"])

    found = mapped(index.select("doc_id", "n", "bits", "signature", "text").filter("bits IS NOT NULL"), search, "item bigint, doc_id bigint, score bigint")
    # the best of each task are cut to those of 64 parts before an item's answers meet
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = F.row_number().over(W.partitionBy("item", "part").orderBy(*order))
    parts = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("r", rank).filter(F.col("r") <= k)
    rank = F.row_number().over(W.partitionBy("item").orderBy(*order))
    return parts.select("item", "doc_id", "score").withColumn("rank", rank).filter(F.col("rank") <= k)


def _blocks_of(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their different terms, so many at once as one pass answers."""
    held, size = [], 0
    for row in items.toLocalIterator():
        terms = sorted(set(terms_of((row["text"] or "").encode())))
        if held and (len(held) == ITEMS or size + len(terms) > ITEM_TERMS):
            yield held
            held, size = [], 0
        held.append((row["item_id"], terms))
        size += len(terms)
    if held:
        yield held


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents of highest score above 0 for each item.

    Items are answered in blocks, each in one pass over the signatures of all documents; the number of documents is not
    bounded anywhere, and neither is the length of a text. Null and empty texts have no terms: such documents count nowhere, such items have no
    rows. Rows with one id are documents, or items, of their own; equal scores stand in ascending order of id, null ids last. Empty
    tables give no rows. Extra columns, whatever their names, play no part.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    totals = index.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(totals[0]), int(totals[1])
    plain = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in _blocks_of(plain):
        terms = sorted({t for _, own in block for t in own})
        asked = spark.createDataFrame([(bytearray(t),) for t in terms], "term binary")
        counts = index.filter("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "dfs")).alias("z")).select("z.terms", "z.dfs")
        found = counts.join(asked, counts["terms"] == asked["term"], "left_semi").groupBy("terms").agg(F.sum("dfs").alias("df")).collect()
        weight = {bytes(r["terms"]): math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in found}
        ranked = _answers(index, Items([own for _, own in block], weight), n_docs, n_terms, k)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "item bigint, item_id bigint")
        named = ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = named if out is None else out.unionAll(named)
    return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out
