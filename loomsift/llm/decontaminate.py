"""Benchmark decontamination with a positional inverted index.

The index is split by documents: each row is a segment with the postings of all words of some documents. A segment
holds its terms as sorted 64-bit numbers of words and, per term, the ascending positions of the word in the segment.
A phrase is looked up inside a segment: the lists of its terms are intersected, each moved back by its place in the phrase,
starting with the rarest. Postings are never shuffled, and no word, however frequent, meets in one task.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.llm.common import id_text, kept_columns, mapped, pieces_of, stored, with_rows
from loomsift.llm.hashing import range_numbers, word_ranges

WINDOW = 10
SEGMENT_BYTES = 6 << 20
#: Characters of benchmark text that are sent to the tasks at once; larger benchmarks are searched in blocks.
BLOCK_CHARS = 8 << 20

INDEX_SCHEMA = (
    "doc_ids array<bigint>, doc_starts binary, terms binary, ends binary, postings binary"
)
# a word byte: digits, a-z after lower-casing, and all bytes of non-ASCII characters
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit numbers of the words of lower-cased UTF-8 bytes."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_ranges(data, _IS_WORD)
    return starts, ends, range_numbers(data, starts, ends)


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of ``docs`` (``doc_id, text``); a row per about ``segment_bytes`` of text, each document inside one segment."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches, size=segment_bytes):
            texts = part.column(1).to_pylist()
            raws = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
            starts, _, numbers = words_of(b"\n".join(raws))
            offsets = np.cumsum([0] + [len(r) + 1 for r in raws])
            doc_starts = np.searchsorted(starts, offsets)
            doc_starts[-1] = len(starts)
            order = np.argsort(numbers, kind="stable")
            ordered = numbers[order]
            firsts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)
            ends = np.append(firsts[1:], len(ordered)) if len(ordered) else firsts
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())),
                    *[
                        pa.array([np.ascontiguousarray(a, t).tobytes()], pa.binary())
                        for a, t in ((doc_starts, "<i4"), (ordered[firsts], "<u8"), (ends, "<i4"), (order, "<i4"))
                    ],
                ],
                names=["doc_ids", "doc_starts", "terms", "ends", "postings"],
            )

    return mapped(id_text(docs), index, INDEX_SCHEMA)


@dataclass
class Segment:
    """One row of the index."""

    doc_ids: list
    starts: np.ndarray
    terms: np.ndarray
    ends: np.ndarray
    postings: np.ndarray

    @classmethod
    def of(cls, row: dict) -> "Segment":
        return cls(
            row["doc_ids"], np.frombuffer(row["doc_starts"], "<i4"), np.frombuffer(row["terms"], "<u8"),
            np.frombuffer(row["ends"], "<i4"), np.frombuffer(row["postings"], "<i4"),
        )

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Row of each term in the term table, -1 where the segment doesn't have it."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def list_of(self, place: int) -> np.ndarray:
        return self.postings[self.ends[place - 1] if place else 0 : self.ends[place]]

    def find(self, places: np.ndarray, slop: int = 0) -> np.ndarray:
        """Starts of the phrase with these terms: each within ``slop`` words of its place, 0 for the exact phrase.

        The rarest list is moved back by its place in the phrase; every other list, in order of rarity, then keeps those
        starts that it has a posting for.
        """
        sizes = self.ends[places] - np.where(places > 0, self.ends[places - 1], 0)
        order = np.argsort(sizes, kind="stable")
        found = self.list_of(int(places[order[0]])) - int(order[0])
        for offset in order[1:]:
            if not len(found):
                break
            postings = self.list_of(int(places[offset]))
            at = np.searchsorted(postings, found + int(offset) - slop)
            near = postings[np.minimum(at, len(postings) - 1)]
            found = found[(at < len(postings)) & (near <= found + int(offset) + slop)]
        found = found[found >= 0]
        doc = np.searchsorted(self.starts, found, side="right") - 1
        return found[found + len(places) <= self.starts[np.minimum(doc + 1, len(self.starts) - 1)]]


def windows(text: str | None, size: int = WINDOW) -> list[np.ndarray]:
    """Numbers of the words of each window of ``size`` consecutive words; a shorter text is one window, one without words none."""
    _, _, numbers = words_of((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(numbers):
        return []
    return [numbers[k : k + size] for k in range(max(1, len(numbers) - size + 1))]


def _blocks(benchmark: DataFrame, item: str, text: str, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in parts of about ``block_chars``, dealt by a hash of the item."""
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 + total // block_chars
    for k in range(parts):
        yield [(r["item"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k).toLocalIterator()]


HITS = "segment bigint, doc_no int, doc_id bigint, n_words bigint, hits array<struct<item:string,start:int,stop:int>>"


def search(
    index: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW, slop: int = 0,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Where windows of the benchmark occur: ``(segment, doc_no, doc_id, n_words, hits)``, a row per document and block.

    ``hits`` has maximal stretches ``[start, stop)`` of words covered by occurrences of windows of an item. ``slop`` of 0
    finds exact phrases; above, proximity matches: every word within so many words of its place in the phrase. Also
    documents without hits have their row. The benchmark, a query set, goes to the tasks in blocks of a bounded size.
    """
    numbered = index.withColumn("segment", F.monotonically_increasing_id())
    sc, parts = index.sparkSession.sparkContext, []
    for block in _blocks(benchmark, item, text, block_chars):
        asked = sc.broadcast(Phrases.of(block, size))

        def look(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    yield _hits_of(Segment.of(row), row["segment"], asked.value, slop)

        parts.append(mapped(numbered, look, HITS))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    if len(parts) > 1:
        keys = ["segment", "doc_no", "doc_id", "n_words"]
        found = found.groupBy(*keys).agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return found


@dataclass
class Phrases:
    """Distinct windows of some items as arrays: the terms, the place among them of every word of every window, and the items of each."""

    names: list[str]
    terms: np.ndarray
    words: np.ndarray
    ends: np.ndarray
    owners: np.ndarray
    owner_ends: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[str, str]], size: int) -> "Phrases":
        names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(names)}
        own: dict[bytes, set[int]] = {}
        for name, body in items:
            for w in windows(body, size):
                own.setdefault(w.tobytes(), set()).add(number[name])
        terms, words = np.unique(np.frombuffer(b"".join(own), np.uint64), return_inverse=True)
        owners = np.array([k for group in own.values() for k in sorted(group)], np.int32)
        return cls(names, terms, words.astype(np.int32), np.cumsum([len(w) // 8 for w in own], dtype=np.int64), owners, np.cumsum([len(g) for g in own.values()], dtype=np.int64))

    def within(self, segment: Segment) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Places of the terms in ``segment``, and the items, of those windows whose terms are all there."""
        if not len(self.ends):
            return
        places = segment.places(self.terms)[self.words]
        firsts, owner_firsts = (np.concatenate(([0], e[:-1])) for e in (self.ends, self.owner_ends))
        for k in np.flatnonzero(np.logical_and.reduceat(places >= 0, firsts)).tolist():
            yield places[firsts[k] : self.ends[k]], [self.names[o] for o in self.owners[owner_firsts[k] : self.owner_ends[k]].tolist()]


def _hits_of(segment: Segment, number: int, phrases: Phrases, slop: int) -> pa.RecordBatch:
    spans: dict[tuple[int, str], list[list[int]]] = {}
    for own, names in phrases.within(segment):
        starts = segment.find(own, slop)
        docs = np.searchsorted(segment.starts, starts, side="right") - 1
        for doc, start in zip(docs.tolist(), (starts - segment.starts[docs]).tolist()):
            for name in names:
                spans.setdefault((doc, name), []).append([start, start + len(own)])
    hits: list[list] = [[] for _ in segment.doc_ids]
    for (doc, name), ranges in sorted(spans.items()):
        merged: list[list[int]] = []
        for start, stop in sorted(ranges):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(stop, merged[-1][1])
            else:
                merged.append([start, stop])
        hits[doc] += [{"item": name, "start": a, "stop": b} for a, b in merged]
    n = len(segment.doc_ids)
    kind = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(segment.doc_ids, pa.int64()),
            pa.array(np.diff(segment.starts), pa.int64()), pa.array(hits, kind),
        ],
        names=["segment", "doc_no", "doc_id", "n_words", "hits"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """``(doc_id, n_words, n_hit, items, contaminated)``, a row per row of ``docs``.

    ``n_hit`` counts words inside any occurrence of a window, ``items`` are the sorted ids of items with such windows.
    Null texts have no words; a null item id counts as an empty one; items with equal ids are taken together; an empty
    benchmark finds nothing. Rows with equal or null ids are documents of their own, each with a row; texts of any length are indexed whole, in segments of
    documents; an empty table gives no rows; other columns, whatever their names, play no part. The index is written to the shared folder once and read by the search.
    """
    found = search(stored(build_index(docs), "index"), benchmark, size=size, slop=slop)
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to"))
    ranges = F.array_sort(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["stop"].alias("stop"))))

    def add(acc, r):
        new = F.greatest(F.lit(0), r["stop"] - F.greatest(r["start"], acc["to"]))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["to"], r["stop"]).alias("to"))

    hit = F.aggregate(ranges, zero, add)["n"]
    items = F.array_sort(F.array_distinct(F.col("hits.item")))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), items.alias("items")).withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs; null texts become empty."""
    rows, _ = with_rows(docs, carry=True)
    found = contamination(rows.select(F.col("row").alias("doc_id"), "text"), benchmark, size)
    hit = found.filter("contaminated").select(F.col("doc_id").alias("row"))
    return kept_columns(rows.join(hit, "row", "left_anti"), docs)
