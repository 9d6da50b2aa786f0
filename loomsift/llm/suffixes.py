"""Removal of repeated byte strings with suffix arrays.

A byte goes when a string of 100 bytes that covers it also starts earlier. Every 100-byte window has an anchor, the position
of its smallest hash of 32 bytes; equal windows have it at the same place. Consecutive windows with one anchor make a
context. A context that is there before, whole, needs no sorting: all its windows repeat. Of the contexts left, those whose anchor bytes
occur in another context, too, meet by anchor in shards. In a shard, windows without another of their number are cut away first; what is
left is sorted by induction, its common prefixes come from the permuted array, and runs of suffixes with 100 bytes in common tell
which windows repeat.

Anchors that are very common, found by a count over all data, would gather too many contexts in one shard; their windows are dealt
by their own 100 bytes instead. Which way a window takes has no influence on the result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.llm.common import mapped, stored, with_rows
from loomsift.llm.hashing import VALUE, mixed, range_numbers, sequence_numbers

WIDTH = 100
#: Bytes of an anchor; every window has WIDTH - GRAM + 1 of them.
GRAM = 32
CHUNK = 1 << 20
#: Windows that are hashed at once.
BLOCK = 1 << 14
SHARD_BYTES = 1 << 20
#: An anchor with a larger share of all contexts is common. At most so many can be: the reciprocal.
COMMON = 1 / 20_000

CONTEXT = np.dtype([("gram", "<u8"), ("number", "<u8"), ("row", "<i8"), ("start", "<i4"), ("size", "<i4")])
SPAN = np.dtype([("row", "<i8"), ("start", "<i4"), ("size", "<i4")])
WANTED = np.dtype([("gram", "<u8"), ("row", "<i8"), ("start", "<i4"), ("size", "<i4")])


# -- suffix arrays --------------------------------------------------------------------------------------------------------


def _types(text: np.ndarray) -> np.ndarray:
    """1 for suffixes that are smaller (S) than the next one, 0 for larger (L) ones; the empty suffix at the end is S."""
    n = len(text)
    small = np.zeros(n + 1, np.uint8)
    small[n] = 1
    rises = text[:-1] < text[1:]
    # in a stretch of equal symbols all suffixes are like the last one
    place = np.where(text[:-1] != text[1:], np.arange(n - 1), n)
    ahead = np.minimum.accumulate(place[::-1])[::-1]
    small[: n - 1] = np.where(ahead < n, rises[np.minimum(ahead, n - 2)], False)
    return small


def _induced(text: np.ndarray, small: np.ndarray, size: int, order: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost S suffixes in ``order``.

    A bucket holds the suffixes of one first symbol, the L suffixes before the S ones. What stands in a bucket is passed on in
    blocks: the suffixes one place to the left go to the next free places of their buckets. Only those of the bucket itself
    make a further block, one for each symbol of its longest run of equal symbols.
    """
    n = len(text)
    kind = np.int16 if size < 1 << 15 else np.int64  # 16 bits are sorted by radix
    counts = np.bincount(text, minlength=size)
    tails = np.cumsum(counts)
    heads = tails - counts
    # the symbol before a suffix, if that is the start of an L or of an S suffix, else -1
    before_large, before_small = np.full(n, -1, kind), np.full(n, -1, kind)
    np.copyto(before_large[1:], text[:-1], casting="unsafe", where=small[: n - 1] == 0)
    np.copyto(before_small[1:], text[:-1], casting="unsafe", where=small[: n - 1] == 1)
    array = np.full(n, -1, np.int64)
    present = np.flatnonzero(counts).tolist()

    def pass_on(block: np.ndarray, before: np.ndarray, places: np.ndarray, step: int) -> None:
        """``places`` are the next free ones, of all buckets; they go up or down by ``step``."""
        if len(block) < 8:
            for k in block.tolist():
                if (c := int(before[k])) >= 0:
                    array[places[c]] = k - 1
                    places[c] += step
            return
        symbols = before[block]
        some = symbols >= 0
        block, symbols = block[some], symbols[some]
        if len(block):
            turn = np.argsort(symbols, kind="stable")
            symbols = symbols[turn]
            first = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
            many = np.diff(first, append=len(symbols))
            own = symbols[first]
            array[np.repeat(places[own] - step * first, many) + step * np.arange(len(symbols))] = block[turn] - 1
            places[own] += step * many

    # the leftmost S suffixes at the ends of their buckets
    symbols = text[order]
    turn = np.argsort(symbols.astype(kind), kind="stable")
    many = np.bincount(symbols, minlength=size)
    leftmost = tails - many
    array[np.repeat(leftmost - (np.cumsum(many) - many), many) + np.arange(len(order))] = order[turn]
    fronts = heads.copy()
    array[fronts[text[n - 1]]] = n - 1  # the suffix before the empty one is L
    fronts[text[n - 1]] += 1
    for c in present:
        low = int(heads[c])
        while low < (high := int(fronts[c])):
            pass_on(array[low:high], before_large, fronts, 1)
            low = high
        pass_on(array[int(leftmost[c]) : int(tails[c])], before_large, fronts, 1)
    ends = tails - 1
    for c in reversed(present):
        high = int(tails[c])
        while high > (low := int(ends[c]) + 1):
            pass_on(array[low:high][::-1], before_small, ends, -1)
            high = low
        pass_on(array[int(heads[c]) : int(fronts[c])][::-1], before_small, ends, -1)
    return array


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``names``: ranks by 1, 2, 4, … names, until all differ; those that do are left alone."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.concatenate(([True], names[order[1:]] != names[order[:-1]]))
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(first, append=n))
    have, at = 1, np.arange(n)
    while True:
        # places in the order whose rank is not theirs alone
        alone = np.append(new, True)
        at = at[~(alone[at] & alone[at + 1])]
        if not len(at):
            return order
        own = order[at]
        after = own + have
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[own]
        turn = np.lexsort((key, group))
        own, key, group = own[turn], key[turn], group[turn]
        order[at] = own
        fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        new[at] = fresh
        rank[own] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        have *= 2


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of ``text`` over symbols below ``size`` by induced sorting.

    Suffixes are smaller (S) or larger (L) than the one after them. The leftmost S of each run starts a substring;
    these substrings are sorted by inducing, named, and, if names repeat, ordered by doubling over the names. Once they
    are in order, one pass from the left puts the L suffixes in place and one from the right the S suffixes.
    """
    text = np.asarray(text, np.int64)
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = _types(text)
    starts = np.flatnonzero((small[1:n] == 1) & (small[: n - 1] == 0)) + 1
    array = _induced(text, small, size, starts)
    if len(starts) > 1:
        first = np.zeros(n, bool)
        first[starts] = True
        ordered = array[first[array]]
        place = np.zeros(n, np.int64)
        place[starts] = np.arange(len(starts))
        stop = np.append(starts[1:] + 1, n)[place[ordered]]
        numbers = sequence_numbers(text, ordered, stop)
        # the last substring ends at the empty suffix, unlike any other
        new = (numbers[1:] != numbers[:-1]) | (stop[1:] - ordered[1:] != stop[:-1] - ordered[:-1]) | (stop[1:] == n) | (stop[:-1] == n)
        names = np.empty(len(starts), np.int64)
        names[place[ordered]] = np.concatenate(([0], np.cumsum(new)))
        order = ordered if new.all() else starts[_by_doubling(names)]
        array = _induced(text, small, size, order)
    return array


def permuted_prefixes(text: np.ndarray, array: np.ndarray, limit: int) -> np.ndarray:
    """Per text position, the common prefix with the suffix before it in the array, up to ``limit``.

    Where the symbol to the left of both is the same, it is one less than that of the position to the left. Only the other
    positions are compared, and every ``limit``-th one that follows, over up to twice the limit, so that those between are known up to the limit.
    """
    text = np.asarray(text, np.int64)
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    place = np.arange(n)
    left = np.concatenate(([-1], text))  # the symbol to the left of a position
    fresh = (before < 1) | (left[:-1] != left[before]) | (place == 0)
    since = place - np.maximum.accumulate(np.where(fresh, place, 0))
    compared = since % limit == 0
    # a word holds four symbols, if they are small; behind the end is a symbol like no other
    step = 4 if text.max() < 0xFFFF else 1
    own = np.concatenate((text, np.full(step, 0xFFFF if step > 1 else -1))).astype(np.uint64)
    words = own[:n].copy() if step > 1 else own
    for k in range(1, step):
        words |= own[k : n + k] << np.uint64(16 * k)
    if step > 1:
        words = np.append(words, np.uint64((1 << 64) - 1))
    known = np.zeros(n, np.int64)
    mine = np.flatnonzero(compared & (before >= 0))
    other, held = before[mine], 0
    while len(mine) and held < 2 * limit:
        unlike = words[mine + held] ^ words[other + held]
        for k in range(step - 1):
            known[mine] += unlike & np.uint64((1 << 16 * (k + 1)) - 1) == 0
        alike = unlike == 0
        mine, other = mine[alike], other[alike]
        held += step
        known[mine] = held
    back = place - np.maximum.accumulate(np.where(compared, place, 0))
    return np.minimum(limit, np.maximum(0, known[place - back] - back))


def with_shared_windows(contexts: list[tuple[int, int, bytes]], width: int = WIDTH) -> list[tuple[int, int, bytes]]:
    """Contexts cut to the stretch of their windows whose number another window here has, too; the others can't repeat and go."""
    sizes = np.array([len(c[2]) for c in contexts])
    data = np.frombuffer(b"".join([c[2] for c in contexts]), np.uint8)
    firsts, windows = np.cumsum(sizes) - sizes, sizes - width + 1
    owner = np.repeat(np.arange(len(contexts)), windows)
    offset = np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner]
    at = firsts[owner] + offset
    numbers = range_numbers(data, at, at + width)
    order = np.argsort(numbers, kind="stable")
    same = numbers[order][1:] == numbers[order][:-1]
    shared = np.zeros(len(numbers), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    low, high = np.full(len(contexts), len(data)), np.full(len(contexts), -1)
    np.minimum.at(low, owner[shared], offset[shared])
    np.maximum.at(high, owner[shared], offset[shared])
    return [(c[0], c[1] + a, c[2][a : b + width]) for c, a, b in zip(contexts, low.tolist(), high.tolist()) if b >= 0]


def repeated_in(contexts: list[tuple[int, int, bytes]], width: int = WIDTH) -> np.ndarray:
    """Spans of windows of ``contexts`` ``(row, start, bytes)`` that also start earlier in one of them."""
    rows = np.array([c[0] for c in contexts], np.int64)
    starts = np.array([c[1] for c in contexts], np.int64)
    sizes = np.array([len(c[2]) for c in contexts])
    # symbols are bytes plus one; a zero ends each context, and no window holds one
    data = (np.frombuffer(b"".join([c[2] + b"\0" for c in contexts]), np.uint8).astype(np.int64)) + 1
    data[np.cumsum(sizes + 1) - 1] = 0
    array = suffix_array(data, 257)
    prefixes = permuted_prefixes(data, array, width)
    firsts = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    offset = np.arange(len(data)) - firsts[owner]
    run = np.cumsum(prefixes[array] < width)
    fits = (offset + width <= sizes[owner])[array]
    run, at = run[fits], array[fits]
    row, start = rows[owner[at]], starts[owner[at]] + offset[at]
    order = np.lexsort((start, row, run))
    run, row, start = run[order], row[order], start[order]
    # the same window of the same text can come with two contexts
    new = np.concatenate(([True], run[1:] != run[:-1]))
    group = np.cumsum(new) - 1
    again = (row != row[new][group]) | (start != start[new][group])
    return spans_of(row[again], start[again], width)


def spans_of(row: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Windows as spans, overlapping and touching ones of a row joined."""
    if not len(row):
        return np.empty(0, SPAN)
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + width)))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    spans = np.empty(len(first), SPAN)
    spans["row"], spans["start"], spans["size"] = row[first], start[first], start[last] + width - start[first]
    return spans


# -- contexts -------------------------------------------------------------------------------------------------------------


def gram_numbers(data: np.ndarray, size: int) -> np.ndarray:
    """Numbers of all strings of ``size`` bytes, a power of two, by doubling.

    They are polynomials modulo 2^64 and for short strings only. An anchor that two strings share by chance makes a shard larger, no more.
    """
    numbers, have, base = VALUE[data], 1, 0x9E3779B97F4A7C15
    while have < size:
        ahead = numbers[have:]
        numbers = numbers[: len(ahead)] * np.uint64(base)
        numbers += ahead
        have, base = 2 * have, base * base % (1 << 64)
    return mixed(numbers)


def window_minima(keys: np.ndarray, size: int) -> np.ndarray:
    have = 1
    while 2 * have <= size:
        keys = np.minimum(keys[: len(keys) - have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (size - have)], keys[size - have :])


def _stretches(raws: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of all contexts of ``raws``, put together: the number and place of the anchor, begin, end, and the text and its begin; and the bytes.

    Texts are gone through in blocks that stay in the cache of a core.
    """
    sizes = np.array([len(r) for r in raws], np.int64)
    data = np.frombuffer(b"".join(raws), np.uint8)
    firsts = np.cumsum(sizes) - sizes
    windows = len(data) - width + 1
    bits = np.uint64((BLOCK + width).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(BLOCK + width, dtype=np.uint64)
    grams, anchors, begins, last = [], [], [], -1
    for at in range(0, windows, BLOCK):
        numbers = gram_numbers(data[at : at + BLOCK + width - 1], gram)
        keys = numbers & ~low
        keys |= place[: len(keys)]
        smallest = window_minima(keys, width - gram + 1)
        new = np.empty(len(smallest), bool)
        new[0] = at + int(smallest[0] & low) != last
        np.not_equal(smallest[1:], smallest[:-1], out=new[1:])
        new[firsts[np.searchsorted(firsts, at) : np.searchsorted(firsts, at + len(new))] - at] = True
        begin = np.flatnonzero(new)
        anchor = (smallest[begin] & low).astype(np.int64)
        grams.append(numbers[anchor])
        anchors.append(anchor + at)
        begins.append(begin + at)
        last = at + int(smallest[-1] & low)
    if not begins:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none, none, none, data
    begin, anchor, number = np.concatenate(begins), np.concatenate(anchors), np.concatenate(grams)
    owner = np.searchsorted(firsts, begin, "right") - 1
    # a context ends where the next begins or the piece has no more windows
    stop = np.minimum(np.append(begin[1:], windows), (firsts + sizes - width + 1)[owner])
    own = stop > begin
    return number[own], anchor[own], begin[own], stop[own] + width - 1, owner[own], firsts[owner[own]], data


def contexts_of(rows: list[int], raws: list[bytes], begins: list[int], width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """Contexts of pieces of texts ``(row, bytes, place in the text)``: every window of every piece is in exactly one."""
    number, anchor, begin, end, owner, first, data = _stretches(raws, width, gram)
    found = np.empty(len(begin), CONTEXT)
    if not len(begin):
        return found
    found["gram"] = number
    inside = range_numbers(data, begin, end)
    found["number"] = mixed(inside + (anchor - begin).astype(np.uint64))
    found["row"] = np.array(rows, np.int64)[owner]
    found["start"] = begin - first + np.array(begins)[owner]
    found["size"] = end - begin
    return found


def _pieces(batches: Iterator[pa.RecordBatch], width: int, chunk: int) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """Rows, bytes and places of texts of about ``chunk`` bytes together; long texts in pieces that share ``width - 1`` bytes."""
    rows, raws, begins, held = [], [], [], 0
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = text.encode("utf-8", "surrogatepass")
            for at in range(0, max(1, len(raw) - width + 1), chunk):
                rows.append(row)
                raws.append(raw[at : at + chunk + width - 1])
                begins.append(at)
                held += len(raws[-1])
                if held >= chunk:
                    yield rows, raws, begins
                    rows, raws, begins, held = [], [], [], 0
    if rows:
        yield rows, raws, begins


def _first_of_each(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by text and place; tells for each whether it is the first of its text."""
    order = np.lexsort((found["start"], found["row"], found["number"], found["gram"]))
    found = found[order]
    same = (found["gram"][1:] == found["gram"][:-1]) & (found["number"][1:] == found["number"][:-1])
    return found, np.concatenate(([True], ~same))[: len(found)]


BLOBS = "bucket int, blob binary"
FOUND = "row bigint, spans binary, wanted binary"


def _blobs(bucket: np.ndarray, rows: np.ndarray, offset: int = 0) -> pa.RecordBatch:
    """One row per bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.empty(0, np.int64)
    stop = np.append(first[1:], len(bucket))
    blobs = [rows[a:b].tobytes() for a, b in zip(first.tolist(), stop.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[first] + offset, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"]
    )


def _by_row(spans: np.ndarray, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row per document with its spans and its contexts that are wanted."""
    columns: list[list] = [[], [], []]
    for k, part in enumerate((spans, wanted)):
        part = part[np.argsort(part["row"], kind="stable")]
        row = part["row"]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.empty(0, np.int64)
        stop = np.append(first[1:], len(row))
        blobs = [part[a:b].tobytes() for a, b in zip(first.tolist(), stop.tolist())]
        columns[0] += row[first].tolist()
        columns[1 + k] += blobs
        columns[2 - k] += [None] * len(blobs)
    for at in range(0, len(columns[0]), 20_000):
        arrays = [pa.array(c[at : at + 20_000], t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "spans", "wanted"])


def _common_grams(rows: DataFrame, width: int, gram: int, share: float) -> np.ndarray:
    """Anchors with more than ``share`` of all contexts; only those with a few in some part of the input are counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for part in _pieces(batches, width, CHUNK):
            found = _stretches(part[1], width, gram)[0]
            total += len(found)
            grams, counts = np.unique(found, return_counts=True)
            often = counts >= max(4, share * len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[often].view(np.int64)), pa.array(counts[often], pa.int64())], names=["gram", "n"]
            )
        yield pa.RecordBatch.from_pydict({"gram": pa.array([None], pa.int64()), "n": pa.array([total], pa.int64())})

    counted = mapped(rows.select("row", "text"), count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = stored(counted, "grams")
    total = counted.filter("gram IS NULL").agg(F.sum("n")).first()[0] or 0
    least = max(64, int(total * share))
    common = counted.filter(F.col("gram").isNotNull() & (F.col("n") > least)).select("gram").collect()  # at most 1 / share
    return np.sort(np.array([r[0] for r in common], np.int64).view(np.uint64))


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def repeated_spans(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, share: float = COMMON, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(row, text, blobs)`` of every row with its spans to remove, in parts."""
    spark = rows.sparkSession
    buckets = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    common = spark.sparkContext.broadcast(_common_grams(rows, width, gram, share))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches, width, CHUNK):
            found = contexts_of(*part, width, gram)
            if not len(found):
                continue
            found, first = _first_of_each(found)
            usual = ~_is_in(found["gram"], common.value)
            # what is there before in this part, whole, repeats; it only has to pass
            sure = found[~first]
            again = np.zeros(len(sure), CONTEXT)
            for name in ("row", "start", "size"):
                again[name] = sure[name]
            again["number"] = 0
            yield _blobs((mixed(sure["row"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), again, -buckets)
            own = found[first & usual]
            yield _blobs((mixed(own["gram"]) % np.uint64(buckets)).astype(np.int64), own)
            own = _windows_of(found[first & ~usual], part, width)
            yield _blobs((mixed(own["number"]) % np.uint64(buckets)).astype(np.int64), own, buckets)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {0: [], 1: [], 2: []}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts[bucket // buckets + 1].append(np.frombuffer(blob, CONTEXT))
        sure, usual, single = (np.concatenate(p) if p else np.empty(0, CONTEXT) for p in parts.values())
        usual, first = _first_of_each(usual)
        single, alone = _first_of_each(single)
        gone = np.concatenate((sure, usual[~first], single[~alone]))
        spans = np.empty(len(gone), SPAN)
        for name in SPAN.names:
            spans[name] = gone[name]
        kept = usual[first]
        shared = np.zeros(len(kept), bool)
        if len(kept):
            same = kept["gram"][1:] == kept["gram"][:-1]
            shared[1:] |= same
            shared[:-1] |= same
        wanted = np.empty(int(shared.sum()), WANTED)
        for name in WANTED.names:
            wanted[name] = kept[name][shared]
        yield from _by_row(spans, wanted)

    dealt = mapped(rows.select("row", "text"), split, BLOBS).repartition("bucket")
    found = stored(mapped(dealt, meet, FOUND), "contexts")
    texts = rows.select("row", "doc_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces: dict[int, list] = {}
            for row, text, asked in zip(*[c.to_pylist() for c in batch.columns]):
                raw = text.encode("utf-8", "surrogatepass")
                wanted = np.concatenate([np.frombuffer(a, WANTED) for a in asked])
                heads, dealt_to = wanted.tobytes(), (mixed(wanted["gram"]) % np.uint64(buckets)).tolist()
                for k, (start, size) in enumerate(zip(wanted["start"].tolist(), wanted["size"].tolist())):
                    head = heads[k * WANTED.itemsize : (k + 1) * WANTED.itemsize]
                    pieces.setdefault(dealt_to[k], []).append(head + raw[start : start + size])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(pieces), pa.int32()), pa.array([b"".join(p) for p in pieces.values()], pa.binary())], names=["bucket", "blob"]
            )

    def sorted_shard(shard: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
        shard = with_shared_windows(shard, width)
        return [repeated_in(shard, width)] if shard else []

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                at = 0
                while at < len(blob):
                    g, row, start, size = np.frombuffer(blob, WANTED, 1, at)[0].item()
                    at += WANTED.itemsize
                    held.append((g, row, start, blob[at : at + size]))
                    at += size
        held.sort()
        shard, size, last = [], 0, None
        spans = []
        for g, row, start, raw in held:
            if size >= shard_bytes and g != last:
                spans += sorted_shard(shard)
                shard, size = [], 0
            shard.append((row, start, raw))
            size += len(raw)
            last = g
        if shard:
            spans += sorted_shard(shard)
        yield from _by_row(np.concatenate(spans) if spans else np.empty(0, SPAN), np.empty(0, WANTED))

    asked = found.filter("wanted IS NOT NULL").groupBy("row").agg(F.collect_list("wanted").alias("asked"))
    cuts = mapped(texts.join(asked, "row").select("row", "text", "asked"), cut, BLOBS).repartition("bucket")
    late = mapped(cuts, sort, FOUND)
    spans = found.select("row", "spans").unionAll(late.select("row", "spans")).filter("spans IS NOT NULL")
    spans = spans.groupBy("row").agg(F.collect_list("spans").alias("blobs"))
    return texts.join(spans, "row", "left")


def _windows_of(found: np.ndarray, part: tuple, width: int) -> np.ndarray:
    """The windows of contexts, each with a number of its own bytes."""
    if not len(found):
        return found
    rows, raws, begins = part
    places: dict[tuple[int, int], int] = {}
    firsts = np.cumsum([0] + [len(r) for r in raws])
    data = np.frombuffer(b"".join(raws), np.uint8)
    by_row: dict[int, list[int]] = {}
    for k, row in enumerate(rows):
        by_row.setdefault(row, []).append(k)
    starts, who = [], []
    for k, (row, start, size) in enumerate(zip(found["row"].tolist(), found["start"].tolist(), found["size"].tolist())):
        piece = next(p for p in by_row[row] if begins[p] <= start and start + size <= begins[p] + len(raws[p]))
        first = int(firsts[piece]) + start - begins[piece]
        starts.append(np.arange(first, first + size - width + 1))
        who.append(np.full(size - width + 1, k))
    at, who = np.concatenate(starts), np.concatenate(who)
    single = np.zeros(len(at), CONTEXT)
    single["number"] = range_numbers(data, at, at + width)
    single["row"], single["size"] = found["row"][who], width
    head = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(found)))[:-1]])
    single["start"] = found["start"][who] + np.arange(len(at)) - head[who]
    return single


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, share: float = COMMON, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)``: a row per row of ``docs``, with the bytes that stay.

    Removed are the bytes covered by a string of ``width`` bytes that also starts earlier, in a text with a smaller id or
    earlier in the same text; strings may overlap, never cross texts, and are judged on the input. ``spans`` are the maximal removed runs
    ``[start, end)`` in bytes of UTF-8. Null texts are empty. Rows with equal or null ids are texts of their own in the order of id, nulls
    last, and text. An empty table gives no rows.
    """
    rows, _ = with_rows(docs)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                columns: list[list] = [[], [], [], []]
                for doc_id, text, blobs in zip(*[c.to_pylist() for c in batch.slice(at, 500).columns]):
                    raw = text.encode("utf-8", "surrogatepass")
                    spans, kept = _without(raw, blobs)
                    for column, value in zip(columns, (doc_id, len(raw), spans, kept)):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_bytes", "spans", "kept"])

    joined = repeated_spans(rows, width, gram, share, shard_bytes).select("doc_id", "text", "blobs")
    return mapped(joined, finish, "doc_id bigint, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary")


def _without(raw: bytes, blobs: list[bytes] | None) -> tuple[list[dict], bytes]:
    if not blobs:
        return [], raw
    found = np.concatenate([np.frombuffer(b, SPAN) for b in blobs])
    step = np.zeros(len(raw) + 1, np.int64)
    np.add.at(step, found["start"], 1)
    np.add.at(step, found["start"] + found["size"], -1)
    gone = np.cumsum(step)[:-1] > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).tolist()
    spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])]
    return spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()
