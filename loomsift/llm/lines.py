"""Removal of repeated lines by pairwise alignment.

Documents that share lines are compared in pairs, a later one with the first that has the line. Patience diff aligns the lines of a
pair: lines that both have once are anchors, the longest chain of anchors in order stays, and matches grow from there. A stretch without
such lines is divided at its longest common block. Aligned common blocks go from the later document.
"""

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.llm.common import mapped, pieces_of, stored, with_rows

#: Lines, as a multiple of those of a pair, that are looked at for blocks without a unique line.
WORK = 40
#: Characters of an aligned block, blanks at the ends of lines aside, from which it goes.
BLOCK_CHARS = 40


#: Bytes of the number of a line, a keyed digest, so that different lines never pass for equal.
WIDTH = 16
_KEY, _BLANK = b"lines of texts", bytes(WIDTH)


def line_numbers(text: str) -> tuple[bytes, np.ndarray]:
    """Numbers of the stripped lines of a text, one after the other, zero for blank ones, and their lengths."""
    lines = [line.strip() for line in text.split("\n")]
    numbers = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=WIDTH, key=_KEY).digest() if x else _BLANK for x in lines]
    return b"".join(numbers), np.array([len(x) for x in lines])


def small_numbers(*lists: bytes) -> list[list[int]]:
    """The numbers of lines of some texts as small ones, equal for equal lines, 0 for blank ones."""
    known = {_BLANK: 0}
    return [[known.setdefault(raw[k : k + WIDTH], len(known)) for k in range(0, len(raw), WIDTH)] for raw in lists]


def patience(a: list[int], b: list[int], sizes: list[int] | None = None) -> list[tuple[int, int]]:
    """Aligned pairs ``(place in a, place in b)``, both ascending, of equal lines. Blank lines (0) are matched next to others only.

    ``sizes`` are the lengths of the lines of ``a``, by which blocks are compared; without them a line counts 1. Stretches that are divided very
    often, as those of periodic lines, are aligned from line to line in the end, so that time stays linear but for a constant.
    """
    if sizes is None:
        sizes = [int(line != 0) for line in a]
    found, stack = [], [(0, len(a), 0, len(b))]
    work = WORK * (len(a) + len(b)) + 10_000
    while stack:
        alo, ahi, blo, bhi = stack.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            found.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            found.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        at = _once(a, alo, ahi)
        once = _once(b, blo, bhi)
        both = sorted((k, once[line]) for line, k in at.items() if line and line in once)
        chain = _longest(both)
        last = (alo, blo)
        for i, j in chain:
            found.append((i, j))
            stack.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
        if chain:
            stack.append((last[0], ahi, last[1], bhi))
            continue
        work -= ahi - alo + bhi - blo
        if work < 0:
            found += _nearest(a, b, alo, ahi, blo, bhi)
        elif block := _longest_block(a, b, alo, ahi, blo, bhi, sizes):
            i, j, n = block
            found += [(i + k, j + k) for k in range(n)]
            stack += [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
    return sorted(found)


def _longest_block(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int, sizes: list[int]) -> tuple[int, int, int] | None:
    """``(place in a, place in b, lines)`` of the common block of two stretches with the most characters, the first of equal ones; None if only blank lines are common.

    The suffix automaton of the stretch of ``b`` reads that of ``a``: time is linear in both, however often a line is repeated.
    """
    if set(b[blo:bhi]).isdisjoint(line for line in a[alo:ahi] if line):
        return None
    steps: list[dict[int, int]] = [{}]
    links, lengths, ends, tip = [-1], [0], [-1], 0
    for j in range(blo, bhi):
        line, state, new = b[j], tip, len(steps)
        steps.append({})
        links.append(0)
        lengths.append(lengths[tip] + 1)
        ends.append(j)
        while state >= 0 and line not in steps[state]:
            steps[state][line] = new
            state = links[state]
        if state >= 0:
            to = steps[state][line]
            if lengths[to] > lengths[state] + 1:
                copy = len(steps)
                steps.append(dict(steps[to]))
                links.append(links[to])
                lengths.append(lengths[state] + 1)
                ends.append(ends[to])
                links[to] = links[new] = copy
                while state >= 0 and steps[state].get(line) == to:
                    steps[state][line] = copy
                    state = links[state]
            else:
                links[new] = to
        tip = new
    best, block, state, n, held = 0, None, 0, 0, 0
    for i in range(alo, ahi):
        line = a[i]
        while state and line not in steps[state]:
            state = links[state]
            held -= sum(sizes[i - n : i - lengths[state]])
            n = lengths[state]
        if line in steps[state]:
            state, n, held = steps[state][line], n + 1, held + sizes[i]
        if held > best:
            best, block = held, (i + 1 - n, ends[state] + 1 - n, n)
    return block


def _nearest(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Aligned pairs from the front on: where two lines differ, the side goes on that has the other's line nearer."""
    places: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
    for own, lines, low, high in ((places[0], a, alo, ahi), (places[1], b, blo, bhi)):
        for k in range(low, high):
            own.setdefault(lines[k], []).append(k)

    def skip(own: dict[int, list[int]], line: int, at: int) -> int:
        held = own.get(line, [])
        k = bisect.bisect_left(held, at)
        return held[k] - at if line and k < len(held) else len(a) + len(b)

    found, i, j = [], alo, blo
    while i < ahi and j < bhi:
        if a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
            continue
        to_b, to_a = skip(places[1], a[i], j), skip(places[0], b[j], i)
        if i + to_a >= ahi and j + to_b >= bhi:
            i, j = i + 1, j + 1
        elif to_b <= to_a:
            j += to_b
        else:
            i += to_a
    return found


def _once(lines: list[int], low: int, high: int) -> dict[int, int]:
    """Places of the lines that are in a stretch once."""
    seen: dict[int, int] = {}
    for k in range(low, high):
        seen[lines[k]] = -1 if lines[k] in seen else k
    return {line: k for line, k in seen.items() if k >= 0}


def _longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain with ascending second places, by piles."""
    tops, piles, back = [], [], {}
    for i, j in pairs:
        k = bisect.bisect_left(tops, j)
        back[(i, j)] = piles[k - 1] if k else None
        if k == len(tops):
            tops.append(j)
            piles.append((i, j))
        else:
            tops[k], piles[k] = j, (i, j)
    chain, pair = [], piles[-1] if piles else None
    while pair is not None:
        chain.append(pair)
        pair = back[pair]
    return chain[::-1]


def common_blocks(later: list[int], earlier: list[int], sizes: list[int], least: int) -> list[tuple[int, int]]:
    """Ranges of lines of ``later`` in aligned blocks with ``least`` characters or more."""
    found, begin, held, last = [], 0, 0, None
    for i, j in [*patience(later, earlier, sizes), (-9, -9)]:
        if last is not None and (i, j) == (last[0] + 1, last[1] + 1):
            held += sizes[i]
        else:
            if last is not None and held >= least:
                found.append((begin, last[0] + 1))
            begin, held = i, sizes[i] if i >= 0 else 0
        last = (i, j)
    return found


LINES = "row bigint, numbers binary, sizes binary"
CUTS = "row bigint, first int, stop int"


def aligned_cuts(rows: DataFrame, rare: int | None = None, least: int = BLOCK_CHARS) -> DataFrame:
    """``(row, first, stop)``: ranges of lines to delete. ``rare`` as in ``drop_repeated_lines``."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches):
            found = [line_numbers(t) for t in part.column(1).to_pylist()]
            arrays = [pa.array([f[0] for f in found], pa.binary()), pa.array([f[1].astype("<i4").tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["row", "numbers", "sizes"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                # half of a number is enough to find partners; alignments compare whole ones
                own = [np.unique(np.frombuffer(b, "<u8")[:: WIDTH // 8]) for b in part.column(1).to_pylist()]
                line = np.concatenate(own)
                row = np.repeat(np.array(part.column(0), np.int64), [len(o) for o in own])
                full = line != 0
                yield pa.RecordBatch.from_arrays([pa.array(line[full].view(np.int64)), pa.array(row[full])], names=["line", "row"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = []
            for at in range(0, batch.num_rows, 500):
                for row, own, sizes, other in zip(*[c.to_pylist() for c in batch.slice(at, 500).columns]):
                    cuts += [(row, a, b) for a, b in common_blocks(*small_numbers(own, other), np.frombuffer(sizes, "<i4").tolist(), least)]
            kinds = (pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cuts], t) for k, t in enumerate(kinds)], names=["row", "first", "stop"])

    lists = stored(mapped(rows.select("row", "text"), number, LINES), "lines")
    lines = mapped(lists.select("row", "numbers"), each, "line bigint, row bigint")
    # stored, so that both sides of the join come from plain shuffles and adaptive execution can split a very common line
    owners = stored(lines.groupBy("line").agg(F.min("row").alias("owner"), F.count("*").alias("n")).filter("n > 1"), "owners")
    shared = lines.join(owners, "line").filter("row > owner")
    if rare is not None:
        bound = shared.groupBy("row").agg(F.greatest(F.min("n"), F.lit(rare)).alias("bound"))
        shared = shared.join(bound, "row").filter("n <= bound")
    pairs = shared.select("row", "owner").distinct()
    later = lists.select("row", F.col("numbers").alias("own"), "sizes")
    earlier = lists.select(F.col("row").alias("owner"), F.col("numbers").alias("other"))
    return mapped(pairs.join(later, "row").join(earlier, "owner").select("row", "own", "sizes", "other"), align, CUTS)


def drop_repeated_lines(docs: DataFrame, rare: int | None = None, least: int = BLOCK_CHARS, carry: bool = False) -> DataFrame:
    """``(doc_id, text, n_lines, n_removed)``, with ``carry`` also the struct ``rest`` of the other columns: a row per row of ``docs``, without the lines of aligned common blocks.

    Earlier means a smaller id. Lines are compared without blanks at their ends. A later document is aligned with the first owner of each of its lines,
    however common; there are at most as many pairs as shared lines. Only where ``rare`` is set, it is aligned with the owners of its lines in at most
    so many documents, or of its rarest shared lines if it has none of these. Blocks under ``least`` characters stay. All
    comparisons use the input, so that a block in a chain of copies stays in the first of them. Null texts are empty and have one blank
    line. Rows with equal or null ids are documents of their own in the order of id, nulls last, and text. A
    very common line costs one aggregate with map-side merging and a join with one row per line, split by adaptive execution.
    """
    rows, _ = with_rows(docs, carry)
    more = ["rest"] if carry else []
    cuts = aligned_cuts(rows, rare, least).groupBy("row").agg(F.collect_list(F.struct("first", "stop")).alias("cuts"))
    joined = rows.join(cuts, "row", "left").select("doc_id", "text", "cuts", *more)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_of(batches):
            texts, totals, removed = [], [], []
            for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                lines = text.split("\n")
                gone = np.zeros(len(lines), bool)
                for r in ranges or []:
                    gone[r["first"] : r["stop"]] = True
                texts.append("\n".join([line for line, g in zip(lines, gone.tolist()) if not g]) if gone.any() else text)
                totals.append(len(lines))
                removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), *part.columns[3:]],
                names=["doc_id", "text", "n_lines", "n_removed", *more],
            )

    rest = f", rest {joined.schema['rest'].dataType.simpleString()}" if carry else ""
    return mapped(joined, cut, f"doc_id bigint, text string, n_lines bigint, n_removed bigint{rest}")
