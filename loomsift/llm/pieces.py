"""Encoding and decoding with a piece vocabulary: the N best segmentations of a text.

The lattice of a text has a node between any two characters and an edge for every piece that fits. The forward pass gives the best
score from the start to each node. Backward from the end, these scores are exact estimates for what is missing of a partial
path, so A-star search pops whole segmentations in order of their score. No piece crosses the front of a word, so
the lattice of a text is a chain of the lattices of its words; words are solved once and their results are put together.
"""

import heapq
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.llm.common import TOKENIZERS, Memo, id_text, mapped, pieces_of, without_cycle_search

MARK = "▁"
#: Longer units are solved one by one.
LONG = 64
_UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Units that also end where a sign follows a letter or number.
_FINE = re.compile(rf"{MARK}*[^\w{MARK}\n]*\w+|{MARK}*[^\w{MARK}\n]+|{MARK}+|\n")
_OVER = re.compile(rf"\w[^\w{MARK}]")


class PieceTable:
    """Hash table of all pieces and their prefixes that looks up the substrings of many texts at once."""

    BITS, PROBES = 18, 64
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, scores: dict[str, tuple[int, float]]):
        self.keys = np.zeros((1 << self.BITS) + self.PROBES, np.uint64)
        self.full = np.zeros(len(self.keys), bool)
        self.ids = np.full(len(self.keys), -1, np.int32)
        self.values = np.full(len(self.keys), -np.inf)
        prefixes: dict[str, np.uint64] = {"": np.uint64(0)}
        with np.errstate(over="ignore"):
            for piece in sorted(scores, key=len):
                for k in range(1, len(piece) + 1):
                    if piece[:k] not in prefixes:
                        key = prefixes[piece[:k]] = self._next(prefixes[piece[: k - 1]], np.uint64(ord(piece[k - 1])))
                        slots = int(self._slot(key)) + np.arange(self.PROBES)
                        free = slots[~self.full[slots]]
                        if not len(free):
                            raise ValueError("the table of pieces is too full")
                        self.keys[free[0]], self.full[free[0]] = key, True
                        if piece[:k] in scores:
                            self.ids[free[0]], self.values[free[0]] = scores[piece[:k]]

    def _next(self, key, char):
        key = (key ^ (char + np.uint64(1))) * self.FACTOR
        return key ^ (key >> np.uint64(31))

    def _slot(self, key):
        return (key * self.FACTOR >> np.uint64(64 - self.BITS)).astype(np.int64)

    def look_up(self, chars: np.ndarray, left: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Per length and start, the id and score of the piece there, -1 and -inf without one.

        A start that no longer begins a piece is not followed any further.
        """
        ids = np.full((reach, len(chars)), -1, np.int32)
        values = np.full((reach, len(chars)), -np.inf)
        at, key = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
        for size in range(1, reach + 1):
            fits = left[at] >= size
            at, key = at[fits], key[fits]
            key = self._next(key, chars[at + size - 1].astype(np.uint64))
            slot = self._slot(key)
            open_ = np.arange(len(at))
            for _ in range(self.PROBES):
                missed = self.keys[slot[open_]] != key[open_]
                open_ = open_[missed]
                if not len(open_):
                    break
                ended = ~self.full[slot[open_]]
                slot[open_[ended]] = -1
                open_ = open_[~ended]
                if not len(open_):
                    break
                slot[open_] += 1
            begun = slot >= 0
            at, key, slot = at[begun], key[begun], slot[begun]
            ids[size - 1, at], values[size - 1, at] = self.ids[slot], self.values[slot]
            if not len(at):
                break
        return ids, values


@dataclass
class Pieces:
    """Pieces with scores; characters without a piece, and the mark itself in a text, become bytes."""

    scores: dict[str, tuple[int, float]]
    bytes: list[int]
    longest: int
    penalty: float
    texts: list[bytes] = field(repr=False, default_factory=list)
    lengths: dict[int, int] = field(repr=False, default_factory=dict)
    table: "PieceTable" = field(repr=False, default=None)
    over: re.Pattern = field(repr=False, default=None)  # a letter or number and a sign that are neighbours in a piece

    @classmethod
    def load(cls, path: str) -> "Pieces":
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores, of_byte, texts = {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            texts.append(piece.replace(MARK, " ").encode())
            if model.is_byte(i):
                of_byte[int(piece[3:5], 16)] = i
                texts[-1] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} crosses the front of a word")
                scores[piece] = (i, model.get_score(i))
        low = min((s for _, s in scores.values() if s > -1e8), default=0.0)
        lengths = {i: len(piece) for piece, (i, _) in scores.items()}
        over = {p[k : k + 2] for p in scores for k in range(len(p) - 1) if _OVER.match(p, k)}
        return cls(scores, of_byte, max(map(len, scores)), low - 10, texts, lengths, PieceTable(scores), re.compile("|".join(map(re.escape, sorted(over))) or "(?!)"))

    def edges(self, unit: str, end: int, plain: bool = False) -> list[tuple[int, tuple[int, ...], float]]:
        """``(start, ids, score)`` of the edges into node ``end``, longest first."""
        found, get = [], self.scores.get
        for start in range(max(0, end - self.longest), end):
            hit = get(unit[start:end])
            if hit is not None and not plain:
                found.append((start, (hit[0],), hit[1]))
            elif start == end - 1:
                raw = unit[start:end].encode("utf-8", "surrogatepass")
                found.append((start, tuple(self.bytes[b] for b in raw), self.penalty))
        return found

    def nbest(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a lattice as ``(score, ids)``, best first; fewer if there are no more."""
        best, into = [0.0] + [-np.inf] * len(unit), [[]]
        for end in range(1, len(unit) + 1):
            edges = self.edges(unit, end)
            into.append(edges)
            best[end] = max(best[s] + v for s, _, v in edges)
        found, serial = [], 0
        heap = [(-best[-1], 0, len(unit), 0.0, None)]
        while heap and len(found) < n:
            estimate, _, node, after, path = heapq.heappop(heap)
            if node == 0:
                ids: list[int] = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                found.append((-estimate, tuple(ids)))
                continue
            for start, ids, value in into[node]:
                serial += 1
                heapq.heappush(heap, (-(best[start] + value + after), serial, start, value + after, (ids, path)))
        return found

    def best_many(self, units: list[str]) -> list[tuple[float, bytes, float]]:
        """``(score, ids, loss)`` of the best segmentation of each unit; ``loss`` is what the second best falls short, inf without one.

        All units pass through the lattice together: scores from the front and from the back of every node, and the
        loss as the least one over all edges beside the best path.
        """
        if not units:
            return []
        lengths = np.array([len(u) for u in units])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        chars = np.frombuffer("".join([units[k] for k in order]).encode("utf-32-le", "surrogatepass"), "<u4")
        firsts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        left = np.repeat(firsts + lengths, lengths) - np.arange(len(chars))  # characters up to the end of the unit
        reach = min(self.longest, int(lengths[0]))
        ids, value = self.table.look_up(chars, left, reach)
        unknown = ids[0] < 0
        value[0][unknown] = self.penalty
        # nodes of unit u: base[u] … base[u] + lengths[u]
        base = firsts + np.arange(len(units))
        ahead, back = np.full(len(chars) + len(units), -np.inf), np.full(len(chars) + len(units), -np.inf)
        step = np.zeros(len(ahead), np.int64)
        ahead[base], back[base + lengths] = 0.0, 0.0
        alive = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right")  # units of at least k characters
        for k in range(1, int(lengths[0]) + 1):
            own, at = base[: alive[k - 1]], firsts[: alive[k - 1]]
            top, by = np.full(len(own), -np.inf), np.zeros(len(own), np.int64)
            for size in range(1, min(reach, k) + 1):
                new = ahead[own + k - size] + value[size - 1][at + k - size]
                better = new > top
                top[better], by[better] = new[better], size
            ahead[own + k], step[own + k] = top, by
        for k in range(1, int(lengths[0]) + 1):
            own, at, n = base[: alive[k - 1]], firsts[: alive[k - 1]], lengths[: alive[k - 1]]
            top = np.full(len(own), -np.inf)
            for size in range(1, min(reach, k) + 1):
                top = np.maximum(top, back[own + n - k + size] + value[size - 1][at + n - k])
            back[own + n - k] = top
        total = ahead[base + lengths]
        loss = np.full(len(units), np.inf)
        unit_of = np.repeat(np.arange(len(units)), lengths)
        node = np.repeat(base, lengths) + np.arange(len(chars)) - np.repeat(firsts, lengths)
        goal = np.repeat(total, lengths)
        path, position = [], base + lengths
        used = np.zeros((reach, len(chars)), bool)
        live = np.arange(len(units))
        while len(live):
            size = step[position[live]]
            position[live] -= size
            at = position[live] - base[live] + firsts[live]
            used[size - 1, at] = True
            path.append((live, ids[size - 1, at]))
            live = live[position[live] > base[live]]
        for size in range(1, reach + 1):
            fits = (left >= size) & ~used[size - 1] & (value[size - 1] > -np.inf)
            at = np.flatnonzero(fits)
            miss = goal[at] - (ahead[node[at]] + value[size - 1][at] + back[node[at] + size])
            np.minimum.at(loss, unit_of[at], miss)
        owner = np.concatenate([p[0] for p in path])
        flat = np.concatenate([p[1] for p in path])
        depth = np.concatenate([np.full(len(p[0]), k) for k, p in enumerate(path)])
        flat = flat[np.lexsort((-depth, owner))]
        ends = np.cumsum(np.bincount(owner, minlength=len(units)))
        raw, odd = flat.astype("<u4").tobytes(), set(np.flatnonzero(np.bincount(owner[np.concatenate([p[1] for p in path]) < 0], minlength=len(units))).tolist())
        found: list = [None] * len(units)
        for u, (k, end, score, short) in enumerate(zip(order.tolist(), ends.tolist(), total.tolist(), loss.tolist())):
            begin = int(ends[u - 1]) if u else 0
            own = raw[4 * begin : 4 * end]
            if u in odd:
                own = self._with_bytes(units[k], flat[begin:end].tolist())
            found[k] = (score, own, short)
        return found

    def _with_bytes(self, unit: str, ids: list[int]) -> bytes:
        """Ids with characters that have no piece as bytes."""
        whole, at = [], 0
        for i in ids:
            if i < 0:
                whole += [self.bytes[b] for b in unit[at].encode("utf-8", "surrogatepass")]
                at += 1
            else:
                whole.append(i)
                at += self.lengths[i]
        return np.array(whole, "<u4").tobytes()

    def units(self, text: str) -> list[str]:
        """Units of a text; where a sign follows a letter or number one ends too, unless the text has such a pair that is in a piece."""
        return units_of(text, _UNIT if self.over.search(text) else _FINE)

    def decode(self, ids) -> str:
        """The text of a segmentation."""
        raw = b"".join([self.texts[i] for i in ids])
        return raw[1:].decode("utf-8", "surrogatepass")


LITERAL = "\n" + MARK  # stands for the mark of a text while it is cut into words; as line ends are alone, no unit of a text is like it


def units_of(text: str, pattern: re.Pattern = _UNIT) -> list[str]:
    """A text with a mark in front and for each blank, cut before each run of marks and around line ends.

    A mark that is in the text itself comes as the unit ``LITERAL``, to become bytes.
    """
    if MARK not in text:
        return pattern.findall(MARK + text.replace(" ", MARK))
    units: list[str] = []
    for k, part in enumerate(text.split(MARK)):
        if k:
            units.append(LITERAL)
        body = part.replace(" ", MARK)
        units += pattern.findall(MARK + body if k == 0 else body)
    return units


def combined(total: float, losses: Sequence[float], alternatives: Callable[[int], list[float]], n: int) -> list[tuple[float, list[tuple[int, int]]]]:
    """The ``n`` best choices of one alternative per word, as ``(score, [(word, alternative), …])`` of words not at their best.

    ``losses`` has the loss of the second best per word, ``alternatives(word)`` the losses of all its n best. The n best
    texts use only words with the n smallest losses. Combinations are popped in order of loss; each goes on with the next alternative of
    its last word, and with the next word in addition or instead.
    """
    few, rest = [], list(losses)
    while rest and len(few) < n - 1 and (least := min(rest)) < np.inf:
        few.append((least, rest.index(least)))
        rest[few[-1][1]] = np.inf
    options = [alternatives(k) for _, k in few]
    found: list = [(total, [])]
    heap = [(options[0][1], 0, ((0, 1),))] if options else []
    serial = 0
    while heap and len(found) < n:
        cost, _, chosen = heapq.heappop(heap)
        found.append((total - cost, [(few[at][1], k) for at, k in chosen]))
        at, k = chosen[-1]
        base = cost - options[at][k]
        steps = []
        if k + 1 < len(options[at]):
            steps.append((base + options[at][k + 1], (*chosen[:-1], (at, k + 1))))
        if at + 1 < len(options):
            steps.append((cost + options[at + 1][1], (*chosen, (at + 1, 1))))
            if k == 1:
                steps.append((base + options[at + 1][1], (*chosen[:-1], (at + 1, 1))))
        for new, what in steps:
            serial += 1
            heapq.heappush(heap, (new, serial, what))
    return found


SCHEMA = "doc_id bigint, n_pieces bigint, ids binary, scores array<double>, others array<binary>, lossless boolean"


class Encoder:
    """Solved units of a model: ``(score, ids, loss, bytes)`` of the best segmentation of each, and the ``n`` best of those that need them.

    ``limit`` bounds the words that are remembered; it changes the speed only.
    """

    def __init__(self, model_path: str, n: int, limit: int):
        self.pieces, self.n = Pieces.load(model_path), n
        raw = MARK.encode()
        self.mark = (self.pieces.penalty, np.array([self.pieces.bytes[b] for b in raw], "<u4").tobytes(), np.inf, raw)
        self.solved, self.nbest = Memo(self._solve, limit), Memo(self._search, max(1000, limit // 10))

    def _solve(self, units: list[str]) -> list[tuple[float, bytes, float, bytes]]:
        # long ones are kept out of the common arrays
        lattices = [u for u in units if len(u) <= LONG and u != LITERAL]
        best = dict(zip(lattices, self.pieces.best_many(lattices)))
        best.update((u, self.pieces.best_many([u])[0]) for u in units if len(u) > LONG)
        return [self.mark if u == LITERAL else (*(found := best[u]), self._text(found[1])) for u in units]

    def _text(self, ids: bytes) -> bytes:
        return b"".join([self.pieces.texts[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def _search(self, units: list[str]) -> list[tuple[list[float], list[bytes]]]:
        found = [self.pieces.nbest(u, self.n) for u in units]
        return [([f[0][0] - s for s, _ in f], [np.array(i, "<u4").tobytes() for _, i in f]) for f in found]

    def best_of(self, unit: str) -> tuple[list[float], list[bytes]]:
        """Losses and ids of the ``n`` best of a unit."""
        if unit not in self.nbest:
            self.nbest.learn([unit])
        return self.nbest[unit]

    def rows(self, texts: list[str], alternatives: bool) -> list[tuple]:
        """``(n_pieces, ids, scores, others, lossless)`` of each text."""
        units, out, look = [self.pieces.units(t) for t in texts], [], self.solved.__getitem__
        self.solved.learn([u for own in units for u in own])
        for text, own in zip(texts, units):
            scores, idss, losses, backs = zip(*map(look, own))
            best = combined(sum(scores), losses, lambda k, own=own: self.best_of(own[k])[0], self.n)
            ids, back, others = b"".join(idss), b"".join(backs)[1:], []
            for _, changed in best[1:] if alternatives else []:
                other = list(idss)
                for k, alternative in changed:
                    other[k] = self.best_of(own[k])[1][alternative]
                others.append(b"".join(other))
            out.append((len(ids) // 4, ids, [s for s, _ in best], others, back == text.encode("utf-8", "surrogatepass")))
        return out


@lru_cache(maxsize=2)
def encoder(model_path: str, n: int, limit: int) -> Encoder:
    """What a worker has solved serves its later tasks too."""
    return Encoder(model_path, n, limit)


def encode(
    docs: DataFrame, n: int = 3, model_path: str = f"{TOKENIZERS}/piece_bpe_32k.model", alternatives: bool = True, limit: int = 600_000
) -> DataFrame:
    """``(doc_id, n_pieces, ids, scores, others, lossless)``: the ``n`` best segmentations of every whole text, a row per row.

    ``ids`` are the little-endian 32-bit ids of the best one, ``scores`` the scores of all, best first, ``others`` the ids
    of the others (empty without ``alternatives``); ``lossless`` tells that decoding ``ids`` gave the text back.
    Segmentations with equal scores come in a fixed order. A null or empty text is the word front alone. White space, unknown
    characters and the front mark in a text survive the round trip, the last two as bytes. ``limit`` bounds the
    words that a worker remembers; a very long text is held whole by its task, with its units. Rows with one id, or none, each give a
    row; an empty table gives none; columns other than id and text play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_path, n, limit)
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.binary()), pa.bool_())
        for part in pieces_of(batches, size=1 << 20):
            with without_cycle_search():
                columns = zip(*coder.rows(part.column(1).to_pylist(), alternatives))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "n_pieces", "ids", "scores", "others", "lossless"],
            )

    return mapped(id_text(docs), run, SCHEMA)


def decode(encoded: DataFrame, model_path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """``(doc_id, text)`` from a column ``ids`` of little-endian 32-bit ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(model_path)
        for batch in batches:
            texts = [None if raw is None else pieces.decode(np.frombuffer(raw, "<u4").tolist()) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return mapped(encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids"), run, "doc_id bigint, text string")
