"""64-bit numbers of byte ranges, for many ranges at once.

A range has the values of two polynomials over its bytes, modulo the prime 2^31 - 1 at two points drawn at random. Different ranges
of n bytes agree in both for about (n / 2^31)^2 of all points, whatever the bytes are; arithmetic modulo 2^64 would have
ranges that agree at every point.
"""

from collections.abc import Callable

import numpy as np

VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_rng = np.random.default_rng(11)
PRIME = (1 << 31) - 1
_P, _BITS = np.uint64(PRIME), np.uint64(31)
_BASES = [int(b) for b in _rng.integers(1 << 20, PRIME - 1, 2)]
_DIGITS = [_rng.integers(1, PRIME, 256, dtype=np.uint64) for _ in _BASES]
_ROW_BITS, _STEP = 12, 8
_ROW = 1 << _ROW_BITS


def mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ (numbers >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    numbers = (numbers ^ (numbers >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return numbers ^ (numbers >> np.uint64(31))


def _fold(numbers: np.ndarray) -> np.ndarray:
    """In place: something equal modulo the prime, below 2^32 + 2 for any number; twice, it is below 2^31 + 2."""
    high = numbers >> _BITS
    numbers &= _P
    numbers += high
    return numbers


def _reduced(numbers: np.ndarray) -> np.ndarray:
    """In place."""
    _fold(_fold(_fold(numbers)))
    numbers[numbers >= _P] -= _P
    return numbers


def powers(base: int, count: int) -> np.ndarray:
    """``base`` to the powers 0 … ``count`` - 1 modulo the prime."""
    out = np.ones(count, np.uint64)
    done = 1
    while done < count:
        more = min(done, count - done)
        out[done : done + more] = _reduced(out[:more] * np.uint64(pow(base, done, PRIME)))
        done += more
    return out


_LOW = [powers(b, _ROW) for b in _BASES]
_INVERSE = [pow(b, -1, PRIME) for b in _BASES]
_LOW_INVERSE = [powers(b, _ROW) for b in _INVERSE]


def _range_sums(digits: Callable[[int, int, int], np.ndarray], n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of ranges of a sequence of ``n`` digits; ``digits(point, low, high)`` gives new arrays of some below the prime.

    Everything goes in steps that stay in the cache of a core.
    """
    rows, out = n // _ROW + 1, np.zeros(len(starts), np.uint64)
    for point, (base, low, low_inverse, inverse) in enumerate(zip(_BASES, _LOW, _LOW_INVERSE, _INVERSE)):
        # the power of a place is that of its row times that of its place in the row
        high, high_inverse = powers(pow(base, _ROW, PRIME), rows), powers(pow(inverse, _ROW, PRIME), rows)
        sums = np.zeros(n + 1, np.uint64)
        for row in range(0, rows, _STEP):
            at, width = row * _ROW, _ROW if rows > 1 else n
            terms = np.zeros(min(_STEP, rows - row) * width, np.uint64)
            own = digits(point, at, min(n, at + len(terms)))
            terms[: len(own)] = own
            table = terms.reshape(-1, width) if width else terms.reshape(1, 0)
            table *= low[:width]
            _fold(_fold(table))
            table *= high[row : row + _STEP, None]
            _fold(terms)
            terms[:1] += sums[at]
            np.cumsum(terms[: len(own)], out=sums[at + 1 : at + 1 + len(own)])
        for k in range(0, len(starts), _STEP * _ROW):
            first, last = starts[k : k + _STEP * _ROW], ends[k : k + _STEP * _ROW]
            part = sums[last]
            part -= sums[first]
            back = low_inverse[first & (_ROW - 1)]
            back *= high_inverse[first >> _ROW_BITS]
            _fold(_fold(part))
            part *= _fold(_fold(back))
            part = _reduced(part)
            if point:
                size = (last - first).astype(np.uint64)
                out[k : k + len(part)] = mixed((out[k : k + len(part)] << np.uint64(32) | part) + (size << np.uint64(40)))
            else:
                out[k : k + len(part)] = part
    return out


def range_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of ``data[start:end]`` of bytes."""
    return _range_sums(lambda k, low, high: _DIGITS[k][data[low:high]], len(data), np.asarray(starts, np.int64), np.asarray(ends, np.int64))


def sequence_numbers(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of ranges of any 64-bit values."""
    own = np.asarray(values).astype(np.uint64)
    salt = [np.uint64((k + 1) << 60) for k in range(2)]
    return _range_sums(lambda k, low, high: _reduced(mixed(own[low:high] + salt[k])), len(own), np.asarray(starts, np.int64), np.asarray(ends, np.int64))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def bucket_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of ``data[start:end]`` modulo 2^64, for buckets of features only: there are long ranges that share one whatever the base is."""

    def powers_of(base: np.uint64) -> np.ndarray:
        out = np.full(len(data) + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(VALUE[data] * powers_of(_BASE)[:-1], dtype=np.uint64)))
    return mixed((sums[ends] - sums[starts]) * powers_of(_UNBASE)[starts] + (ends - starts).astype(np.uint64))


def word_ranges(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], is_word[data], [False])).astype(np.int8)))
    return edges[::2], edges[1::2]
