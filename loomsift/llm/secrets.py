"""Secret scan: keyed patterns, and strings that a subword vocabulary compresses badly."""

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from loomsift.llm.common import TOKENIZERS, id_text, mapped, pieces_of

KINDS = ("assign", "access", "hex", "dense")

_WORDS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of a run that is measured.
LEAST = 16
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_DIGEST_CHARS = frozenset((32, 40, 48, 56, 64, 96, 128))
_PURE_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_WORDY = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[-_/+](?:[A-Za-z]+|[0-9]+))*")
_NUMBERED = re.compile(r"[A-Za-z_]+[0-9]{1,4}")

SCHEMA = "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]
)

# the splitting rule of the public vocabulary; a fixed value of its format
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(run: str) -> bool:
    """A digest of a usual length or a UUID: no secret."""
    return bool((len(run) in _DIGEST_CHARS and _PURE_HEX.fullmatch(run)) or _UUID.fullmatch(run))


def plain(run: str) -> bool:
    """Letters alone, words or numbers joined by signs, or a name with a number: mostly an identifier."""
    return bool(_WORDY.fullmatch(run) or _NUMBERED.fullmatch(run))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans ``(start, order of kind, end)`` of the keyed patterns, leftmost and without overlap per kind."""
    found = []
    small = text.lower()
    if any(word in small for word in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


def joined(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """``[start, end]`` of what spans cover, in order and apart from each other."""
    out: list[list[int]] = []
    for start, _, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def dense_spans(text: str, base: list[tuple[int, int, int]], vocab: tiktoken.Encoding, ratio: float, plain_ratio: float) -> list[tuple[int, int, int]]:
    """Runs outside the base spans, or their parts between slashes, that take a token for every ``ratio`` characters or fewer.

    Runs that look like identifiers have to stay under ``plain_ratio``. Runs and base spans are passed through once, side by side.
    """
    covered, at, found = joined(base), 0, []

    def dense(run: str) -> bool:
        body = run.rstrip("=")
        if len(run) < LEAST or body.isdigit() or digest(body):
            return False
        return len(run) <= (plain_ratio if plain(body) else ratio) * len(vocab.encode_ordinary(run))

    for m in _RUN.finditer(text):
        run, start, end = m.group(), m.start(), m.end()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if at < len(covered) and covered[at][0] < end:
            continue
        if dense(run):
            found.append((start, 3, end))
        elif "/" in run:
            for part in run.split("/"):
                if dense(part):
                    found.append((start, 3, start + len(part)))
                start += len(part) + 1
    return found


def find_secrets(docs: DataFrame, vocabulary_path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", ratio: float = 1.85, plain_ratio: float = 1.6) -> DataFrame:
    """``(doc_id, spans)``: one row per row of ``docs``, spans by start and kind, in code points, end exclusive.

    Kinds ``assign``, ``access`` and ``hex`` come from patterns. Kind ``dense`` comes from token efficiency: a run of
    16 or more base64 characters, or its part between slashes, is a secret when the vocabulary needs a token for every
    ``ratio`` characters or fewer, unless it is a number, a known digest or a UUID, or touches a base span. Letters alone and
    what looks like an identifier is one from ``plain_ratio`` on. Time is linear in the text.
    Null texts are empty and have no spans, rows with a null id or a repeated id each give a row, extra columns
    are not read. The work is narrow: no shuffle, memory of a few texts per task.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path)
        for part in pieces_of(batches):
            spans = []
            for text in part.column(1).to_pylist():
                base = base_spans(text)
                every = sorted(base + dense_spans(text, base, vocab, ratio, plain_ratio))
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, _ARROW.field(1).type)], schema=_ARROW)

    return mapped(id_text(docs), scan, SCHEMA)
