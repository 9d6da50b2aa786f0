"""Quality classifier: averaged vectors of hashed words and character n-grams, softmax, trained by stochastic gradient descent."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.llm.common import Memo, id_text, mapped, pieces_of
from loomsift.llm.hashing import bucket_numbers, mixed

CUT = 0.7
#: How often a repeated word counts among the features of a text; a word itself has about so many.
REPEAT_WEIGHT = 8
#: Words over so many characters are not remembered.
LONG = 64
#: Characters that are hashed at once.
PART_CHARS = 1 << 18


@dataclass(frozen=True)
class Options:
    """``per_class`` bounds the labelled rows that are learnt from, so that training fits one task at any corpus size."""

    buckets: int = 1 << 17
    dimensions: int = 16
    shortest: int = 2
    longest: int = 5
    per_class: int = 1000
    epochs: int = 5
    least_steps: int = 5000  # few documents are gone through more often
    rate: float = 0.3
    boost: float = 200.0  # of the step of the vectors, whose gradients are divided among all features of a text
    seed: int = 11


def features(words: list[str], o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its character n-grams between edge marks, and the place of the word that each belongs to."""
    raws = [w.encode("utf-8", "surrogatepass") for w in words]
    ends = np.cumsum([len(r) for r in raws])
    whole = bucket_numbers(np.frombuffer(b"".join(raws), np.uint8), np.concatenate(([0], ends[:-1])), ends)
    marked = [f"<{w}>" for w in words]
    sizes = np.array([len(m) for m in marked])
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.cumsum(sizes)[owner] - np.arange(len(owner))
    keys, places = _grams("".join(marked), left, o)
    return _buckets(np.concatenate([whole, keys]), o), np.concatenate([np.arange(len(words)), owner[places]])


def _buckets(keys: np.ndarray, o: Options) -> np.ndarray:
    return (keys % np.uint64(o.buckets)).astype(np.int64)


def _grams(text: str, left: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and places of the n-grams that begin at the first ``len(left)`` characters; ``left`` are the characters up to the end of the word."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    keys, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at, key = np.arange(len(left)), np.zeros(len(left), np.uint64)
    for n in range(1, o.longest + 1):
        fits = left[at] >= n
        at, key = at[fits], key[fits]
        key = mixed(key + chars[at + n - 1] + np.uint64(1))
        if n >= o.shortest:
            keys.append(key)
            places.append(at)
    return np.concatenate(keys), np.concatenate(places)


def feature_parts(words: list[str], o: Options, chars: int = PART_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, stop, buckets, owners)``: ``features`` of ``words[first:stop]``, all words in arrays of bounded size.

    A word over ``chars`` characters comes in several parts, from blocks that overlap by ``longest - 1`` characters.
    """
    first = held = 0
    for k, word in enumerate([*words, None]):
        if first < k and (word is None or held + len(word) > chars or k - first >= 20_000):
            yield (first, k, *features(words[first:k], o))
            first, held = k, 0
        if word is None:
            return
        if len(word) <= chars:
            held += len(word)
            continue
        raw = word.encode("utf-8", "surrogatepass")
        whole = bucket_numbers(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
        yield k, k + 1, _buckets(whole, o), np.zeros(1, np.int64)
        marked = f"<{word}>"
        for at in range(0, len(marked), chars):
            starts = min(chars, len(marked) - at)
            part = marked[at : at + starts + o.longest - 1]
            keys, _ = _grams(part, len(part) - np.arange(starts), o)
            yield k, k + 1, _buckets(keys, o), np.zeros(len(keys), np.int64)
        first = k + 1


def feature_lists(words: list[str], o: Options) -> list[np.ndarray]:
    """Buckets per word."""
    if not words:
        return []
    buckets, owners = features(words, o)
    order = np.argsort(owners, kind="stable")
    return np.split(buckets[order], np.cumsum(np.bincount(owners, minlength=len(words)))[:-1])


def repeats(words: list[str]) -> int:
    """Word bigrams whose second word is the first one again; they share one bucket."""
    return sum(map(str.__eq__, words, words[1:]))


def _repeat_bucket(o: Options) -> int:
    return o.buckets // 3


def document_features(text: str, memo: Memo, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    words = text.split()
    short = [w for w in words if len(w) <= LONG]
    memo.learn(short)
    parts = [memo[w] for w in short]
    again = repeats(words)
    parts.append(np.full(again * REPEAT_WEIGHT, _repeat_bucket(o), np.int64))
    counts = np.bincount(np.concatenate(parts), minlength=o.buckets)
    for _, _, buckets, _ in feature_parts([w for w in words if len(w) > LONG], o):
        counts += np.bincount(buckets, minlength=o.buckets)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


@dataclass
class Model:
    vectors: np.ndarray  # buckets x dimensions
    output: np.ndarray  # dimensions x 2

    def weights(self) -> np.ndarray:
        """Per bucket, what its vector adds to the difference of the two outputs.

        The mean of vectors and the output layer are linear, so the score of a text is the logistic function of
        the mean of these numbers over its features.
        """
        return (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64)


def fit(texts: list[str], labels: list[int], o: Options) -> Model:
    """Plain stochastic gradient descent over documents, in an order that depends on the seed only."""
    rng = np.random.default_rng(o.seed)
    memo = Memo(lambda words: feature_lists(words, o), 50_000)
    rows = [document_features(t, memo, o) for t in texts]
    vectors = rng.uniform(-1 / o.dimensions, 1 / o.dimensions, (o.buckets, o.dimensions)).astype(np.float32)
    output = np.zeros((o.dimensions, 2), np.float32)
    epochs = max(o.epochs, -(-o.least_steps // max(1, len(rows))))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            rate, (ids, counts) = o.rate * (1 - done / steps), rows[k]
            done += 1
            if not len(ids):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ vectors[ids]
            z = mean @ output
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = output @ p
            output -= rate * np.outer(mean, p)
            vectors[ids] -= rate * o.boost * np.outer(share, back)
    return Model(vectors, output)


def train(docs: DataFrame, labels: DataFrame, o: Options = Options()) -> Model:
    """Learn ``labels.quality`` from at most ``per_class`` labelled documents of each class, chosen by a hash of their id.

    Labels that are null or neither 0 nor 1 are left out, as are labels without a document; a repeated label row counts once.
    All tasks look for the chosen texts, which then meet in one, whose input the bound limits; only the model comes to the driver.
    """
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2).distinct()
    chosen = None
    for label in (0, 1):
        own = marked.filter(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(o.per_class)
        chosen = own if chosen is None else chosen.unionAll(own)
    rows = id_text(docs).join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class ids

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [(d, t, q) for b in batches for d, t, q in zip(*[c.to_pylist() for c in b.columns])]
        read.sort()
        if not read:
            return
        model = fit([t for _, t, _ in read], [q for _, _, q in read], o)
        yield pa.RecordBatch.from_pydict({"vectors": [model.vectors.tobytes()], "output": [model.output.tobytes()]})

    row = mapped(rows.select("doc_id", "text", "quality").repartition(1), learn, "vectors binary, output binary").first()
    if row is None:  # nothing to learn from
        return Model(np.zeros((o.buckets, 1), np.float32), np.zeros((1, 2), np.float32))
    output = np.frombuffer(row["output"], np.float32).reshape(-1, 2)
    return Model(np.frombuffer(row["vectors"], np.float32).reshape(o.buckets, -1), output)


class Scorer:
    """Scores of texts: softmax share of label 1, 0.5 for a text without words. Remembers words up to a bound."""

    def __init__(self, weights: np.ndarray, o: Options):
        self.again = float(weights[_repeat_bucket(o)])

        def make(words: list[str]) -> list[tuple[float, int]]:
            sums, counts = np.zeros(len(words)), np.zeros(len(words), np.int64)
            for first, stop, buckets, owners in feature_parts(words, o):
                sums[first:stop] += np.bincount(owners, weights[buckets], stop - first)
                counts[first:stop] += np.bincount(owners, minlength=stop - first)
            return list(zip(sums.tolist(), counts.tolist()))

        self.make, self.memo = make, Memo(make, 250_000)

    def __call__(self, texts: list[str]) -> list[float]:
        lists = [t.split() for t in texts]
        self.memo.learn([w for words in lists for w in words if len(w) <= LONG])
        long = list({w for words in lists for w in words if len(w) > LONG})
        sums = dict(zip(long, self.make(long)))
        scores = []
        for words in lists:
            known = [self.memo[w] if len(w) <= LONG else sums[w] for w in words]
            twice = REPEAT_WEIGHT * repeats(words)
            total, count = sum(k[0] for k in known) + twice * self.again, sum(k[1] for k in known) + twice
            scores.append(float(1 / (1 + np.exp(-total / count))) if count else 0.5)
        return scores


def score(docs: DataFrame, model: Model, o: Options = Options()) -> DataFrame:
    """``(doc_id, score)`` for every whole text, a row per row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model.weights())

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value, o)
        for part in pieces_of(batches, size=1 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return mapped(id_text(docs), rate, "doc_id bigint, score double")


def good_documents(docs: DataFrame, labels: DataFrame, o: Options = Options()) -> DataFrame:
    """The rows of ``docs``, all columns, with a score of 0.7 or more; narrow but for the training.

    Null texts are scored as empty and stay null, long ones are scored whole. Each row is judged by its text, whatever its id is, so that repeated rows stay or
    go together. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, o).weights())
    at = docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value, o)
        for part in pieces_of(batches, size=1 << 20):
            scores = scorer([t or "" for t in part.column(at).to_pylist()])
            yield part.filter(pa.array([s >= CUT for s in scores], pa.bool_()))

    return docs.mapInArrow(sift, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, o: Options = Options()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: train on labelled rows that are not held out, score every row.

    ``held_out`` is null for a null id. With no usable labels all scores are 0.5. Null texts are empty, long ones are read whole; equal texts have equal
    scores, and every row gives one, also where ids are repeated. An empty table gives no rows. Columns other than id and text play no part.
    """
    scored = score(docs, train(docs, labels, o), o)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

