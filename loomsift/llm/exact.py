"""Exact duplicates by compressed radix tries over full byte strings."""

import hashlib
import os
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.llm.common import id_text, mapped, pieces_of, stored

#: Bytes of edge labels that a trie holds before it spills a subtree.
HELD_BYTES = 96 << 20
#: Rows of one length and hash, from as many parts of the input, beyond which they are combined in several tasks first.
COPIES = 256


class Node:
    __slots__ = ("label", "kids", "rows")

    def __init__(self, label: bytes):
        self.label, self.kids, self.rows = label, {}, None


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``, found by doubling and halving over slices."""
    low, high = 0, min(len(a), len(b) - at)
    step = 16
    while low + step <= high and a[low : low + step] == b[at + low : at + low + step]:
        low += step
        step *= 2
    high = min(high, low + step)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _read(spilled) -> Iterator[tuple[bytes, list]]:
    spilled.seek(0)
    while True:
        try:
            yield pickle.load(spilled)
        except EOFError:
            return


class Trie:
    """Radix trie whose terminal nodes list the rows of a string.

    Beyond ``budget`` bytes of labels the largest subtree below the root goes to a file, and so does what would enter it
    later; ``groups`` works through the spilled subtrees one by one, without the prefix that their strings share.
    """

    def __init__(self, budget: int = HELD_BYTES):
        self.root, self.budget, self.held = Node(b""), budget, 0
        self.sizes: dict[int, int] = {}
        self.spilled: dict[int, object] = {}

    def insert(self, text: bytes, row) -> None:
        if text and text[0] in self.spilled:
            pickle.dump((text, [row]), self.spilled[text[0]])
            return
        node, at = self.root, 0
        while at < len(text):
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text[at:])
                self._grew(text[0], len(text) - at)
                node, at = kid, len(text)
            elif text.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
            else:
                cut = _shared(kid.label, text, at)
                upper = node.kids[text[at]] = Node(kid.label[:cut])
                kid.label = kid.label[cut:]
                upper.kids[kid.label[0]] = kid
                node, at = upper, at + cut
        if node.rows is None:
            node.rows = []
        node.rows.append(row)
        if self.held > self.budget and len(self.sizes) > 0:
            self._spill()

    def _grew(self, first: int, size: int) -> None:
        self.held += size
        self.sizes[first] = self.sizes.get(first, 0) + size

    def _spill(self) -> None:
        first = max(self.sizes, key=self.sizes.get)
        handle, name = tempfile.mkstemp(suffix=".trie")
        out = os.fdopen(handle, "w+b")
        os.unlink(name)  # the space is free as soon as the file is closed, also if the task dies
        for text, rows in self._walk(self.root.kids.pop(first), b""):
            pickle.dump((text, rows), out)
        self.held -= self.sizes.pop(first)
        self.spilled[first] = out

    @staticmethod
    def _walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            text = prefix + node.label
            if node.rows is not None:
                yield text, node.rows
            stack += [(kid, text) for kid in node.kids.values()]

    def groups(self) -> Iterator[list]:
        """The rows of each distinct string."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.rows is not None:
                yield node.rows
            stack += node.kids.values()
        self.root, self.held = Node(b""), 0
        for out in self.spilled.values():
            below, common = Trie(self.budget), None
            for text, _ in _read(out):
                common = text if common is None else common[: _shared(common, text, 0)]
            for text, rows in _read(out):
                below.insert(text[len(common) :], tuple(rows))
            out.close()
            for parts in below.groups():
                yield [row for part in parts for row in part]


SHARDS = "local string, n_bytes bigint, head bigint, text_sha256 string, text binary, members array<bigint>, best bigint, n bigint"
_ARROW = pa.schema(
    [
        ("local", pa.string()), ("n_bytes", pa.int64()), ("head", pa.int64()), ("text_sha256", pa.string()),
        ("text", pa.binary()), ("members", pa.list_(pa.int64())), ("best", pa.int64()), ("n", pa.int64()),
    ]
)
OWNERS = "local string, keep_id bigint, group_size bigint, leader string"


def lowered(text: str) -> bytes:
    """A-Z to a-z and nothing else, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower()


def _best(choose: Callable, ids: list) -> int | None:
    return choose((i for i in ids if i is not None), default=None)


def exact_owners(docs: DataFrame, keep: str = "smallest", budget: int = HELD_BYTES, copies: int = COPIES) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``: a row per row of ``docs``.

    Texts are equal when their bytes are, after A-Z became a-z. Of equal texts the row with the smallest (or ``largest``) id stays;
    if the id that stays is there more than once, one of its rows is kept. Null texts are empty; null ids lose against
    others; a group of null ids alone has a null ``keep_id`` and one kept row. An empty table gives no rows.

    Two levels of tries: every task first puts its own rows, a few megabytes at a time, into one, so that a text with any number of copies goes on
    as one row per part of the input. These rows are dealt by length and content hash, and the tries of
    the partitions compare full strings. Where more than ``copies`` of them have one length and hash, tries of about the root of their
    number each combine as many first, so that a text in every part of the input does not meet in one task. Ids of members do not move;
    they are joined by the number of their part's group.
    """
    choose = {"smallest": min, "largest": max}[keep]

    def local_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        for part in pieces_of(batches, size=8 << 20):
            texts, trie = [lowered(t) for t in part.column(1).to_pylist()], Trie()
            ids = part.column(0).to_pylist()
            for row, text in enumerate(texts):
                trie.insert(text, row)
            rows = []
            for members in trie.groups():
                text, own = texts[members[0]], [ids[m] for m in members]
                digest = hashlib.sha256(text).digest()
                head = int.from_bytes(digest[:8], "little", signed=True)
                rows.append((f"{task}-{serial}", len(text), head, digest.hex(), text, own, _best(choose, own), len(own)))
                serial += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, names, best, sizes = Trie(budget), [], [], []
        for batch in batches:
            for local, text, first, n in zip(*[c.to_pylist() for c in batch.columns]):
                trie.insert(text, len(names))
                names.append(local)
                best.append(first)
                sizes.append(n)
        held: list[tuple] = []
        for rows in trie.groups():
            stays = _best(choose, [best[r] for r in rows])
            leader = min(names[r] for r in rows if best[r] == stays)
            total = sum(sizes[r] for r in rows)
            held += [(names[r], stays, total, leader) for r in rows]
            if len(held) >= 10_000:
                yield _owner_rows(held)
                held = []
        if held:
            yield _owner_rows(held)

    shards = stored(mapped(id_text(docs), local_groups, SHARDS), "exact")
    slim = shards.select("local", "text", "best", "n", "n_bytes", "head")
    crowds = shards.groupBy("n_bytes", "head").agg(F.count("*").alias("copies")).filter(F.col("copies") > copies)
    crowds = stored(crowds.withColumn("parts", F.ceil(F.sqrt("copies")).cast("int")), "crowds")

    def merged(rows: DataFrame, *keys: str) -> DataFrame:
        return mapped(rows.repartition("n_bytes", "head", *keys).select("local", "text", "best", "n"), owners, OWNERS)

    if crowds.isEmpty():
        found = merged(slim)
    else:
        common = slim.join(crowds, ["n_bytes", "head"]).withColumn("part", F.pmod(F.xxhash64("local"), F.col("parts")))
        first = stored(merged(common, "part"), "combined")
        leaders = first.filter("local = leader").select("local", F.col("keep_id").alias("best"), F.col("group_size").alias("n"))
        leaders = slim.drop("best", "n").join(leaders, "local").select(*slim.columns)
        last = stored(merged(slim.join(crowds, ["n_bytes", "head"], "left_anti").select(*slim.columns).unionAll(leaders)), "owners")
        above = last.select(F.col("local").alias("above"), "keep_id", "group_size", "leader")
        below = first.select("local", F.col("leader").alias("above")).join(above, "above")
        found = last.join(first.select("local"), "local", "left_anti").unionAll(below.select("local", "keep_id", "group_size", "leader"))
    found = found.withColumn("winner", F.col("local") == F.col("leader")).drop("leader")
    joined = shards.select("local", "text_sha256", "members").join(found, "local")
    rows = joined.select("keep_id", "group_size", "text_sha256", "winner", "members", F.posexplode("members").alias("at", "doc_id"))
    first = F.coalesce(F.array_position("members", F.col("keep_id")) - 1, F.lit(0))
    kept = F.col("winner") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("at") == first)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _owner_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["local", "keep_id", "group_size", "leader"])
