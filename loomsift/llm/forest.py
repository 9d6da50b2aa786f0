"""Near duplicates by an LSH forest.

A text is the set of its word shingles. Equal sets are one node. A node has a signature of 64 minimum hashes, and the
forest sorts all nodes in 16 orders, each by eight consecutive values from another place of the signature. Close in an order means a
long common prefix: candidates of a node are all nodes with the same prefix, its run. The depth of a run adapts to its
region: three values where at most ``RUN`` nodes share them, else as many more as it takes. Nodes of such crowded
regions are sorted in 48 more orders, by values picked at random, to make up for the greater depth. A run that is crowded at
the full depth is dealt in parts, each with the first node of the run. Runs never cross the border of a range.

Candidates whose whole signatures are alike make regions, the components of that graph. A region is a superset of
classes: inside it, full sets decide, and every pair that could still join two classes is tested.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.llm.common import kept_columns, mapped, pieces_of, stored, with_rows
from loomsift.llm.graph import components
from loomsift.llm.hashing import mixed, range_numbers, word_ranges

SHINGLE = 5
VALUES, TREES, DEPTH, LEAST_DEPTH = 64, 16, 8, 3
#: Nodes of a run up to which no deeper prefix is asked for.
RUN = 2048
#: Equal values of 64 that make two nodes candidates: at a similarity of 0.75 this is 4.6 standard deviations down.
ALIKE = 32
#: Regions up to this size are solved in one task, larger ones by rounds over all tasks.
REGION_NODES, REGION_SHINGLES = 10_000, 3_000_000
#: What a task compares with the leaders of a large region, and what these hold in a round at most.
SHARE_NODES, SHARE_SHINGLES, LEADER_SHINGLES = 4000, 2_000_000, 2_000_000

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_RNG = np.random.default_rng(29)
_FACTOR = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, VALUES, dtype=np.uint64)
#: Places of the signature by which the further orders of crowded regions sort.
_PICKS = np.stack([_RNG.permutation(VALUES)[:DEPTH] for _ in range(48)])


def shingle_sets(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit numbers of the shingles of each text."""
    raws = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(raws), np.uint8)
    starts, ends = word_ranges(data, _IS_WORD)
    words = range_numbers(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    at = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws]))
    whole = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        whole = mixed(whole + words[k : k + len(whole)]) if len(whole) else whole
    sets = []
    for first, last in zip(at[:-1].tolist(), at[1:].tolist()):
        if last - first >= size:
            sets.append(np.unique(whole[first : last - size + 1]))
        elif last > first:
            number = np.full(1, last - first, np.uint64)  # a short sequence is told apart by its length
            for word in words[first:last]:
                number = mixed(number + word)
            sets.append(number)
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum hashes of non-empty sets, a row of 64 each."""
    flat = np.concatenate(sets)
    firsts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    return np.stack([np.minimum.reduceat(flat * f + s, firsts) for f, s in zip(_FACTOR, _SHIFT)], axis=1)


NODES = "set_key binary, n_shingles bigint, node bigint, members array<bigint>, ids array<bigint>, orders binary, sketch binary"
LINKS = "u bigint, v bigint"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct sets of each part of the input, with the rows that have them."""
    import hashlib

    for part in pieces_of(batches, size=3 << 20):
        rows, ids = part.column(0).to_pylist(), part.column(1).to_pylist()
        sets = shingle_sets(part.column(2).to_pylist())
        groups: dict[bytes, list[int]] = {}
        for k, s in enumerate(sets):
            key = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""
            groups.setdefault(key, []).append(k)
        own = [sets[g[0]] for g in groups.values()]
        full = [s for s in own if len(s)]
        values = signatures(full) if full else np.empty((0, VALUES), np.uint64)
        values = mixed(values)
        short, sketch = (values >> np.uint64(48)).astype(">u2"), (values >> np.uint64(8)).astype(np.uint8)
        orders, sketches, at = [], [], 0
        for s in own:
            orders.append(short[at].tobytes() if len(s) else None)
            sketches.append(sketch[at].tobytes() if len(s) else None)
            at += bool(len(s))
        members = [[rows[k] for k in g] for g in groups.values()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(groups), pa.binary()), pa.array([len(s) for s in own], pa.int64()),
                pa.array([min(m) for m in members], pa.int64()), pa.array(members, pa.list_(pa.int64())),
                pa.array([[ids[k] for k in g] for g in groups.values()], pa.list_(pa.int64())),
                pa.array(orders, pa.binary()), pa.array(sketches, pa.binary()),
            ],
            names=["set_key", "n_shingles", "node", "members", "ids", "orders", "sketch"],
        )


def _alike(sketch: np.ndarray) -> np.ndarray:
    """First member of the class of each row when all alike rows are linked.

    One row at a time is compared with all others, until every row outside the largest class has been.
    """
    labels, led = np.arange(len(sketch)), np.zeros(len(sketch), bool)
    while True:
        sizes = np.bincount(labels)
        top = sizes.argmax()
        rest = np.flatnonzero(~led & ((labels != top) | (sizes[top] == 1)))
        if not len(rest):
            return labels
        led[rest[0]] = True
        near = np.unique(labels[(sketch == sketch[rest[0]]).sum(axis=1) >= ALIKE])
        if len(near) > 1:
            labels[np.isin(labels, near)] = near[0]


def _run_links(rows: pa.Table) -> pa.RecordBatch:
    """Candidates inside whole runs of sorted rows ``(tree, key, part, node, sketch)``."""
    n = rows.num_rows
    node = np.array(rows.column(3), np.int64)
    sketch = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint8).reshape(n, VALUES)
    firsts = np.flatnonzero(_run_starts(rows))
    sizes = np.diff(np.append(firsts, n))
    pairs = firsts[sizes == 2]
    pairs = pairs[(sketch[pairs] == sketch[pairs + 1]).sum(axis=1) >= ALIKE]
    u, v = [node[pairs + 1]], [node[pairs]]
    for first, size in zip(firsts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        labels = _alike(sketch[first : first + size])
        k = np.flatnonzero(labels != np.arange(size))
        u.append(node[first + k])
        v.append(node[first + labels[k]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v)], names=["u", "v"])


def _run_starts(rows: pa.Table) -> np.ndarray:
    starts = np.ones(rows.num_rows, bool)
    if len(starts) > 1:
        starts[1:] = False
        for column in rows.columns[:3]:
            starts[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy()
    return starts


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates among rows ``(tree, key, part, node, sketch)`` sorted by the first three; the last run waits for the next rows."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= 4 * RUN:
            rows = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_run_starts(rows))[-1])
            if last:
                yield _run_links(rows.slice(0, last))
            held, count = rows.slice(last).to_batches(), 0
    if held and (rows := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield _run_links(rows)


def _more_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(tree, prefix, node, sketch)`` of the further orders, from ``(node, orders, sketch)``."""
    for batch in batches:
        n, times = batch.num_rows, len(_PICKS)
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(n, VALUES)
        prefix = np.ascontiguousarray(values[:, _PICKS]).reshape(n * times, DEPTH)
        again = pa.array(np.repeat(np.arange(n), times))
        columns = [
            pa.array(np.tile(np.arange(TREES, TREES + times, dtype=np.int32), n)), pa.array([p.tobytes() for p in prefix], pa.binary()),
            batch.column(0).take(again), batch.column(2).take(again),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["tree", "prefix", "node", "sketch"])


def _runs(trees: DataFrame, run: int) -> tuple[DataFrame, DataFrame | None]:
    """``(tree, key, part, node, sketch)`` of rows ``(tree, prefix, node, sketch)``, and the nodes of crowded regions if there are any.

    ``key`` is the shortest prefix that at most ``run`` nodes share. Counts meet after map-side merging; only crowded prefixes are kept.
    """
    rows, left = trees.withColumn("depth", F.lit(LEAST_DEPTH)), trees
    crowded = nodes = None
    for depth in range(LEAST_DEPTH, DEPTH + 1):
        key = F.substring("prefix", 1, 2 * depth).alias("key")
        first = [F.min(F.struct("node", "sketch")).alias("first")] if depth == DEPTH else []
        counts = left.groupBy("tree", key).agg(F.count("*").alias("n"), *first)
        crowded = stored(counts.filter(F.col("n") > run), "crowded")
        if crowded.isEmpty():
            crowded = None
            break
        here = crowded.select("tree", "key")
        left = left.withColumn("key", key).join(here, ["tree", "key"], "left_semi").drop("key")
        if nodes is None:
            nodes = left.select("node").distinct()
        if depth < DEPTH:
            marked = here.withColumn("more", F.lit(True))
            rows = rows.withColumn("key", key).join(marked, ["tree", "key"], "left")
            rows = rows.withColumn("depth", F.when(F.col("more"), F.lit(depth + 1)).otherwise(F.col("depth"))).drop("key", "more")
    out = rows.select("tree", F.expr("substring(prefix, 1, 2 * depth)").alias("key"), "node", "sketch")
    if crowded is None:
        return out.select("tree", "key", F.lit(0).alias("part"), "node", "sketch"), nodes
    parts = crowded.select("tree", "key", F.ceil(F.col("n") / run).cast("int").alias("parts"), "first")
    out = out.join(parts.drop("first"), ["tree", "key"], "left")
    out = out.select("tree", "key", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.lit(0)).alias("part"), "node", "sketch")
    firsts = parts.select("tree", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "first.node", "first.sketch")
    return out.unionAll(firsts), nodes


def _candidates(mine: DataFrame, run: int) -> DataFrame:
    """Links of alike nodes ``(node, orders, sketch)``."""
    parts = max(1, int(mine.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def linked(runs: DataFrame) -> DataFrame:
        dealt = runs.repartitionByRange(parts, "tree", "key", "part").sortWithinPartitions("tree", "key", "part")
        return mapped(dealt, _neighbours, LINKS)

    doubled = F.concat("orders", F.substring("orders", 1, 2 * DEPTH))
    trees = mine.select("node", "sketch", doubled.alias("values"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    step = 2 * VALUES // TREES
    trees = trees.select("tree", F.substring("values", F.col("tree") * step + 1, F.lit(2 * DEPTH)).alias("prefix"), "node", "sketch")
    runs, crowded = _runs(trees, run)
    links = linked(runs)
    if crowded is None:
        return links
    more = mapped(mine.join(crowded, "node", "left_semi").select("node", "orders", "sketch"), _more_orders, "tree int, prefix binary, node bigint, sketch binary")
    return stored(links, "candidates").unionAll(linked(_runs(stored(more, "orders"), run)[0]))


def similar(overlap: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """Intersections of three quarters of the union or more, in whole numbers."""
    return 100 * overlap >= 75 * (size + sizes - overlap)


class Listed:
    """Sets of numbers, and for each number those that have it."""

    def __init__(self, sets: list[np.ndarray]):
        self.flat, self.inverse = np.unique(np.concatenate(sets), return_inverse=True)
        self.sizes = np.array([len(s) for s in sets])
        self.ends = np.cumsum(self.sizes)
        self.uses = np.bincount(self.inverse, minlength=len(self.flat))
        self.lists = np.repeat(np.arange(len(sets)), self.sizes)[np.argsort(self.inverse, kind="stable")]
        self.list_ends = np.cumsum(self.uses)
        self.mark = np.zeros(len(self.flat), np.int64)

    def places(self, numbers: np.ndarray) -> np.ndarray:
        """Where those of ``numbers`` are that any set has."""
        at = np.minimum(np.searchsorted(self.flat, numbers), len(self.flat) - 1)
        return at[self.flat[at] == numbers]

    def similar_to(self, own: np.ndarray, size: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """Sets, of the ``wanted`` ones, that are similar to one of ``size`` numbers, of which those at the places ``own`` are here.

        A similar set has one at least of any quarter of the numbers and one more, so that only sets with one of the rarest of these are looked at.
        """
        rare = own[np.argsort(self.uses[own], kind="stable")[: max(0, size // 4 + 1 - (size - len(own)))]]
        if not len(rare):
            return np.empty(0, np.int64)
        others = np.unique(np.concatenate([self.lists[e - n : e] for e, n in zip(self.list_ends[rare].tolist(), self.uses[rare].tolist())]))
        others = others[similar(np.minimum(self.sizes[others], size), size, self.sizes[others])]
        if wanted is not None:
            others = others[wanted[others]]
        if not len(others):
            return others
        self.mark[own] = 1
        widths = self.sizes[others]
        firsts = np.cumsum(widths) - widths
        places = np.arange(widths.sum()) + np.repeat(self.ends[others] - widths - firsts, widths)
        overlap = np.add.reduceat(self.mark[self.inverse[places]], firsts)
        self.mark[own] = 0
        return others[similar(overlap, size, widths)]


def classes(sets: list[np.ndarray]) -> list[int]:
    """First member of the class of each set when all similar pairs are linked.

    One set at a time is compared with others. That is done for every set outside the largest class, so that no two
    classes have an untested pair, while the many members of one class need no comparison with each other.
    """
    listed = Listed(sets)
    labels, led = np.arange(len(sets)), np.zeros(len(sets), bool)
    while True:
        counts = np.bincount(labels)
        top = counts.argmax()
        rest = np.flatnonzero(~led & ((labels != top) | (counts[top] == 1)))
        if not len(rest):
            return labels.tolist()
        leader = int(rest[0])
        led[leader] = True
        size = int(listed.sizes[leader])
        own = listed.inverse[listed.ends[leader] - size : listed.ends[leader]]
        near = np.unique(labels[listed.similar_to(own, size)])
        if len(near) > 1:
            labels[np.isin(labels, near)] = near[0]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside small regions, from rows ``(region, node, text)`` sorted by region."""
    region, nodes, sets = None, [], []

    def found():
        roots = classes(sets)
        links = [(nodes[k], nodes[r]) for k, r in enumerate(roots) if k != r]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for part in pieces_of(batches):
        for r, node, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), shingle_sets(part.column(2).to_pylist())):
            if r != region and sets:
                yield found()
                nodes, sets = [], []
            region = r
            nodes.append(node)
            sets.append(own)
    if sets:
        yield found()


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces_of(batches):
        sets = shingle_sets(part.column(2).to_pylist())
        columns = [part.column(0), part.column(1), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["region", "node", "numbers"])


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components of a region, from rows ``(region, salt, member, node, component, numbers)`` sorted by the first three.

    The leaders of a share (``member`` 0) come before its members and are held; the members pass by in parts of some megabytes. Members of the
    component of a leader are not compared with it.
    """
    share, leaders = None, []
    for part in pieces_of(batches, "numbers"):
        region, salt, member, component = (np.array(part.column(k), np.int64) for k in (0, 1, 2, 4))
        sets = [np.frombuffer(b, "<u8") for b in part.column(5).to_pylist()]
        cuts = (np.flatnonzero((np.diff(region) != 0) | (np.diff(salt) != 0)) + 1).tolist()
        for first, last in zip([0, *cuts], [*cuts, len(sets)]):
            if share != (now := (int(region[first]), int(salt[first]))):
                share, leaders = now, []
            middle = first + int((member[first:last] == 0).sum())
            leaders += zip(component[first:middle].tolist(), sets[first:middle])
            if middle == last or not leaders:
                continue
            listed, labels = Listed(sets[middle:last]), component[middle:last]
            u, v = [], []
            for label, own in leaders:
                near = np.unique(labels[listed.similar_to(listed.places(own), len(own), labels != label)])
                u.append(np.full(len(near), label))
                v.append(near)
            links = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], axis=1).astype(np.int64), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["u", "v"])


def _large_links(
    rows: DataFrame, sizes: DataFrame, leaders_at_once: int = 16, share_nodes: int = SHARE_NODES, share_shingles: int = SHARE_SHINGLES, leader_shingles: int = LEADER_SHINGLES
) -> DataFrame:
    """Links inside regions that are too large for a task, from rows ``(region, node, text)``.

    Rounds of the comparison in ``classes``: some leaders of each region, from outside its largest class, the longest ones first, go against all members
    of other classes, which are dealt over tasks in shares of a few thousand. Classes that a round links become one. It ends when all nodes outside
    the largest class have led; the links are those of each node to the first one of its class.
    """
    sets = stored(mapped(rows.select("region", "node", "text"), _set_rows, "region bigint, node bigint, numbers binary"), "sets")
    shares = F.greatest(F.ceil(F.col("nodes") / share_nodes), F.ceil(F.col("shingles") / share_shingles)).cast("int").alias("shares")
    shares = stored(sizes.select("region", shares), "shares")
    state = sets.select("region", "node", (F.octet_length("numbers") / 8).cast("bigint").alias("n_shingles")).join(shares, "region")
    salt = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("salt")
    state = stored(state.select("region", "node", "n_shingles", salt, F.col("node").alias("component"), F.lit(False).alias("led")), "state")
    while True:
        counts = state.groupBy("region", "component").agg(F.count("*").alias("n"))
        largest = counts.groupBy("region").agg(F.max(F.struct("n", "component")).alias("top"))
        rest = state.filter("not led").join(largest, "region").filter((F.col("component") != F.col("top.component")) | (F.col("top.n") == 1))
        at_once = F.least(F.lit(leaders_at_once), F.greatest(F.lit(1), F.floor(leader_shingles / F.max("n_shingles")))).alias("parts")
        dealt = rest.select("region", "node", "n_shingles").join(rest.groupBy("region").agg(at_once), "region")
        chosen = dealt.groupBy("region", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).alias("part"))
        chosen = stored(chosen.agg(F.max(F.struct("n_shingles", "node")).alias("most")).select("region", "most.node"), "leaders")
        if chosen.isEmpty():
            return state.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        mine = state.join(chosen.select("region").distinct(), "region", "left_semi").select("node", "component", "salt")
        members = sets.join(mine, "node").select("region", "salt", F.lit(1).alias("member"), "node", "component", "numbers")
        named = chosen.join(shares, "region").select("node", "shares").join(state.select("node", "component"), "node")
        leaders = sets.join(named, "node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        both = members.unionAll(leaders.select("region", "salt", F.lit(0).alias("member"), "node", "component", "numbers"))
        both = both.repartition("region", "salt").sortWithinPartitions("region", "salt", "member")
        merged = components(mapped(both, _against, LINKS)).select(F.col("node").alias("component"), F.col("component").alias("root"))
        marks = chosen.select("node", F.lit(True).alias("leads"))
        state = state.join(merged, "component", "left").join(marks, "node", "left")
        component, led = F.coalesce("root", "component").alias("component"), (F.col("led") | F.coalesce("leads", F.lit(False))).alias("led")
        state = stored(state.select("region", "node", "n_shingles", "salt", component, led), "state")
        leaders_at_once = min(4 * leaders_at_once, 4096)


def row_groups(rows: DataFrame, region_nodes: int = REGION_NODES, region_shingles: int = REGION_SHINGLES, run: int = RUN) -> DataFrame:
    """``(row, doc_id, n_shingles, component)`` of rows ``(row, doc_id, text)``, ``component`` being the first row reachable."""
    nodes = stored(mapped(rows.select("row", "doc_id", "text"), _nodes, NODES), "nodes")
    full = nodes.filter("n_shingles > 0")
    firsts = full.groupBy("set_key").agg(F.min("node").alias("first"))
    own = full.join(firsts, "set_key")
    mine = stored(own.filter("node = first").select("node", "n_shingles", "orders", "sketch"), "signatures")
    regions = components(_candidates(mine, run)).withColumnRenamed("component", "region")
    sized = stored(regions.join(mine.select("node", "n_shingles"), "node"), "regions")
    sizes = stored(sized.groupBy("region").agg(F.count("*").alias("nodes"), F.sum("n_shingles").alias("shingles")), "sizes")
    small = (F.col("nodes") <= region_nodes) & (F.col("shingles") <= region_shingles)
    wanted = sized.join(sizes.withColumn("small", small), "region").select("node", "region", "small")
    texts = rows.select(F.col("row").alias("node"), "text").join(wanted, "node")
    large = sizes.filter(~small)
    any_large = not large.isEmpty()
    if any_large:
        texts = stored(texts, "texts")  # it is read twice, and the join shuffles the texts that are in no region too
    grouped = texts.filter("small").select("region", "node", "text").repartition("region").sortWithinPartitions("region", "node")
    links = mapped(grouped, _solved, LINKS)
    if any_large:
        links = stored(links, "links").unionAll(_large_links(texts.filter(~F.col("small")), large))
    linked = components(links)
    done = own.select("members", "ids", "n_shingles", F.col("first").alias("node")).join(linked, "node", "left")
    done = done.select("members", "ids", "n_shingles", F.coalesce("component", "node").alias("component"))
    alone = nodes.filter("n_shingles = 0").select("members", "ids", "n_shingles", F.lit(None).cast("bigint").alias("component"))
    each = done.unionAll(alone).select("n_shingles", "component", F.explode(F.arrays_zip("members", "ids")).alias("m"))
    return each.select(F.col("m.members").alias("row"), F.col("m.ids").alias("doc_id"), "n_shingles", F.coalesce("component", F.col("m.members")).alias("component"))


def near_groups(docs: DataFrame, region_nodes: int = REGION_NODES, region_shingles: int = REGION_SHINGLES, run: int = RUN) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: a row per row of ``docs``.

    Texts whose shingle sets have an intersection of three quarters of their union or more are linked; ``component_id`` is
    the smallest id that links lead to, and that document is kept. Texts without words have no shingles and are linked
    with nothing. Rows with equal or null ids count as documents of their own, in the order of their ids and texts, null ids
    last; of a group that starts with an id which is there twice, the first row is kept. An empty table gives no rows.
    """
    rows, numbered = with_rows(docs)
    each = row_groups(rows, region_nodes, region_shingles, run)
    kept = (F.col("row") == F.col("component")).alias("kept")
    if not numbered:
        return each.select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept)
    names = rows.select(F.col("row").alias("component"), F.col("doc_id").alias("component_id"))
    return each.join(names, "component").select("doc_id", "n_shingles", "component_id", kept)


def first_of_each_group(docs: DataFrame, region_nodes: int = REGION_NODES) -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_groups`` keeps; null texts become empty."""
    rows, _ = with_rows(docs, carry=True)
    kept = row_groups(rows, region_nodes).filter("row = component").select("row")
    return kept_columns(rows.join(kept, "row", "left_semi"), docs)
