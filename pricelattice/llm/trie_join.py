"""Groups of documents by Jaccard similarity of their word n-grams, with a prefix-tree join.

*Global order.* Every n-gram becomes one integer: two bits for how many texts have it, then a digest. Three in ten n-grams, chosen by
their digest, are counted over all texts (each task adds up its own, Spark the rest); bitmaps of fixed size tell which of them
several and which many texts have. Sets are sorted by that integer, rare n-grams first. Any order gives the same links; with
this one the first n-grams of a document without neighbours are mostly its own, and it takes no further part.

*Trie.* Two sets with Jaccard ``t`` or more share an n-gram among the first ``n - ceil(t n) + 1`` of each; documents that share one meet.
Where they meet, those that length and parity bits don't tell apart are one group. Its sorted sets are stored in a path-compressed
trie, and each set is driven down it: the overlap so far is shared by all sets below a node, and a subtree is left as soon as no set
below it can still reach the overlap that its lengths ask for.

*Large groups of copies.* Equal sets are one class from the start. Links are wanted up to connection only, so traversal skips
what is connected already and a cell returns edges that connect, never its pairs. Each document goes to its most frequent n-gram first, in
parts that share one document; components are labelled. At the n-grams where two components still meet, documents come with
their size, the n-gram's place in their set and ``SKETCH`` parity bits: sets with Jaccard ``t`` have their first common n-gram early enough in both
(*positional filter*) and differ in no more bits than n-grams. Sets move only for the pairs that this leaves. No task holds a
bucket, and no pair is left out.

Defined results: a null or empty text, or one without words, has an empty set and is alone; with fewer than ``n`` words the
whole sequence is the set's one element; repeated rows of an id are one node with the sets of all its rows (its size is that of
the largest); a null id is dropped from the nodes and returned alone with null class; an empty table gives an empty table;
further columns are ignored. Digests have 58 bits and are compared within a pair only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import PART, run_cells
from .common import documents, stored
from .components import components
from .hashing import stir, word_codes

#: N-grams with digests below this are counted (three in ten); ``MANY`` texts make one common; bits of a map (8 MB at every size).
#: None of these touches the links.
SAMPLED, MANY, BITS = np.uint64(3 * (1 << 58) // 10), 8, 1 << 26
#: Ids of candidates are broadcast (eight bytes each) up to this many, counted first; beyond it texts are shuffled to them.
BROADCAST_IDS = 1_000_000
#: Parity bits of a set, and bytes of them that one task compares at a time (twice as many where two parts of a bucket meet).
SKETCH, AREA_BYTES = 1 << 11, 1 << 20

_M3 = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted 58-bit digests of a text's distinct word n-grams, A-Z in lower case."""
    codes = word_codes(text)
    if not len(codes):
        return np.empty(0, np.uint64)
    wide = min(n, len(codes))
    with np.errstate(over="ignore"):
        mixed = np.full(len(codes) - wide + 1, np.uint64(wide))
        for k in range(wide):
            mixed = stir(mixed * _M3 + codes[k:len(codes) - wide + 1 + k])
    return np.unique(mixed >> np.uint64(6))


class Order:
    """The global order: sampled n-grams that no other text has, then those of a few texts, of more texts, then all others.

    Two bits on top of the digest tell the class; the same n-gram has the same place in every set."""

    def __init__(self, bitmaps: tuple[bytes, ...]):
        self.maps = [np.frombuffer(m, np.uint8) for m in bitmaps]

    def sort(self, found: np.ndarray) -> np.ndarray:
        if not len(found):
            return found.view(np.int64)
        place = _place(found)
        level = np.full(len(found), 3, np.uint64)
        taken = found < SAMPLED
        level[taken] = sum(((m[place[taken] >> 3] >> (place[taken] & 7).astype(np.uint8)) & 1).astype(np.uint64) for m in self.maps)
        return np.sort(found | level << np.uint64(58)).view(np.int64)


def _place(found: np.ndarray) -> np.ndarray:
    return (found & np.uint64(BITS - 1)).astype(np.int64)


def prefix_length(size: int, percent: int) -> int:
    """First n-grams of a set among which it shares one with every set that it links with."""
    return size - -(-size * percent // 100) + 1 if size else 0


def _bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    column = batch.column(name)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def global_order(docs: DataFrame, n: int) -> tuple[bytes, ...]:
    """Bitmaps of the sampled n-grams that several texts have, and of those that many have: counted over the whole table.

    What is sampled depends on the n-gram alone, so its count is complete. Counts are added up in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for text in _bytes(batch):
                keys = shingles(text, n)
                held.append((keys[:np.searchsorted(keys, SAMPLED)] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                if sum(map(len, held[-64:])) and len(held) % 4_096 == 0:
                    yield folded(held)
                    held = []
        yield folded(held)

    def folded(held):
        keys, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint32), np.empty(0, np.int64))
        return pa.RecordBatch.from_pydict({"gram": pa.array(keys.view(np.int32)), "n": pa.array(counts.astype(np.int32))})

    found = docs.select("text").mapInArrow(count, "gram int, n int").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")
    bit = F.pmod(F.col("gram").cast("bigint"), F.lit(BITS)) + 1  # the functions count from 1
    marks = found.select(bit.alias("bit"), F.explode(F.when(F.col("n") < MANY, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("level"))
    slices = marks.groupBy("level", F.expr("bitmap_bucket_number(bit)").alias("slice")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    maps = [bytearray(BITS // 8) for _ in range(2)]
    for r in slices.toLocalIterator():
        at = (r["slice"] - 1) * 4_096
        maps[r["level"]][at:at + 4_096] = r["bits"]
    return tuple(bytes(m) for m in maps)


class Trie:
    """Path-compressed prefix tree of sorted sets. Nodes keep the range of set sizes below them."""

    __slots__ = ("edge", "children", "members", "low", "high")

    def __init__(self, edge: np.ndarray):
        self.edge, self.children, self.members = edge, {}, []
        self.low, self.high = 1 << 62, 0

    def add(self, keys: np.ndarray, size: int, member: int) -> None:
        node, at = self, 0
        while True:
            node.low, node.high = min(node.low, size), max(node.high, size)
            if at == len(keys):
                node.members.append(member)
                return
            first = int(keys[at])
            child = node.children.get(first)
            if child is None:
                child = Trie(keys[at:])
                node.children[first] = child
                child.low = child.high = size
                child.members.append(member)
                return
            rest = keys[at:]
            most = min(len(rest), len(child.edge))
            differs = np.flatnonzero(rest[:most] != child.edge[:most])
            same = int(differs[0]) if len(differs) else most
            if same < len(child.edge):
                upper = Trie(child.edge[:same])
                upper.low, upper.high = child.low, child.high
                child.edge = child.edge[same:]
                upper.children[int(child.edge[0])] = child
                node.children[first] = upper
                child = upper
            node, at = child, at + same


class Links:
    """Connected members of one bucket."""

    def __init__(self, labels: list[int]):
        roots: dict[int, int] = {}
        self.up = [roots.setdefault(label, k) for k, label in enumerate(labels)]

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k


def trie_links(sets: list[np.ndarray], labels: list[int], percent: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of members that connect what ``labels`` don't yet connect; with ``sides``, only across sides.

    Each set walks down the trie of the sets before it. At a node, ``shared`` n-grams are common to the set and the path;
    what is left of the set and of the longest useful set below bounds the overlap that any set below can reach."""
    links, found = Links(labels), []
    root = Trie(np.empty(0, np.int64))
    for me in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        mine = sets[me]
        size = len(mine)
        todo = [(root, 0, 0)]
        while todo:
            node, shared, depth = todo.pop()
            for other in node.members:
                if links.root(other) != links.root(me) and (sides is None or sides[other] != sides[me]):
                    # depth is the other set's size here: all of it has been compared
                    if 100 * shared >= percent * (size + depth - shared):
                        links.up[links.root(other)] = links.root(me)
                        found.append((other, me))
            for child in node.children.values():
                if 100 * child.high < percent * size:
                    continue
                edge = child.edge
                if not child.children and all(links.root(o) == links.root(me) for o in child.members):
                    continue
                at = np.searchsorted(mine, edge)
                hit = int(np.count_nonzero(mine[np.minimum(at, size - 1)] == edge))
                now, deep = shared + hit, depth + len(edge)
                left = size - int(np.searchsorted(mine, edge[-1], side="right"))
                # the best size below: just long enough to hold what is left of this set
                best = min(max(left + deep, child.low), child.high)
                reach = now + min(left, best - deep)
                if 100 * reach >= percent * (size + best - reach):
                    todo.append((child, now, deep))
        root.add(mine, size, me)
    return found


def sketch(keys: np.ndarray) -> bytes:
    """``SKETCH`` parity bits of a set: two sets differ in no more bits than elements."""
    place = (stir(keys.view(np.uint64)) & np.uint64(SKETCH - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def meeting(cell: np.ndarray, ids: np.ndarray, label: np.ndarray, size: np.ndarray, pos: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Of sets in order of their cell, the pairs (of ids) in a cell with different labels that could be similar if the n-gram is their first common one."""
    out, at, step = [np.empty((0, 2), np.int64)], np.arange(len(cell)), 1
    while len(at):
        at = at[at + step < len(cell)]
        at = at[cell[at] == cell[at + step]]
        both = size[at] + size[at + step]
        least = -(-percent * both // (100 + percent))
        fits = (label[at] != label[at + step]) & (np.minimum(size[at] - pos[at], size[at + step] - pos[at + step]) >= least)
        for k in range(0, len(near := at[fits]), 1 << 14):
            x = near[k:k + (1 << 14)]
            x = x[np.bitwise_count(bits[x] ^ bits[x + step]).sum(1, dtype=np.int64) <= (both - 2 * least)[fits][k:k + (1 << 14)]]
            out.append(np.sort(np.stack([ids[x], ids[x + step]], 1), axis=1))
        step += 1
    return np.unique(np.concatenate(out), axis=0)


def _meetings(rows: DataFrame, percent: int) -> DataFrame:
    """``meeting`` of rows ``cell, id, label, size, pos, bits``, some whole cells at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def pairs(table):
            column = {c: table.column(c).to_numpy() for c in ("cell", "id", "label", "size", "pos")}
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(table), -1)
            found = meeting(column["cell"], column["id"], column["label"], column["size"].astype(np.int64), column["pos"].astype(np.int64), bits, percent)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n * SKETCH // 8 >= AREA_BYTES:
                table = pa.Table.from_batches(held)
                cell = table.column("cell").to_numpy()
                whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
                if whole:
                    yield pairs(table.slice(0, whole))
                    held, n = table.slice(whole).combine_chunks().to_batches(), len(table) - whole
        if n:
            yield pairs(pa.Table.from_batches(held))

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint").filter("a <> b").distinct()


def sets_of(docs: DataFrame, order, n: int, percent: int) -> DataFrame:
    """``doc_id, size, class, skip, prefix`` of every row: the class is a digest of the whole set; ``skip`` n-grams come before the prefix's."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = Order(order.value)
        for batch in batches:
            size, name, skip, prefix = [], [], [], []
            for text in _bytes(batch):
                keys = shingles(text, n)
                size.append(len(keys))
                name.append(_digest(keys))
                first = ranked.sort(keys)[:prefix_length(len(keys), percent)]
                # what no other text has can't be shared
                skip.append(int(np.searchsorted(first, 1 << 58)))
                prefix.append(first[skip[-1]:])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(name, pa.binary()), pa.array(skip, pa.int32()),
                 pa.array(prefix, pa.list_(pa.int64()))], names=["doc_id", "size", "class", "skip", "prefix"])
    return docs.mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, size bigint, class binary, skip int, prefix array<bigint>")


def _digest(keys: np.ndarray) -> bytes:
    import hashlib
    return hashlib.blake2b(keys.tobytes(), digest_size=16).digest()


def _cells(members: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` that tries find in cells (``cell, id, label, keys``) beyond what labels connect."""
    def work(rows: list[tuple]) -> list[tuple[int, int]]:
        ids, sets = [r[0] for r in rows], [np.frombuffer(r[2], np.int64) for r in rows]
        size, bits = np.array(list(map(len, sets))), np.frombuffer(b"".join(map(sketch, sets)), np.uint64).reshape(len(sets), -1)
        near = Links(list(range(len(sets))))
        for k in range(1, len(sets)):
            both = size[:k] + size[k]
            least = -(-percent * both // (100 + percent))
            fits = (np.minimum(size[:k], size[k]) >= least) & (np.bitwise_count(bits[:k] ^ bits[k]).sum(1, dtype=np.int64) <= both - 2 * least)
            for j in np.flatnonzero(fits).tolist():
                near.up[near.root(j)] = near.root(k)
        groups: dict[int, list[int]] = {}
        for k in range(len(sets)):
            groups.setdefault(near.root(k), []).append(k)
        # one trie for each group of members that length and parity bits don't tell apart
        links, out = Links([r[1] for r in rows]), []
        for group in groups.values():
            roots = [links.root(k) for k in group]
            if len(set(roots)) > 1:
                for x, y in trie_links([sets[k] for k in group], roots, percent):
                    x, y = group[x], group[y]
                    links.up[links.root(x)] = links.root(y)
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return [(a, b) for a, b in out if a != b]
    return run_cells(members, ["id", "label", "keys"], work)


def similar(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id, class`` of every row of ``docs`` (``doc_id, text``)."""
    docs = documents(docs)
    order = docs.sparkSession.sparkContext.broadcast(global_order(docs, n))
    rows = stored(sets_of(docs, order, n, percent), "sets")
    known = rows.filter("size > 0 and doc_id is not null")
    nodes = stored(known.groupBy("class").agg(F.min("doc_id").alias("id")), "classes")

    # n-grams that several classes have in their prefixes
    named = known.filter(F.size("prefix") > 0).select("class", "doc_id", "size", "skip", "prefix").join(
        nodes.withColumnRenamed("id", "doc_id"), ["class", "doc_id"])
    placed = named.select(F.col("doc_id").alias("id"), F.col("size").cast("int").alias("size"), "skip", F.posexplode("prefix").alias("pos", "gram"))
    entries = stored(placed.select("id", "gram", "size", (F.col("skip") + F.col("pos")).alias("pos")).distinct(), "entries")
    shared = entries.groupBy("gram").agg(F.count("*").alias("held"), F.min("id").alias("anchor")).filter("held > 1")
    live = stored(entries.join(shared, "gram").select("id", "gram", "size", "pos", "held", "anchor"), "live")
    ids = stored(live.select(F.col("id").alias("doc_id")).distinct(), "ids")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = Order(order.value)
        for batch in batches:
            found = [ranked.sort(shingles(t, n)) for t in _bytes(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([k.tobytes() for k in found], pa.binary()), pa.array(map(len, found), pa.int32()),
                                              pa.array([sketch(k) for k in found], pa.binary())], names=["id", "keys", "size", "bits"])

    few = ids.count() <= BROADCAST_IDS
    sets = stored(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(keys, "id bigint, keys binary, size int, bits binary"), "keys")

    # each document goes to its most frequent n-gram first, in parts that share that n-gram's smallest document
    parts = F.greatest(F.lit(1), F.ceil(F.col("held") / PART)).cast("int")
    chosen = live.groupBy("id").agg(F.max(F.struct("held", "gram", "anchor")).alias("at")).select("id", "at.*")
    seats = chosen.select(F.struct(F.col("gram").alias("at"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part")).alias("cell"), "id")
    anchors = chosen.select("gram", "anchor", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).select(
        F.struct(F.col("gram").alias("at"), "part").alias("cell"), F.col("anchor").alias("id"))
    first = seats.unionByName(anchors).distinct().select(F.xxhash64("cell").alias("cell"), "id", F.col("id").alias("label"))
    edges = stored(_cells(first.join(sets.select("id", "keys"), "id"), percent), "links")
    labels = stored(components(edges), "labels")

    # then the n-grams at which two components still meet, by place and parity bits: parts in pairs
    labelled = live.join(labels, F.col("id") == labels["node"], "left").select("id", "gram", "size", "pos", "held", F.coalesce("label", "id").alias("label"))
    open_grams = labelled.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("gram")
    level = F.ceil(F.col("held") * (SKETCH // 8) / AREA_BYTES).cast("int")
    split = labelled.join(open_grams, "gram", "left_semi").withColumn("parts", level).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    paired = split.select("gram", "id", "size", "pos", "label", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = paired.select(F.xxhash64("gram", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "id", "size", "pos", "label").join(
        sets.select("id", "size", "bits").distinct(), ["id", "size"])
    likely = stored(_meetings(met, percent), "likely")

    # the pairs that are left, each document with the larger ids that it met
    second = likely.select(F.col("a").alias("cell"), F.col("b").alias("id")).unionByName(likely.select(F.col("a").alias("cell"), F.col("a").alias("id"))).distinct().join(
        labels, F.col("id") == labels["node"], "left").select("cell", "id", F.coalesce("label", "id").alias("label"))
    more = stored(_cells(second.join(sets.select("id", "keys"), "id"), percent), "links")
    final = components(more.unionByName(labels.select(F.col("label").alias("a"), F.col("node").alias("b"))))

    reached = nodes.join(final, nodes["id"] == final["node"], "left").select("class", F.coalesce("label", "id").alias("component"))
    return rows.join(stored(reached, "reached"), "class", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "class")


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each group of linked documents, that with the smallest id, with its columns as given.

    Rows without an id or without words stay as they are."""
    found = stored(similar(docs, n, percent).select("doc_id", "component_id", "n_shingles"), "groups")
    drop = stored(found.filter("component_id <> doc_id").select("doc_id").distinct(), "drop")
    again = stored(found.filter("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again")
    kept = docs.join(drop, "doc_id", "left_anti").select(docs.columns)
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(
        kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
