"""Regression trees, forests and boosted trees of bounded leaves on one quantised feature table.

*Table.* Every numeric feature is cut once at up to 255 quantiles of the training rows and takes a byte; the category (one column per
value where a model is written out one-hot) takes a number. Rows are packed into blocks of bytes, checkpointed once, and shared by all trees of all
models and by both fits of a selection (training rows; training and validation rows), which grow side by side in the same jobs.

*Growth.* A node's histogram (rows, weight and sum of the target per feature and bin) gives its best split, the one that lowers the squared error
most: ``x <= edge`` for a feature, ``= value`` for the category. Nodes with more than ``IN_MEMORY`` rows are counted where their rows lie; histograms
are added up by key in a second stage, which returns the split alone. The rows of a smaller node travel once to one task, which grows all below it,
the larger child's histogram by subtraction from its parent's. Which of the two finds a split makes no difference to it. With a bound on
leaves, the tree takes splits best first: the driver, which holds splits and gains only, asks for nodes whose gain it must know
next, until the bound is reached.

*Boosting* adds trees one after another to the mean; a row's value so far is kept with its block and renewed every ``RENEW`` rounds.
*Forests* weight rows by Poisson numbers drawn from a digest of the row and the tree, the same however rows are dealt.

Ties go to the lower feature, then the lower bin, the category last. Rows need finite features and labels; a category value that the
training rows don't have goes the "other" way at every split on the category.
"""

from __future__ import annotations

import heapq
import json
import math
import pickle
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of a node that one task may hold; rows of a block; boosting rounds between renewals; bytes of rows sent in one batch.
IN_MEMORY, BLOCK, RENEW, SENT = 1_000_000, 8_192, 25, 16 << 20
BINS, LEAST_GAIN = 256, 1e-9
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


@dataclass(frozen=True)
class Rules:
    """How one kind of tree grows: deepest level, fewest rows in a leaf, most leaves (None: no bound)."""
    depth: int
    min_leaf: int
    leaves: int | None = None


@dataclass(frozen=True)
class Cuts:
    """Upper edges of the bins of each feature, and the numbers of the category's values."""
    features: tuple[str, ...]
    category: str
    edges: tuple[np.ndarray, ...]
    values: dict[str, int]

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, np.asarray(c, float)) for e, c in zip(self.edges, columns)], axis=1).astype(np.uint8)

    def numbers(self, values) -> np.ndarray:
        return np.array([self.values.get(v, -1) for v in values], np.int32)


def cuts(train: DataFrame, features: list[str], category: str) -> Cuts:
    """Edges and category values of the training rows; the category's vocabulary is part of the model and held on the driver."""
    share = [k / (BINS - 1) for k in range(1, BINS - 1)]
    told = train.agg(*(F.percentile_approx(F.col(c).cast("double"), share, 100_000).alias(f"e{k}") for k, c in enumerate(features))).first()
    names = sorted(r[0] for r in train.select(category).distinct().collect() if r[0] is not None)
    return Cuts(tuple(features), category, tuple(np.unique(np.array(told[f"e{k}"] or [], float)) for k in range(len(features))), {v: k for k, v in enumerate(names)})


BLOCK_SHAPE = "block bigint, n int, bins binary, value binary, y binary, row binary, part binary, so_far binary"


def pack(frame: DataFrame, cut: Cuts, label: str, part: str, keys: list[str], fits: int) -> DataFrame:
    """Blocks of rows. ``part`` (0, 1, …) says in which fits a row takes part: fit ``k`` has the parts up to ``k``."""
    names = [f"f{k}" for k in range(len(cut.features))]
    flat = frame.select(F.xxhash64(*keys).alias("row"), F.col(part).cast("int").alias("part"), F.col(label).cast("double").alias("y"),
                        F.col(cut.category).alias("value"), *(F.col(c).cast("double").alias(n) for c, n in zip(cut.features, names)))
    tasks = frame.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                b = batch.slice(at, BLOCK)
                row = b["row"].to_numpy()
                arrays = (cut.bins([b[n].to_numpy() for n in names]), cut.numbers(b["value"].to_pylist()), b["y"].to_numpy(), row, b["part"].to_numpy().astype(np.uint8), np.zeros((len(b), fits)))
                yield pa.RecordBatch.from_pydict({"block": pa.array([int(row.min())], pa.int64()), "n": pa.array([len(b)], pa.int32()),
                                                  **{n: pa.array([a.tobytes()], pa.binary()) for n, a in zip(("bins", "value", "y", "row", "part", "so_far"), arrays)}})

    return cut_lineage(flat.repartition(tasks, "row").sortWithinPartitions("row").mapInArrow(run, BLOCK_SHAPE))


class Rows:
    """The rows of one packed block."""

    def __init__(self, record: dict, features: int, fits: int):
        n = record["n"]
        self.block = record["block"]
        self.bins = np.frombuffer(record["bins"], np.uint8).reshape(n, features)
        self.value, self.y = np.frombuffer(record["value"], np.int32), np.frombuffer(record["y"], np.float64)
        self.row, self.part = np.frombuffer(record["row"], np.int64), np.frombuffer(record["part"], np.uint8)
        self.so_far = np.frombuffer(record["so_far"], np.float64).reshape(n, fits)


class Tree:
    """Splits of a tree in arrays: feature (-1: leaf; the number of features: category), bin or value number, children, mean."""

    def __init__(self, feature, bin_, left, right, mean):
        self.feature, self.bin = np.asarray(feature, np.int16), np.asarray(bin_, np.int32)
        self.left, self.right, self.mean = np.asarray(left, np.int32), np.asarray(right, np.int32), np.asarray(mean, np.float64)

    def leaf(self, bins: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The node at which each row ends."""
        node, moving = np.zeros(len(bins), np.int32), np.arange(len(bins))
        while len(moving):
            at = node[moving]
            feature = self.feature[at]
            moving, at, feature = (x[feature >= 0] for x in (moving, at, feature))
            category = feature == bins.shape[1]
            left = np.where(category, value[moving] == self.bin[at], bins[moving, np.where(category, 0, feature)] <= self.bin[at])
            node[moving] = np.where(left, self.left[at], self.right[at])
        return node

    def __call__(self, bins: np.ndarray, value: np.ndarray) -> np.ndarray:
        return self.mean[self.leaf(bins, value)]


@dataclass(frozen=True)
class Spec:
    """A tree to grow: which fit's rows, by which rules, on the label or on what boosting has left of it, weighted for a forest or not."""
    fit: int
    rules: Rules
    residual: bool = False
    draw: int | None = None


class Histogram:
    """Rows, weight and sum of the target per feature and bin, and per value of the category."""

    def __init__(self, count, weight, total, value, value_sums):
        self.count, self.weight, self.total, self.value, self.value_sums = count, weight, total, value, value_sums

    @classmethod
    def of(cls, bins: np.ndarray, value: np.ndarray, target: np.ndarray, weight: np.ndarray) -> Histogram:
        features = bins.shape[1]
        flat, size = (bins + BINS * np.arange(features, dtype=np.int32)).ravel(), features * BINS
        plain = weight.min(initial=1) == 1 == weight.max(initial=1)
        count = np.bincount(flat, minlength=size).reshape(features, BINS)
        heavy = count.astype(float) if plain else np.bincount(flat, np.repeat(weight, features), size).reshape(features, BINS)
        total = np.bincount(flat, np.repeat(weight * target, features), size).reshape(features, BINS)
        values, at = np.unique(value, return_inverse=True)
        sums = np.stack([np.bincount(at, x, len(values)) for x in (np.ones(len(value)), weight, weight * target)], axis=1)
        return cls(count, heavy, total, values, sums)

    def state(self) -> tuple:
        return self.count, self.weight, self.total, self.value, self.value_sums

    def _values(self, other: Histogram, sign: int) -> tuple[np.ndarray, np.ndarray]:
        value = np.union1d(self.value, other.value)
        sums = np.zeros((len(value), 3))
        sums[np.searchsorted(value, self.value)] += self.value_sums
        sums[np.searchsorted(value, other.value)] += sign * other.value_sums
        return (value, sums) if sign > 0 else (value[sums[:, 0] > 0], sums[sums[:, 0] > 0])

    def __add__(self, other: Histogram) -> Histogram:
        return Histogram(self.count + other.count, self.weight + other.weight, self.total + other.total, *self._values(other, 1))

    def __sub__(self, part: Histogram) -> Histogram:
        return Histogram(self.count - part.count, self.weight - part.weight, self.total - part.total, *self._values(part, -1))

    def sums(self) -> tuple[int, float, float]:
        return int(self.count[0].sum()), float(self.weight[0].sum()), float(self.total[0].sum())

    def best(self, min_leaf: int) -> tuple[float, int, int, tuple, tuple] | None:
        """Gain, feature, bin, and (rows, weight, sum) on both sides of the best split; None where no split gains."""
        n, w, s = self.sums()
        if n < 2 * min_leaf:
            return None
        with np.errstate(divide="ignore", invalid="ignore"):
            left = [np.cumsum(x, axis=1)[:, :-1] for x in (self.count, self.weight, self.total)]
            value = self.value_sums[self.value >= 0].T
            ways = [np.concatenate([x.ravel(), y]) for x, y in zip(left, value)]
            gain = ways[2] ** 2 / ways[1] + (s - ways[2]) ** 2 / (w - ways[1]) - s ** 2 / w
        gain[~((ways[0] >= min_leaf) & (n - ways[0] >= min_leaf)) | ~np.isfinite(gain)] = 0
        k = int(np.argmax(gain))
        if gain[k] <= LEAST_GAIN * max(1.0, s ** 2 / w):
            return None
        a = (int(ways[0][k]), float(ways[1][k]), float(ways[2][k]))
        numeric = left[0].size
        feature, at = divmod(k, BINS - 1) if k < numeric else (len(self.count), int(self.value[self.value >= 0][k - numeric]))
        return float(gain[k]), feature, at, a, (n - a[0], w - a[1], s - a[2])


@dataclass
class Node:
    """A node that may become part of a tree; ``known`` once its best split (or that it has none) is."""
    rows: int
    mean: float
    depth: int
    known: bool = False
    gain: float = 0.0
    feature: int = -1
    bin: int = 0
    left: int = -1
    right: int = -1


def _child(sums: tuple, depth: int) -> Node:
    return Node(sums[0], sums[2] / sums[1] if sums[1] else 0.0, depth)


def grow_here(bins: np.ndarray, value: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, rules: Rules) -> list[Node]:
    """All nodes below one whose rows are at hand, itself first; with a bound on leaves, the splits that best-first growth may take."""
    hist = Histogram.of(bins, value, target, weight)
    nodes, open_, leaves = [_child(hist.sums(), depth)], [], 1

    def look(k: int, rows: np.ndarray, hist: Histogram) -> None:
        node = nodes[k]
        node.known = True
        found = hist.best(rules.min_leaf) if node.depth < rules.depth else None
        if found:
            # best first where leaves are bounded, else depth first, which holds few histograms
            heapq.heappush(open_, (-found[0] if rules.leaves else -k, k, rows, hist, found))

    look(0, np.arange(len(bins)), hist)
    while open_ and (rules.leaves is None or leaves < rules.leaves):
        _, k, rows, hist, found = heapq.heappop(open_)
        node = nodes[k]
        node.gain, node.feature, node.bin = found[:3]
        side = value[rows] == node.bin if node.feature == bins.shape[1] else bins[rows, node.feature] <= node.bin
        parts = rows[side], rows[~side]
        node.left, node.right, leaves = len(nodes), len(nodes) + 1, leaves + 1
        nodes += [_child(found[3], node.depth + 1), _child(found[4], node.depth + 1)]
        if node.depth + 1 >= rules.depth or len(rows) < 2 * rules.min_leaf:
            nodes[-1].known = nodes[-2].known = True
            continue
        small = int(len(parts[1]) < len(parts[0]))
        few = parts[small]
        counted = Histogram.of(bins[few], value[few], target[few], weight[few])
        both = (hist - counted, counted) if small else (counted, hist - counted)
        for j in (0, 1):
            look(len(nodes) - 2 + j, parts[j], both[j])
    return nodes


class Growing:
    """A tree while it grows: the nodes known so far, on the driver."""

    def __init__(self, spec: Spec, rows: int):
        self.spec, self.nodes, self.big = spec, [Node(rows, 0.0, 0)], False

    def chosen(self) -> tuple[set[int], list[int]]:
        """The splits that the tree takes as far as is known, and the nodes that must be known before more can be said."""
        taken, leaves, unknown = set(), [0], []
        most = self.spec.rules.leaves
        while True:
            unknown = [k for k in leaves if not self.nodes[k].known]
            able = [k for k in leaves if self.nodes[k].known and self.nodes[k].feature >= 0]
            if not able or (unknown and most) or (most and len(leaves) >= most):
                return taken, unknown if not most or len(leaves) < most else []
            for k in ([min(able, key=lambda k: (-self.nodes[k].gain, k))] if most else able):
                leaves.remove(k)
                leaves += [self.nodes[k].left, self.nodes[k].right]
                taken.add(k)

    def graft(self, at: int, below: list[Node]) -> None:
        base = len(self.nodes) - 1
        for k, node in enumerate(below):
            if node.left >= 0:
                node.left, node.right = node.left + base, node.right + base
            if k:
                self.nodes.append(node)
            else:
                self.nodes[at] = node

    def split(self, at: int, found: tuple | None, sums: tuple) -> None:
        node = self.nodes[at]
        node.rows, node.mean, node.known = sums[0], sums[2] / sums[1] if sums[1] else 0.0, True
        if found:
            node.gain, node.feature, node.bin = found[:3]
            node.left, node.right = len(self.nodes), len(self.nodes) + 1
            self.nodes += [_child(found[3], node.depth + 1), _child(found[4], node.depth + 1)]

    def tree(self, taken: set[int], numbers: dict[int, int] | None = None) -> Tree:
        """The splits taken as arrays; ``numbers`` gets the position of each node."""
        order, numbers = [0], {} if numbers is None else numbers
        for k in order:
            numbers[k] = len(numbers)
            if k in taken:
                order += [self.nodes[k].left, self.nodes[k].right]
        rows = [self.nodes[k] for k in order]
        inner = [k in taken for k in order]
        return Tree([n.feature if i else -1 for n, i in zip(rows, inner)], [n.bin if i else 0 for n, i in zip(rows, inner)],
                    [numbers[n.left] if i else -1 for n, i in zip(rows, inner)], [numbers[n.right] if i else -1 for n, i in zip(rows, inner)], [n.mean for n in rows])


def _weights(row: np.ndarray, draw: int | None) -> np.ndarray:
    if draw is None:
        return np.ones(len(row))
    with np.errstate(over="ignore"):
        x = row.view(np.uint64) ^ np.uint64((draw + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for step in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(29))) * np.uint64(step)
        return np.searchsorted(_POISSON, (x >> np.uint64(11)) / float(1 << 53), side="right").astype(float)


def grow(blocks: DataFrame, specs: list[Spec], rows: list[int], features: int, added: tuple[list[Tree], ...] = (), rate: float = 1.0) -> list[Tree]:
    """One tree per spec. ``rows``: how many rows each fit has; ``added``: per fit, trees that boosting has added since the blocks' values."""
    trees = [Growing(spec, rows[spec.fit]) for spec in specs]
    done: list[Tree | None] = [None] * len(trees)
    while True:
        asked: dict[bool, dict[int, tuple[Tree, dict[int, int]]]] = {True: {}, False: {}}
        for i, tree in enumerate(trees):
            if done[i] is None:
                taken, unknown = tree.chosen()
                if not unknown:
                    done[i] = tree.tree(taken)
                    continue
                numbers: dict[int, int] = {}
                now = tree.tree(taken, numbers)
                for big in (True, False):
                    wanted = {numbers[k]: k for k in unknown if (tree.nodes[k].rows > IN_MEMORY) == big}
                    if wanted:
                        asked[big][i] = now, wanted
        if not asked[True] and not asked[False]:
            return done
        for big, wanted in asked.items():
            if wanted:
                for i, k, answer in _ask(blocks, specs, wanted, trees, big, features, len(rows), added, rate):
                    trees[i].split(k, *answer) if big else trees[i].graft(k, answer)


def _target(rows: Rows, fit: int, residual: bool, added: tuple[list[Tree], ...], rate: float) -> np.ndarray:
    if not residual:
        return rows.y
    return rows.y - rows.so_far[:, fit] - rate * sum((tree(rows.bins, rows.value) for tree in added[fit]), np.zeros(len(rows.y)))


def _ask(blocks: DataFrame, specs: list[Spec], wanted: dict, trees: list[Growing], big: bool, features: int, fits: int, added, rate: float) -> Iterator[tuple[int, int, object]]:
    """Of each node asked for: its best split and sums (``big``), or all nodes below it."""
    depths = {(i, k): trees[i].nodes[k].depth for i, (_, nodes) in wanted.items() for k in nodes.values()}

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.to_pylist():
                rows, targets = Rows(record, features, fits), {}
                for i, (tree, nodes) in wanted.items():
                    spec = specs[i]
                    if (key := (spec.fit, spec.residual)) not in targets:
                        targets[key] = _target(rows, *key, added, rate)
                    weight = _weights(rows.row, spec.draw) * (rows.part <= spec.fit)
                    leaf = tree.leaf(rows.bins, rows.value)
                    for number, k in nodes.items():
                        at = np.flatnonzero((leaf == number) & (weight > 0))
                        if len(at):
                            arrays = rows.bins[at], rows.value[at], targets[key][at], weight[at]
                            held.append((i, k, rows.block, pickle.dumps(Histogram.of(*arrays).state() if big else arrays, 5)))
                            size += len(held[-1][3])
                    if size > SENT:
                        yield _held(held)
                        held, size = [], 0
        yield _held(held)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            for i, k, data in zip(*(batch[c].to_pylist() for c in ("tree", "node", "data"))):
                if key is not None and (i, k) != key:
                    yield _held([(*key, 0, _answer(parts, specs[key[0]].rules, depths[key], big))])
                    parts = []
                key, got = (i, k), pickle.loads(data)
                if big:
                    parts = [parts[0] + Histogram(*got) if parts else Histogram(*got)]
                else:
                    parts.append(got)
        if key is not None:
            yield _held([(*key, 0, _answer(parts, specs[key[0]].rules, depths[key], big))])

    shape = "tree int, node int, block bigint, data binary"
    tasks = min(len(depths), 4 * blocks.sparkSession.sparkContext.defaultParallelism)
    moved = blocks.mapInArrow(sent, shape).repartition(tasks, "tree", "node").sortWithinPartitions("tree", "node", "block")
    told = moved.mapInArrow(answered, shape).select("tree", "node", "data").toArrow()
    got = {(i, k): pickle.loads(data) for i, k, data in zip(*(told[c].to_pylist() for c in ("tree", "node", "data")))}
    for i, k in depths:
        # a node that no row reaches (all weights zero) has nothing to split
        found = got.get((i, k), (None, (0, 0.0, 0.0)) if big else [(0, 0.0, depths[i, k], True)])
        yield i, k, found if big else [Node(*fields) for fields in found]


def _held(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("tree", pa.int32()), ("node", pa.int32()), ("block", pa.int64()), ("data", pa.binary()))
    return pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds)})


def _answer(parts: list, rules: Rules, depth: int, big: bool) -> bytes:
    if big:
        return pickle.dumps((parts[0].best(rules.min_leaf) if depth < rules.depth else None, parts[0].sums()))
    return pickle.dumps([astuple(node) for node in grow_here(*(np.concatenate(x) for x in zip(*parts)), depth, rules)])


@dataclass
class TreeModel:
    """``base + scale x`` the sum of the trees; ``transform`` adds the column ``prediction``."""
    cuts: Cuts
    trees: list[Tree] = field(default_factory=list)
    base: float = 0.0
    scale: float = 1.0

    def predict(self, bins: np.ndarray, value: np.ndarray) -> np.ndarray:
        return self.base + self.scale * sum((tree(bins, value) for tree in self.trees), np.zeros(len(bins)))

    def transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((astuple(self.cuts), [(t.feature, t.bin, t.left, t.right, t.mean) for t in self.trees], self.base, self.scale))

        @F.pandas_udf("double")
        def predicted(rows: pd.DataFrame) -> pd.Series:
            cut, grown, base, scale = shared.value
            model = TreeModel(Cuts(*cut), [Tree(*t) for t in grown], base, scale)
            columns = [rows[f"f{k}"].to_numpy(float) for k in range(len(model.cuts.features))]
            return pd.Series(model.predict(model.cuts.bins(columns), model.cuts.numbers(rows["value"])))

        given = F.struct(F.col(self.cuts.category).alias("value"), *(F.col(c).cast("double").alias(f"f{k}") for k, c in enumerate(self.cuts.features)))
        return df.withColumn("prediction", predicted(given))

    def save(self, spark: SparkSession, folder: str) -> None:
        """One row per node, with edges and category values written out, and one row of facts."""
        names, features = {k: v for v, k in self.cuts.values.items()}, len(self.cuts.features)
        nodes = pd.concat([pd.DataFrame({"tree": t, "node": range(len(x.mean)), "feature": x.feature, "bin": x.bin, "left": x.left, "right": x.right, "mean": x.mean}) for t, x in enumerate(self.trees)])
        nodes["edge"] = [float(self.cuts.edges[f][b]) if 0 <= f < features and b < len(self.cuts.edges[f]) else None for f, b in zip(nodes.feature, nodes.bin)]
        nodes["value"] = [names[b] if f == features else None for f, b in zip(nodes.feature, nodes.bin)]
        spark.createDataFrame(nodes.astype({c: int for c in ("tree", "node", "feature", "bin", "left", "right")}),
                              "tree int, node int, feature int, bin int, left int, right int, mean double, edge double, value string").write.mode("overwrite").parquet(f"{folder}/nodes")
        facts = json.dumps({"features": self.cuts.features, "category": self.cuts.category, "edges": [list(e) for e in self.cuts.edges], "values": self.cuts.values, "base": self.base, "scale": self.scale})
        spark.createDataFrame([(facts,)], "facts string").write.mode("overwrite").parquet(f"{folder}/facts")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> TreeModel:
        facts = json.loads(spark.read.parquet(f"{folder}/facts").first()[0])
        nodes = spark.read.parquet(f"{folder}/nodes").orderBy("tree", "node").toPandas()
        trees = [Tree(*(g[c].to_numpy() for c in ("feature", "bin", "left", "right", "mean"))) for _, g in nodes.groupby("tree", sort=True)]
        return cls(Cuts(tuple(facts["features"]), facts["category"], tuple(np.array(e) for e in facts["edges"]), facts["values"]), trees, facts["base"], facts["scale"])


@dataclass(frozen=True)
class Packed:
    """The shared table of a selection: cuts, blocks, and rows and mean of each fit."""
    cuts: Cuts
    blocks: DataFrame
    rows: list[int]
    means: list[float]


def packed(frame: DataFrame, features: list[str], category: str, label: str, part: str, keys: list[str], fits: int = 1) -> Packed:
    """Rows with ``part`` from 0 to ``fits - 1``; bins and category values come from part 0."""
    used = frame.where(F.col(part).between(0, fits - 1))
    cut = cuts(used.where(F.col(part) == 0), features, category)
    told = used.agg(*(F.count_if(F.col(part) <= k).alias(f"n{k}") for k in range(fits)), *(F.avg(F.when(F.col(part) <= k, F.col(label))).alias(f"m{k}") for k in range(fits))).first()
    return Packed(cut, pack(used, cut, label, part, keys, fits), [told[f"n{k}"] for k in range(fits)], [float(told[f"m{k}"] or 0.0) for k in range(fits)])


def single(table: Packed, rules: Rules) -> list[TreeModel]:
    """One tree for each fit."""
    return [TreeModel(table.cuts, [t]) for t in grow(table.blocks, [Spec(k, rules) for k in range(len(table.rows))], table.rows, len(table.cuts.features))]


def forest(table: Packed, rules: Rules, trees: int, seed: int) -> list[TreeModel]:
    """Means of trees on rows drawn with Poisson numbers, for each fit."""
    fits = len(table.rows)
    grown = grow(table.blocks, [Spec(k, rules, draw=seed * 1_000_003 + t) for k in range(fits) for t in range(trees)], table.rows, len(table.cuts.features))
    return [TreeModel(table.cuts, grown[k * trees:(k + 1) * trees], scale=1 / trees) for k in range(fits)]


def boosted(table: Packed, rules: Rules, rounds: int, rate: float) -> list[TreeModel]:
    """Trees on what the mean and the trees before have left, each times ``rate``, for each fit."""
    fits, features = len(table.rows), len(table.cuts.features)
    models = [TreeModel(table.cuts, [], table.means[k], rate) for k in range(fits)]
    blocks, since = _renewed(table.blocks, tuple([] for _ in models), 0.0, features, table.means), 0
    for done in range(rounds):
        added = tuple(m.trees[since:] for m in models)
        for model, tree in zip(models, grow(blocks, [Spec(k, rules, residual=True) for k in range(fits)], table.rows, features, added, rate)):
            model.trees.append(tree)
        if (done + 1) % RENEW == 0 and done + 1 < rounds:
            blocks, since = _renewed(blocks, tuple(m.trees[since:] for m in models), rate, features), done + 1
    return models


def _renewed(blocks: DataFrame, added: tuple[list[Tree], ...], rate: float, features: int, start: list[float] | None = None) -> DataFrame:
    """Blocks with their rows' values brought up to date."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for record in batch.to_pylist():
                rows = Rows(record, features, len(added))
                now = np.stack([(start[k] if start else rows.so_far[:, k]) + rate * sum((t(rows.bins, rows.value) for t in trees), np.zeros(len(rows.y))) for k, trees in enumerate(added)], axis=1)
                out.append(now.tobytes())
            yield batch.set_column(batch.schema.get_field_index("so_far"), "so_far", pa.array(out, pa.binary()))

    return cut_lineage(blocks.mapInArrow(run, BLOCK_SHAPE))
