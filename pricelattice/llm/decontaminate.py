"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts are compared as words (letters and digits, lower case); an edit puts in, leaves out or replaces a word. An item that may
have ``k`` edits holds ``k + 1`` parts of equal length that don't overlap, and an edit spoils one part at most: every passage within
the distance holds one part word for word, at most ``k`` places off. Parts are looked up by hash at every word of the whole text, so that no
passage is missed at any item length or kind of edit. Candidates are verified by exact edit distance, the passage's ends free, so
whatever is reported is right.

A candidate is verified only where a passage within the distance can lie: of the item's ``k + 2`` words that are rarest in the
documents (one counting pass over all texts, benchmark words only), ``k`` edits leave at least two, in places at most ``k``
apart from those in the item.

Benchmark items reach the tasks in slices of at most ``SLICE`` (checked by a count), each slice one pass over the documents,
so no broadcast grows with the benchmark.

Defined results: null or empty texts and items match nothing; items under ``SHORT`` words match without any edit; equal items are all
reported; repeated rows give repeated results; an empty table on either side gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stored

#: Edits that a passage may have per word of the item; items under ``SHORT`` words may have none.
RATE, SHORT = 0.2, 10
SLICE = 20_000

_token = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _token.findall(text.lower())


def limit(n: int, rate: float = RATE) -> int:
    return int(n * rate) if n >= SHORT else 0


def _hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words from each place on; places without as many words have none."""
    out = np.zeros(max(0, len(codes) - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width if len(out) else 0):
            out = (out + codes[k:k + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class Index:
    """Items of one slice: codes of their words, and per length of parts their hashes in order, with item and place."""

    def __init__(self, items: list[tuple[object, str]], counts: dict[str, int], rate: float = RATE):
        self.rate = rate
        split = [(key, words(text or "")) for key, text in items]
        self.items = [(key, w) for key, w in split if w]
        self.code = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.coded = [np.array([self.code[w] for w in ws]) for _, ws in self.items]
        self.rare_at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        parts = defaultdict(list)
        for k, (_, ws) in enumerate(self.items):
            most = limit(len(ws), rate)
            chosen = sorted(range(len(ws)), key=lambda q: (counts.get(ws[q], 0), ws[q], q))[:most + 2]
            for q in chosen:
                self.rare_at[self.code[ws[q]]].append((k, q))
            self.needed.append(max(1, len(chosen) - most))
            count = min(most + 1, len(ws))
            width = len(ws) // count
            at = np.arange(0, width * count, width)
            parts[width].append((_hashes(self.coded[k], width)[at], np.full(len(at), k), at))
        self.rare = np.zeros(len(self.code) + 1, bool)
        self.rare[list(self.rare_at)] = True
        self.tables = {}
        for width, rows in sorted(parts.items()):
            hashed, item, at = (np.concatenate(column) for column in zip(*rows))
            order = np.argsort(hashed, kind="stable")
            self.tables[width] = hashed[order], item[order], at[order]

    def diagonals(self, codes: np.ndarray) -> dict[int, list[int]]:
        """Per item with a part in the text the places, in order, at which the item would start by one of its parts."""
        found = []
        for width, (hashed, item, at) in self.tables.items():
            text = _hashes(codes, width)
            low, high = np.searchsorted(hashed, text), np.searchsorted(hashed, text, side="right")
            where = np.flatnonzero(high > low)
            many = (high - low)[where]
            entry = np.repeat(low[where] - np.cumsum(many) + many, many) + np.arange(many.sum())
            found.append(np.stack([item[entry], np.repeat(where, many) - at[entry]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        items, first = np.unique(pairs[0], return_index=True)
        return {k: part.tolist() for k, part in zip(items.tolist(), np.split(pairs[1], first[1:]))}

    def ranges(self, codes: np.ndarray) -> dict[int, list[list[int]]]:
        """Per item the first and last places, without overlaps, at which a passage within the distance may start."""
        parts = self.diagonals(codes)
        rare = defaultdict(list)
        for at in np.flatnonzero(self.rare[codes]).tolist() if parts else ():
            for item, q in self.rare_at[codes[at]]:
                if item in parts:
                    rare[item].append((at - q, at))
        out = {}
        for item, found in rare.items():
            most, needed, by_part = limit(len(self.coded[item]), self.rate), self.needed[item], parts[item]
            found.sort()
            joined: list[list[int]] = []
            for k in range(needed - 1, len(found)):
                low, high = found[k - needed + 1], found[k]
                if high[0] - low[0] <= most and (needed == 1 or low[1] != high[1]):
                    a, b = high[0] - most, low[0] + most
                    near = bisect_left(by_part, a - most)
                    if near < len(by_part) and by_part[near] <= b + most:
                        if joined and a <= joined[-1][1] + 1:
                            joined[-1][1] = max(joined[-1][1], b)
                        else:
                            joined.append([a, b])
            if joined:
                out[item] = joined
        return out

    def matches(self, text: str) -> list[tuple[object, int, int, int]]:
        """``item, first word, end word, edits`` of each item's best passage in a text."""
        get = self.code.get
        codes = np.array([get(w, 0) for w in words(text)], np.int64)
        best: dict[int, tuple[int, int, int]] = {}
        for item, ranges in self.ranges(codes).items() if len(codes) else ():
            mine = self.coded[item]
            most = limit(len(mine), self.rate)
            for first, last in ranges:
                low, high = max(0, first), max(0, last + len(mine) + most)
                found = passage(mine, codes[low:high], most)
                if found and (item not in best or found[2] < best[item][2]):
                    best[item] = (low + found[0], low + found[1], found[2])
                if item in best and best[item][2] == 0:
                    break
        return [(self.items[k][0], *best[k]) for k in sorted(best)]


def passage(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """The part of ``text`` nearest to ``item`` by edit distance, if that is ``most`` or less: start, end, distance."""
    n = len(text)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    index = np.arange(n + 1)
    for word in item:
        change = cost[:-1] + (text != word)
        drop = cost + 1
        low = drop.copy()
        low[1:] = np.minimum(drop[1:], change)
        begin = start.copy()
        better = change < drop[1:]
        begin[1:][better] = start[:-1][better]
        # words put in: the best of all cells to the left, one edit a step
        reach = np.minimum.accumulate(low - index)
        origin = np.maximum.accumulate(np.where(low - index == reach, index, 0))
        cost, start = reach + index, begin[origin]
    end = int(np.argmin(cost))
    return (int(start[end]), end, int(cost[end])) if cost[end] <= most else None


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, most: int = SLICE) -> DataFrame:
    """``doc_id, item_id, word_start, word_end, edits, item_words``: each document's best passage for each item it holds."""
    items = benchmark.filter("text is not null").select("item_id", "text")
    slices = max(1, -(-items.count() // most))
    keyed = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)))
    if slices > 1:
        keyed = stored(keyed, "items")
    return reduce(DataFrame.unionByName, [_pass(docs, keyed.filter(F.col("slice") == k), benchmark, rate) for k in range(slices)])


def corpus_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each of these words occurs in all texts: one row per word and task, added up in Spark."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = {w: k for k, w in enumerate(shared.value)}
        total = np.zeros(len(code) + 1, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total += np.bincount([code.get(w, len(code)) for w in words(text)], minlength=len(code) + 1)
        seen = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_pydict({"code": pa.array(seen), "n": pa.array(total[seen])})

    sums = documents(docs).select("text").mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {vocabulary[r["code"]]: r["n"] for r in sums}


def _pass(docs: DataFrame, items: DataFrame, benchmark: DataFrame, rate: float) -> DataFrame:
    held = [(r["item_id"], r["text"]) for r in items.select("item_id", "text").collect()]
    counts = corpus_counts(docs, sorted({w for _, text in held for w in words(text)}))
    index = docs.sparkSession.sparkContext.broadcast((held, counts))
    kinds = {"doc_id": docs.schema["doc_id"].dataType, "item_id": benchmark.schema["item_id"].dataType}
    from pyspark.sql.pandas.types import to_arrow_type
    item_type = to_arrow_type(kinds["item_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Index(*index.value, rate)
        size = {key: len(w) for key, w in known.items}
        for batch in batches:
            rows = [(d, *m) for d, m in ((k, m) for k, text in enumerate(batch.column("text").to_pylist()) for m in known.matches(text))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], item_type),
                 *(pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3, 4)), pa.array([size[r[1]] for r in rows], pa.int64())],
                names=["doc_id", "item_id", "word_start", "word_end", "edits", "item_words"])

    return documents(docs).mapInArrow(run, f"doc_id {kinds['doc_id'].simpleString()}, item_id {kinds['item_id'].simpleString()}, "
                                           "word_start bigint, word_end bigint, edits bigint, item_words bigint")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, most: int = SLICE) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, with their columns as given; one map over the texts per slice."""
    items = benchmark.filter("text is not null").select("item_id", "text")
    slices = max(1, -(-items.count() // most))
    for k in range(slices):
        held = [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()]
        index = docs.sparkSession.sparkContext.broadcast((held, corpus_counts(docs, sorted({w for _, text in held for w in words(text)}))))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = Index(*index.value, rate)
            for batch in batches:
                kept = [not known.matches(t) for t in batch.column("text").to_pylist()]
                yield batch.select(["row"]).filter(pa.array(kept, pa.bool_()))

        whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
        docs = whole.mapInArrow(run, f"row {whole.schema['row'].dataType.simpleString()}").select("row.*")
    return docs
