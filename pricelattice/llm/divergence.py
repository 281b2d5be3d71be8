"""Source divergence audit: how far the term frequencies of a language's sources lie apart, and which terms set a source off.

Terms are runs of letters and of characters beyond ASCII, A-Z in lower case. A language keeps the terms found in at least
``least_docs`` of its documents (rows of the table). A share is ``p = 1 + floor(SCALE (count + PRIOR) / (N + PRIOR V))`` over the ``V`` kept
terms, for each source and for the language as a whole; all arithmetic is in whole numbers (decimals for the product).

*Late string materialization.* Tasks count 64-bit digests over whole byte buffers and add up their own counts first, so that a shuffle
gets at most a row per key and task, of fixed width. The first pass finds the kept digests of each language; a bitmap of fixed size
(``BITMAP`` bits, two megabytes) tells the second pass which terms are worth a row (what it lets through wrongly is dropped by an exact
join). The second pass counts these per source and notes, per task and kept digest, the least and the greatest string. Where they differ over all
tasks, terms collide: such digests are split, that is counted once more by their strings. Other texts join back only behind the rank limit.

*Distances.* A source has a share for every kept term, most of them that of count 0. ``sum |p_a - p_b|`` is ``V |zero_a - zero_b|`` plus what the
terms with a count in either add to it. Sources fall into blocks; a task gets the shares of two blocks for a part of the terms, in order of
term, and adds up a matrix of block x block sums, so no row per pair and term exists. A share is sent once for each block of its
language (once up to ``BLOCK`` sources).

Defined results: null text, lang and source are empty strings; a source is one per language and value; a language without kept terms has
distances 0 and no terms; repeated rows count as documents of their own; a language with one source has no pairs; an empty table gives
an empty table; ``doc_id`` and further columns are ignored. Counts must stay below 10^18.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .hashing import _BACK, _BASE, LOWER, _power, chunks, stir

LEAST_DOCS, TOP, PRIOR, SCALE = 30, 50, 5, 1_000_000_000
#: Bits of the bitmap of kept digests; sources in a block; rows that a task adds up before it hands them on.
BITMAP, BLOCK, HELD = 1 << 24, 64, 1_000_000
#: Colliding digests that are split at most; 64 bits make that many only beyond 10^12 distinct terms.
MOST_SPLIT = 1_000_000

_letters = np.zeros(256, bool)
_letters[0x41:0x5B] = _letters[0x61:0x7B] = True
_letters[0x80:] = True


class Terms:
    """The terms of some texts that lie in one byte buffer: digest, place, length and number of the text, in order."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, bits: int):
        self.data = LOWER[data]
        solid, edge = _letters[data], np.zeros(len(data) + 1, bool)
        edge[starts] = edge[-1] = True
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1] | edge[1:-1]
        ends[:-1] &= ~solid[1:] | edge[1:-1]
        self.first = np.flatnonzero(begins)
        last = np.flatnonzero(ends)
        self.size = last + 1 - self.first
        with np.errstate(over="ignore"):
            sums = np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)))
            before = np.where(self.first > 0, sums[self.first - 1], np.uint64(0))
            self.digest = stir((sums[last] - before) * _power("down", _BACK, len(data))[self.first])
        if bits < 64:
            self.digest &= np.uint64((1 << bits) - 1)
        self.doc = np.searchsorted(starts, self.first, side="right") - 1

    def only(self, kept: np.ndarray) -> Terms:
        self.first, self.size, self.digest, self.doc = self.first[kept], self.size[kept], self.digest[kept], self.doc[kept]
        return self

    def by_digest(self) -> Terms:
        return self.only(np.argsort(self.digest, kind="stable"))

    def strings(self, which: np.ndarray) -> pa.Array:
        """The terms numbered ``which``."""
        size = self.size[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        places = np.repeat(self.first[which] - ends[:-1], size) + np.arange(ends[-1])
        return pa.Array.from_buffers(pa.string(), len(which), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(self.data[places].tobytes())])

    def unlike(self, model: np.ndarray) -> np.ndarray:
        """Numbers of the terms whose string isn't that of the term that ``model`` names for each."""
        odd = self.size != self.size[model]
        size = np.where(odd, 0, self.size)
        ends = np.cumsum(size)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        differs = self.data[np.repeat(self.first, size) + inside] != self.data[np.repeat(self.first[model], size) + inside]
        if differs.any():
            odd[np.repeat(np.arange(len(size)), size)[differs]] = True
        return np.flatnonzero(odd)


class Sums:
    """Rows added up by key within a task; handed on whenever more than ``HELD`` keys are held."""

    def __init__(self, keys: list[str], how: list[tuple[str, str]]):
        self.keys, self.how, self.parts, self.rows, self.limit = keys, how, [], 0, HELD

    def add(self, **columns) -> list[pa.Table]:
        self.parts.append(pa.table(columns))
        self.rows += len(self.parts[-1])
        if self.rows < 2 * self.limit:
            return []
        now = self._merge()
        if len(now) > HELD:
            return self.drain()
        self.limit = max(HELD, len(now))
        return []

    def _merge(self) -> pa.Table:
        if len(self.parts) > 1:
            got = pa.concat_tables(self.parts).group_by(self.keys, use_threads=False).aggregate(self.how)
            self.parts = [pa.table({k: got[k] for k in self.keys} | {c: got[f"{c}_{how}"] for c, how in self.how})]
            self.rows = len(self.parts[0])
        return self.parts[0]

    def drain(self) -> list[pa.Table]:
        if not self.parts:
            return []
        out, self.parts, self.rows = [self._merge()], [], 0
        return out


def _shaped(tables: list[pa.Table], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for table in tables:
        columns = [table[f.name].cast(f.type) if f.name in table.column_names else pa.nulls(len(table), f.type) for f in schema]
        yield from pa.table(columns, schema=schema).to_batches(max_chunksize=50_000)


def _buffers(batches: Iterator[pa.RecordBatch], key: str, bits: int) -> Iterator[tuple[np.ndarray, Terms]]:
    """Terms of the texts, buffer by buffer, texts put in order of ``key``; with each text's key."""
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch, [(key, "ascending")]))
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        for at, data, starts in chunks(batch.column("text")):
            yield keys[at:at + len(starts)], Terms(data, starts, bits)


def _marks(*columns: np.ndarray) -> np.ndarray:
    """True where any column differs from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _tallied(terms: Terms, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of terms in order of digest: each key and digest once, with its terms and its documents."""
    key = keys[terms.doc]
    new = _marks(terms.digest, key)
    at = np.flatnonzero(new)
    docs = np.add.reduceat(_marks(terms.digest, terms.doc).astype(np.int64), at) if len(at) else at
    return key[at], terms.digest[at].view(np.int64), np.diff(np.append(at, len(new))), docs


def kept_digests(docs: DataFrame, least_docs: int, bits: int) -> DataFrame:
    """``lid, digest, docs``: the digests in enough documents of a language (``docs`` has ``lid, text``)."""
    schema = pa.schema([("lid", pa.int64()), ("digest", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["lid", "digest"], [("docs", "sum")])
        for keys, terms in _buffers(batches, "lid", bits):
            lid, digest, _, found = _tallied(terms.by_digest(), keys)
            yield from _shaped(sums.add(lid=lid, digest=digest, docs=found), schema)
        yield from _shaped(sums.drain(), schema)

    partial = docs.select("lid", "text").mapInArrow(run, "lid bigint, digest bigint, docs bigint")
    return partial.groupBy("lid", "digest").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)


def bitmap(kept: DataFrame) -> np.ndarray:
    """One bit for each digest value modulo ``BITMAP``; only its words that aren't zero reach the driver."""
    place = F.pmod("digest", F.lit(BITMAP))
    words = kept.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(digest, {BITMAP}) & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def source_counts(docs: DataFrame, kept: DataFrame, bits: int) -> DataFrame:
    """Counts ``gid, digest, n`` of the digests that may be kept, and their strings ``digest, lo, hi`` (``gid`` null), as each
    task found them (``docs`` has ``gid, text``)."""
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(kept))
    schema = pa.schema([("gid", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("lo", pa.string()), ("hi", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, names, known = Sums(["gid", "digest"], [("n", "sum")]), Sums(["digest"], [("lo", "min"), ("hi", "max")]), marks.value
        for keys, terms in _buffers(batches, "gid", bits):
            place = terms.digest & np.uint64(BITMAP - 1)
            terms = terms.only((known[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)).by_digest()
            gid, digest, n, _ = _tallied(terms, keys)
            yield from _shaped(sums.add(gid=gid, digest=digest, n=n), schema)
            new = _marks(terms.digest)
            first = np.flatnonzero(new)
            shown = np.concatenate([first, terms.unlike(first[np.cumsum(new) - 1])]) if len(first) else first
            text = terms.strings(shown)
            yield from _shaped(names.add(digest=terms.digest[shown].view(np.int64), lo=text, hi=text), schema)
        yield from _shaped(sums.drain() + names.drain(), schema)

    return docs.select("gid", "text").mapInArrow(run, "gid bigint, digest bigint, n bigint, lo string, hi string")


def split_counts(docs: DataFrame, digests: list[int], bits: int) -> DataFrame:
    """``gid, digest, split, n, docs`` of the terms of colliding digests, counted by their strings."""
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(digests, np.int64).view(np.uint64)))
    schema = pa.schema([("gid", pa.int64()), ("digest", pa.int64()), ("split", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["gid", "digest", "split"], [("n", "sum"), ("docs", "sum")])
        for keys, terms in _buffers(batches, "gid", bits):
            terms = terms.only(np.isin(terms.digest, wanted.value))
            rows = pa.table({"gid": keys[terms.doc], "digest": terms.digest.view(np.int64), "doc": terms.doc, "split": terms.strings(np.arange(len(terms.doc)))})
            per_doc = rows.group_by(["gid", "digest", "doc", "split"], use_threads=False).aggregate([([], "count_all")])
            yield from _shaped(sums.add(gid=per_doc["gid"], digest=per_doc["digest"], split=per_doc["split"], n=per_doc["count_all"],
                                        docs=pa.array(np.ones(len(per_doc), np.int64))), schema)
        yield from _shaped(sums.drain(), schema)

    partial = docs.select("gid", "text").mapInArrow(run, "gid bigint, digest bigint, split string, n bigint, docs bigint")
    return partial.groupBy("gid", "digest", "split").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lid, gid, text`` of every document, and the groups ``lid, gid, lang, source``; numbers are digests that are seen to differ."""
    filled = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = stored(filled.select("lang", "source").distinct(), "groups")
    for seed in range(16):
        ids = (F.xxhash64(F.lit(seed), "lang").alias("lid"), F.xxhash64(F.lit(seed), "lang", "source").alias("gid"))
        told = groups.select("lang", *ids).agg(F.count("*"), F.countDistinct("gid"), F.countDistinct("lang"), F.countDistinct("lid")).first()
        if told[0] == told[1] and told[2] == told[3]:
            return filled.select(*ids, "text"), groups.select(*ids, "lang", "source")
    raise RuntimeError("sources can't be told apart by their digests")


def share(count: str, total: str, v: str) -> Column:
    """``1 + floor(SCALE (count + PRIOR) / (total + PRIOR v))`` without rounding; 1 where there is nothing to divide by."""
    over = f"cast({total} + {PRIOR} * {v} as decimal(20, 0))"
    return F.expr(f"1 + coalesce((cast({count} + {PRIOR} as decimal(20, 0)) * cast({SCALE} as decimal(10, 0))) div nullif({over}, 0), 0)")


class Table:
    """What is counted: ``cells`` (``lid, gid, digest, split, n, total``), ``groups`` with their sums, and ``names`` (digest to text)."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS, bits: int = 64):
        texts, groups = numbered(docs)
        kept = stored(kept_digests(texts, least_docs, bits), "kept")
        found = stored(source_counts(texts, kept, bits), "counts")
        names = found.filter("gid is null").join(kept.select("digest").distinct(), "digest", "left_semi")
        self.names = stored(names.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "names")
        lids = groups.select("gid", "lid")
        whole = found.filter("gid is not null").groupBy("gid", "digest").agg(F.sum("n").alias("n")).join(lids, "gid").join(
            kept.select("lid", "digest"), ["lid", "digest"]).withColumn("split", F.lit(""))
        collided = [r.digest for r in self.names.filter("lo <> hi").select("digest").limit(MOST_SPLIT + 1).collect()]
        if len(collided) > MOST_SPLIT:
            raise RuntimeError(f"more than {MOST_SPLIT} colliding digests")
        if collided:
            parts = stored(split_counts(texts, collided, bits).join(lids, "gid"), "splits")
            enough = parts.groupBy("lid", "digest", "split").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
            again = parts.join(enough.drop("docs"), ["lid", "digest", "split"])
            whole = whole.join(self.names.filter("lo <> hi").select("digest"), "digest", "left_anti").select("lid", "gid", "digest", "split", "n").unionByName(
                again.select("lid", "gid", "digest", "split", "n"))
        term = Window.partitionBy("lid", "digest", "split")
        self.cells = stored(whole.select("lid", "gid", "digest", "split", "n", F.sum("n").over(term).alias("total")), "cells")
        kinds = self.cells.groupBy("lid", "digest", "split").agg(F.first("total").alias("total")).groupBy("lid").agg(F.count("*").alias("v"), F.sum("total").alias("of_lang"))
        sums = self.cells.groupBy("gid").agg(F.sum("n").alias("of_source"))
        known = groups.join(sums, "gid", "left").join(kinds, "lid", "left").fillna(0, ["of_source", "v", "of_lang"])
        lang = Window.partitionBy("lid")
        known = known.withColumn("sid", F.row_number().over(lang.orderBy("source")) - 1).withColumn("blocks", F.expr(f"cast((max(sid) over (partition by lid)) div {BLOCK} as int) + 1"))
        self.groups = stored(known.withColumn("zero", share("0", "of_source", "v")), "sources")

    def shares(self) -> DataFrame:
        """``cells`` with the share of the source (``p``) and of the language (``q``), and the facts of the source."""
        joined = self.cells.join(self.groups.drop("lid"), "gid")
        return joined.withColumn("p", share("n", "of_source", "v")).withColumn("q", share("total", "of_lang", "v"))


def distances(table: Table) -> DataFrame:
    """``lid, a, b, value``: the summed difference of the shares of each pair of sources (numbers in their language, ``a < b``)."""
    shards = int(table.groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.expr(f"cast(sid div {BLOCK} as int)")

    def dealt(rows: DataFrame) -> DataFrame:
        to = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return to.select("lid", F.least(own, "other").alias("a"), F.greatest(own, "other").alias("b"), "shard", "term", "digest", "split", "sid", "p")

    shares = table.shares().select("lid", "sid", "blocks", F.pmod("digest", F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("term"), "digest", "split", "p")
    heads = table.groups.select("lid", "sid", "blocks", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("term"),
                                F.lit(0).cast("bigint").alias("digest"), F.lit("").alias("split"), F.col("zero").alias("p"))
    cell = ["lid", "a", "b", "shard"]
    rows = dealt(shares).unionByName(dealt(heads)).repartition(*cell).sortWithinPartitions(*cell, "term", "digest", "split")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            columns = [held[c].to_numpy() for c in (*cell, "term", "digest")]
            split = pc.dictionary_encode(held["split"].combine_chunks()).indices.to_numpy()
            at = np.flatnonzero(_marks(*columns, split))
            if len(at) > 1:  # the last term may go on in the next batch
                for block, done in _cells(held.slice(0, at[-1]), block):
                    yield from done
                held = held.slice(at[-1])
        if held is not None:
            for block, done in _cells(held, block):
                yield from done
        if block:
            yield block.told()

    partial = rows.mapInArrow(run, "lid bigint, a int, b int, value bigint").groupBy("lid", "a", "b").agg(F.sum("value").alias("value"))
    ends = [table.groups.select("lid", F.col("sid").alias(s), F.col("zero").alias(f"zero_{s}"), *(["v"] if s == "a" else [])) for s in ("a", "b")]
    return partial.join(ends[0], ["lid", "a"]).join(ends[1], ["lid", "b"]).select("lid", "a", "b", (F.col("value") + F.col("v") * F.abs(F.col("zero_a") - F.col("zero_b"))).alias("value"))


class Block:
    """Two blocks of sources of a language and a part of its terms: sums of what the terms add beyond the shares of count 0."""

    def __init__(self, lid: int, a: int, b: int):
        self.lid, self.a, self.b, self.wide = lid, a, b, BLOCK if a == b else 2 * BLOCK
        self.zero, self.there = np.zeros(self.wide, np.int64), np.zeros(self.wide, bool)
        self.sums = np.zeros((BLOCK, self.wide), np.int64)

    def place(self, sid: np.ndarray) -> np.ndarray:
        return sid - self.a * BLOCK if self.a == self.b else np.where(sid // BLOCK == self.a, sid - self.a * BLOCK, sid - self.b * BLOCK + BLOCK)

    def add(self, term: np.ndarray, sid: np.ndarray, p: np.ndarray) -> None:
        """Shares ``p`` of sources ``sid`` for terms numbered from 0; a term comes in one call."""
        place, n = self.place(sid), int(term[-1]) + 1
        used = np.flatnonzero(self.there)
        shares = np.tile(self.zero, (n, 1))
        shares[term, place] = p
        for i in used[used < BLOCK]:
            self.sums[i, used] += np.abs(shares[:, [i]] - shares[:, used]).sum(axis=0) - n * np.abs(self.zero[i] - self.zero[used])

    def told(self) -> pa.RecordBatch:
        lower = 0 if self.a == self.b else BLOCK
        pairs = [(i, j) for i in np.flatnonzero(self.there[:BLOCK]) for j in np.flatnonzero(self.there) if j >= lower and (self.a != self.b or i < j)]
        i, j = np.array(pairs, np.int64).reshape(-1, 2).T
        base = self.a * BLOCK if self.a == self.b else (self.b - 1) * BLOCK
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), self.lid), pa.int64()), pa.array(i + self.a * BLOCK, pa.int32()), pa.array(j + base, pa.int32()),
                                           pa.array(self.sums[i, j], pa.int64())], names=["lid", "a", "b", "value"])


def _cells(rows: pa.Table, block: Block | None) -> Iterator[tuple[Block, list[pa.RecordBatch]]]:
    """Add whole terms to the block that they belong to; a block is told when the next one begins."""
    lid, a, b, shard, term, digest, sid, p = (rows[c].to_numpy() for c in ("lid", "a", "b", "shard", "term", "digest", "sid", "p"))
    split = pc.dictionary_encode(rows["split"].combine_chunks()).indices.to_numpy()
    starts = np.flatnonzero(_marks(lid, a, b, shard, term))
    for at, end in zip(starts, np.append(starts[1:], len(lid))):
        part = slice(at, end)
        if term[at] == 0:
            fresh = block is None or (block.lid, block.a, block.b, block.shard) != (lid[at], a[at], b[at], shard[at])
            done = [block.told()] if fresh and block else []
            if fresh:
                block = Block(int(lid[at]), int(a[at]), int(b[at]))
                block.shard = shard[at]
            place = block.place(sid[part])
            block.zero[place], block.there[place] = p[part], True
            yield block, done
        else:
            block.add(np.cumsum(_marks(digest[part], split[part])) - 1, sid[part], p[part])
            yield block, []


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has every other source of the language, part ``term`` the terms whose share
    in the source is above the language's, the ``top`` first ones. Rank by value (descending), then item."""
    table = Table(docs, least_docs, bits)
    one = table.groups.select("lid", "gid", "lang", "source", "sid")
    apart = distances(table)
    ways = F.array(*(F.struct(F.col(x).alias("sid"), F.col(y).alias("to")) for x, y in ("ab", "ba")))
    both = apart.select("lid", F.explode(ways).alias("way"), "value").select("lid", "way.*", "value")
    items = one.select("lid", F.col("sid").alias("to"), F.col("source").alias("item"))
    pairs = both.join(one, ["lid", "sid"]).join(items, ["lid", "to"]).select("gid", "lang", "source", F.lit("pair").alias("part"), "item", "value")
    above = table.shares().filter("p > q").select("gid", "lang", "source", "digest", "split", (F.col("p") - F.col("q")).alias("value"))
    best = above.withColumn("near", F.rank().over(Window.partitionBy("gid").orderBy(F.desc("value")))).filter(F.col("near") <= top)
    terms = best.join(table.names.select("digest", "lo"), "digest").select(
        "gid", "lang", "source", F.lit("term").alias("part"), F.when(F.col("split") == "", F.col("lo")).otherwise(F.col("split")).alias("item"), "value")
    ranked = pairs.unionByName(terms).withColumn("rank", F.row_number().over(Window.partitionBy("gid", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top)).drop("gid")
