"""Line dedup: lines whose word sets are similar to an earlier line's are removed.

A line is the set of its distinct words (A-Z in lower case). It goes if the corpus holds an earlier line (lower ``doc_id``, then
lower position) with a Jaccard similarity of ``percent`` or more; lines without a word stay. Whether the earlier line stays
itself doesn't matter, so the result depends on no order of work.

*Join.* Words are ordered by rarity (the ``HOT`` most frequent words of all texts, counted in each task and added up, come last by
frequency class; others by digest). What lines are joined by are pairs of words that follow each other in that order: each word that only one
of two lines has spoils at most one of them, so that sets of ``n`` words share one among their first (rarest) ``n - ceil((2 t - 1) n) + 1``.
Equal sets are one line from the start, at its first place. A prefix goes to where its tokens meet as records of 18 bytes (``ENTRY``); two lines
go on if the *length filter* (``t |x| <= |y|``) and 64 parity bits (their differences are no more than the words that differ) don't exclude them, and
if they meet as often as similar lines of their size do (``shared_tokens``; prefixes are longer by as many). Of these alone the sets are
fetched and verified exactly with the *positional filter*. Digests of 64 bits stand for words.

*Copies in bulk.* What is asked of a line is whether any earlier line is similar, so a search ends with the first hit. Where a token is rich in
pairs, its lines go on instead of them. Then each line goes to one bucket only (large ones in parts that share one line); what isn't removed there is searched
against all lines of its buckets, by their lengths and 256 parity bits first, so that sets move only to likely partners. Pairs within a group of copies
are never written out.

Defined results: null or empty texts have no lines; repeated rows of an id are one text's lines at the same places, so all of
them lose a line together or keep it; a null id counts as lower than any other; a document that loses every line with a word keeps the
other lines; an empty table gives an empty table; ``dedup`` keeps all further columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .cells import PART, run_cells
from .common import documents, let, stored
from .hashing import chunks, stir, words

PERCENT = 80
#: Frequent words that are broadcast, and how many a task reports at most. Neither touches the result.
HOT, LOCAL_HOT = 1 << 17, 1 << 15
#: Documents with candidate lines are broadcast up to this many, counted first; beyond it texts are shuffled to them.
BROADCAST_DOCS = 200_000
#: What a line sends to each place of its prefix. Tag (half of its name) and bits together tell lines apart there; sizes end at ``LONGEST``.
ENTRY = np.dtype([("token", "<u4"), ("tag", "<u4"), ("bits", "<u8"), ("size", "<u2")])
LONGEST = (1 << 16) - 1
#: Places are dealt by the first 12 bits of a token. A task writes entries after so many and looks at so many or one place's together. Of a
#: token that more than ``MANY`` lines have, or that gives more than ``RICH`` pairs a line, all lines go on unseen, at the latest when a place has ``CROWD``.
BUCKETS, FLUSH, HELD, MANY, RICH, CROWD = 1 << 12, 1 << 20, 1 << 18, 1 << 12, 16, 1 << 21
#: Lines of a cell that are compared without looking at their lengths and bits first.
FEW = 4
#: Lines of one bucket whose parity bits a task compares at once (twice as many where two parts of a bucket meet), some 100 bytes each.
SIGNED = 1 << 14


def shared_tokens(size, percent: int):
    """Tokens that two similar lines of this size or more share in their prefixes, which are longer by all but one of them."""
    return 1 + size // 32 * (3 * percent > 200)


def lines_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of texts: each word's digest and line (numbered through the run), each line's text and its number there."""
    for first, data, starts in chunks(column):
        breaks = np.flatnonzero(data == 10)
        code, at = words(data, starts)
        # a line begins at every text and after every line feed; an empty text begins where the next one does
        text_of_break = np.searchsorted(starts, breaks, side="right") - 1
        counts = np.bincount(text_of_break, minlength=len(starts)) + 1
        base = np.cumsum(counts) - counts
        text_of_word = np.searchsorted(starts, at, side="right") - 1
        line = np.searchsorted(breaks, at) + text_of_word
        text = np.repeat(np.arange(len(starts)), counts)
        yield code, line, text + first, np.arange(len(text)) - base[text]


def word_order(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Digests (sorted) and frequency classes of the most frequent words of all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, counts = [], np.empty(0, np.uint64), np.empty(0, np.int64)

        def fold(keys, counts):
            mine, times = np.unique(np.concatenate(held), return_counts=True)
            every, at = np.unique(np.concatenate([keys, mine]), return_inverse=True)
            return every, np.bincount(at, weights=np.concatenate([counts, times])).astype(np.int64)

        for batch in batches:
            held += [code for code, *_ in lines_of(batch.column("text"))]
            if sum(map(len, held)) > 1_000_000:
                keys, counts = fold(keys, counts)
                held.clear()
                if len(keys) > 2_000_000:
                    keys, counts = keys[counts > 1], counts[counts > 1]
        if held:
            keys, counts = fold(keys, counts)
        top = np.argsort(-counts, kind="stable")[:LOCAL_HOT]
        top = top[counts[top] > 1]
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys[top].view(np.int64)), "n": pa.array(counts[top])})

    found = docs.select("text").mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    hot = found.filter("n > 3").orderBy(F.desc("n"), "key").limit(HOT).toPandas()
    keys = hot["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.minimum(np.log2(hot["n"].to_numpy(np.float64)).astype(np.uint64) + np.uint64(1), np.uint64(31))[order]


def ranked(code: np.ndarray, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Digests with their frequency class on top: rare words first."""
    keys, classes = order
    out = code >> np.uint64(5)
    if len(keys) and len(code):
        by = np.argsort(code)  # looked up in order, the keys stay in the processor's cache
        at = np.empty(len(code), np.int64)
        at[by] = np.minimum(np.searchsorted(keys, code[by]), len(keys) - 1)
        hit = keys[at] == code
        out[hit] |= classes[at[hit]] << np.uint64(59)
    return out


def _sets(code, line, order) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (line, word) in order of line, then rank."""
    rank = ranked(code, order)
    if not len(rank):
        return rank, line
    # one sort by the line and what room is left for the rank; where that was too little, by both
    wide = np.uint64(max(1, int(line[-1]).bit_length()))
    by = np.argsort(line.astype(np.uint64) << (np.uint64(64) - wide) | rank >> wide)
    if ((line[by][1:] == line[by][:-1]) & (rank[by][1:] < rank[by][:-1])).any():
        by = np.lexsort((rank, line))
    rank, line = rank[by], line[by]
    new = np.ones(len(rank), bool)
    new[1:] = (rank[1:] != rank[:-1]) | (line[1:] != line[:-1])
    return rank[new], line[new]


def _named(rank: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, size and name (a digest) of each owner's set."""
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
    size = np.diff(np.r_[begin, len(owner)])
    with np.errstate(over="ignore"):
        name = np.add.reduceat(stir(rank + np.uint64(1)), begin) if len(begin) else np.empty(0, np.uint64)
        return begin, size, stir(name + size.astype(np.uint64))


def parity(rank: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64 bits of each set: two sets differ in no more bits than words."""
    return np.bitwise_xor.reduceat(np.uint64(1) << (stir(rank + np.uint64(77)) & np.uint64(63)), begin)


def parities(rank: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same in 256 bits, four words a set."""
    place = stir(rank + np.uint64(77))
    bit, word, owner = np.uint64(1) << (place & np.uint64(63)), (place >> np.uint64(6) & np.uint64(3)).astype(np.int64), np.repeat(np.arange(len(begin)), size)
    out = np.zeros((len(begin), 4), np.uint64)
    np.bitwise_xor.at(out, (owner, word), bit)
    return out


def prefix_of(rank: np.ndarray, begin: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the sets' prefixes and how many each has: pairs of words in succession, single words where less than two thirds must agree."""
    if 3 * percent > 200:
        most = np.minimum(size - 1, size - -(-size * (2 * percent - 100) // 100) + shared_tokens(size, percent))
        with np.errstate(over="ignore"):
            token = stir(rank * np.uint64(0x9E3779B97F4A7C15) + np.r_[rank[1:], np.zeros(min(1, len(rank)), np.uint64)])
    else:
        most, token = size - -(-size * percent // 100) + 1, stir(rank)
    return token[np.arange(len(rank)) - np.repeat(begin, size) < np.repeat(most, size)], most


def records(docs: DataFrame, order, percent: int) -> DataFrame:
    """One pass over the texts: rows ``doc_id, line, name, bits`` of every line with a word, and rows ``bucket, entries`` of their prefixes."""
    kind = docs.schema["doc_id"].dataType

    def entries(held) -> pa.RecordBatch:
        name, bits, size, most, token = (np.concatenate(x) for x in zip(*held))
        first = np.zeros(len(name), bool)
        first[np.unique(name, return_index=True)[1]] = True
        token, owner = token[np.repeat(first, most)], np.repeat(np.flatnonzero(first), most[first])
        by = np.argsort(token)
        token, owner = token[by], owner[by]
        out = np.empty(len(token), ENTRY)
        out["token"], out["tag"], out["bits"] = token >> np.uint64(20) & np.uint64(0xFFFFFFFF), name[owner] & np.uint64(0xFFFFFFFF), bits[owner]
        out["size"] = np.minimum(size[owner], LONGEST)
        ends = np.searchsorted(token >> np.uint64(52), np.arange(BUCKETS + 1).astype(np.uint64))
        some = np.flatnonzero(ends[1:] > ends[:-1])
        blobs = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((np.r_[ends[some], ends[-1]] * ENTRY.itemsize).astype(np.int32)), pa.py_buffer(out)])
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), blobs, *(pa.nulls(len(some), t) for t in (to_arrow_type(kind), pa.int32(), pa.int64(), pa.int64()))],
                                          names=["bucket", "entries", "doc_id", "line", "name", "bits"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, dealt = [], 0, 0
        for batch in batches:
            for code, line, text, number in lines_of(batch.column("text")):
                rank, owner = _sets(code, line, order.value)
                if not len(rank):
                    continue
                begin, size, name = _named(rank, owner)
                bits = parity(rank, begin)
                token, most = prefix_of(rank, begin, size, percent)
                held.append((name, bits, size, most, token))
                which = owner[begin]
                # rows of lines are dealt in turn
                yield pa.RecordBatch.from_arrays([
                    pa.array(((np.arange(len(name)) + dealt) % BUCKETS).astype(np.int32)), pa.nulls(len(name), pa.binary()),
                    batch.column("doc_id").take(pa.array(text[which])).cast(to_arrow_type(kind)), pa.array(number[which].astype(np.int32)),
                    pa.array(name.view(np.int64)), pa.array(bits.view(np.int64))], names=["bucket", "entries", "doc_id", "line", "name", "bits"])
                n, dealt = n + len(token), dealt + len(name)
                if n >= FLUSH:
                    yield entries(held)
                    held, n = [], 0
        if n:
            yield entries(held)

    return docs.mapInArrow(make, f"bucket int, entries binary, doc_id {kind.simpleString()}, line int, name bigint, bits bigint")


def partners(word: np.ndarray, size: np.ndarray, bits: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct entries in order of word, then size: the pairs at a word that length and bits don't exclude, and which entries' words are too rich for pairs."""
    new = np.r_[True, word[1:] != word[:-1]][:len(word)]
    group, count = np.cumsum(new) - 1, np.diff(np.r_[np.flatnonzero(new), len(word)])
    rich, found = count > MANY, np.zeros(len(count), np.int64)
    one, two = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at, step = np.flatnonzero(~rich[group]), 1
    while len(at):
        at = at[at + step < len(word)]
        at = at[(word[at] == word[at + step]) & (100 * size[at] >= percent * size[at + step])]
        differ = np.bitwise_count(bits[at] ^ bits[at + step]).astype(np.int64)
        near = at[(differ * (100 + percent) <= (100 - percent) * (size[at] + size[at + step])) | (size[at + step] >= LONGEST)]
        if len(near):
            one.append(near)
            two.append(near + step)
            np.add.at(found, group[near], 1)
            over = found > RICH * count
            if over.any():
                rich |= over
                at = at[~rich[group[at]]]
        step += 1
    one, two = np.concatenate(one), np.concatenate(two)
    keep = ~rich[group[one]]
    return one[keep], two[keep], rich[group]


MET = ["word", "tag", "pair", "n", "k", "doc_id", "line", "name", "bits"]


def meetings(given: DataFrame, percent: int) -> DataFrame:
    """``records`` with, in place of the entries, rows ``pair, n, k`` (two tags, how often they met, and how often similar lines do) and, for words
    too rich for pairs, ``word, tag, bits``. A task holds a few places, or a part of a crowded one."""
    kind = given.schema["doc_id"].dataType
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), to_arrow_type(kind), pa.int32(), pa.int64(), pa.int64()]

    def rows(count, **columns):
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(count, t) for c, t in zip(MET, types)], names=MET)

    def settle(held, crowded, whole):
        """Rows of what goes on, what is still held, and the words of which everything goes on."""
        entry = np.concatenate([e for _, e in held])
        word = np.concatenate([np.full(len(e), b, np.uint64) for b, e in held]) << np.uint64(32) | entry["token"]
        if whole:  # a word that one line has gives no pair
            by = np.argsort(word)
            same = word[by[1:]] == word[by[:-1]]
            by = by[np.r_[False, same] | np.r_[same, False] | np.isin(word[by], crowded)] if len(by) else by
            entry, word = entry[by], word[by]
        by = np.lexsort((entry["tag"], entry["bits"], word << np.uint64(16) | entry["size"]))
        entry, word = entry[by], word[by]
        new = np.ones(len(word), bool)  # copies of a line
        new[1:] = (entry[1:] != entry[:-1]) | (word[1:] != word[:-1])
        entry, word = entry[new], word[new]
        rest, out = [], []
        if whole:
            on = np.isin(word, crowded)
            entry, word, out = entry[~on], word[~on], [(entry[on], word[on])]
            size, tag = entry["size"].astype(np.int64), entry["tag"].astype(np.uint64)
            one, two, on = partners(word, size, entry["bits"], percent)
            pair, first, n = np.unique(np.minimum(tag[one], tag[two]) << np.uint64(32) | np.maximum(tag[one], tag[two]), return_index=True, return_counts=True)
            k = shared_tokens(np.minimum(size[one], size[two])[first], percent)
            yield rows(len(pair), pair=pa.array(pair.view(np.int64)), n=pa.array(n.astype(np.int32)), k=pa.array(k.astype(np.int32))), [], crowded
        else:
            words, count = np.unique(word, return_counts=True)
            crowded = np.union1d(crowded, words[count > MANY])
            on = np.isin(word, crowded)
            place = word >> np.uint64(32)
            rest = [(b, entry[~on & (place == np.uint64(b))]) for b in np.unique(place).tolist()]
        for entry, word in [*out, (entry[on], word[on])]:
            yield rows(len(word), word=pa.array(word.view(np.int64)), tag=pa.array(entry["tag"].astype(np.int64)),
                       bits=pa.array(np.ascontiguousarray(entry["bits"]).view(np.int64))), rest, crowded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, limit, crowded = [], 0, CROWD, np.empty(0, np.uint64)
        for batch in batches:
            sent = pc.is_valid(batch.column("entries"))
            lines = batch.filter(pc.invert(sent))
            yield rows(len(lines), **{c: lines.column(c) for c in ("doc_id", "line", "name", "bits")})
            sent = batch.filter(sent)
            for bucket, blob in zip(sent.column("bucket").to_pylist(), sent.column("entries").to_pylist()):
                if held and bucket != held[-1][0] and n >= HELD:
                    for out, held, _ in settle(held, crowded, True):
                        yield out
                    held, n, limit, crowded = [], 0, CROWD, np.empty(0, np.uint64)
                held.append((bucket, np.frombuffer(blob, ENTRY)))
                n += len(held[-1][1])
                if n >= limit:
                    for out, held, crowded in settle(held, crowded, False):
                        yield out
                    n = sum(len(e) for _, e in held)
                    limit = n + CROWD
        if held:
            for out, *_ in settle(held, crowded, True):
                yield out

    return given.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        run, f"word bigint, tag bigint, pair bigint, n int, k int, doc_id {kind.simpleString()}, line int, name bigint, bits bigint")


def reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity; the start of both decides most pairs (positional filter)."""
    least = -(-percent * (len(x) + len(y)) // (100 + percent))
    if min(len(x), len(y)) < least:
        return False
    head = min(len(x), max(4, len(x) - least + 1))
    at = np.searchsorted(y, x[:head])
    got = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x[:head]))
    if got + min(len(x) - head, len(y) - int(np.searchsorted(y, x[head - 1], side="right"))) < least:
        return False
    at = np.searchsorted(y, x[head:])
    return got + int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x[head:])) >= least


def later(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Of a cell's lines (``id, place, probe, keys``; places as comparable text), the probes with an earlier similar line: ``(earlier, later)``."""
    lines = sorted(({r[0]: r for r in rows}).values(), key=lambda r: r[1])
    sets = [np.frombuffer(r[3], np.uint64) for r in lines]
    if len(lines) <= FEW:
        firsts = ((k, next((j for j in range(k) if reaches(sets[k], sets[j], percent)), None)) for k, r in enumerate(lines) if r[2])
        return [(lines[j][0], lines[k][0]) for k, j in firsts if j is not None]
    size = np.array([len(s) for s in sets])
    bits = parity(np.concatenate(sets), np.cumsum(size) - size)
    out = []
    for k in range(1, len(lines)):
        if lines[k][2]:
            # length and parity first, then the earliest lines first
            differ = np.bitwise_count(bits[:k] ^ bits[k]).astype(np.int64)
            fits = (100 * size[:k] >= percent * size[k]) & (100 * size[k] >= percent * size[:k])
            for j in np.flatnonzero(fits & (differ * (100 + percent) <= (100 - percent) * (size[:k] + size[k]))).tolist():
                if reaches(sets[k], sets[j], percent):
                    out.append((lines[j][0], lines[k][0]))
                    break
    return out


def likely(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Of a bucket's lines (``id, place, probe, size, bits``), all pairs ``(earlier, later)`` of a later probe that length and parity don't exclude."""
    lines = sorted(rows, key=lambda r: r[1])
    size, bits = np.array([r[3] for r in lines]), np.frombuffer(b"".join(r[4] for r in lines), np.uint64).reshape(-1, 4)
    out = []
    for k in (k for k, r in enumerate(lines) if r[2]):
        fits = np.flatnonzero((100 * size[:k] >= percent * size[k]) & (100 * size[k] >= percent * size[:k]))
        differ = np.bitwise_count(bits[fits] ^ bits[k]).sum(1).astype(np.int64)
        out += [(lines[j][0], lines[k][0]) for j in fits[differ * (100 + percent) <= (100 - percent) * (size[fits] + size[k])].tolist()]
    return out


def removals(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All lines with a word (``doc_id, line, name``) and the sets (``name, doc_id, line, gone``) with their first place."""
    docs = documents(docs)
    order = docs.sparkSession.sparkContext.broadcast(word_order(docs))
    found = stored(meetings(records(docs, order, percent), percent), "records")
    lines = found.filter("name is not null").select("doc_id", "line", "name", "bits")
    firsts = stored(lines.groupBy("name").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.first("bits").alias("bits")), "firsts")

    # pairs that met as often as similar lines do; the lines of rich words, by word
    half = F.lit(0xFFFFFFFF)
    known = firsts.select("name", F.col("name").bitwiseAND(half).alias("tag"), "bits", "at")
    often = found.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"), F.min("k").alias("k")).filter("n >= k")
    x, y = (known.select(F.col("tag").alias(f"{c}_tag"), F.col("name").alias(f"{c}_name"), F.col("at").alias(f"{c}_at")) for c in "xy")
    met = often.select(F.shiftrightunsigned("pair", 32).alias("x_tag"), F.col("pair").bitwiseAND(half).alias("y_tag")).join(x, "x_tag").join(y, "y_tag").filter("x_name <> y_name")
    pairs = stored(met.select(F.when(F.col("x_at") < F.col("y_at"), F.col("x_name")).otherwise(F.col("y_name")).alias("early"),
                              F.when(F.col("x_at") < F.col("y_at"), F.col("y_name")).otherwise(F.col("x_name")).alias("late")), "pairs")
    entries = stored(found.filter("word is not null").select("word", "tag", "bits").join(known, ["tag", "bits"]).select("name", "word").distinct(), "entries")
    shared = entries.groupBy("word").agg(F.count("*").alias("held"), F.min("name").alias("anchor")).filter("held > 1")
    live = stored(entries.join(shared, "word"), "live")
    named = pairs.select(F.col("early").alias("name")).unionByName(pairs.select(F.col("late").alias("name"))).unionByName(live.select("name"))
    names = named.distinct().join(firsts, "name").select("name", "at.*")
    per_doc = stored(names.groupBy("doc_id").agg(F.collect_list(F.struct("line", "name")).alias("wanted")), "wanted")
    kind = docs.schema["doc_id"].dataType

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("name").to_numpy(zero_copy_only=False)
            for code, line, text, _ in lines_of(batch.column("text")):
                rank, owner = _sets(code, line, order.value)
                begin, size, name = _named(rank, owner)
                row = text[owner[begin]]
                same = np.flatnonzero(name.view(np.int64) == wanted[row])  # rows of one id may differ
                taken = pa.array(row[same])
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).take(taken) for c in ("name", "doc_id", "line")),
                    pa.array([rank[b:b + n].tobytes() for b, n in zip(begin[same].tolist(), size[same].tolist())], pa.binary()),
                    pa.array(size[same].astype(np.int32)), pa.array([b.tobytes() for b in parities(rank, begin, size)[same]], pa.binary())],
                    names=["name", "doc_id", "line", "keys", "size", "bits"])

    few = per_doc.count() <= BROADCAST_DOCS
    texts = docs.join(F.broadcast(per_doc) if few else per_doc, docs["doc_id"].eqNullSafe(per_doc["doc_id"])).select(docs["doc_id"], F.explode(let(
        F.split("text", "\n"), lambda parts: F.transform("wanted", lambda w: F.struct(w["name"].alias("name"), w["line"].alias("line"), F.get(parts, w["line"]).alias("text"))))).alias("w"))
    sets = stored(texts.select("doc_id", "w.*").filter("text is not null").mapInArrow(
        keys, f"name bigint, doc_id {kind.simpleString()}, line int, keys binary, size int, bits binary"), "keys").select(
        "name", F.struct("doc_id", "line").alias("place"), "keys", "size", "bits")

    def search(members: DataFrame) -> DataFrame:
        # places become one sortable number per cell: documents and lines in order
        return stored(run_cells(members.select("cell", "name", F.struct("place.doc_id", "place.line").alias("place"), "probe", "keys"),
                                ["name", "place", "probe", "keys"], lambda rows: later([(r[0], _place(r[1]), r[2], r[3]) for r in rows], percent)), "removed")

    def against(pairs: DataFrame) -> DataFrame:
        # each later line with the earlier ones that it met
        members = pairs.select(F.col("late").alias("cell"), F.col("late").alias("name"), F.lit(True).alias("probe")).unionByName(
            pairs.select(F.col("late").alias("cell"), F.col("early").alias("name"), F.lit(False).alias("probe"))).distinct()
        return search(members.join(sets, "name")).select(F.col("b").alias("name"))

    paired_off = against(pairs)

    # of rich words, first each line in its largest bucket, in parts that share one line
    parts = F.greatest(F.lit(1), F.ceil(F.col("held") / PART)).cast("int")
    chosen = live.groupBy("name").agg(F.max(F.struct("held", "word", "anchor")).alias("at")).select("name", "at.*")
    placed = chosen.select("name", "word", F.pmod(F.xxhash64("name"), parts).cast("int").alias("part"))
    anchors = chosen.select("word", "anchor", parts.alias("parts")).distinct().select(
        F.col("anchor").alias("name"), "word", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    first = placed.unionByName(anchors).distinct().select(F.xxhash64("word", "part").alias("cell"), "name", F.lit(True).alias("probe"))
    gone = search(first.join(sets, "name")).select(F.col("b").alias("name")).unionByName(paired_off).distinct()

    # then what is left, against all lines of its buckets: their bits first
    left = live.join(gone.withColumn("gone", F.lit(True)), "name", "left").select("name", "word", "held", F.col("gone").isNull().alias("probe"))
    open_words = left.filter("probe").select("word").distinct()
    split = left.join(open_words, "word", "left_semi").withColumn("parts", F.ceil(F.col("held") / SIGNED).cast("int"))
    split = split.withColumn("mine", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    paired = split.select("word", "name", "probe", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    signed = paired.select(F.xxhash64("word", F.least("mine", "other"), F.greatest("mine", "other")).alias("cell"), "name", "probe").join(
        sets.select("name", "place", "size", "bits"), "name")
    second = run_cells(signed, ["name", "place", "probe", "size", "bits"], lambda rows: likely([(r[0], _place(r[1]), *r[2:]) for r in rows], percent))
    more = against(stored(second.select(F.col("a").alias("early"), F.col("b").alias("late")).distinct(), "likely"))
    removed = stored(gone.unionByName(more).distinct(), "gone")
    table = firsts.select("name", "at.*").join(removed.withColumn("gone", F.lit(True)), "name", "left").select(
        "name", "doc_id", "line", F.coalesce("gone", F.lit(False)).alias("gone"))
    return lines.select("doc_id", "line", "name"), stored(table, "sets")


def _place(place: dict) -> tuple:
    doc = place["doc_id"]
    return (doc is not None, doc if doc is not None else 0, place["line"])


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_lines, removed``: lines with a word and the numbers (from 0) of those that go; one row per id that has a line."""
    lines, sets = removals(docs, percent)
    there = sets.select("name", F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line"), "gone")
    goes = F.col("gone") | ~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("line") == F.col("first_line")))
    judged = lines.distinct().join(there, "name").select("doc_id", "line", goes.alias("goes"))
    return judged.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.when(F.col("goes"), F.col("line")))).alias("removed"))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with its texts freed of the removed lines, and ``n_lines_with_words, n_lines_removed`` beside the given columns."""
    found = stored(removed_lines(docs, percent), "removed")
    given, of, removed, n_lines = docs["text"], found["doc_id"], found["removed"], found["n_lines"]
    joined = docs.join(found, docs["doc_id"].eqNullSafe(of), "left")
    rest = F.array_join(F.filter(F.split(given, "\n"), lambda x, i: ~F.array_contains(removed, i)), "\n")
    text = F.when(F.size(removed) > 0, rest).otherwise(given).alias("text")
    return joined.select(*(text if c == "text" else docs[c] for c in docs.columns), F.coalesce(n_lines, F.lit(0).cast("bigint")).alias("n_lines_with_words"),
                         F.greatest(F.coalesce(F.size(removed), F.lit(0)), F.lit(0)).cast("bigint").alias("n_lines_removed"))
