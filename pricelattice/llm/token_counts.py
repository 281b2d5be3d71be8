"""Exact token counts by a map-side two-tier lookup.

A text falls into *pre-tokens*, its runs without ASCII white space. The tokenizer drops white space and never joins across
it, so the count of a text is the sum over its pre-tokens. The first tier is a broadcast table of the frequent ones and
their lengths; the second is a bounded cache in each Python worker, filled by encoding what the first tier misses. No
pre-token is shuffled: only each task's most frequent ones (``LOCAL_TOP`` at most) are added up for the first tier.

Defined results: null or empty text has 0 bytes and 0 tokens; a null ``doc_id`` stays null; repeated rows give repeated
results; an empty table gives an empty table; further columns of ``docs`` are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents

#: First tier: entries broadcast, and entries that one task reports. Both bound memory, neither touches the result.
TABLE_SIZE, LOCAL_TOP = 65_536, 8_192
#: A task forgets its rarer half beyond this many distinct pre-tokens; a worker empties its cache beyond it.
HELD = 400_000
LIMIT = 2_048

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a file, one per process, without threads of its own."""
    import os

    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Tokenizer.from_file(path)
    return _encoders[path]


def lengths(path: str, pieces: list[bytes]) -> list[int]:
    """Tokens of each pre-token, special strings handled as the tokenizer's default."""
    got = encoder(path).encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
    return [len(x) for x in got]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    column = batch.column("text")
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def frequent(docs: DataFrame, size: int = TABLE_SIZE, local_top: int = LOCAL_TOP) -> list[bytes]:
    """The most frequent pre-tokens of the whole table: every task counts its own, reports its top, Spark adds them up."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in _texts(batch):
                seen.update(text.split())
                if len(seen) > HELD:
                    seen = Counter(dict(seen.most_common(HELD // 2)))
        top = [(p, n) for p, n in seen.most_common(local_top) if n > 1 and len(p) <= 64]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in top], pa.binary()), "n": pa.array([n for _, n in top], pa.int64())})

    found = documents(docs).select("text").mapInArrow(count, "piece binary, n bigint")
    return [bytes(r.piece) for r in found.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size).collect()]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, table_size: int = TABLE_SIZE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document, in one pass over the texts after the first tier is known."""
    pieces = frequent(docs, table_size)
    first = docs.sparkSession.sparkContext.broadcast((b" ".join(pieces), bytes(bytearray(min(n, 255) for n in lengths(path, pieces)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, sizes = first.value
        common = {p: n for p, n in zip(joined.split(), sizes) if n < 255}
        cache: dict[bytes, int] = {}
        for batch in batches:
            texts = _texts(batch)
            totals, misses = [], []
            for text in texts:
                total, missed = 0, []
                for piece in text.split():
                    n = common.get(piece)
                    if n is None:
                        missed.append(piece)
                    else:
                        total += n
                totals.append(total)
                misses.append(missed)
            new = list({p for missed in misses for p in missed if p not in cache})
            for at in range(0, len(new), 20_000):
                part = new[at:at + 20_000]
                cache.update(zip(part, lengths(path, part)))
            for i, missed in enumerate(misses):
                totals[i] += sum(map(cache.__getitem__, missed))
            if len(cache) > HELD:
                cache.clear()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_tokens": pa.array(totals, pa.int64()), "over_limit": pa.array([n > limit for n in totals], pa.bool_())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
