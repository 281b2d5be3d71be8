"""BPE encoding and decoding of whole texts with the vocabulary file of a tokenizer (word-level kind with a suffix at word ends).

*Encoding.* A text falls into its runs without ASCII white space: the tokenizer drops white space and never merges across it. Special
strings are cut out of a run first; what lies between them is normalised and cut into pre-tokens as the file says. Each pre-token
starts as one symbol per byte, the last with the word-end suffix, in a doubly linked list. A priority queue holds ``(merge rank,
position)`` of neighbouring pairs; the least is taken, skipped if either symbol has changed since it was pushed (a stale entry), and
otherwise joined, which pushes the two new neighbouring pairs. That is ``O(n log n)`` in a pre-token's length, however long it is.
Runs and pre-tokens are remembered per worker in caches of bounded size; no text is shuffled.

*Decoding.* The vocabulary strings of the ids, joined by one space where the file names no decoder.

Defined results: null text is empty and gives no ids; a null ``doc_id`` stays null; repeated rows give repeated results; an empty table
gives an empty table; further columns are ignored. Ids without a vocabulary string decode to nothing; a null list of ids decodes to
null.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .batches import slices
from .common import documents

#: Remembered runs and pre-tokens, each, per worker (the older half goes when twice as many are held); longer ones aren't remembered.
HELD, LONGEST = 150_000, 64
#: Bytes of text, and ids, that one result batch covers (a single text may be longer).
BATCH_BYTES, BATCH_IDS = 4 << 20, 2 << 20

# The rules of the vocabulary file for which `Plain` cuts runs of common characters itself.
PLAIN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PLAIN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_books: dict[str, "Book"] = {}
_strings: dict[str, pa.Array] = {}


class Cache:
    """A map of bounded size: two generations, of which the older one goes when the younger is full."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def find(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Plain:
    """What the rules above come to for runs of visible ASCII and Latin letters, all of which are composed already."""

    fits = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
    pieces = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^0-9a-z\u00df-\u00f6\u00f8-\u00ff]+").findall

    def __init__(self, spec: dict, cut):
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.holds = ((spec["normalizer"] or {}).get("normalizers") == PLAIN_NORMALIZER and len(steps) == 2 and steps[0].get("pattern") == {"Regex": PLAIN_SPLIT}
                      and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and steps[1].get("type") == "ByteLevel"
                      and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space"))
        self.bytes = {c: cut(chr(c))[0][0] for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))} if self.holds else {}

    def words(self, run: str) -> list[str]:
        return self.pieces(run.lower()) if run.isascii() else [w.translate(self.bytes) for w in self.pieces(run.lower())]


class Book:
    """A vocabulary file: ids of symbols, ranked merges, special strings, and the file's own rules for normalising and cutting texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only plain BPE vocabularies are read here")
        rules = Tokenizer.from_file(path)
        self.normalize, self.cut = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.plain = Plain(spec, self.cut)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.left, self.right, self.made, self.ranks = [], [], [], {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right = self.ids[a], self.ids[b]
            self.left.append(left)
            self.right.append(right)
            self.made.append(self.ids[a + b])
            self.ranks[left << 32 | right] = rank
        added = [(t["content"], t["id"]) for t in spec["added_tokens"]]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: only special strings that are matched as they stand are read here")
        self.special = dict(added)
        self.marks = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        self.words, self.runs = Cache(HELD), Cache(HELD)

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols of one pre-token after all merges."""
        n, rank_of, left, right, made = len(symbols), self.ranks.get, self.left, self.right, self.made
        queue = [rank << 32 | k for k in range(n - 1) if (rank := rank_of(symbols[k] << 32 | symbols[k + 1])) is not None]
        if not queue:
            return symbols
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, k = entry >> 32, entry & 0xFFFFFFFF
            follows = after[k]
            if follows < 0 or symbols[k] != left[rank] or symbols[follows] != right[rank]:
                continue  # stale
            now = symbols[k] = made[rank]
            symbols[follows] = -1
            then, prior = after[follows], before[k]
            after[k], after[follows] = then, -1
            if then >= 0:
                before[then] = k
                if (rank := rank_of(now << 32 | symbols[then])) is not None:
                    heapq.heappush(queue, rank << 32 | k)
            if prior >= 0 and (rank := rank_of(symbols[prior] << 32 | now)) is not None:
                heapq.heappush(queue, rank << 32 | prior)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> bytes:
        """Ids, four bytes each, of a pre-token written in the file's byte alphabet."""
        found = self.words.find(word)
        if found is None:
            start = [*map(self.ids.get, word[:-1]), self.ids.get(word[-1] + self.suffix)]
            ids = self.merged(start if None not in start else [s for s in start if s is not None])
            found = struct.pack(f"={len(ids)}i", *ids)
            if len(word) <= LONGEST:
                self.words.put(word, found)
        return found

    def run(self, run: bytes) -> bytes:
        """Ids, four bytes each, of a run without white space."""
        found = self.runs.find(run)
        if found is not None:
            return found
        text, out = run.decode("utf-8", "replace"), []
        for k, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if k % 2:
                out.append(struct.pack("=i", self.special[part]))
            elif part and self.plain.holds and self.plain.fits(part):
                out += map(self.word, self.plain.words(part))
            elif part:
                out += [self.word(word) for word, _ in self.cut(self.normalize(part))]
        found = b"".join(out)
        if len(run) <= LONGEST:
            self.runs.put(run, found)
        return found

    def text(self, text: bytes) -> bytes:
        runs = text.split()
        found = list(map(self.runs.young.get, runs))
        for k, ids in enumerate(found):
            if ids is None:
                found[k] = self.run(runs[k])
        return b"".join(found)


def book(path: str) -> Book:
    """The vocabulary of a file, read once per process."""
    if path not in _books:
        _books[path] = Book(path)
    return _books[path]


def strings(path: str) -> pa.Array:
    """The vocabulary string of each id, special strings included; all that decoding needs."""
    if path not in _strings:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec.get("decoder") is not None:
            raise ValueError(f"{path}: only files without a decoder are read here")
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        _strings[path] = pa.array([names.get(i) for i in range(max(names) + 1)], pa.string())
    return _strings[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of every document: its token ids in order, without added special tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = book(path).text
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                found = [to_ids(text) for text in part.column("text").cast(pa.large_binary()).to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in found)])
                ids = pa.array(np.frombuffer(b"".join(found), np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, separator: str = " ") -> DataFrame:
    """``encoded`` (with a column ``ids``) and the text of its ids, ``decoded``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_strings = strings(path)
        for batch in batches:
            for part in slices(batch, "ids", BATCH_IDS):
                lists = part.column("ids")
                flat = lists.flatten()
                known = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(known_strings))), flat, pa.scalar(None, flat.type))
                named = pc.fill_null(known_strings.take(known), "")
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                kept = pc.not_equal(named, "").to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])]
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), named.filter(pa.array(kept))), separator)
                yield pa.RecordBatch.from_arrays([*part.columns, pc.if_else(pc.is_null(lists), pa.scalar(None, pa.string()), texts)], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))
