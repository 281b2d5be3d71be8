"""Source divergence, structure repair and BPE against brute force, on the edge cases that their modules define."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from pricelattice.llm import bpe, divergence, repair
from pricelattice.llm.registry import op12_structure_repair, op13_bpe

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, gid string, ids string, split string, p string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, schema=SCHEMA):
    width = schema.count(",") + 1
    return spark.createDataFrame([(*r, *["other"] * (width - len(r))) for r in rows], schema)


# source divergence

@pytest.fixture(scope="module")
def texts():
    draw = random.Random(11)
    words = [f"{a}{b}" for a in ("Abc", "é", "über", "ñandú", "日本", "x'y", "z") for b in "klmnop"]
    rows = [(None, None, None, None, 1), (1, "", "en", "empty", 1), (2, "only" * 9000 + " Only" * 400, "en", "long", 1), (3, "alone", "xx", "one", 1), (3, "alone", "xx", "one", 1)]
    for k in range(10, 130):
        some = [draw.choice(words[:6 + k % 30]) for _ in range(draw.randrange(0, 40))]
        rows.append((k, " ".join(some) + f" rare{k}\n", draw.choice(["en", "de", None]), draw.choice(["a", "b", "é", "zz", None, "a"]), 1))
    return rows


def divergence_of(rows, least, top):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        found = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in found.items() if n >= least)
        count = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if found[t] >= least) for s in {d[1] for d in own}}
        whole = sum(count.values(), collections.Counter())

        def share(c, t):
            return 1 + 10 ** 9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in count.items():
            pairs = [(sum(abs(share(c, t) - share(o, t)) for t in kept), item) for item, o in count.items() if item != s]
            terms = [(share(c, t) - share(whole, t), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("bits,block", [(64, 64), (4, 2)])
def test_divergence_equals_its_definition(spark, texts, monkeypatch, bits, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "HELD", 60)
    got = divergence.audit(frame(spark, texts).repartition(5), least_docs=8, top=6, bits=bits)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence_of(texts, 8, 6)


def test_divergence_without_kept_terms_or_rows(spark, texts):
    got = divergence.audit(frame(spark, texts), least_docs=10 ** 6).collect()
    assert {(r.part, r.value) for r in got} == {("pair", 0)} and len(got) == len(divergence_of(texts, 10 ** 6, 50))
    assert divergence.audit(frame(spark, [])).collect() == []


# structure repair

def brute(codes):
    """Least (cost, audit) row by row over the four states, all insertions tried between rows."""
    def opened(now):
        for _ in range(4):
            for q, (cost, audit) in list(now.items()):
                if (to := repair.TURN[q]) not in now or (cost + 5, audit + "I") < now[to]:
                    now[to] = (cost + 5, audit + "I")
        return now
    now = opened({0: (0, "")})
    for code in codes:
        initial, fault = divmod(code, 4)
        new = {}
        for q, (cost, audit) in now.items():
            ways = [(q, cost + 2, audit + "D")]
            if fault <= 1:
                ways.append((repair.TURN[q], cost + 1 + 5 * fault, audit + "R"))
                if initial < 3 and repair.STEP[q][initial] >= 0:
                    ways.append((repair.STEP[q][initial], cost + 5 * fault, audit + "K"))
            for to, *way in ways:
                new[to] = min(new.get(to, (1 << 60, "")), tuple(way))
        now = opened(new)
    return min(now[q] for q in (0, 3) if q in now)


def test_cheapest_edits_equal_brute_force():
    draw = random.Random(4)
    for _ in range(3000):
        codes = bytes(draw.choice([0, 4, 4, 8, 8, 5, 9, 1, 6, 11, 12, 13]) for _ in range(draw.randrange(0, 12)))
        assert repair.cheapest(codes) == brute(codes), codes
    long = bytes(draw.choice([4, 8, 4, 8, 5, 11, 0]) for _ in range(20_000))
    assert repair.cheapest(long) == brute(long)


def repaired_of(rows):
    """Audits and repaired rows of undamaged ``(turn, role, text)`` rows, by plain loops."""
    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(*r[1:])))
    seen, codes, counts = set(), [], collections.Counter()
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = repair.BLANK if not solid else repair.DUPLICATE if (role, text) in seen else repair.NONE if solid[-1] in ".!?" else repair.TRUNCATED
        seen.add((role, text))
        counts[fault] += 1
        codes.append(4 * ("sua".find(role[0]) % 4 if role else 3) + fault)
    cost, audit = brute(bytes(codes))
    roles = [(r + " ")[0] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    turns = {t for t, *_ in rows if t is not None}
    out, given = [], iter(rows)
    for edit in audit:
        role, text = (next(given)[1:] if edit != "I" else ("", ""))
        shift = bool(out) and out[0][0][0] == "s"
        named = role if edit == "K" else ("user", "assistant")[(len(out) - shift) % 2]
        if edit != "D":
            out.append((named, text))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts[repair.BLANK], counts[repair.DUPLICATE], counts[repair.TRUNCATED], illegal, cost, audit), out


@pytest.fixture(scope="module")
def talks():
    draw = random.Random(8)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), ("long", 0, "user", "word " * 200_000 + "."), ("long", 1, "assistant", "ok."),
            ("tie", 1, "user", "b."), ("tie", 1, "user", "a."), ("tie", 1, "assistant", "a."), ("odd", 5, "", "x."), ("odd", 2, "tool", "y!"), ("odd", None, "System", "z?")]
    for k in range(120):
        rows += [(f"c{k}", draw.choice([t, t, t + 1, None]), draw.choice(["user", "assistant", "user", "assistant", "system", None]), draw.choice(["One.", "Two!", "three", " \n", "", None, "Four? \t"]))
                 for t in range(draw.randrange(1, 9))]
    return rows


TALKS = "conv_id string, turn bigint, role string, text string, audit string, digest string, place string"


def test_repair_equals_brute_force(spark, talks):
    rows = frame(spark, talks, TALKS).repartition(5)
    found = repair.audits(rows).cache()
    groups = collections.defaultdict(list)
    for conv, *row in talks:
        groups[conv].append(row)
    want = {conv: repaired_of(g) for conv, g in groups.items()}
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == {conv: w[0] for conv, w in want.items()}
    fixed = repair.repaired(rows, found)
    got = collections.defaultdict(list)
    for r in sorted(fixed.collect(), key=lambda r: r.place):
        got[r.conv_id].append((r.role, r.text))
    assert got == {conv: out for conv, (_, out) in want.items() if out}
    assert {r[0]: r[1] for r in repair.sealed(fixed).collect()} == {
        conv: hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest() for conv, (_, out) in want.items() if out}
    nothing = frame(spark, [], TALKS)
    assert repair.audits(nothing).collect() == [] and repair.repaired(nothing, repair.audits(nothing)).collect() == []


def test_damage_follows_the_checksum(spark, talks, folder):
    frame(spark, talks, TALKS).select("conv_id", "turn", "role", "text").write.parquet(f"{folder}/conversations.parquet")
    want = collections.defaultdict(list)
    for conv, turn, role, text in talks:
        role, text = (" " if x is None else x for x in (role, text))
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (turn, "user" if draw == 4 else role, "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text)
        want[conv] += [row] * (0 if draw == 0 else 2 if draw == 3 else 1)
    got = {r.conv_id: r for r in op12_structure_repair(spark, folder).collect()}
    assert set(got) == set(want) and any(not rows for rows in want.values())
    for conv, rows in want.items():
        counts, out = repaired_of(rows)
        assert tuple(got[conv])[1:8] == counts
        assert got[conv].repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


# BPE

def tokenizer():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    draw = random.Random(2)
    signs = "aAbZz09 \t\n.,!'’éÉ́ßΣςİı日本\x1c\x85　‍😀👍🏽ſﬁ½\x00￿ึ<|>"
    return [None, "", " \n\t", "Hello  World's", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>", "I'll've", "a" * 30_000, "ab" * 20_000 + " x", "é" * 5_000, "word " * 30_000,
            *("".join(draw.choice(signs) for _ in range(draw.randrange(1, 30))) for _ in range(1500))]


def test_bpe_equals_the_library_both_ways(spark, monkeypatch):
    from tokenizers import Tokenizer
    monkeypatch.setattr(bpe, "HELD", 50)
    library = Tokenizer.from_file(tokenizer())
    rows = [(None, "no id", "en", "a", 1), *((k // 2, t, "en", "a", 1) for k, t in enumerate(odd_texts()))]
    got = bpe.decode(bpe.encode(frame(spark, rows).repartition(3), tokenizer()), tokenizer()).collect()
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == collections.Counter(want)
    assert bpe.encode(frame(spark, []), tokenizer()).collect() == []


def test_bpe_decodes_any_list(spark):
    ids = spark.createDataFrame([(1, [320, 49407, 10 ** 6, -1, 343]), (2, []), (3, None)], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(ids, tokenizer()).collect()} == {1: "a</w> <|endoftext|> x</w>", 2: "", 3: None}


def test_merges_take_the_least_rank_first():
    """Against merging by whole scans: the least-ranked pair anywhere, leftmost first, until none is left."""
    book, draw = bpe.book(tokenizer()), random.Random(6)
    for _ in range(400):
        word = "".join(draw.choice("abehinorstt") for _ in range(draw.randrange(1, 25)))
        now = [*(book.ids[c] for c in word[:-1]), book.ids[word[-1] + book.suffix]]
        queued = book.merged(list(now))
        while True:
            ranked = [(r, k) for k in range(len(now) - 1) if (r := book.ranks.get(now[k] << 32 | now[k + 1])) is not None]
            if not ranked:
                break
            rank, k = min(ranked)
            now[k:k + 2] = [book.made[rank]]
        assert queued == now


def test_op13_digests(spark, folder):
    frame(spark, [(k, t, "en", "a", 1) for k, t in enumerate(odd_texts()[:40])]).select("doc_id", "text").write.parquet(f"{folder}/documents.parquet")
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokenizer())
    for r in op13_bpe(spark, folder).collect():
        ids = library.encode(odd_texts()[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
