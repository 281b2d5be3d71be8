"""String expressions: mark folding, slugs, state names, tiers. All JVM-side."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from ..spec import ACCEPTABLE_TIERS, STATE_ALIASES, TIER_RANK


def _class(codes: list[int]) -> str:
    """Regular-expression class of ascending code points."""
    out, start = [], None
    for k, code in enumerate(codes):
        start = code if start is None else start
        if k + 1 == len(codes) or codes[k + 1] != code + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{code:X}}}")
            start = None
    return "[" + "".join(out) + "]"


@lru_cache(maxsize=1)
def _combining_class() -> str:
    """All characters with a non-zero combining class (vowel signs of Indic scripts have none)."""
    return _class([c for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))])


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, str, str]:
    """Characters whose compatibility decomposition leaves one base character, and the base characters; a class of those that leave none
    or several, and both sides of that map, parts set off by a control character."""
    one, several = {}, {}
    for code in (*range(0xA0, 0x1FBFA), *range(0x2F800, 0x2FA1E)):
        ch = chr(code)
        full = "" if 0xD800 <= code < 0xE000 else unicodedata.normalize("NFKD", ch)
        base = "".join(c for c in full if not unicodedata.combining(c))
        if full not in ("", ch) and not unicodedata.combining(ch) and base != ch:
            (one if len(base) == 1 else several)[ch] = base
    return "".join(one), "".join(one.values()), _class(sorted(map(ord, several))), PART.join(several), PART.join(several.values())


PART = "\x01"


def fold_marks(c: Column) -> Column:
    """The compatibility decomposition without combining marks, for every character: accents go, ligatures, fractions and Hangul syllables
    fall into their parts.

    The long ``translate`` map runs only for text that holds a non-ASCII character, the map to several characters only for text that
    holds one of them.
    """
    src, dst, class_, names, parts = _fold_tables()
    table = F.map_from_arrays(F.split(F.lit(names), PART), F.split(F.lit(parts), PART))
    wide = F.when(c.rlike(class_), F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")).otherwise(c)
    folded = F.regexp_replace(F.translate(wide, src, dst), _combining_class(), "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


NOT_ASCII = r"[^\x00-\x7F]"


@lru_cache(maxsize=1)
def _ascii_tables() -> tuple[str, str, str, str, str]:
    """``_fold_tables`` for the characters whose decomposition holds ASCII, without the rest of it: a thirteenth of the size, and it
    stands three times in the plan of every market id."""
    one, several = {}, {}
    for code in (*range(0xA0, 0xD800), *range(0xE000, 0x1FBFA), *range(0x2F800, 0x2FA1E)):
        part = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if c < "\x80")
        if part:
            (one if len(part) == 1 else several)[chr(code)] = part
    return "".join(one), "".join(one.values()), _class(sorted(map(ord, several))), PART.join(several), PART.join(several.values())


def ascii_fold(c: Column) -> Column:
    """The ASCII characters of ``fold_marks(c)``."""
    src, dst, class_, names, parts = _ascii_tables()
    table = F.map_from_arrays(F.split(F.lit(names), PART), F.split(F.lit(parts), PART))
    wide = F.when(c.rlike(class_), F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")).otherwise(c)
    return F.when(c.rlike(NOT_ASCII), F.regexp_replace(F.translate(wide, src, dst), NOT_ASCII, "")).otherwise(c)


def key_slug(c: Column) -> Column:
    """Lower-case words joined by ``_``; no mark folding (column headings, job keys)."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def job_slug(c: Column, empty: str = "unknown") -> Column:
    return F.coalesce(F.nullif(key_slug(c), F.lit("")), F.lit(empty))


def slug(c: Column) -> Column:
    return job_slug(ascii_fold(F.coalesce(c.cast("string"), F.lit(""))))


def make_market_id(state: Column, district: Column, market: Column) -> Column:
    return F.concat_ws("__", slug(state), slug(district), slug(market))


def title_case(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest. ASCII words between spaces need no taking apart."""
    parts = F.split(F.lower(c), r"(?<=[^\p{L}])")
    titled = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), "")
    return F.when(c.rlike("^[A-Za-z ]*$"), F.initcap(c)).otherwise(titled)


def canonical_state(c: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in STATE_ALIASES.items() for x in pair])

    def known(name: Column) -> Column:
        low = F.lower(name)
        key = F.when(low.rlike(r"\s\s|[^\S ]"), F.trim(F.regexp_replace(low, r"\s+", " "))).otherwise(low)
        return F.coalesce(F.try_element_at(aliases, key), title_case(name))

    # a one-element array hands the folded name on, so that its tables stand in the plan once
    return F.transform(F.array(fold_marks(F.trim(F.coalesce(c.cast("string"), F.lit(""))))), known)[0]


def infer_source_tier(source: Column, mode: Column) -> Column:
    src = F.upper(F.trim(F.coalesce(source, F.lit(""))))
    md = F.upper(F.trim(F.coalesce(mode, F.lit(""))))
    return (
        F.when((md == "DEMO") | src.startswith("DEMO"), "DEMO")
        .when(src.contains("DATA_GOV") | src.contains("AGMARKNET_OFFICIAL"), "PRIMARY_OFFICIAL")
        .when(src.contains("CEDA"), "CURATED_OFFICIAL_DERIVED")
        .when(src.contains("MIRROR") | src.contains("ARCHIVE"), "SECONDARY_MIRROR")
        .otherwise("USER_SUPPLIED")
    )


def split_tiers(c: Column) -> Column:
    """One comma-joined tier label to an array of trimmed upper-case tiers."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.upper(F.trim(t)))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def tiers_acceptable(tiers: Column) -> Column:
    ok = F.array(*[F.lit(t) for t in ACCEPTABLE_TIERS])
    return (F.size(tiers) > 0) & (F.size(F.array_except(tiers, ok)) == 0)


def authority_rank(c: Column) -> Column:
    """Highest rank among the comma-joined tiers; an unknown or empty tier ranks 1."""
    ranks = F.create_map(*[x for t, r in TIER_RANK.items() for x in (F.lit(t), F.lit(r))])
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","),
                        lambda t: F.coalesce(F.try_element_at(ranks, F.trim(t)), F.lit(1)))
    return F.array_max(parts)
