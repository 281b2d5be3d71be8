"""Secret scan over an incremental ledger of blobs, in DataFrame operations only.

Every version of every path is content-addressed (SHA-256 of its text), so one text is one *blob*, however many paths and
versions hold it. A ledger lists which (blob, rule set version) pairs have been scanned and what was found. A run scans only
the pairs that the ledger lacks and joins the findings of all blobs back to all paths. Adding a rule changes the rule set's version,
so every blob is pending again; adding versions of files makes only new texts pending.

Positions come without a loop: splitting a text by a rule gives what lies between its matches, extracting gives the
matches, and the running sums of both lengths are the starts.

Defined results: null text is the empty text; an empty text has no findings; repeated rows and ids give a result row each;
an empty table or ledger gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

#: Kind, pattern, group that is measured (0: all), least length of that group. The order is the order of kinds.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("platform", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})", 0, 1),
    ("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
BASE = ("assign", "access", "hex")
FINDING = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _matches(text: Column, rank: int, rule: tuple[str, str, int, int]) -> Column:
    """The findings of one rule, leftmost and not overlapping, too short ones dropped after matching."""
    kind, pattern, group, least = rule

    def place(pieces: Column) -> Column:
        found = pieces["found"]
        steps = F.zip_with(found, F.zip_with(F.slice(pieces["between"], 1, F.size(found)), pieces["part"], lambda b, p: F.struct(
            F.char_length(b).alias("gap"), F.char_length(p).alias("part"))), lambda f, x: F.struct(
                x["gap"].alias("gap"), F.char_length(f).alias("all"), x["part"].alias("part")))
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(FINDING).alias("list"))

        def step(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            one = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + x["all"]).alias("end"))
            return F.struct((start + x["all"]).alias("at"), F.when(
                x["part"] >= least, F.concat(state["list"], F.array(one))).otherwise(state["list"]).cast(FINDING).alias("list"))
        return F.aggregate(steps, begin, step)["list"]

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pieces = F.struct(whole.alias("found"), part.alias("part"), F.split(text, pattern).alias("between"))
    return F.when(text.rlike(pattern), let(pieces, place)).otherwise(F.array().cast(FINDING))


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """``sha, version, findings`` of blobs (``sha, text``); only the found ranges leave the text."""
    text = F.col("text")
    lists = [_matches(text, k, rule) for k, rule in enumerate(rules)]
    return blobs.select("sha", F.lit(version(rules)).alias("version"), F.sort_array(F.concat(*lists)).alias("findings"))


def versions(docs: DataFrame) -> DataFrame:
    """Every stored version of every path with its content address."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("path"), F.sha2(text, 256).alias("sha"), text.alias("text"))


def pending(history: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """The distinct blobs whose pair with this rule version the ledger lacks (``sha, text``)."""
    rows = history.select("sha", "text")
    if ledger is not None:
        rows = rows.join(ledger.filter(F.col("version") == version(rules)).select("sha"), "sha", "left_anti")
    return rows.groupBy("sha").agg(F.first("text").alias("text"))


def ledger_after(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """The ledger with this run's pairs added: write it as a new table and hand it to the next run."""
    fresh = scan(pending(versions(docs), ledger, rules), rules)
    return fresh if ledger is None else ledger.select("sha", "version", "findings").unionByName(fresh)


def findings(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``doc_id, findings`` of every row of ``docs``, through the ledger."""
    # written first, as a ledger is: then hot texts can be split among the paths that hold them
    known = stored(ledger_after(docs, ledger, rules), "ledger").filter(F.col("version") == version(rules)).filter(F.size("findings") > 0)
    paths = versions(docs).select(F.col("path").alias("doc_id"), "sha")
    return paths.join(known.select("sha", "findings"), "sha", "left").select(
        "doc_id", F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def spans(found: Column, kinds=None) -> Column:
    """Findings as ``kind:start:end``, by start, then kind as listed."""
    chosen = found if kinds is None else F.filter(found, lambda f: f["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("bigint")
