"""Quality rules as a learned decision list, in DataFrame operations only.

Statistics of a text become ratios; ratios become bins at fixed grids. From the labelled rows Spark counts good and bad
ones per bin. Sequential covering then *grows* one rule at a time: a conjunction of thresholds, each chosen by its gain
(FOIL) over all statistics and thresholds at once; on rows kept aside it is *pruned* from its end while that raises
(p - n) / (p + n). Rows that the rule covers leave, and the next rule grows, until none is precise enough. The rules, in
order, are one ``CASE WHEN`` expression: the first that holds rejects a document, a document that none covers is kept.

All learning happens in aggregations over the labelled rows; only bin counts (statistics x bins) reach the driver. The fit
may use all labelled rows or the ``TRAIN_ROWS`` with the lowest id digests. Documents are then judged in one scan without
a shuffle.

Defined results: a null or empty text has zero for every statistic (and fails the base test by its word count); without
labelled rows of both kinds there is no rule and every document is kept that passes the base test; rows with a null label
or id are not learned from; repeated rows get equal results; an empty table gives an empty table; further columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, let, stored, words_of

WINDOW = 8
TRAIN_ROWS = 200_000
RULES, CONDITIONS = 8, 3
#: A rule must reject this share of bad rows among those it covers, on the rows kept aside as well, and cover this many bad rows.
PRECISION, SUPPORT = 0.95, 5
BINS = 64
FEATURES = ("mean_word", "symbols", "dup_lines", "repeats", "distinct", "capitals", "exclaims", "pipes", "short")


def _repeats(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found twice or more in the text."""
    def covered(codes: Column) -> Column:
        def marked(ordered: Column) -> Column:
            # equal windows are neighbours once sorted by digest
            same = F.transform(ordered, lambda x, i: F.when(
                ((i > 0) & (F.get(ordered, i - 1)["code"] == x["code"])) | F.coalesce(F.get(ordered, i + 1)["code"] == x["code"], F.lit(False)), x["at"]))
            return F.array_sort(F.filter(same, lambda x: x.isNotNull()))

        def total(starts: Column) -> Column:
            begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
            return F.aggregate(starts, begin, lambda s, x: F.struct(
                x.alias("last"), (s["sum"] + F.least(F.lit(WINDOW), x - s["last"])).alias("sum")))["sum"]

        paired = F.transform(codes, lambda c, i: F.struct(c.alias("code"), i.alias("at")))
        return F.when(F.size(F.array_distinct(codes)) < F.size(codes), let(let(F.sort_array(paired), marked), total)).otherwise(0)

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) > WINDOW, let(windows, covered)).otherwise(0)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id``, the base statistics and what the ratios need, for every row."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))

    def count(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(text, pattern, "")).cast("bigint")

    def all_of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"), _repeats(words).cast("bigint").alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, GAP, "")) > 0)
    return rows.select(
        "doc_id", let(words_of(text), all_of).alias("w"), count(GAP).alias("word_chars"), count(r"[^#*$%&|<>]+").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("l"),
        count(r"[^\p{Lu}]+").alias("n_capitals"), count("[^!]+").alias("n_exclaims"), count("[^|]+").alias("n_pipes"),
    ).select("doc_id", "w.*", "word_chars", "n_symbols", "l.*", "n_capitals", "n_exclaims", "n_pipes")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bins() -> list[Column]:
    """Each ratio on its grid: whole numbers from 0 to ``BINS - 1``, so that thresholds are exact in any engine."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))

    def grid(part: Column, whole: Column, steps: int) -> Column:
        return F.least(F.lit(BINS - 1), F.floor(part * steps / whole)).cast("int")

    made = {
        "mean_word": grid(F.col("word_chars"), words, 4), "symbols": grid(F.col("n_symbols"), words, 20),
        "dup_lines": grid(F.col("n_dup_lines"), F.greatest(F.col("n_lines"), F.lit(1)), 50), "repeats": grid(F.col("n_repeat_words"), words, 60),
        "distinct": grid(F.col("n_distinct"), words, 60), "capitals": grid(F.col("n_capitals"), chars, 60),
        "exclaims": grid(F.col("n_exclaims"), words, 30), "pipes": grid(F.col("n_pipes"), words, 30),
        "short": F.least(F.lit(BINS - 1), F.floor(F.col("n_words") / 5)).cast("int")}
    return [made[name].alias(name) for name in FEATURES]


Condition = tuple[str, str, int]


def holds(conditions: list[Condition]) -> Column:
    tests = [F.col(name) <= at if side == "<=" else F.col(name) >= at for name, side, at in conditions]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def learn(rows: DataFrame, rules: int = RULES, conditions: int = CONDITIONS, precision: float = PRECISION) -> list[list[Condition]]:
    """Rules for rejection from binned rows with ``bad`` (0, 1) and ``grow`` (true: growing, false: pruning)."""
    import math
    done: list[list[Condition]] = []

    def table(where: Column) -> list:
        """Bad and good rows per statistic and bin of the rows that ``where`` holds for: one scan, one row per bin."""
        long = rows.filter(where).select("bad", F.explode(F.array(*(F.struct(F.lit(f).alias("name"), F.col(f).alias("bin")) for f in FEATURES))).alias("x"))
        return long.groupBy("x.name", "x.bin").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()

    for _ in range(rules):
        left = ~reduce(lambda a, b: a | b, map(holds, done), F.lit(False))
        rule: list[Condition] = []
        while len(rule) < conditions:
            seen = table(left & F.col("grow") & holds(rule))
            by: dict[str, list] = {}
            for r in seen:
                by.setdefault(r["name"], []).append((r["bin"], r["bad"], r["good"]))
            one = by.get(FEATURES[0], [])
            bad, good = sum(x[1] for x in one), sum(x[2] for x in one)
            if not bad or (rule and not good):
                break
            best, start = None, math.log2((bad + 1) / (bad + good + 2))
            for name in sorted(by):
                for side in ("<=", ">="):
                    p = n = 0
                    for at, b, g in sorted(by[name], reverse=side == ">="):
                        p, n = p + b, n + g
                        gain = p * (math.log2((p + 1) / (p + n + 2)) - start)
                        if n < good and p >= SUPPORT and (best is None or gain > best[0] + 1e-9):
                            best = (gain, (name, side, at))
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
        if not rule:
            break
        # prune from the end on the rows kept aside, all shortenings in one scan
        cuts = [holds(rule[:k]) for k in range(1, len(rule) + 1)]
        sums = [F.coalesce(F.sum(F.when(c, v)), F.lit(0)).alias(f"{n}{k}") for k, c in enumerate(cuts) for n, v in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]
        told = rows.filter(left & ~F.col("grow")).agg(*sums).first()
        worth = [(told[f"p{k}"] - told[f"n{k}"]) / max(1, told[f"p{k}"] + told[f"n{k}"]) for k in range(len(cuts))]
        keep = max(range(len(cuts)), key=lambda k: (worth[k], -k))
        rule = rule[:keep + 1]
        both = rows.filter(left & holds(rule)).agg(
            F.sum("bad").alias("p"), F.count("*").alias("all"), F.sum(F.when(~F.col("grow"), F.col("bad"))).alias("kp"),
            F.count_if(~F.col("grow")).alias("kall")).first()
        if not both["all"] or both["p"] < SUPPORT or both["p"] < precision * both["all"] or (both["kp"] or 0) < (2 * precision - 1) * both["kall"]:
            break
        done.append(rule)
    return done


def expression(rules: list[list[Condition]]) -> Column:
    """The decision list as one conditional expression over the binned statistics: the number of the rule that rejects, 0 for none."""
    out = F
    for k, rule in enumerate(rules, 1):
        out = out.when(holds(rule), F.lit(k))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def fit(stats: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, **options) -> list[list[Condition]]:
    """Rules from the labelled rows of ``stats``; those that fail the base test need no rule and are left out."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = stats.filter(~base_failed()).join(known, "doc_id").select(
        *bins(), (1 - F.col("quality")).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"),
        F.xxhash64("doc_id").alias("draw")).orderBy("draw").limit(most)
    return learn(stored(rows, "labelled"), **options)


def judge(docs: DataFrame, labels: DataFrame, **options) -> tuple[DataFrame, list[list[Condition]]]:
    """Every document's statistics with ``base_failed``, ``rule`` (that rejects it, 0: none) and ``kept``; and the rules."""
    stats = stored(statistics(docs), "statistics")
    rules = fit(stats, labels, **options)
    rule = expression(rules)
    binned = stats.select("*", *bins()).select(*stats.columns, base_failed().alias("base_failed"), rule.alias("rule"))
    return binned.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
