"""Quality rules: text statistics, and a decision list learned from labelled ones by sequential covering.

Everything runs as DataFrame functions. Learning reads counts per (feature, bin) of labelled documents, so the driver
receives a few hundred numbers a step whatever the number of documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.llm.shared import SPACE, WORD, fresh, let, stage, text_of

WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars_seen", "n_lines", "n_upper", "n_digits", "n_marks"]
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word": "word_chars / greatest(1, n_words)",
    "symbols_per_word": "n_symbols / greatest(1, n_words)",
    "dup_line_share": "n_dup_lines / greatest(1, n_lines)",
    "repeat_share": "n_repeat_words / greatest(1, n_words)",
    "upper_share": "n_upper / greatest(1, word_chars)",
    "digit_share": "n_digits / greatest(1, word_chars)",
    "marks_per_word": "n_marks / greatest(1, n_words)",
    "words_per_line": "n_words / greatest(1, n_lines)",
}


def _covered(windows: Column) -> Column:
    """Positions inside windows whose hash occurs at least twice, from the hashes in order of their starts."""

    def starts(pairs: Column) -> Column:
        at = lambda k: F.get(pairs, k)["h"]
        twin = F.filter(
            F.sequence(F.lit(0), F.size(pairs) - 1),
            lambda k: at(k).eqNullSafe(at(k + 1)) | at(k).eqNullSafe(at(k - 1)),
        )
        return F.sort_array(F.transform(twin, lambda k: F.get(pairs, k)["i"]))

    def length(found: Column) -> Column:
        return F.aggregate(
            found,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
            lambda acc, x: F.struct(x.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("total")),
            lambda acc: acc["total"],
        )

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(pairs, lambda p: let(starts(p), length))


def _repeats(words: Column) -> Column:
    """Words inside 8-word windows that the text holds twice or more.

    Windows are compared by 64-bit hashes of their words' hashes; texts without a repeated window (most) stop at the
    count of distinct hashes.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    counted = let(hashes, lambda h: let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_covered(w))))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(counted)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def with_stats(docs: DataFrame) -> DataFrame:
    """``docs`` with one more column at the end: a struct of the counts in ``BASE`` and ``MORE``, see ``stat``.

    A null text counts as empty, and all its counts are 0. The struct comes out of a generator, so that filters and
    several uses of it do not compute it anew.
    """
    (name,) = fresh(docs, "text_stats")
    text = text_of()
    only = lambda keep: F.length(F.regexp_replace(text, keep, "")).cast("long")
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeats(w).cast("long").alias("n_repeat_words")))
    stats = F.struct(
        counted.alias("by_word"),
        only(SPACE).alias("word_chars"),
        only("[^#*$%&|<>]+").alias("n_symbols"),
        _dup_lines(text).cast("long").alias("n_dup_lines"),
        F.length(text).cast("long").alias("n_chars_seen"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        only("[^A-Z]+").alias("n_upper"),
        only("[^0-9]+").alias("n_digits"),
        only("[^!?;:\"()]+").alias("n_marks"),
    )
    return docs.select("*", F.explode(F.array(stats)).alias(name))


def stat(stats: str, name: str) -> Column:
    """One of the counts in the column ``stats``."""
    s = F.col(stats)
    return s["by_word"][name] if name in ("n_words", "n_repeat_words") else s[name]


def stats_name(df: DataFrame) -> str:
    return df.columns[-1]


def base_failed(stats: str) -> Column:
    n = stat(stats, "n_words")
    return (n < 20) | (100 * stat(stats, "n_repeat_words") > 30 * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def column(self, values: Column) -> Column:
        v = values[self.feature]
        return v > self.bound if self.above else v <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.bound:g}"


class DecisionList:
    """Ordered conjunctions; the first that holds rejects the document, none keeps it."""

    def __init__(self, rules: list[list[Condition]]):
        self.rules = rules

    def verdict(self, stats: str) -> Column:
        values = F.struct(*[F.expr(_on(sql, stats)).alias(n) for n, sql in FEATURES.items()])
        if not self.rules:
            return F.lit(True)
        case = F
        for rule in self.rules:
            cond = F.lit(True)
            for c in rule:
                cond = cond & F.coalesce(c.column(values), F.lit(False))
            case = case.when(cond, F.lit(False))
        return case.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "; ".join(" and ".join(map(str, r)) for r in self.rules) or "keep all"


def _on(sql: str, stats: str) -> str:
    for n in BASE + MORE:
        sql = sql.replace(n, f"`{stats}`." + ("by_word." if n in ("n_words", "n_repeat_words") else "") + n)
    return sql


def learn(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 20_000,
    cuts: int = 32,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.8,
) -> DecisionList:
    """A decision list for ``quality = 0`` from at most ``max_labelled`` labelled documents (smallest hashes of doc_id).

    Two thirds of them grow conjunctions condition by condition (highest information gain over thresholds at the
    features' quantiles); the last third prunes trailing conditions and ends the list when a rule's precision there is
    below ``min_precision``. Null labels and ids are ignored; without labelled documents every document is kept.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("_bad"))
    known = known.orderBy(F.xxhash64("_id"), "_id", "_bad").limit(max_labelled)  # the bound of the broadcast below
    seen = with_stats(docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")))
    values = stage(
        seen.select(
            "_bad",
            (F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(3)) == 0).alias("_prune"),
            base_failed(stats_name(seen)).alias("_failed"),
            *[F.expr(_on(sql, stats_name(seen))).alias(n) for n, sql in FEATURES.items()],
        ).where("NOT _failed")
    )
    names = list(FEATURES)
    probs = [i / cuts for i in range(1, cuts)]
    row = values.agg(*[F.percentile_approx(n, probs, 10_000).alias(n) for n in names]).first()
    bounds = {n: sorted(set(row[n] or [])) for n in names}
    if not any(bounds.values()):
        return DecisionList([])

    def bin_of(name: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds[name]]), lambda b: b < F.col(name)))

    bins = F.array(*map(bin_of, names))
    table = stage(values.select("_bad", "_prune", bins.alias("_bins")))

    def holds(rule: list[tuple[int, bool, int]]) -> Column:
        cond = F.lit(True)
        for f, above, k in rule:
            b = F.col("_bins")[f]
            cond = cond & ((b > k) if above else (b <= k))
        return cond

    def counts(df: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
        per = df.select("_bad", F.posexplode("_bins").alias("f", "b")).groupBy("f", "b")
        got = per.agg(F.sum(F.col("_bad").cast("int")).alias("p"), F.count("*").alias("n")).collect()  # features x bins rows
        return {(r["f"], r["b"]): (r["p"], r["n"] - r["p"]) for r in got}

    def best(got: dict[tuple[int, int], tuple[int, int]]) -> tuple[float, tuple[int, bool, int] | None]:
        top: tuple[float, tuple[int, bool, int] | None] = (0.0, None)
        for f, n in enumerate(names):
            per = [got.get((f, b), (0, 0)) for b in range(len(bounds[n]) + 1)]
            p0, n0 = sum(x[0] for x in per), sum(x[1] for x in per)
            if not p0:
                continue
            prior, p, q = math.log2(p0 / (p0 + n0)), 0, 0
            for k in range(len(bounds[n])):
                p, q = p + per[k][0], q + per[k][1]
                for above, (a, b) in ((False, (p, q)), (True, (p0 - p, n0 - q))):
                    if a and (gain := a * (math.log2(a / (a + b)) - prior)) > top[0] + 1e-9:
                        top = gain, (f, above, k)
        return top

    rules: list[list[tuple[int, bool, int]]] = []
    left = table
    while len(rules) < max_rules:
        rule: list[tuple[int, bool, int]] = []
        grown = left.where("NOT _prune")
        while len(rule) < max_conditions:
            got = counts(grown.where(holds(rule)))
            _, step = best(got)
            if step is None:
                break
            rule.append(step)
        if not rule:
            break
        sums = [x for i in range(1, len(rule) + 1) for x in (F.sum(F.when(holds(rule[:i]) & F.col("_bad"), 1).otherwise(0)), F.sum(F.when(holds(rule[:i]), 1).otherwise(0)))]
        got = left.where("_prune").agg(*sums).first()
        value = [((got[2 * i] or 0), (got[2 * i + 1] or 0)) for i in range(len(rule))]
        keep = max(range(len(rule)), key=lambda i: ((2 * value[i][0] - value[i][1]) / value[i][1] if value[i][1] else -1.0, -i))
        hit, n = value[keep]
        if not n or hit < min_precision * n:
            break
        rules.append(rule[: keep + 1])
        left = left.where(~holds(rules[-1]))
    return DecisionList([[Condition(names[f], above, float(bounds[names[f]][k])) for f, above, k in r] for r in rules])


def judge(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``docs`` with two more columns at the end: the statistics and whether the document is kept.

    A document is rejected if it has under 20 words, if over 30 % of them lie in repeated windows, or by the list.
    Null and empty texts have no words and are rejected; very long ones are read whole. Every row is judged for itself,
    repeated ones alike; an empty table gives no rows. Names that ``docs`` has get underscores in front in the new columns.
    """
    rules = learn(docs, labels, **how)
    out = with_stats(docs)
    stats = stats_name(out)
    (kept,) = fresh(out, "kept")
    return out.withColumn(kept, ~base_failed(stats) & rules.verdict(stats))


def kept_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are kept, as they are: all columns, repeated rows as often as they come.

    Null and empty texts go, as ``judge`` says.
    """
    out = judge(docs, labels, **how)
    return out.where(F.col(out.columns[-1])).select(*docs.columns)
