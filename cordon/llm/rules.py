"""Quality rules with risk-controlled thresholds. Column functions only.

Measures of each text are compared with cutoffs. A cutoff is used only where labelled good
documents prove, by an exact binomial test corrected for the number of tests, that it rejects
at most a stated share of good documents of its stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordon.llm.text import SPACE, let, words
from cordon.session import cut

WINDOW = 5
#: Fixed grid of cutoffs of each rule; a document fails a rule when its measure is above the cutoff.
CUTOFFS = {
    "symbol_share": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0],
    "dup_line_share": [0.1, 0.2, 0.3, 0.5, 0.7],
    "repeat_share": [0.02, 0.05, 0.1, 0.15],
    "word_length": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0],
    "short_word_length": [-4.5, -4.0, -3.5, -3.0, -2.5],
}
RISK = 0.01  # share of good documents of a stratum that one rule may reject
CONFIDENCE = 0.95  # of all rules and strata together


def covered(hashes: Column) -> Column:
    """Words inside windows that are found twice or more, from the windows' hashes in order. Windows are
    sorted by hash, those with an equal neighbour kept, and their places' spans added up: n log n a text."""
    def places(pairs):
        n = F.size(pairs)
        same = F.filter(pairs, lambda x, j: ((j > 0) & (F.get(pairs, j - 1)["h"] == x["h"])) | ((j < n - 1) & (F.get(pairs, j + 1)["h"] == x["h"])))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def spans(at):
        start = F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, i: F.struct((acc["sum"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("sum"), i.alias("last"))
        return F.aggregate(at, start, step, lambda acc: acc["sum"])

    def counted(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs, places), spans))

    return let(hashes, counted)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the whole text's n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def by_words(w):
        n = F.size(w)
        window = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(WINDOW)]))
        return F.struct(n.cast("long").alias("n"), F.when(n > WINDOW, covered(window)).otherwise(0).cast("long").alias("repeats"))

    def by_lines(lines):
        n = F.size(lines)
        return F.struct(n.cast("long").alias("n"), (n - F.size(F.array_distinct(lines))).cast("long").alias("dup"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        "doc_id", "lang", let(words(F.col("text")), by_words).alias("_w"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, by_lines).alias("_l"),
    ).select("doc_id", "lang", F.col("_w.n").alias("n_words"), "word_chars", "n_symbols", F.col("_l.n").alias("n_lines"), F.col("_l.dup").alias("n_dup_lines"), F.col("_w.repeats").alias("n_repeat_words"))


def rates(measured: DataFrame) -> DataFrame:
    """The measures that the rules compare; 0 for a text without words."""
    n = F.col("n_words")
    per_word = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    return measured.withColumns({
        "symbol_share": per_word(F.col("n_symbols")), "dup_line_share": F.when(n > 0, F.col("n_dup_lines") / F.col("n_lines")).otherwise(0.0), "repeat_share": per_word(F.col("n_repeat_words")),
        "word_length": per_word(F.col("word_chars")), "short_word_length": F.when(n > 0, -F.col("word_chars") / n).otherwise(-1e9),
    })


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1, by Stirling's series shifted up by seven (error below 1e-12)."""
    y = x + 7
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    shift = F.lit(0.0)
    for i in range(7):
        shift = shift + F.ln(x + i)
    return series - shift


def binomial_tail(k: Column, n: Column, p: float, steps: int = 20_000) -> Column:
    """P(at most k of n at rate p), for k below n p: the point probability of k times a falling series. What
    lies past ``steps`` terms is bounded by a geometric series and added, so the value is never too low."""
    k, n = k.cast("double"), n.cast("double")
    point = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc, i):
        term = acc["term"] * (k - i + 1) / (n - k + i) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    def finish(acc):
        ratio = F.greatest(F.lit(0.0), (k - steps) / (n - k + steps + 1) * ((1 - p) / p))
        return acc["sum"] + F.when(k > steps, acc["term"] * ratio / (1 - ratio)).otherwise(0.0)

    terms = F.when(k >= 1, F.sequence(F.lit(1), F.least(k, F.lit(steps)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return point * F.aggregate(terms, start, step, finish)


def thresholds(good: DataFrame, stratum: str, risk: float = RISK, confidence: float = CONFIDENCE, cutoffs: dict = CUTOFFS) -> DataFrame:
    """Per stratum, the cutoff of each rule (null: none is proven), from the ``rates`` of labelled good documents.

    One aggregate counts the good documents that each cutoff would reject. A cutoff is valid when so few rejections
    would have a chance of at most (1 - confidence) / number of tests if its true rate were above ``risk``. The
    number of tests is rules x cutoffs x strata (Bonferroni), so that all chosen cutoffs keep the risk at once.
    The lowest valid cutoff is taken."""
    grid = [(rule, c) for rule, cs in cutoffs.items() for c in cs]
    counts = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(float(c)).alias("cutoff"), F.count_if(F.col(rule) > c).alias("k")) for rule, c in grid])
    table = cut(good.groupBy(F.col(stratum).alias("_stratum")).agg(F.count(F.lit(1)).alias("n"), counts.alias("_tests")))
    limit = (1 - confidence) / (max(1, table.count()) * len(grid))
    tests = table.select("_stratum", "n", F.explode("_tests").alias("t")).select("_stratum", "n", "t.*")
    proven = tests.where(F.col("k") < risk * F.col("n")).where(binomial_tail(F.col("k"), F.col("n"), risk) <= limit)
    return proven.groupBy("_stratum").agg(*[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"_max_{rule}") for rule in cutoffs])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, the measures, base_failed, kept, failed_rules.

    base_failed: fewer than 10 words, or more than a fifth of them repeated. kept: not base_failed, and no measure above its
    stratum's cutoff. Null texts have no words, a null stratum is a stratum, a stratum with too few good labels to
    prove a cutoff keeps every document that passes the base rules; ids whose labels disagree calibrate nothing;
    repeated rows are judged alike; an empty table gives no rows."""
    rows = cut(measures(docs))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rated = rates(rows.withColumn("base_failed", base))
    clear = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q = 1").select(F.col("doc_id").alias("_id"))
    good = rated.where(~F.col("base_failed")).join(clear, F.col("doc_id") == F.col("_id"))
    limits = thresholds(good, stratum, risk, confidence)
    fails = {rule: F.coalesce(F.col(rule) > F.col(f"_max_{rule}"), F.lit(False)) for rule in CUTOFFS}
    names = F.array_compact(F.array(*[F.when(c, F.lit(rule)) for rule, c in fails.items()]))
    out = rated.join(limits, F.col(stratum).eqNullSafe(F.col("_stratum")), "left").withColumn("failed_rules", names)
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"))
