r"""Document quality by weak supervision over rules, in DataFrame operations only.

Each rule votes for or against a text or abstains. Expectation-maximisation
over the counts of vote patterns estimates the share of good texts and, for
each rule, how often it is right about good and about bad texts when it votes;
a text is kept by its posterior probability of being good. There are 3 ** rules
patterns at most, whatever the corpus holds, so the estimation runs on their
counts in the driver and comes back as weights in a column expression.

Words are runs outside space and U+0009..U+000D. Repeated 3-word windows are
found by sorting, in each text, 64-bit integers of a window's hash and place:
one sort of a primitive array instead of rows for every word. Windows whose
hashes agree there are then compared by their words, so the count is exact.

The vocabulary of prose grows about as the root of its length, so a text is poor in
distinct words if they are both under 0.15 of its words and under three times the
root of their number; texts of any length are held to the same rule.

Defined results: a null text has no words and fails; null doc_ids, repeated
rows and empty tables keep their rows as they are; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = r"[\x20\x09-\x0D]+"
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of one to three letters: function words, in many languages.
SHORT = r"(?<![^\x20\x09-\x0D])\p{L}{1,3}(?![^\x20\x09-\x0D])"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the further rules need."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", "text", F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"))
    n = F.size("words")
    # the window's hash above, its place in the low bits: as few of them as the text's word count needs
    bits = F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double"))).cast("int")
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    keyed = words.select("doc_id", "text", "words", bits.alias("bits"), F.when(n >= 3, F.sequence(F.lit(0), n - 3)).alias("at")).select(
        "doc_id", "text", "words", "bits",
        F.sort_array(F.transform("at", lambda i: F.call_function("shiftleft", F.call_function("shiftright", window(i), F.col("bits")), F.col("bits")).bitwiseOR(i.cast("bigint")))).alias("keys"),
    )
    key = lambda x: F.call_function("shiftright", x, F.col("bits"))
    same = lambda x, k: (key(x) == key(F.get("keys", k + 1))) | ((k > 0) & (key(x) == key(F.get("keys", k - 1))))
    place = lambda x: (x - F.call_function("shiftleft", key(x), F.col("bits"))).cast("int")
    # windows of equal keys, by their words: equal bits of a hash are no proof
    said = lambda i: F.struct(F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("said"), i.alias("place"))
    alike = keyed.select("doc_id", "text", "words", F.sort_array(F.transform(F.filter("keys", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: said(place(x)))).alias("alike"))
    again = lambda x, k: (x["said"] == F.get("alike", k + 1)["said"]) | ((k > 0) & (x["said"] == F.get("alike", k - 1)["said"]))
    found = alike.select("doc_id", "text", "words", F.sort_array(F.transform(F.filter("alike", lambda x, k: F.coalesce(again(x, k), F.lit(False))), lambda x: x["place"])).alias("starts"))
    covered = F.aggregate(
        "starts", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["sum"] + s + 3 - F.greatest(a["end"], s)).alias("sum"), (s + 3).alias("end")), lambda a: a["sum"],
    )
    lines = F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    return found.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        _without(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        _without(F.col("text"), UPPER).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(SHORT)).cast("long").alias("n_short_words"),
    ).select("doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"), "n_repeat_words", "n_distinct_words", "n_upper", "n_short_words")


def votes() -> dict[str, Column]:
    """1: good, -1: bad, 0: abstains. A rule that sees nothing wrong abstains unless that itself speaks for a text."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def vote(bad: Column, good: Column | None = None) -> Column:
        votes = F.when(bad, -1)
        return (votes.when(good, 1) if good is not None else votes).otherwise(0)

    symbols, repeats, lines, length = F.col("n_symbols") / n, F.col("n_repeat_words") / n, F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("word_chars") / n
    distinct, upper, short = F.col("n_distinct_words") / n, F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)), F.col("n_short_words") / n
    return {
        "v_symbols": vote(symbols > 0.1, symbols < 0.01),
        "v_repeats": vote(repeats > 0.4),
        "v_lines": vote(lines > 0.4),
        "v_length": vote((length < 2.5) | (length > 12)),
        "v_distinct": vote((distinct < 0.15) & (F.col("n_distinct_words") < 3 * F.sqrt(n))),
        "v_upper": vote(upper > 0.4),
        "v_short": vote(short < 0.1, short > 0.2),
        "v_words": vote(F.col("n_words") < 30, F.col("n_words") > 100),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], *, rounds: int = 300, prior: float = 0.8, accuracy: float = 0.8, pseudo: float = 10.0) -> tuple[float, list[dict[int, float]]]:
    """EM over (votes, count): the share of good texts, and each rule's evidence, the log of how much likelier
    a vote (or an abstention) is on good texts than on bad ones.

    A vote's evidence never turns against it, so the classes can't swap their names; pseudo counts keep the
    evidence of rules that hardly vote near that of the starting accuracy.
    """
    width = len(patterns[0][0]) if patterns else 0
    start = math.log(accuracy / (1 - accuracy))
    weights = [{-1: -start, 0: 0.0, 1: start} for _ in range(width)]
    lean = {1: {-1: 1 - accuracy, 0: 0.5, 1: accuracy}, 0: {-1: accuracy, 0: 0.5, 1: 1 - accuracy}}
    for _ in range(rounds):
        sums = [{c: {v: pseudo * lean[c][v] for v in (-1, 0, 1)} for c in (0, 1)} for _ in range(width)]
        mass = {0: 0.0, 1: 0.0}
        for pattern, count in patterns:
            p = 1 / (1 + math.exp(-_logit(pattern, prior, weights)))
            for c, share in ((1, p), (0, 1 - p)):
                mass[c] += share * count
                for j, v in enumerate(pattern):
                    sums[j][c][v] += share * count
        before, old = weights, prior
        weights = []
        for s in sums:
            w = {v: math.log(s[1][v] / sum(s[1].values())) - math.log(s[0][v] / sum(s[0].values())) for v in (-1, 0, 1)}
            weights.append({-1: max(-20.0, min(0.0, w[-1])), 0: w[0], 1: min(20.0, max(0.0, w[1]))})
        total = mass[0] + mass[1]
        prior = min(0.99, max(0.5, mass[1] / total)) if total else prior
        if abs(old - prior) < 1e-9 and all(abs(x[v] - y[v]) < 1e-7 for x, y in zip(before, weights) for v in x):
            break
    return prior, weights


def _logit(pattern: tuple[int, ...], prior: float, weights: list[dict[int, float]]) -> float:
    return max(-500.0, min(500.0, math.log(prior / (1 - prior)) + sum(w[v] for v, w in zip(pattern, weights))))


def judge(docs: DataFrame, *, threshold: float = 0.5, **columns) -> DataFrame:
    """The features, each rule's vote, base_failed, posterior and kept."""
    rules = votes()
    counted = materialize(features(docs, **columns).withColumns({k: v.cast("tinyint") for k, v in rules.items()}), "rules")
    patterns = [(tuple(r[k] for k in rules), r["count"]) for r in counted.groupBy(*rules).count().collect()]
    prior, weights = estimate(sorted(patterns))
    z = F.lit(math.log(prior / (1 - prior)))
    for k, w in zip(rules, weights):
        z = z + F.when(F.col(k) > 0, w[1]).when(F.col(k) < 0, w[-1]).otherwise(w[0])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    posterior = 1 / (1 + F.exp(-z))
    return counted.withColumn("base_failed", failed).withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
