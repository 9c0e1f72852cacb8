import math
import re
from collections import Counter

from earshot.llm import rules
from earshot.llm.registry import QUERIES

from .fixtures import SF, edge_frames


def counted(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, held = Counter(zip(w, w[1:], w[2:])), set()
    for k in range(len(w) - 2):
        if seen[tuple(w[k : k + 3])] > 1:
            held |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(held)


def compare(docs, out):
    expected = sorted((repr(r.doc_id), *counted(r.text)) for r in docs.select("doc_id", "text").collect())
    assert sorted((repr(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == expected
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_query(spark):
    compare(spark.read.parquet(f"{SF}/documents.parquet"), QUERIES["op7_rule_votes"](spark, SF).collect())


def test_edges(spark):
    for _, df in edge_frames(spark):
        compare(df, rules.judge(df).collect())


def test_estimate_finds_the_accuracies():
    import random

    rng = random.Random(3)
    patterns = Counter()
    for _ in range(20000):
        good = rng.random() < 0.8
        patterns[tuple((1 if good == (rng.random() < a) else -1) if rng.random() < 0.7 else 0 for a in (0.9, 0.8, 0.7, 0.85))] += 1
    prior, weights = rules.estimate(sorted(patterns.items()))
    assert abs(prior - 0.8) < 0.05
    assert weights[0][1] > weights[2][1] > 0 > weights[2][-1] > weights[0][-1]


def test_verdicts_follow_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op7_rule_votes"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    assert sum(r.kept == bool(r.quality) for r in out) / len(out) > 0.95


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op7_rule_votes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_votes(text):
    """The rules once more, from the text alone."""
    n_words, chars, symbols, dup_lines, repeats = counted(text)
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, distinct = max(n_words, 1), len(set(w))
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
    upper = sum("A" <= c <= "Z" for c in text or "") / max(chars, 1)
    short = sum(len(x) <= 3 and x.isalpha() for x in w) / n
    say = lambda bad, good=False: -1 if bad else int(good)
    return (
        say(symbols / n > 0.1, symbols / n < 0.01), say(repeats / n > 0.4), say(dup_lines / max(lines, 1) > 0.4), say(chars / n < 2.5 or chars / n > 12),
        say(distinct / n < 0.15 and distinct < 3 * math.sqrt(n)), say(upper > 0.4), say(short < 0.1, short > 0.2), say(n_words < 30, n_words > 100),
    )


def test_verdicts_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    votes = {k: plain_votes(t) for k, t in texts.items()}
    prior, weights = rules.estimate(sorted(Counter(votes.values()).items()))
    out = QUERIES["op7_rule_votes"](spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        posterior = 1 / (1 + math.exp(-math.log(prior / (1 - prior)) - sum(w[v] for v, w in zip(votes[r.doc_id], weights))))
        assert abs(r.posterior - posterior) < 1e-9
        assert r.kept == (not r.base_failed and posterior >= 0.5)


def test_few_distinct_words_are_held_against_texts_of_any_length(spark):
    poor = [(n, " ".join(f"w{(k * k) % 97}" for k in range(n))) for n in (1_000, 1_999, 2_000, 50_000)]
    rich = [(-n, " ".join(f"w{(k * 2654435761) % max(n // 20, 1200)}" for k in range(n))) for n in (1_000, 1_999, 2_000, 50_000)]
    out = {r.doc_id: r.v_distinct for r in rules.judge(spark.createDataFrame(poor + rich, "doc_id bigint, text string")).collect()}
    assert out == {n: -1 if n > 0 else 0 for n, _ in poor + rich}
