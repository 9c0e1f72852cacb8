import hashlib
import os
import random
import re
import time

from pyspark.sql import functions as F

from earshot.llm import pii
from earshot.llm.registry import ORACLES, QUERIES
from tests.oracle import duckdb_rows, rows_of

from .fixtures import DOC, SF, edge_frames

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in value.split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


#: What a match holds; the plain patterns take quadratic time on a long run without it.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def base(text):
    return sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(PLAIN.items()) if NEEDED[k] in (text or "") for m in re.finditer(p, text or "") if valid(k, m[0]))


def compare(docs, out):
    expected = sorted((repr(r.doc_id), *(sum(s[3] == k for s in base(r.text)) for k in PLAIN), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base(r.text)).encode()).hexdigest()) for r in docs.select("doc_id", "text").collect())
    assert sorted((repr(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == expected


def test_query(spark):
    compare(spark.read.parquet(f"{SF}/documents.parquet"), QUERIES["op6_disclosure"](spark, SF).collect())


def test_edges(spark):
    for _, df in edge_frames(spark):
        compare(df, pii.counts(pii.find(df)).collect())
        clean = pii.sanitize(df, length_col="n_chars")
        assert clean.columns == df.columns and clean.count() == df.count()


def test_hard_matches(spark):
    texts = ["a@b.c_d@e.f x@y a@b..c a@b.c.d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111 5 41111111111111112 4111-1111-1111-1111, 4111  1111 1111 1111", "+1 (555) 123-4567.+44 20 7946 0958 +1 +123 +1+2345678901", "é😀 a@b.c 😀 +15551234567", "1" * 40 + " " + "12 " * 50, "@@@ a@@b.c a%b@c-d.e-f. +" + "1" * 20000, "x" * 200000, "4" * 15 + "1.2.3.4@5.6.7.8"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)
    compare(df, pii.counts(pii.find(df)).collect())


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)


def spans_of(df, **limits):
    return {r.doc_id: r.spans for r in pii.counts(pii.find(df, **limits)).collect()}


def test_terms_that_disclose_an_entity(spark):
    """A name that only texts with one address hold, short ones and those with digits too; words of other texts stay."""
    texts = [f"note {i} zanzibarfund by Jo of x7 mail kim@corp.example about item{i} today soon" for i in range(6)] + [f"other text number {i} about the item today soon with ordinary words by" for i in range(200)]
    df = frame(spark, texts)
    found = spans_of(df)
    for i in range(6):
        cut = sorted(texts[i][int(a) : int(b)] for kind, a, b in (x.split(":") for x in found[i].split(",")) if kind in ("term", "wide"))
        assert cut == ["Jo", "mail", "note", "of", "x7", "zanzibarfund"]
    assert all(found[i] == "" for i in range(6, 206))
    clean = {r.doc_id: r.text for r in pii.sanitize(df, length_col="n_chars").collect()}
    assert "[EMAIL]" in clean[0] and "zanzibarfund" not in clean[0] and "Jo" not in clean[0] and "today soon" in clean[0] and clean[10] == texts[10]


def test_one_co_occurrence_is_no_proof(spark):
    """Whatever the corpus' size: an entity of one text, and one that two texts hold with different words beside it."""
    for n in (100, 3000):
        texts = ["only here zanzibarfund +15551234567", "first alpha a@b.example", "second beta a@b.example"] + [f"ordinary words {i % 50}" for i in range(n)]
        assert not any("term" in s or "wide" in s for s in spans_of(frame(spark, texts)).values())


def test_copies_are_no_witnesses(spark):
    texts = ["copied words zanzibarfund a@b.example"] * 30 + [f"ordinary words {i % 50}" for i in range(500)]
    assert not any("term" in s or "wide" in s for s in spans_of(frame(spark, texts)).values())


def test_frequent_entities_and_frequent_terms(spark):
    """An address on most pages is disclosed by nothing; a word that most texts without the address hold discloses nothing."""
    texts = [f"page {i} of zanzibarfund a@b.example" for i in range(300)] + [f"plain page {i}" for i in range(100)]
    assert not any("term" in s or "wide" in s for s in spans_of(frame(spark, texts)).values())
    texts = [f"zanzibarfund c@d.example n{i}" for i in range(5)] + [f"zanzibarfund alone n{i}" for i in range(10)] + [f"plain page {i}" for i in range(300)]
    assert not any("term" in s or "wide" in s for s in spans_of(frame(spark, texts)).values())


def test_a_term_is_generalised_to_a_wider_one(spark):
    """The name stands by its trade, which other texts name as well; the other name stands by nothing that is wider."""
    texts = [f"n{i} our gardener Zanzibrow rang +15551234567 today" for i in range(5)] + [f"q{i} Quillbert +15559876543" for i in range(5)]
    texts += [f"a gardener came, number {i}" for i in range(40)] + [f"our ordinary words rang today {i}" for i in range(600)]
    df = frame(spark, texts)
    found, clean = spans_of(df), {r.doc_id: r.text for r in pii.sanitize(df).collect()}
    at = texts[0].index("Zanzibrow")
    assert f"wide:{at}:{at + 9}" in found[0] and clean[0] == "n0 our gardener gardener rang [PHONE] today"
    assert f"term:3:12" in found[5] and clean[5] == "q0 [REMOVED] [PHONE]" and clean[20] == texts[20]


def test_long_texts_take_time_in_proportion(spark):
    """32,000 addresses in a megabyte, a megabyte without a space, and many overlapping spans."""
    text = " ".join(f"user{k}.name@mail{k % 97}.example.org" for k in range(32_000))
    many = "4111111111111111.1+15551234567.2@x.yz " * 3000
    expected = ""  # by the definition: in order of start, what begins within another is passed over
    at = 0
    for a, n, b, k in base(many):
        if a >= at:
            expected, at = expected + many[at:a] + f"[{k.upper()}]", b
    expected += many[at:]
    df = frame(spark, [text, "x" * 1_000_000, many, "y" * 1023 + "é" + " a@b.cd " + "🙂" * 3000, "9" * 1_000_000]).repartition(5)
    redacted = df.select("doc_id", pii.redact(F.col("text"), pii.base_spans(F.col("text"))).alias("t"))
    redacted.limit(1).collect()
    began = time.monotonic()
    out = {r.doc_id: r.t for r in redacted.collect()}
    assert time.monotonic() - began < 10
    assert out[0] == " ".join(["[EMAIL]"] * 32_000) and len(out[1]) == 1_000_000 == len(out[4]) and out[2] == expected
    assert out[3] == "y" * 1023 + "é [EMAIL] " + "🙂" * 3000
    compare(df, pii.counts(pii.find(df)).collect())
    assert {r.doc_id: r.text for r in pii.sanitize(df).collect()} == out


def test_walks_in_blocks(spark):
    rng = random.Random(6)
    rows = [[rng.randrange(9) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000)]
    for r in spark.createDataFrame([(r,) for r in rows], "a array<bigint>").select("a", pii._before(F.col("a")).alias("b")).collect():
        assert r.b == [sum(r.a[:k]) for k in range(len(r.a))]
    text = "".join(rng.choice("aé🙂\n") for _ in range(5000))
    places = [(a, b) for a, b in ((rng.randrange(5001), rng.randrange(5001)) for _ in range(200)) if a <= b] + [(0, 5000), (1024, 2048), (1023, 1024), (1024, 1024), (5000, 5000)]
    df = spark.createDataFrame([(text, a, b) for a, b in places], "t string, a bigint, b bigint")
    for r in df.select("a", "b", pii._piece(pii._chunks(F.col("t")), F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == text[r.a : r.b]


def test_overlapping_spans_leave_nothing_over(spark):
    spans = [(0, 0, 5, "ab"), (3, 1, 9, "x"), (9, 4, 11, "y"), (12, 5, 14, "wider"), (14, 2, 14, "z")]
    df = spark.createDataFrame([("0123456789abcdefgh", spans)], f"t string, s {pii.SPAN}")
    assert df.select(pii.redact(F.col("t"), F.col("s")).alias("t")).first().t == "[EMAIL]5678[REMOVED]bwider[CARD]efgh"


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (QUERIES["op6_disclosure"](spark, SF), pii.sanitize(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_disclosed_terms_by_sql(spark, tmp_path):
    """Random notes about people who share addresses, names and trades, with copies, against the SQL twin."""
    rng = random.Random(9)
    people = [(f"kim{k}@x.example" if k % 2 else f"+1555123{4000 + k}", f"name{k}ly", rng.choice(["gardener", "baker", "carter", "sailor"])) for k in range(12)]
    common = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(400):
        said = rng.choices(common, k=12)
        if k < 90:
            contact, name, trade = people[int(12 * rng.random() ** 2)]
            said[rng.randrange(12)] = rng.choice([contact, contact, "7.7.7.7"])
            said[3:4] = [rng.choice(["our", "the"]), trade, name] if rng.random() < 0.8 else [f"rare{k}"]
        elif k < 200:
            said[5:6] = ["a", rng.choice(["gardener", "baker", "carter", "sailor"]), "spoke"]
        texts.append(" ".join(said) + rng.choice(["", ".", "\\n(end)"]))
    texts += texts[:30] + [None, ""]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)
    df.coalesce(1).write.parquet(str(tmp_path / "rows"))
    os.rename(next((tmp_path / "rows").glob("*.parquet")), tmp_path / "documents.parquet")
    out = pii.counts(pii.find(df))
    rows = out.collect()
    assert sum("wide:" in r.spans for r in rows) > 5 and sum("term:" in r.spans for r in rows) > 5
    columns, expected = duckdb_rows(ORACLES["op6_disclosure"], str(tmp_path))
    assert sorted(out.columns) == columns and rows_of(out.columns, rows) == expected
