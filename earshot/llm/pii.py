r"""Personal data: exact spans of four kinds, and terms that reveal the protected entities.

All of it is DataFrame operations. Spans of a kind are the leftmost
non-overlapping matches of its pattern that pass its test; places are code
points. Splitting a text at a pattern gives the pieces between its matches, so
piece and match lengths add up to the places.

Information-theoretic sanitisation: the protected entities are the span values.
The corpus says how strongly a term t, any word of a text outside its base spans,
reveals an entity e that the text holds. Documents are the unit: of all N,
n(e) hold e, df(t) hold t, and n(t, e) both. As a pair is only looked at because
a text x brought it up, that text (and its copies, c in all) is no witness:

    p(e) = n(e) / N,   p(e | t) = (n(t, e) - c + p(e)) / (df(t) - c + 1).

A term discloses e in x if at least ``min_others`` other texts hold both, if what
is left to learn of e, -log2 p(e | t), is at most ``residual`` bits, if it
says at least ``gain`` bits more than nothing, log2(p(e | t) / p(e)), and if that
isn't chance: were the other df(t) - c and n(e) - c documents spread at random, they would meet
m = (df(t) - c)(n(e) - c) / (N - c) times on average, and as often as the k seen with
a probability of at most (e m / k)^k (Chernoff), which must be ``alpha`` at most. So one
co-occurrence never is proof, in a corpus of any size.

A disclosing term is generalised to a wider term of the corpus if there is one,
else removed. Wider is, as co-occurrence shows, a word h that stands within
``NEAR`` words of t in at least half of the texts with an entity that hold t, twice as often at
least as its share of all documents, of at least four times the documents and
more than twice those of any entity that t discloses (so that h doesn't disclose it:
p(e | h) is below 1/2), and of a tenth of all documents at most; the one in
most of these texts, then the rarest, then the first by spelling.

Entities that the same documents hold have the same counts and are treated as
one. Entities, and terms, of too few texts are left out before anything is
paired, as are terms more than half of whose documents hold no entity: they
can't reach the thresholds. So pairs are made of words that stand almost only beside
entities, and of entities that other texts hold, of each text apart.

Patterns begin at the start of a run or where the match before ended (``\G``),
and take runs possessively: the same matches as the plain patterns, in linear
time and without recursion on long runs.

Defined results: null texts are empty, without spans; null doc_ids and repeated
rows keep their rows; empty tables give none; other columns are not read. Long
texts are worked on whole: a text's spans are one array, and everything that
walks along them does so in blocks, so time is in proportion to the text; its
different words become rows, one each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds of span that the method adds: removed, and generalised (their value is the wider term).
METHOD = ("term", "wide")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap to search: a text that doesn't match holds no span of the kind.
HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
WORD = r"[\p{L}\p{N}]+"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: A wider term stands within so many words of a term.
NEAR = 5
SPAN = "array<struct<start:bigint,kind_no:int,end:bigint,value:string>>"
#: Elements of an array that are gone along at once, and characters of a text that are kept together.
BLOCK, CHUNK = 256, 1024


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once: within a lambda an expression is worked out at every use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _blocks(items: Column) -> Column:
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def _along(items: Column, at: Column, step, row: str) -> Column:
    """(at, out) after a walk along items: step(at, item) gives the next `at` and an array of `row`s to put out.

    What is put out grows by a block at a time, so a long array isn't copied at every item.
    """
    none, nothing = F.expr(f"cast(array() as array<{row}>)"), F.expr(f"cast(array() as array<array<{row}>>)")

    def item(state: Column, x: Column) -> Column:
        return _let(step(state["at"], x), lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], r["out"]).alias("out")))

    def block(state: Column, own: Column) -> Column:
        done = F.aggregate(own, F.struct(state["at"].alias("at"), none.alias("out")), item)
        return _let(done, lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], F.array(r["out"])).alias("out")))

    walked = lambda v: F.aggregate(_blocks(v), F.struct(at.alias("at"), nothing.alias("out")), block, lambda s: F.struct(s["at"].alias("at"), F.flatten(s["out"]).alias("out")))
    return _let(items, walked)


def _before(lengths: Column) -> Column:
    """Running sums of an array: of what comes before each element."""
    return _along(lengths, F.lit(0).cast("bigint"), lambda at, x: F.struct((at + x).alias("at"), F.array(at).alias("out")), "bigint")["out"]


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _piece(chunks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end, of a text in chunks: a place is found without going along the whole text."""
    i, j = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    first, last = (start % CHUNK).cast("int"), (end % CHUNK).cast("int")
    tail = F.coalesce(F.substring(F.get(chunks, j), F.lit(1), last), F.lit(""))
    several = F.concat(F.substring(F.get(chunks, i), first + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), tail)
    return F.when(start >= end, F.lit("")).when(i == j, F.substring(F.get(chunks, i), first + 1, (end - start).cast("int"))).otherwise(several)


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        return (F.length(digits) <= 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda span: _valid(kind, span["value"])


def _places(hits: Column, pieces: Column, kind_no: int) -> Column:
    """Spans of the matches, from their values and the pieces between them."""

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.slice(pieces, F.lit(1), F.size(hits)), lambda p: F.char_length(p).cast("bigint"))
        before = _before(F.zip_with(gaps, hits, lambda g, h: g + F.char_length(h)))
        starts = F.zip_with(before, gaps, lambda b, g: b + g)
        return F.zip_with(starts, hits, lambda s, h: F.struct(s.alias("start"), F.lit(kind_no).alias("kind_no"), (s + F.char_length(h)).alias("end"), h.alias("value")))

    return _let(hits, placed)


def base_spans(text: Column) -> Column:
    """The valid spans of the four kinds, by start, then by kind as listed."""
    found = []
    for number, kind in enumerate(KINDS):
        pattern = PATTERNS[kind]
        spans = _places(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), number)
        found.append(F.when(text.rlike(HINTS[kind]), F.filter(spans, _test(kind))).otherwise(F.expr(f"cast(array() as {SPAN})")))
    return F.array_sort(F.concat(*found))


def spell(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in (*KINDS, *METHOD)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def outside(text: Column, base: Column) -> Column:
    """(start, piece) of what lies between base spans; spans that overlap are one."""
    row = "struct<start:bigint,end:bigint>"
    step = lambda at, s: F.struct(F.greatest(at, s["end"]).alias("at"), F.when(s["start"] > at, F.array(F.struct(at.alias("start"), s["start"].alias("end")))).otherwise(F.expr(f"cast(array() as array<{row}>)")).alias("out"))
    gaps = _let(_along(base, F.lit(0).cast("bigint"), step, row), lambda r: F.concat(r["out"], F.array(F.struct(r["at"].alias("start"), F.char_length(text).cast("bigint").alias("end")))))
    return _let(_chunks(text), lambda chunks: F.transform(gaps, lambda g: F.struct(g["start"].alias("start"), _piece(chunks, g["start"], g["end"]).alias("piece"))))


def _own_words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), NOT_WORD)), lambda w: w != "")


def disclosing(holders: DataFrame, words: DataFrame, spread: DataFrame, total: int, *, residual: float = 1.0, gain: float = 3.0, alpha: float = 0.01, min_others: int = 1) -> DataFrame:
    """(key, term, most): the terms of each text that disclose an entity of it, and the documents of the commonest such entity.

    holders: key, copies, base of texts that hold entities; words: key, copies, term; spread: term, df.
    """
    spots = holders.select("key", "copies", F.explode(F.array_distinct(F.transform("base", lambda b: F.lower(b["value"])))).alias("value"))
    # entities of the same documents are one: who holds them is told by 128 bits
    alike = spots.groupBy("value").agg(F.bit_xor(F.xxhash64("key")).alias("h"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("h2"), F.sum("copies").alias("held"), F.count("*").alias("texts"))
    shared = alike.filter(F.col("texts") > min_others)
    entities = spots.join(shared, "value").select("key", F.struct("h", "h2", "held").alias("entity")).distinct()
    near = words.groupBy("term").agg(F.sum("copies").alias("beside"), F.count("*").alias("texts")).filter(F.col("texts") > min_others)
    least = 2.0**-residual
    rare = near.join(spread, "term").filter(F.col("beside") >= least * F.col("df")).select("term", "df")
    pairs = materialize(words.join(rare, "term").join(entities, "key").select("key", "copies", "term", "df", "entity"), "pii-pairs")
    together = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("both"), F.count("*").alias("texts")).filter(F.col("texts") > min_others).drop("texts")
    share = F.col("entity.held") / F.lit(float(max(total, 1)))
    others, left = F.col("both") - F.col("copies"), F.lit(float(total)) - F.col("copies")
    known = (others + share) / (F.col("df") - F.col("copies") + 1)
    chance = others * (F.log((F.col("df") - F.col("copies")) * (F.col("entity.held") - F.col("copies")) / left / others) + 1)
    told = pairs.join(together, ["entity", "term"]).filter((others > 0) & (known >= least) & (known >= share * 2.0**gain) & (chance <= math.log(alpha)))
    found = materialize(told.groupBy("key", "term").agg(F.max("entity.held").alias("most")), "pii-disclosing")
    drop_table(pairs)
    return found


def word_places(pieces: DataFrame) -> DataFrame:
    """(key, copies, part, nth, term, start, end) of every word of the pieces (key, copies, start, piece); part is where its piece starts."""
    spans = _places(F.regexp_extract_all("piece", F.lit(WORD), F.lit(0)), F.split("piece", WORD, -1), 0)
    each = pieces.select("key", "copies", F.col("start").alias("part"), F.posexplode(spans).alias("nth", "x"))
    return each.select("key", "copies", "part", "nth", F.lower("x.value").alias("term"), (F.col("part") + F.col("x.start")).alias("start"), (F.col("part") + F.col("x.end")).alias("end"), F.col("x.value").alias("value"))


def wider_terms(placed: DataFrame, found: DataFrame, spread: DataFrame, total: int) -> DataFrame:
    """(term, wider) of the disclosing terms that have a wider one. placed: word_places() of the texts that hold them."""
    at = placed.join(found.select("key", "term"), ["key", "term"]).select("key", "copies", "part", "nth", "term")
    around = at.select("key", "copies", "part", "term", F.explode(F.array(*(F.col("nth") + d for d in range(-NEAR, NEAR + 1) if d))).alias("nth"))
    beside = around.join(placed.select("key", "part", "nth", F.col("term").alias("wider")), ["key", "part", "nth"]).filter("wider <> term").select("key", "term", "wider").distinct()
    counted = beside.groupBy("term", "wider").agg(F.count("*").alias("near"))
    own = found.groupBy("term").agg(F.count("*").alias("texts"), F.max("most").alias("most"))
    share = F.col("wide_df") / F.lit(float(max(total, 1)))
    fits = counted.join(own, "term").filter(2 * F.col("near") >= F.col("texts")).join(spread, "term").join(spread.select(F.col("term").alias("wider"), F.col("df").alias("wide_df")), "wider")
    fits = fits.filter((F.col("wide_df") >= 4 * F.col("df")) & (F.col("wide_df") > 2 * F.col("most")) & (share <= 0.1) & (F.col("near") >= 2 * share * F.col("texts")))
    return fits.groupBy("term").agg(F.min_by("wider", F.struct(-F.col("near"), "wide_df", "wider")).alias("wider"))


def _spanned(docs: DataFrame, carry: list[str], text_col: str, limits: dict) -> DataFrame:
    """k0, k1 .. (the carried columns), text, base, spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [f"k{i}" for i in range(len(carry))]
    source = docs.select(*(F.col(c).alias(n) for c, n in zip(carry, names)), text.alias("text"))
    spanned = source.withColumn("base", base_spans(F.col("text"))).withColumn("key", F.when(F.size("base") > 0, F.md5(F.encode("text", "utf-8"))))
    table = materialize(spanned, "pii-spans")
    columns, none = [*names, "text", "base", "spans"], F.expr(f"cast(array() as {SPAN})")
    holders = materialize(table.filter(F.col("key").isNotNull()).groupBy("key").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.count("*").alias("copies")), "pii-holders")
    once = holders.select("key", F.explode(F.array_distinct(F.transform("base", lambda b: F.lower(b["value"])))).alias("value")).groupBy("value").count()
    if once.filter(F.col("count") > limits.get("min_others", 1)).isEmpty():  # no entity has another text for a witness
        drop_table(holders)
        return table.withColumn("spans", F.col("base")).select(*columns)
    pieces = holders.select("key", "copies", F.explode(outside(F.col("text"), F.col("base"))).alias("x")).select("key", "copies", "x.start", "x.piece")
    words = materialize(pieces.select("key", "copies", F.explode(_own_words(F.col("piece"))).alias("term")).distinct(), "pii-words")
    others = table.filter(F.col("key").isNull()).select(F.explode(_own_words(F.col("text"))).alias("term"), F.lit(1).cast("bigint").alias("n"))
    spread = materialize(others.unionByName(words.select("term", F.col("copies").alias("n"))).groupBy("term").agg(F.sum("n").alias("df")), "pii-spread")
    total = table.count()
    told = disclosing(holders, words, spread, total, **limits)
    placed = materialize(word_places(pieces.join(told.select("key").distinct(), "key", "left_semi")), "pii-places")
    wider = wider_terms(placed, told, spread, total)
    span = F.struct("start", F.when(F.col("wider").isNull(), len(KINDS)).otherwise(len(KINDS) + 1).alias("kind_no"), "end", F.coalesce("wider", "value").alias("value"))
    spots = placed.join(told.select("key", "term"), ["key", "term"]).join(wider, "term", "left")
    found = materialize(spots.groupBy("key").agg(F.collect_list(span).alias("revealed")), "pii-found")  # the terms of one text
    for done in (holders, words, spread, told, placed):
        drop_table(done)
    spans = F.array_sort(F.concat("base", F.coalesce("revealed", none)))
    without = table.filter(F.col("key").isNull()).withColumn("spans", none)
    return table.filter(F.col("key").isNotNull()).join(found, "key", "left").withColumn("spans", spans).select(*columns).unionByName(without.select(*columns))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, base, spans: arrays of (start, kind_no, end, value); `limits` as disclosing() takes them."""
    return _spanned(docs, [id_col], text_col, limits).select(F.col("k0").alias("doc_id"), "base", "spans")


def sanitize(docs: DataFrame, *, text_col: str = "text", length_col: str | None = None, **limits) -> DataFrame:
    """The rows with all their columns, their texts redacted; length_col follows the new text."""
    carry = [c for c in docs.columns if c != text_col]
    found = _spanned(docs, carry, text_col, limits).withColumn("text", redact(F.col("text"), F.col("spans")))
    name = {c: F.col(f"k{i}") for i, c in enumerate(carry)} | {text_col: F.col("text")}
    if length_col in name:
        name[length_col] = F.char_length("text").cast(docs.schema[length_col].dataType)
    return found.select(*(name[c].alias(c) for c in docs.columns))


def redact(text: Column, spans: Column) -> Column:
    """The text with base spans and wide ones generalised, the ones to their kind, the others to their wider term, and
    terms removed; of overlapping spans the first counts."""
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS), F.lit("[REMOVED]"))
    said = lambda s: F.when(s["kind_no"] > len(KINDS), s["value"]).otherwise(F.get(kinds, s["kind_no"]))
    row = "struct<start:bigint,end:bigint,said:string>"
    kept = lambda at, s: F.array(F.struct(at.alias("start"), s["start"].alias("end"), said(s).alias("said")))
    step = lambda at, s: F.struct(F.greatest(at, F.when(s["start"] >= at, s["end"]).otherwise(at)).alias("at"), F.when(s["start"] < at, F.expr(f"cast(array() as array<{row}>)")).otherwise(kept(at, s)).alias("out"))
    walked = _along(spans, F.lit(0).cast("bigint"), step, row)
    joined = lambda chunks: _let(walked, lambda w: F.concat(F.array_join(F.transform(w["out"], lambda p: F.concat(_piece(chunks, p["start"], p["end"]), p["said"])), ""), _piece(chunks, w["at"], F.char_length(text).cast("bigint"))))
    return F.when(F.size(spans) == 0, text).otherwise(_let(_chunks(text), joined))


def counts(found: DataFrame) -> DataFrame:
    of = lambda k: F.size(F.filter("base", lambda s: s["kind_no"] == k)).cast("long")
    return found.select("doc_id", *(of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(spell(F.col("base")), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
