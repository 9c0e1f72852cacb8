r"""DuckDB SQL that must give the rows of those corpus queries that SQL can express.

Words are runs of letters and digits of the lower-cased text, as words.scan()
takes them.
"""

from __future__ import annotations

from . import chat

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-/:-@\[-`{-\x7f]+')"

LEAKS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
parts AS (SELECT item_id, 'whole' AS part, w FROM i UNION ALL SELECT item_id, 'question', w[1:CAST(ceil(2 * len(w) / 3.0) AS BIGINT)] FROM i UNION ALL SELECT item_id, 'answer', w[CAST(ceil(2 * len(w) / 3.0) AS BIGINT) + 1:] FROM i),
sized AS (SELECT item_id, part, w, greatest(1, least(5, len(w))) AS k FROM parts),
shingles AS (SELECT DISTINCT item_id, part, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS s FROM sized),
held AS (SELECT DISTINCT doc_id, 5 AS k, unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' '))) AS s FROM d),
hits AS (SELECT h.doc_id, s.item_id, s.part, count(*) AS n FROM shingles s JOIN held h ON h.s = s.s AND h.k = s.k GROUP BY ALL),
total AS (SELECT item_id, part, count(*) AS n FROM shingles GROUP BY ALL),
share AS (SELECT doc_id, item_id, max(CASE WHEN part = 'whole' THEN hits.n / total.n END) AS overlap, max(CASE WHEN part = 'question' THEN hits.n / total.n END) AS question_overlap, max(CASE WHEN part = 'answer' THEN hits.n / total.n END) AS answer_overlap FROM hits JOIN total USING (item_id, part) GROUP BY doc_id, item_id),
leaks AS (SELECT * FROM share WHERE overlap >= 0.8 AND question_overlap >= 0.5 AND answer_overlap >= 0.5),
t AS (SELECT item_id, len(w) AS n, unnest(w) AS term FROM i),
corpus AS (SELECT count(*) AS items, sum(len(w)) / count(*) AS mean FROM i),
df AS (SELECT term, count(DISTINCT item_id) AS df FROM t GROUP BY term),
raw AS (SELECT item_id, n, term, ln(1 + (items - df + 0.5) / (df + 0.5)) * count(*) * 2.2::DOUBLE / (count(*) + 1.2::DOUBLE * (0.25 + 0.75 * n / mean)) AS impact FROM t JOIN df USING (term), corpus GROUP BY item_id, n, term, df, items, mean),
impacts AS (SELECT item_id, term, greatest(8, CAST(2 ** ceil(log2(n)) AS BIGINT)) AS step, impact / sum(impact) OVER (PARTITION BY item_id) AS impact FROM raw),
said AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS place FROM d WHERE doc_id IN (SELECT doc_id FROM leaks)),
met AS (SELECT DISTINCT s.doc_id, l.item_id, m.term, m.impact, unnest([CAST(floor(place / step) AS BIGINT), greatest(0, CAST(floor(place / step) AS BIGINT) - 1)]) AS passage FROM leaks l JOIN said s USING (doc_id) JOIN impacts m ON m.item_id = l.item_id AND m.term = s.term),
best AS (SELECT doc_id, item_id, max(score) AS score FROM (SELECT doc_id, item_id, passage, sum(impact) AS score FROM met GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, item_id, round(score, 6) AS score, overlap, question_overlap, answer_overlap FROM leaks JOIN best USING (doc_id, item_id)"""

CLASSES = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' ')))) END AS g FROM d),
sets AS (SELECT g, min(doc_id) AS own, count(*) AS n_copies FROM s WHERE len(g) > 0 GROUP BY g),
tokens AS (SELECT own, len(g) AS n, unnest(g) AS t FROM sets),
pairs AS (SELECT a.own AS x, b.own AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.own < b.own GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE c >= 0.8 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT own AS x, own AS y FROM sets UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
class AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n_links FROM both_ways GROUP BY x)
SELECT s.doc_id, coalesce(class.class_id, s.doc_id) AS class_id, coalesce(degree.n_links, 0) AS n_links, coalesce(sets.n_copies, 1) AS n_copies
FROM s LEFT JOIN sets ON sets.g = s.g LEFT JOIN class ON class.x = sets.own LEFT JOIN degree ON degree.x = sets.own"""


LOSSES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, {_WORDS} AS w FROM documents),
t AS (SELECT r, good, len(w) AS n, unnest(w) AS w, unnest(list_prepend('', w[:-2])) AS v FROM d WHERE len(w) > 0),
singles AS (SELECT w, count(*) AS n, count(*) FILTER (good) AS g FROM t GROUP BY w),
doubles AS (SELECT v, w, count(*) AS n, count(*) FILTER (good) AS g FROM t GROUP BY v, w),
befores AS (SELECT w AS v, n, g FROM singles UNION ALL SELECT '', count(*), count(*) FILTER (good) FROM d WHERE len(w) > 0),
own AS (SELECT r, w, count(*) AS n FROM t GROUP BY r, w),
own_double AS (SELECT r, v, w, count(*) AS n FROM t GROUP BY r, v, w),
own_before AS (SELECT r, w AS v, n FROM own UNION ALL SELECT r, '', 1 FROM d),
whole AS (SELECT sum(n) AS n, sum(g) AS g, count(*) AS words FROM singles),
p AS (SELECT o.r, any_value(t.n) AS size, o.n AS times, any_value(t.good) AS good, any_value(s.n - a.n) AS b1, any_value(s.g - CASE WHEN t.good THEN a.n ELSE 0 END) AS t1, any_value(x.n - o.n) AS b2, any_value(x.g - CASE WHEN t.good THEN o.n ELSE 0 END) AS t2, any_value(y.n - c.n) AS b0, any_value(y.g - CASE WHEN t.good THEN c.n ELSE 0 END) AS t0
  FROM own_double o JOIN t ON t.r = o.r AND t.v = o.v AND t.w = o.w JOIN singles s ON s.w = o.w JOIN own a ON a.r = o.r AND a.w = o.w JOIN doubles x ON x.v = o.v AND x.w = o.w JOIN befores y ON y.v = o.v JOIN own_before c ON c.r = o.r AND c.v = o.v GROUP BY o.r, o.v, o.w, o.n),
l AS (SELECT r, sum(-times * ln((t2 + 50.0::DOUBLE * (t1 + 1) / (whole.g - CASE WHEN good THEN size ELSE 0 END + words + 1)) / (t0 + 50.0::DOUBLE))) / any_value(size) AS target_loss, sum(-times * ln((b2 + 50.0::DOUBLE * (b1 + 1) / (whole.n - size + words + 1)) / (b0 + 50.0::DOUBLE))) / any_value(size) AS background_loss FROM p, whole GROUP BY r)
SELECT doc_id, len(w) AS n_tokens, round(coalesce(target_loss, 0), 6) AS target_loss, round(coalesce(background_loss, 0), 6) AS background_loss, round(coalesce(target_loss - background_loss, 0), 6) AS difference FROM d LEFT JOIN l USING (r)"""


_CUT = "list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)"
_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST({_DIGITS}[length({_DIGITS}) - k + 1] AS INT) WHEN CAST({_DIGITS}[length({_DIGITS}) - k + 1] AS INT) > 4 THEN 2 * CAST({_DIGITS}[length({_DIGITS}) - k + 1] AS INT) - 9 ELSE 2 * CAST({_DIGITS}[length({_DIGITS}) - k + 1] AS INT) END)) % 10 = 0"
_HITS = " UNION ALL ".join(f"SELECT x, {n} AS kind_no, '{k}' AS kind, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS pieces FROM t" for n, k, p in ((0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), (1, "ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), (2, "card", r"[0-9](?:[ -]?[0-9])+"), (3, "phone", r"\+[0-9][ ().0-9-]+[0-9]")))
_SPELT = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no)"
_PIECE_WORDS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"

DISCLOSURE = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS MATERIALIZED (SELECT row_number() OVER () AS x, text, count(*) AS copies FROM d GROUP BY text),
every AS (SELECT x, kind_no, kind, value, start, start + length(value) AS stop FROM (SELECT x, kind_no, kind, hits[i] AS value, CAST({_CUT} AS BIGINT) AS start FROM ({_HITS}) AS m, unnest(generate_series(1, len(hits))) AS u(i))),
base AS MATERIALIZED (SELECT * FROM every WHERE kind = 'email' OR kind = 'ip' AND len(list_filter(string_split(value, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 999) > 255)) = 0 OR kind = 'card' AND length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN} OR kind = 'phone' AND length({_DIGITS}) BETWEEN 10 AND 15),
edges AS (SELECT x, start, coalesce(max(stop) OVER (PARTITION BY x ORDER BY start, kind_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM base),
gaps AS (SELECT x, upto AS a, start AS b FROM edges WHERE start > upto UNION ALL SELECT x, max(stop), any_value(length(text)) FROM base JOIN t USING (x) GROUP BY x),
pieces AS MATERIALIZED (SELECT x, copies, a, text[a + 1:b] AS piece FROM gaps JOIN t USING (x)),
words AS MATERIALIZED (SELECT DISTINCT x, copies, unnest({_PIECE_WORDS.format('piece')}) AS term FROM pieces),
spread AS MATERIALIZED (SELECT term, CAST(sum(n) AS BIGINT) AS df FROM (SELECT term, copies AS n FROM words UNION ALL SELECT unnest(list_distinct({_PIECE_WORDS.format('text')})), copies FROM t WHERE x NOT IN (SELECT x FROM base)) GROUP BY term),
held AS (SELECT DISTINCT b.x, copies, lower(value) AS entity FROM base b JOIN t USING (x)),
holders AS (SELECT entity, sum(copies) AS n FROM held GROUP BY entity HAVING count(*) > 1),
pairs AS MATERIALIZED (SELECT w.x, w.copies, term, entity, n AS held FROM words w JOIN held USING (x) JOIN holders USING (entity)),
together AS (SELECT entity, term, sum(copies) AS n, count(*) AS texts FROM pairs GROUP BY ALL),
known AS (SELECT x, term, held, p.copies AS c, g.n - p.copies AS k, df, held / total AS share, ((g.n - p.copies) + held / total) / (df - p.copies + 1) AS p, total FROM pairs p JOIN together g USING (entity, term) JOIN spread USING (term), (SELECT count(*)::DOUBLE AS total FROM d) WHERE g.texts > 1 AND g.n > p.copies),
told AS MATERIALIZED (SELECT x, term, max(held) AS most FROM known WHERE p >= 0.5 AND p >= share * 8 AND k * (ln((df - c) * (held - c)::DOUBLE / (total - c) / k) + 1) <= ln(0.01::DOUBLE) GROUP BY x, term),
placed AS MATERIALIZED (SELECT x, a, i AS nth, lower(hits[i]) AS term, a + CAST({_CUT} AS BIGINT) AS start, a + CAST({_CUT} AS BIGINT) + length(hits[i]) AS stop FROM (SELECT x, a, regexp_extract_all(piece, '[\p{{L}}\p{{N}}]+') AS hits, string_split_regex(piece, '[\p{{L}}\p{{N}}]+') AS pieces FROM pieces WHERE x IN (SELECT x FROM told)) AS m, unnest(generate_series(1, len(hits))) AS u(i)),
near AS (SELECT term, wider, count(*) AS near FROM (SELECT DISTINCT p.x, p.term, h.term AS wider FROM placed p JOIN told USING (x, term) JOIN placed h ON h.x = p.x AND h.a = p.a AND abs(h.nth - p.nth) BETWEEN 1 AND 5 AND h.term <> p.term) GROUP BY ALL),
own AS (SELECT term, count(*) AS texts, max(most) AS most FROM told GROUP BY term),
wider AS (SELECT n.term, arg_min(wider, {{'near': -near, 'df': w.df, 'wider': wider}}) AS wider FROM near n JOIN own USING (term) JOIN spread s ON s.term = n.term JOIN spread w ON w.term = n.wider, (SELECT count(*)::DOUBLE AS total FROM d)
  WHERE 2 * near >= texts AND w.df >= 4 * s.df AND w.df > 2 * most AND w.df / total <= 0.1::DOUBLE AND near >= 2 * (w.df / total) * texts GROUP BY n.term),
spans AS (SELECT x, kind_no, kind, start, stop FROM base UNION ALL SELECT p.x, CASE WHEN wider IS NULL THEN 4 ELSE 5 END, CASE WHEN wider IS NULL THEN 'term' ELSE 'wide' END, start, stop FROM placed p JOIN told USING (x, term) LEFT JOIN wider w ON w.term = p.term)
SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce({_SPELT} FILTER (kind_no < 4), '')) AS base_sha256, coalesce({_SPELT}, '') AS spans, count(kind) AS n_spans FROM d JOIN t USING (text) LEFT JOIN spans USING (x) GROUP BY r, doc_id"""


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in text)


_CONTROL = "|".join(map(_quoted, chat.CONTROL))
_ESCAPED = "(length({0}) + length({0}) - length(replace({0}, '\\', '')) + len(regexp_extract_all({0}, '" + _CONTROL + "')))"
_MARKS = len(chat.START) + len(chat.SEP) + len(chat.END)

CHATS = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_ESCAPED.format('role')} + {_ESCAPED.format('text')} + {_MARKS}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""


_RESAMPLED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BYTE = "(instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1"
_BITS = "c"
for _ in range(8):  # a byte's eight steps of the division by the reversed polynomial
    _BITS = f"list_transform([{_BITS}], lambda c: xor(c >> 1, 3988292384 * (c & 1)))[1]"
_BITS = _BITS.replace("[c]", "[xor(crc, b)]", 1)

DRAWN = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_RESAMPLED} AS w FROM documents),
own AS MATERIALIZED (SELECT r, unnest(w) AS word FROM d), aims AS MATERIALIZED (SELECT unnest({_RESAMPLED}) AS word FROM benchmark),
spelt AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM own UNION SELECT word FROM aims)),
coded AS (SELECT word, list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: CAST({_BYTE} AS BIGINT))) AS bytes FROM spelt),
bucket AS MATERIALIZED (SELECT word, xor(list_reduce(bytes, lambda crc, b: {_BITS}), 4294967295) % 10000 AS bucket FROM coded),
s AS (SELECT bucket, count(*) AS n FROM own JOIN bucket USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM aims JOIN bucket USING (word) GROUP BY bucket),
whole AS (SELECT (SELECT count(*) FROM own)::DOUBLE AS s, (SELECT count(*) FROM aims)::DOUBLE AS t),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (whole.s + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (whole.t + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), whole),
weights AS (SELECT r, sum(gain) AS total, count(*) AS n FROM own JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY r),
weighed AS (SELECT doc_id, len(w) AS n_features, CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight FROM d LEFT JOIN weights USING (r)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank FROM placed"""


def _round(k: int) -> str:
    """Assignment to codebook k - 1, as an{k}, and codebook k from it, as bn{k}."""
    return f"""an{k} AS MATERIALIZED (SELECT r, p, x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS best FROM parts JOIN bn{k - 1} USING (p) GROUP BY r, p, x),
mn{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM an{k}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL) GROUP BY p, e),
bn{k} AS MATERIALIZED (SELECT p, e, coalesce(mn{k}.c, bn{k - 1}.c) AS c FROM bn{k - 1} LEFT JOIN mn{k} USING (p, e)),"""


CODES = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM kept, unnest(range(0, 8)) AS u(p)),
bn0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 16),
{chr(10).join(map(_round, range(1, 7)))}
last AS (SELECT r, p, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS best FROM parts JOIN bn6 USING (p) GROUP BY r, p),
codes AS (SELECT r, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM last GROUP BY r),
spelt AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM bn6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN codes USING (r), spelt"""
