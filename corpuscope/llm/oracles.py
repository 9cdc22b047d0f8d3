"""DuckDB SQL that says what the operators' queries return, written from the definitions and not from the operators."""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), measured AS (
  SELECT *, length(role) + length(regexp_replace(role, '[^\\<\[]', '', 'g')) + length(text)
            + length(regexp_replace(text, '[^\\<\[]', '', 'g')) + 9 + CASE WHEN role = 'assistant' THEN 4 ELSE 7 END AS shown
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(shown)::BIGINT AS formatted_chars
FROM measured GROUP BY conv_id
"""

WINNOWING = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM item_windows
), doc_windows AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)
), hit AS (SELECT d.doc_id, d.i, d.size, item_id FROM doc_windows d JOIN item_windows USING (size, win)
), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

LINE_WINDOWS = r"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line, trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), used AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM lines WHERE bare <> ''
), windows AS (
  SELECT doc_id, n, i AS i0, lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2,
         bare || chr(10) || lead(bare, 1) OVER w || chr(10) || lead(bare, 2) OVER w AS win
  FROM used WINDOW w AS (PARTITION BY doc_id ORDER BY n)
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, n) AS nth FROM windows WHERE win IS NOT NULL) WHERE nth > 1
), covered AS (SELECT DISTINCT doc_id, unnest([i0, i1, i2]) AS i FROM later)
SELECT l.doc_id, count(*) AS n_lines, count(c.i) AS n_removed, count(*) FILTER (WHERE c.i IS NULL AND bare <> '') AS n_left,
       length(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL), '')) AS n_chars_left,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id
"""

_SPACE = r"[\x20\x09-\x0D]"
_LEAST = {"word_length": 1.0, "symbol_share": 0.02, "mark_share": 0.15, "upper_share": 0.08, "dup_line_share": 0.2, "repeat_share": 0.15}
_PER = {"word_length": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"), "mark_share": ("n_marks", "word_chars"),
        "upper_share": ("n_upper", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words")}
_GROWTH = "(1.02::DOUBLE / 0.98::DOUBLE)"
_MEASURES = " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS measure, {a}::DOUBLE / greatest({b}, 1) AS v FROM judged" for m, (a, b) in _PER.items())
_FENCE = f"""CASE WHEN b <= 0 THEN 0 ELSE 1e-6::DOUBLE * pow({_GROWTH}, b) * 2 / (1 + {_GROWTH}) END"""
_LEVEL = """{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {by} measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {by} measure) AS of
    FROM (SELECT {by} measure, b, sum(n) AS n FROM sketch GROUP BY ALL)),
  {name} AS (SELECT {by} measure, of, min(CASE WHEN upto >= ceil(of * 0.25::DOUBLE) THEN x END) AS q1, min(CASE WHEN upto >= ceil(of * 0.75::DOUBLE) THEN x END) AS q3
    FROM (SELECT *, {fence} AS x FROM {name}_r) GROUP BY ALL)"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
runs AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM runs WHERE times > 1) GROUP BY 1),
counted AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!-/:-@\[-`{{-~]', '', 'g')) AS n_marks,
  length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
m AS ({_MEASURES}),
sketch AS (SELECT lang, source, measure, CAST(ceil(ln(greatest(v, 1e-6::DOUBLE) / 1e-6::DOUBLE) / ln({_GROWTH})) AS INT) AS b, count(*) AS n FROM m WHERE NOT base_failed GROUP BY ALL),
{_LEVEL.format(name='fine', by='lang, source,', fence=_FENCE)}, {_LEVEL.format(name='coarse', by='lang,', fence=_FENCE)}, {_LEVEL.format(name='whole', by='', fence=_FENCE)},
fenced AS (SELECT m.*, coalesce(CASE WHEN f.of >= 40 THEN f.q1 END, CASE WHEN c.of >= 40 THEN c.q1 END, w.q1) AS q1,
  coalesce(CASE WHEN f.of >= 40 THEN f.q3 END, CASE WHEN c.of >= 40 THEN c.q3 END, w.q3) AS q3,
  CASE m.measure {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in _LEAST.items())} END AS least
  FROM m LEFT JOIN fine f ON f.measure = m.measure AND f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source
  LEFT JOIN coarse c ON c.measure = m.measure AND c.lang IS NOT DISTINCT FROM m.lang LEFT JOIN whole w ON w.measure = m.measure),
bad AS (SELECT doc_id, bool_or(coalesce(v < q1 - 3 * greatest(q3 - q1, least) OR v > q3 + 3 * greatest(q3 - q1, least), false)) AS beyond FROM fenced GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT beyond AS kept FROM judged JOIN bad USING (doc_id)
"""

_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
     "list_bool_and(list_transform(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST('0' || right(ltrim(p, '0'), 3) AS INT) <= 255))"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+",
     "length(dg) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(dg[length(dg) - i + 1] AS INT) "
     "ELSE CAST(dg[length(dg) - i + 1] AS INT) * 2 - CASE WHEN CAST(dg[length(dg) - i + 1] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(dg) BETWEEN 8 AND 15"),
)


def _spans(table: str, ident: str, text: str) -> str:
    """Rows (ident, kind number, start, stop, hit) of the valid base matches."""
    parts = []
    for number, (_, pattern, test) in enumerate(_KINDS):
        parts.append(f"""SELECT {ident}, {number} AS kind, stop - length(hit) AS start, stop, hit FROM (
          SELECT {ident}, hits[i] AS hit, regexp_replace(hits[i], '[^0-9]', '', 'g') AS dg,
            (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(hits[1:i], lambda h: length(h))))::BIGINT AS stop
          FROM (SELECT {ident}, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
            SELECT {ident}, regexp_extract_all({text}, '{pattern}') AS hits, regexp_split_to_array({text}, '{pattern}') AS gaps FROM {table}))) WHERE {test}""")
    return " UNION ALL ".join(parts)


_BLANKED = "line"
for _name in (0, 3, 2, 1):
    _BLANKED = f"regexp_replace({_BLANKED}, '{_KINDS[_name][1]}', ' ', 'g')"
_TERMS = "list_distinct(list_transform(regexp_extract_all({c}, '\\p{{L}}+'), lambda x: lower(x)))"

DISCLOSURE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_spans('d', 'doc_id', 't')}),
lines AS (SELECT doc_id * 1000000 + i AS line_id, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM d))),
found AS ({_spans('lines', 'line_id', 'line')}),
pairs AS (SELECT f.kind || ':' || lower(hit) AS entity, substr(line, greatest(start - 30, 0)::BIGINT + 1, (stop - greatest(start - 30, 0) + 30)::BIGINT) AS around, {_TERMS.format(c=_BLANKED)} AS terms
  FROM found f JOIN lines USING (line_id)),
entities AS (SELECT entity, count(*) AS w FROM pairs GROUP BY 1 HAVING count(*) >= 3),
met AS (SELECT entity, w, around, unnest(terms) AS term FROM pairs JOIN entities USING (entity)),
strong AS (SELECT entity, term, w, count(*) AS both_n FROM met GROUP BY ALL HAVING count(DISTINCT around) >= 3),
own AS (SELECT term, count(*) AS own FROM (SELECT unnest({_TERMS.format(c=_BLANKED)}) AS term FROM lines) WHERE term IN (SELECT term FROM strong) GROUP BY 1),
total AS (SELECT count(*)::DOUBLE AS n FROM lines),
told AS (SELECT term, both_n, own, w, n, log2(both_n * n / (own * w)) AS bits FROM strong JOIN own USING (term), total),
flagged AS (SELECT DISTINCT term FROM told WHERE both_n >= 0.5::DOUBLE * own AND bits >= 8::DOUBLE / 9 * log2(n / w) AND bits * both_n >= least(24, log2(n))),
said AS (SELECT doc_id, ws, gs, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '\p{{L}}+') AS ws, regexp_split_to_array(t, '\p{{L}}+') AS gs FROM d
  WHERE len(list_intersect({_TERMS.format(c='t')}, (SELECT coalesce(list(term), []) FROM flagged))) > 0)),
spoken AS (SELECT doc_id, 4 AS kind, stop - length(hit) AS start, stop, hit FROM (SELECT doc_id, ws[i] AS hit,
  (list_sum(list_transform(gs[1:i], lambda g: length(g))) + list_sum(list_transform(ws[1:i], lambda h: length(h))))::BIGINT AS stop FROM said WHERE lower(ws[i]) IN (SELECT term FROM flagged))),
every AS (SELECT doc_id, kind, start, stop, ['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start || ':' || stop AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM spoken))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
  sha256(coalesce(string_agg(s, ',' ORDER BY kind, start) FILTER (kind < 4), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY kind, start), '') AS spans
FROM d LEFT JOIN every e ON e.doc_id = d.doc_id GROUP BY d.doc_id
"""

_BASE32 = " || ".join(f"lpad(to_base(('0x' || substr(sha1(p), {1 + 5 * i}, 5))::BIGINT, 32), 4, '0')" for i in range(8))

#: SHA-1 in base 32 by fives of hexadecimal digits; equal payloads refer to their largest page
WARC = f"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
coded AS (SELECT page_id, octet_length(encode(p)) AS payload_bytes,
                 translate({_BASE32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
                 max(page_id) OVER (PARTITION BY p) AS latest FROM rows)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM latest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM latest THEN latest END AS refers_to
FROM coded"""
