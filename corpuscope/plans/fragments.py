"""SQL fragments that several oracle texts share."""

from __future__ import annotations

TOKENS = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 2)"


def tokens(column: str) -> str:
    return TOKENS.format(c=column)


UP = """up AS (SELECT tag_id, tag_id AS ancestor, 0 AS depth FROM org_tags UNION ALL
    SELECT up.tag_id, t.parent_tag, up.depth + 1 FROM up JOIN org_tags t ON t.tag_id = up.ancestor
    WHERE t.parent_tag IS NOT NULL)"""

EFFECTIVE = UP + """, eff AS (SELECT user_id, coalesce(up.ancestor, o.tag_id) AS tag FROM
    (SELECT user_id, unnest(string_split(org_tags, ',')) AS tag_id FROM users WHERE org_tags <> '') o
    LEFT JOIN up ON up.tag_id = o.tag_id UNION SELECT user_id, 'DEFAULT' FROM users)"""


def bm25(queries: str, docs: str, *, acl: bool, prefix: str = "bm") -> str:
    """Common table expressions ending in ``{prefix}_scores`` (query_id, doc_id, score, matched, n_terms)."""
    visible = (f"""WHERE p.owner_id = q.user_id OR p.is_public
        OR (q.user_id, p.org_tag) IN (SELECT (user_id, tag) FROM eff)""") if acl else ""
    extra_q = ", user_id" if acl else ""
    extra_d = ", owner_id, org_tag, is_public" if acl else ""
    return f"""{prefix}_q AS (SELECT query_id{extra_q}, len(ts) AS n_terms, unnest(ts) AS term FROM
        (SELECT *, list_distinct({tokens('text')}) AS ts FROM {queries})),
    {prefix}_t AS (SELECT doc_id{extra_d}, len(ts) AS dl, unnest(ts) AS term FROM
        (SELECT *, {tokens('text')} AS ts FROM {docs})),
    {prefix}_stat AS (SELECT count(*) AS n, avg(len({tokens('text')})) AS avgdl FROM {docs}),
    {prefix}_p AS (SELECT doc_id{extra_d}, dl, term, count(*) AS tf FROM {prefix}_t
        WHERE term IN (SELECT term FROM {prefix}_q) GROUP BY ALL),
    {prefix}_df AS (SELECT term, count(*) AS df FROM {prefix}_p GROUP BY term),
    {prefix}_scores AS (SELECT q.query_id, p.doc_id, max(q.n_terms) AS n_terms, count(*) AS matched,
        round(sum(ln(1 + (s.n - d.df + CAST(0.5 AS DOUBLE)) / (d.df + CAST(0.5 AS DOUBLE))) * p.tf
          / (p.tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * p.dl / s.avgdl))), 9) AS score
        FROM {prefix}_p p JOIN {prefix}_q q USING (term) JOIN {prefix}_df d USING (term), {prefix}_stat s
        {visible} GROUP BY q.query_id, p.doc_id)"""


def topk(source: str, k: int, score: str = "score", ident: str = "doc_id", where: str = "") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, {ident}) AS rank
        FROM {source} {where}) ranked WHERE rank <= {k}"""


def dense(queries: str, vectors: str, *, acl: bool) -> str:
    """SELECT of every visible (query_id, doc_id, score)."""
    visible = ("""WHERE v.owner_id = q.user_id OR v.is_public
        OR (q.user_id, v.org_tag) IN (SELECT (user_id, tag) FROM eff)""") if acl else ""
    return f"""SELECT q.query_id, v.doc_id, round((1 + list_cosine_similarity(CAST(q.embedding AS DOUBLE[]),
        CAST(v.embedding AS DOUBLE[]))) / 2, 9) AS score FROM {queries} q, {vectors} v {visible}"""


# Folds of the chunker as list_reduce over states {done, cur}.
_NONE = "{'done': []::VARCHAR[], 'cur': ''}"


def trimmed(value: str) -> str:
    return f"regexp_replace({value}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"


def _closed(state: str, trim: bool) -> str:
    last = trimmed(f"{state}.cur") if trim else f"{state}.cur"
    return f"CASE WHEN {state}.cur <> '' THEN list_append({state}.done, {last}) ELSE {state}.done END"


def _fold(items: str, name: str, step: str, trim: bool) -> str:
    """Pieces that the fold of ``items`` leaves; ``step`` names the state ``a{name}`` and the item ``x{name}.cur``."""
    states = f"list_concat([{_NONE}], list_transform({items}, lambda u{name}: {{'done': []::VARCHAR[], 'cur': u{name}}}))"
    return f"list_transform([list_reduce({states}, lambda a{name}, x{name}: {step})], lambda s{name}: {_closed('s' + name, trim)})[1]"


def split_sentence(value: str, size: int) -> str:
    step = (f"CASE WHEN a1.cur <> '' AND length(a1.cur) + length(x1.cur) > {size} THEN {{'done': list_append(a1.done, a1.cur), 'cur': x1.cur}} "
            "ELSE {'done': a1.done, 'cur': a1.cur || x1.cur} END")
    return _fold(f"regexp_extract_all({value}, '(?s)[A-Za-z0-9_]+|\\s+|.')", "1", step, False)


def split_paragraph(value: str, size: int) -> str:
    marked = f"regexp_replace(regexp_replace({value}, '([。！？；])', '\\1' || chr(1), 'g'), '([.!?;])\\s+', '\\1' || chr(1), 'g')"
    step = (f"CASE WHEN length(a2.cur) + length(x2.cur) <= {size} THEN {{'done': a2.done, 'cur': a2.cur || x2.cur}} "
            f"WHEN length(x2.cur) > {size} THEN {{'done': list_concat({_closed('a2', True)}, {split_sentence('x2.cur', size)}), 'cur': ''}} "
            f"ELSE {{'done': {_closed('a2', True)}, 'cur': x2.cur}} END")
    return _fold(f"string_split({marked}, chr(1))", "2", step, True)


def pack_paragraphs(value: str, size: int) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array({value}, '\\n\\n+'), lambda p: {trimmed('p')}), lambda p: p <> '')"
    step = (f"CASE WHEN length(x3.cur) > {size} THEN {{'done': list_concat({_closed('a3', True)}, {split_paragraph('x3.cur', size)}), 'cur': ''}} "
            f"WHEN length(a3.cur) + length(x3.cur) + CASE WHEN a3.cur = '' THEN 0 ELSE 2 END <= {size} "
            "THEN {'done': a3.done, 'cur': CASE WHEN a3.cur = '' THEN x3.cur ELSE a3.cur || chr(10) || chr(10) || x3.cur END} "
            f"ELSE {{'done': {_closed('a3', True)}, 'cur': x3.cur}} END")
    return _fold(parts, "3", step, True)


def merge_short(chunks: str, least: int, most: int) -> str:
    clean = f"list_filter(list_transform({chunks}, lambda p: {trimmed('p')}), lambda p: p <> '')"
    step = (f"CASE WHEN a4.cur <> '' AND (length(x4.cur) < {least} OR length(a4.cur) < {least}) AND length(a4.cur) + 2 + length(x4.cur) <= {most} "
            f"THEN {{'done': a4.done, 'cur': a4.cur || chr(10) || chr(10) || x4.cur}} ELSE {{'done': {_closed('a4', False)}, 'cur': x4.cur}} END")
    return _fold(clean, "4", step, False)


def _tail_fold(items: str, name: str, step: str) -> str:
    states = f"list_concat([{{'out': '', 'stop': false}}], list_transform(list_reverse({items}), lambda u{name}: {{'out': u{name}, 'stop': false}}))"
    return f"list_reduce({states}, lambda a{name}, x{name}: {step}).out"


def tail_on_token(value: str, size: int, name: str) -> str:
    clean = trimmed(value)
    step = (f"CASE WHEN a{name}.stop OR length(a{name}.out) + length(x{name}.out) > {size} THEN {{'out': a{name}.out, 'stop': true}} "
            f"ELSE {{'out': x{name}.out || a{name}.out, 'stop': false}} END")
    found = _tail_fold(f"regexp_extract_all({clean}, '(?s)[A-Za-z0-9_]+|\\s+|.')", name, step)
    return f"CASE WHEN length({clean}) <= {size} THEN {clean} ELSE coalesce(nullif({found}, ''), right({clean}, {size})) END"


def overlap_text(value: str, size: int) -> str:
    found = f"list_filter(list_transform(regexp_extract_all({value}, '[^。！？；.!?;]+[。！？；.!?;]?'), lambda p: {trimmed('p')}), lambda p: p <> '')"
    units = f"CASE WHEN len({found}) > 0 THEN {found} ELSE [{trimmed(value)}] END"
    step = (f"CASE WHEN a6.stop THEN a6 WHEN length(x6.out) > {size} AND a6.out = '' THEN {{'out': {tail_on_token('x6.out', size, '5')}, 'stop': true}} "
            f"WHEN length(a6.out) + length(x6.out) > {size} THEN {{'out': a6.out, 'stop': true}} ELSE {{'out': x6.out || a6.out, 'stop': false}} END")
    kept = _tail_fold(units, "6", step)
    return f"list_transform([{kept}], lambda k: CASE WHEN k = '' THEN {tail_on_token(value, size, '7')} ELSE {trimmed('k')} END)[1]"
