"""Multi-query recall, evidence, refinement, context and memory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscope.functions import rules as R
from corpuscope.functions import text as X
from corpuscope.operators import agentic, context, evidence, fuse, ingest, memory
from corpuscope.operators.postings import lexical_topk, open_postings, write_postings
from corpuscope.plans import fragments as sql
from corpuscope.plans.ingestion import _ANCHOR, _SQUEEZE, PARENTS, numbered
from corpuscope.plans.lists import ACTIVE, _NOW
from corpuscope.plans.planning import plan_sql, variants_sql
from corpuscope.plans.registry import query
from corpuscope.plans.retrieval import asked, asked_both, index_of, rerank_sql, stored_once

QPLAN = plan_sql("SELECT query_id, text FROM questions")
QVARIANTS = variants_sql(QPLAN)
PHRASES = evidence.ConflictPhrases(question=("th", "le"), support=("tion",), reject=("with", "mit"), against=("heit",))


def plans(t):
    """Planned questions with aspects and user; embeddings where the question has one."""
    return evidence.required_aspects(R.query_plans(asked_both(t)))


RECALL = f"""WITH RECURSIVE {sql.EFFECTIVE}, {QVARIANTS}, keyed AS (SELECT v.query_id * 4 + v.variant_no - 1 AS query_id, v.query_id AS qid, variant_no, variant_type, variant AS text, q.user_id
      FROM variants v JOIN questions q ON q.query_id = v.query_id), {sql.bm25('keyed', 'docs', acl=True)},
    kv AS (SELECT k.query_id, k.user_id, e.embedding FROM keyed k JOIN question_vectors e ON e.query_id = k.qid), dn AS ({sql.dense('kv', 'vectors', acl=True)}),
    lists AS (SELECT k.qid AS query_id, k.variant_no, k.variant_type AS query_type, x.doc_id, x.rank, x.channel FROM (
      SELECT query_id, doc_id, rank, 'BM25' AS channel FROM ({sql.topk('bm_scores', 30, where='WHERE score >= 0.3')}) a
      UNION ALL SELECT query_id, doc_id, rank, 'VECTOR' FROM ({sql.topk('dn', 30)}) b) x JOIN keyed k ON k.query_id = x.query_id)"""


def variants_with_user(t):
    v = R.query_variants(R.query_plans(asked(t))).select("query_id", "variant_no", "variant_type", F.col("variant").alias("text"), "user_id", "user_tags")
    return v.join(t.question_vectors.select("query_id", "embedding"), "query_id", "left")


@query("f09_multi_query_recall", f"{RECALL} SELECT query_id, variant_no, query_type, doc_id, rank, channel FROM lists")
def _recall(t):
    return fuse.recall_round(variants_with_user(t), index_of(t), t.vectors, 8).select("query_id", "variant_no", "query_type", "doc_id", "rank", "channel")


@query("f09_degraded_channels", f"""{RECALL}, gone AS (SELECT v.query_id, v.variant_no, c.channel FROM variants v, (SELECT unnest(['BM25', 'VECTOR']) AS channel) c WHERE c.channel = 'BM25' OR v.query_id % 4 <> 0)
    SELECT v.query_id, v.variant_no, c.channel FROM variants v, (SELECT unnest(['BM25', 'VECTOR']) AS channel) c
    WHERE NOT EXISTS (SELECT 1 FROM lists l WHERE l.query_id = v.query_id AND l.variant_no = v.variant_no AND l.channel = c.channel AND (l.channel = 'BM25' OR v.query_id % 4 <> 0))""")
def _degraded(t):
    # the vector channel of every fourth question is taken to be down
    variants = variants_with_user(t).withColumn("embedding", F.when(F.col("query_id") % 4 != 0, F.col("embedding")))
    return fuse.degraded_channels(variants, fuse.recall_round(variants, index_of(t), t.vectors, 8))


@query("f12_parent_assembly", f"""WITH RECURSIVE {sql.EFFECTIVE}, {PARENTS}, ch AS (SELECT n.doc_id * 100000 + chunk_id AS doc_id, n.doc_id AS file_id, n.doc_id * 100000 + chunk_id - in_page % 3 AS parent_id, n.text,
      d.owner_id, d.org_tag, d.is_public FROM num n JOIN docs d ON d.doc_id = n.doc_id),
    {sql.bm25('questions', 'ch', acl=True)}, hits AS ({sql.topk('bm_scores', 20)}),
    k AS (SELECT h.query_id, h.doc_id AS child_id, h.rank, c.file_id, c.parent_id FROM hits h JOIN ch c ON c.doc_id = h.doc_id),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank, child_id) AS one FROM k),
    f AS (SELECT query_id, child_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, child_id) AS rank FROM b WHERE one = 1),
    n AS (SELECT query_id, count(*) AS n_candidates, count(*) - count(DISTINCT parent_id) AS n_dropped FROM k GROUP BY 1)
    SELECT f.query_id, f.child_id, f.parent_id, f.rank, md5(p.parent_text) AS text_md5, n.n_candidates, n.n_dropped FROM f JOIN n USING (query_id)
    JOIN par p ON p.doc_id * 100000 + p.parent_index = f.parent_id WHERE f.rank <= 8""")
def _parents(t):
    rows = numbered(t)
    child = rows.select((F.col("doc_id") * 100000 + F.col("chunk_id")).alias("child_id"), "doc_id",
                        (F.col("doc_id") * 100000 + F.col("chunk_id") - F.col("in_page") % 3).alias("parent_id"), "text")
    parents = ingest.parent_chunks(rows).select((F.col("doc_id") * 100000 + F.col("parent_index")).alias("parent_id"), "parent_text")
    # a passage is seen by those who see its document
    access = t.docs.select("doc_id", "owner_id", "org_tag", "is_public")
    passages = child.join(access, "doc_id").drop("doc_id").withColumnRenamed("child_id", "doc_id")
    index = stored_once(t, "passage-postings", lambda path: write_postings(passages, path), lambda path: open_postings(t.spark, path))
    hits = lexical_topk(asked(t), index, 20, min_score=0.0).withColumnRenamed("doc_id", "child_id")
    out = fuse.assemble_parents(hits.drop("score"), child, parents, 8)
    return out.select("query_id", "child_id", "parent_id", "rank", F.md5("text").alias("text_md5"), "n_candidates", "n_dropped")


def _distinct(expr):
    return f"list_filter({expr}, lambda e, i: list_position({expr}, e) = i)"


ASPECTS = f"""{QVARIANTS}, dec AS (SELECT query_id, list(variant ORDER BY variant_no) AS parts FROM variants WHERE variant_type = 'DECOMPOSED' GROUP BY 1),
    asp AS (SELECT p.query_id, p.text, p.intent, p.complexity, CASE WHEN d.parts IS NOT NULL THEN {_distinct('d.parts')} WHEN p.intent IN ('COMPARE', 'MULTI_HOP') AND len(p.entities) > 0
      THEN p.entities[1:6] ELSE [p.text] END AS aspects, p.entities FROM plan p LEFT JOIN dec d ON d.query_id = p.query_id)"""


@query("f13_required_aspects", f"WITH {ASPECTS} SELECT query_id, unnest(range(0, len(aspects))) AS aspect_no, unnest(aspects) AS aspect FROM asp")
def _aspects(t):
    rows = evidence.required_aspects(R.query_plans(t.questions))
    return rows.select("query_id", F.posexplode("aspects").alias("aspect_no", "aspect"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _terms(c):
    return f"list_distinct(list_filter({sql.tokens(c)}, lambda w: w NOT IN ({_STOP})))"


def _any(c, needles):
    return "(" + " OR ".join(f"contains({c}, '{n}')" for n in needles) + ")"


HITS = f"""{sql.EFFECTIVE}, {sql.bm25('questions', 'docs', acl=True)}, top8 AS ({sql.topk('bm_scores', 8, where='WHERE score >= 0.3')}),
    ev AS (SELECT h.query_id, h.doc_id, h.rank, f.file_name || '   ' || d.text AS body, d.text, f.file_name FROM top8 h JOIN docs d ON d.doc_id = h.doc_id JOIN files f ON f.doc_id = h.doc_id)"""
def cover(hits: str) -> str:
    """Coverage and status over the rows ``ev`` (query_id, doc_id, rank, body) that ``hits`` defines."""
    return f"""{ASPECTS}, {hits}, ht AS (SELECT *, {_terms('body')} AS ts, lower(body) AS lb FROM ev),
    aa AS (SELECT query_id, unnest(range(0, len(aspects))) AS i, unnest(aspects) AS aspect FROM asp),
    ac AS (SELECT a.query_id, a.i, a.aspect, coalesce(max(CASE WHEN len({_terms('a.aspect')}) = 0 THEN 0 ELSE len(list_intersect({_terms('a.aspect')}, h.ts))::DOUBLE / len({_terms('a.aspect')}) END), 0) AS best
      FROM aa a LEFT JOIN ht h ON h.query_id = a.query_id GROUP BY 1, 2, 3),
    un AS (SELECT query_id, list_distinct(flatten(list(ts))) AS us, count(*) AS n_hits, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS ids,
      bool_or({_any('lb', PHRASES.support)} AND NOT {_any('lb', PHRASES.against)}) AS yes, bool_or({_any('lb', PHRASES.reject)}) AS no FROM ht GROUP BY 1),
    qc AS (SELECT a.query_id, a.text, a.intent, a.complexity, len(a.aspects) AS n_aspects, coalesce(u.n_hits, 0) AS n_hits, coalesce(u.ids, '') AS ids,
      CASE WHEN u.us IS NULL OR len({_terms('a.text')}) = 0 THEN 0 ELSE len(list_intersect({_terms('a.text')}, u.us))::DOUBLE / len({_terms('a.text')}) END AS query_coverage,
      {_any('a.text', PHRASES.question)} AND coalesce(u.n_hits, 0) >= 2 AND coalesce(u.yes, false) AND coalesce(u.no, false) AS conflict FROM asp a LEFT JOIN un u ON u.query_id = a.query_id),
    cv AS (SELECT query_id, coalesce(string_agg(aspect, ',' ORDER BY aspect COLLATE "C") FILTER (best >= 0.5), '') AS covered, count(*) FILTER (best >= 0.5) AS n_covered, count(*) AS n_a FROM ac GROUP BY 1),
    st AS (SELECT q.*, c.covered, c.n_covered, c.n_covered::DOUBLE / c.n_a AS aspect_coverage FROM qc q JOIN cv c ON c.query_id = q.query_id),
    fin AS (SELECT *, CASE WHEN conflict THEN 'CONFLICTED' WHEN n_hits = 0 THEN 'INSUFFICIENT' WHEN n_hits >= 2 AND query_coverage >= 0.25 AND (NOT (complexity = 'COMPLEX' OR intent IN ('COMPARE', 'MULTI_HOP')) OR aspect_coverage >= 0.75)
      THEN 'SUFFICIENT' WHEN query_coverage > 0 OR aspect_coverage > 0 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS status FROM st)"""


COVER = cover(HITS)
_CONFIDENCE = ("CASE WHEN status = 'INSUFFICIENT' AND n_hits = 0 THEN 0.95 ELSE greatest(0, least(1, 0.25::DOUBLE * least(1, n_hits / 4.0::DOUBLE) + 0.4::DOUBLE * query_coverage "
               "+ 0.35::DOUBLE * aspect_coverage)) END")


def evidence_hits(t):
    hits = lexical_topk(asked(t), index_of(t), 8)
    return agentic.as_evidence(hits, t.docs, t.files)


def aspects(t):
    return evidence.required_aspects(R.query_plans(t.questions))


@query("f14_coverage", f"WITH RECURSIVE {COVER} SELECT a.query_id, a.i AS aspect_no, round(a.best, 6) AS best_coverage, round(q.query_coverage, 6) AS query_coverage FROM ac a JOIN qc q ON q.query_id = a.query_id")
def _coverage(t):
    seen = evidence.coverage(aspects(t), evidence_hits(t))
    return seen.select("query_id", F.posexplode("aspect_scores").alias("aspect_no", "_b"), "query_coverage").select(
        "query_id", "aspect_no", F.round("_b", 6).alias("best_coverage"), F.round("query_coverage", 6).alias("query_coverage"))


@query("f15_evidence_status", f"""WITH RECURSIVE {COVER} SELECT query_id, status, n_hits, n_covered, CASE status WHEN 'SUFFICIENT' THEN 'ANSWER' WHEN 'CONFLICTED' THEN 'ANSWER_WITH_CONFLICTS' ELSE 'REFINE_RETRIEVAL' END AS action,
    round(CASE WHEN status = 'INSUFFICIENT' AND n_hits = 0 THEN 0.95 ELSE greatest(0, least(1, 0.25::DOUBLE * least(1, n_hits / 4.0::DOUBLE) + 0.4::DOUBLE * query_coverage + 0.35::DOUBLE * aspect_coverage)) END, 6) AS confidence FROM fin""")
def _status(t):
    out = evidence.assess(aspects(t), evidence_hits(t), phrases=PHRASES)
    return out.select("query_id", "status", "n_hits", F.size("covered").alias("n_covered"), "action", F.round("confidence", 6).alias("confidence"))


@query("f16_conflicts", f"WITH RECURSIVE {COVER} SELECT query_id, conflict FROM qc")
def _conflicts(t):
    return evidence.coverage(aspects(t), evidence_hits(t), PHRASES).select("query_id", "conflict")


@query("f17_progress_signature", f"WITH RECURSIVE {COVER} SELECT query_id, sha256(status || '|' || ids || '|' || covered) AS signature FROM fin")
def _signature(t):
    return evidence.assess(aspects(t), evidence_hits(t), phrases=PHRASES).select("query_id", "signature")


@query("f18_corrective_queries", f"""WITH RECURSIVE {COVER}, ms AS (SELECT query_id, list(aspect ORDER BY i) FILTER (best < 0.5) AS missing FROM ac GROUP BY 1),
    cand AS (SELECT query_id, unnest(range(0, len(missing))) AS o, 'DECOMPOSED' AS variant_type, unnest(missing) AS variant FROM ms WHERE missing IS NOT NULL
      UNION ALL SELECT query_id, 1000, 'LEXICAL', array_to_string(missing, ' ') FROM ms WHERE missing IS NOT NULL
      UNION ALL SELECT ms.query_id, 0, 'SEMANTIC', array_to_string(list_concat(a.entities, [a.text]), ' ') FROM ms JOIN asp a ON a.query_id = ms.query_id WHERE missing IS NULL),
    fpd AS (SELECT *, lower(trim(regexp_replace(variant, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS fp FROM cand),
    one AS (SELECT *, row_number() OVER (PARTITION BY query_id, fp ORDER BY o) AS d FROM fpd WHERE fp <> ''),
    lim AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o) AS variant_no FROM one WHERE d = 1 AND NOT EXISTS (SELECT 1 FROM variants v WHERE v.query_id = one.query_id AND v.fp = one.fp AND v.variant_type = 'ORIGINAL'))
    SELECT query_id, variant_no, variant_type, variant FROM lim WHERE variant_no <= 3""")
def _corrective(t):
    who = aspects(t)
    judged = evidence.assess(who, evidence_hits(t), phrases=PHRASES)
    executed = R.query_variants(who.drop("aspects")).where("variant_type = 'ORIGINAL'").select("query_id", "fp")
    return evidence.corrective_queries(who, judged, executed).select("query_id", "variant_no", "variant_type", "variant")


def copies(t):
    """Copies of one text as children of the first of them: (children, parents)."""
    first = t.files.groupBy("file_md5").agg(F.min("doc_id").alias("parent_id"), F.count("*").alias("n"))
    children = t.files.join(first, "file_md5").select("doc_id", F.when(F.col("n") > 1, F.col("parent_id")).alias("parent_id"))
    return children, t.docs.select(F.col("doc_id").alias("parent_id"), F.col("text").alias("parent_text"))


def agentic_outcome(t, max_rounds):
    children, parents = copies(t)
    return agentic.retrieve(plans(t), t.docs, t.vectors, t.files, 8, max_rounds=max_rounds, index=index_of(t), children=children, parents=parents, phrases=PHRASES)


def assessed_rows(out):
    return out.assessments.select("query_id", "status", F.round("confidence", 6).alias("confidence"), "round", "n_hits", F.size("covered").alias("n_covered"), "action",
                                  evidence.terminal_reason(F.col("action")).alias("terminal_reason"))


# one round in SQL: all lists fused, reranked against the question, copies folded into their first, and the evidence of what is left
ASSEMBLED = f"""{RECALL[len("WITH RECURSIVE "):].replace(QVARIANTS + ", ", "")}, fused AS (SELECT query_id, doc_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 12) AS rrf_score, count(*) AS n_hits, '' AS retrieval_mode FROM lists GROUP BY 1, 2),
    top40 AS ({sql.topk('fused', 40, score='rrf_score')}), rr AS ({rerank_sql('top40', 8)}),
    hr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_score DESC, doc_id) AS rank FROM rr) y WHERE rank <= 8),
    par AS (SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY file_md5) > 1 THEN min(doc_id) OVER (PARTITION BY file_md5) END AS parent_id FROM files),
    kids AS (SELECT h.query_id, h.doc_id, h.rank, p.parent_id, row_number() OVER (PARTITION BY h.query_id, coalesce('p' || p.parent_id, 'c' || h.doc_id) ORDER BY h.rank, h.doc_id) AS one FROM hr h JOIN par p ON p.doc_id = h.doc_id),
    kept AS (SELECT query_id, doc_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS rank FROM kids WHERE one = 1),
    ev AS (SELECT k.query_id, k.doc_id, k.rank, k.parent_id, f.file_name || ' ' || coalesce({_ANCHOR.format(c=_SQUEEZE.format(c='coalesce(pd.text, d.text)'))}, '') || ' '
      || CASE WHEN length(d.text) > 800 THEN left(d.text, 800) || '…' ELSE d.text END || ' ' || coalesce(pd.text, d.text) AS body
      FROM kept k JOIN docs d ON d.doc_id = k.doc_id JOIN files f ON f.doc_id = k.doc_id LEFT JOIN docs pd ON pd.doc_id = k.parent_id)"""
FIRST_ROUND = cover(ASSEMBLED)
_ACTIONS = "CASE status WHEN 'SUFFICIENT' THEN 'ANSWER' WHEN 'CONFLICTED' THEN 'ANSWER_WITH_CONFLICTS' ELSE CASE WHEN n_hits = 0 THEN 'ABSTAIN' ELSE 'PARTIAL_ANSWER' END END"


@query("f19_agentic_retrieval")
def _agentic(t):
    return assessed_rows(agentic_outcome(t, 2))


@query("f19_first_round", f"""WITH RECURSIVE {FIRST_ROUND} SELECT query_id, status, round({_CONFIDENCE}, 6) AS confidence, 0 AS round, n_hits, n_covered, {_ACTIONS} AS action,
    CASE {_ACTIONS} WHEN 'ANSWER' THEN 'ANSWERED' WHEN 'ANSWER_WITH_CONFLICTS' THEN 'CONFLICTED' WHEN 'PARTIAL_ANSWER' THEN 'PARTIAL' ELSE 'INSUFFICIENT_EVIDENCE' END AS terminal_reason FROM fin""")
def _first_round(t):
    return assessed_rows(agentic_outcome(t, 0))


@query("f20_stage_trace")
def _trace(t):
    return agentic_outcome(t, 1).trace.drop("latency_ms")


@query("f20_first_round_trace", f"""WITH RECURSIVE {FIRST_ROUND},
    cv_ AS (SELECT query_id, count(*) AS v FROM variants GROUP BY 1), lv AS (SELECT query_id, count(*) AS l FROM lists GROUP BY 1),
    ch_ AS (SELECT query_id, string_agg(c, ';' ORDER BY c COLLATE "C") AS channels FROM (SELECT query_id, channel || ':' || query_type || '=' || count(*) AS c FROM lists GROUP BY query_id, channel, query_type) x GROUP BY 1),
    fv AS (SELECT query_id, count(*) AS f FROM top40 GROUP BY 1), rv AS (SELECT query_id, count(*) AS r FROM hr GROUP BY 1),
    av AS (SELECT query_id, count(*) AS a, count(parent_id) AS x FROM kept GROUP BY 1), dv AS (SELECT query_id, count(*) FILTER (one > 1) AS dropped FROM kids GROUP BY 1),
    nv AS (SELECT query_id, count(*) AS d FROM variants WHERE query_id NOT IN (SELECT query_id FROM question_vectors) GROUP BY 1),
    b AS (SELECT p.query_id, p.intent, p.complexity, coalesce(v, 0) AS v, coalesce(l, 0) AS l, coalesce(f, 0) AS f, coalesce(r, 0) AS r, coalesce(a, 0) AS a, coalesce(x, 0) AS x, coalesce(dropped, 0) AS dropped,
      coalesce(d, 0) AS d, coalesce(channels, '') AS channels, n.status, n.n_covered, CAST(floor({_CONFIDENCE} * 10000) AS BIGINT) AS conf, {_ACTIONS} AS action
      FROM plan p LEFT JOIN cv_ USING (query_id) LEFT JOIN lv USING (query_id) LEFT JOIN ch_ USING (query_id) LEFT JOIN fv USING (query_id) LEFT JOIN rv USING (query_id) LEFT JOIN av USING (query_id)
      LEFT JOIN dv USING (query_id) LEFT JOIN nv USING (query_id) JOIN fin n USING (query_id))
    SELECT query_id, 0 AS round, 'QUERY_PLANNING' AS stage, 'SUCCEEDED' AS status, 1 AS n_in, v AS n_out, 'complexity=' || complexity || ';intent=' || intent AS details FROM b
    UNION ALL SELECT query_id, 0, 'PARALLEL_RECALL', CASE WHEN d > 0 THEN 'DEGRADED' ELSE 'SUCCEEDED' END, v, l, channels FROM b
    UNION ALL SELECT query_id, 0, 'RRF_FUSION', 'SUCCEEDED', l, f, 'rankConstant=60;refinementRound=0' FROM b
    UNION ALL SELECT query_id, 0, 'RERANK', 'SUCCEEDED', f, r, 'refinementRound=0;strategy=HEURISTIC' FROM b
    UNION ALL SELECT query_id, 0, 'PARENT_CONTEXT_ASSEMBLY', 'SUCCEEDED', r, a, 'deduplicatedChildren=' || dropped || ';expandedParents=' || x || ';refinementRound=0' FROM b
    UNION ALL SELECT query_id, 0, 'EVIDENCE_VERIFY', status, a, n_covered, 'action=' || action || ';confidence=' || conf || ';refinementRound=0' FROM b""")
def _first_trace(t):
    return agentic_outcome(t, 0).trace.drop("latency_ms")


@query("f21_context_pack", f"""WITH RECURSIVE {HITS} SELECT query_id, string_agg('[' || rank || '] (' || file_name || ' | 第' || rank || '页) ' || CASE WHEN length(text) > 300 THEN left(text, 300) || '…' ELSE text END || chr(10), '' ORDER BY rank) AS context FROM ev GROUP BY query_id""")
def _pack(t):
    return context.context_pack(evidence_hits(t).withColumn("page", F.col("rank")))


@query("f21_tool_text", f"""WITH RECURSIVE {HITS} SELECT e.query_id, '检索到 ' || count(*) || ' 个知识库片段。' || chr(10) || chr(10) || string_agg('[' || e.rank || '] ' || file_name || ' (doc=' || e.doc_id || ', score=' || printf('%.4f', e.rank::DOUBLE) || ')' || chr(10)
    || CASE WHEN length(text) > 1200 THEN left(text, 1200) || '…' ELSE text END, chr(10) || chr(10) ORDER BY e.rank) AS content FROM ev e GROUP BY e.query_id""")
def _tool_text(t):
    return context.tool_text(evidence_hits(t).withColumn("score", F.col("rank").cast("double")))


@query("f22_message_truncation", """SELECT conv_id, pos, CASE WHEN role <> 'system' AND length(content) > 1600 THEN left(content, 1600 - 8) || chr(10) || '[内容已截断]' ELSE content END AS content FROM messages""")
def _truncate(t):
    return t.messages.select("conv_id", "pos", context.normalized_message().alias("content"))


@query("f22_message_compaction", """WITH RECURSIVE m AS (SELECT conv_id, pos, CASE WHEN role = 'user' AND pos % 4 = 2 THEN 'tool' ELSE role END AS role, pos % 4 = 1 AS calls,
      CASE WHEN role = 'system' THEN length(content) WHEN role = 'user' AND pos % 4 = 2 THEN least(length(content), 8000) ELSE least(length(content), 1600) END AS len FROM messages),
    l AS (SELECT *, max(CASE WHEN role <> 'tool' THEN pos END) OVER (PARTITION BY conv_id ORDER BY pos) AS lead, min(pos) OVER (PARTITION BY conv_id) AS fp FROM m),
    g AS (SELECT l.*, l.role = 'system' AND l.pos = l.fp AS sys, CASE WHEN l.role = 'tool' AND h.calls AND h.role = 'assistant' THEN l.lead ELSE l.pos END AS grp FROM l LEFT JOIN m h ON h.conv_id = l.conv_id AND h.pos = l.lead),
    hd AS (SELECT conv_id, sum(CASE WHEN sys THEN len ELSE 0 END) AS used, sum(len) AS total FROM g GROUP BY 1),
    z AS (SELECT conv_id, grp, sum(len) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY grp DESC) AS n FROM g WHERE NOT sys GROUP BY 1, 2),
    f AS (SELECT z.conv_id, z.grp, z.n, CAST(hd.used + z.size AS BIGINT) AS used, true AS kept FROM z JOIN hd USING (conv_id) WHERE z.n = 1
      UNION ALL SELECT z.conv_id, z.grp, z.n, CAST(f.used + CASE WHEN f.used + z.size <= 1500 THEN z.size ELSE 0 END AS BIGINT), f.used + z.size <= 1500 FROM f JOIN z ON z.conv_id = f.conv_id AND z.n = f.n + 1)
    SELECT g.conv_id, g.pos, g.role, g.len AS characters FROM g LEFT JOIN f ON f.conv_id = g.conv_id AND f.grp = g.grp JOIN hd ON hd.conv_id = g.conv_id WHERE g.sys OR f.kept OR hd.total <= 1500""")
def _compact(t):
    tool = (F.col("role") == "user") & (F.col("pos") % 4 == 2)
    rows = t.messages.withColumn("role", F.when(tool, "tool").otherwise(F.col("role"))).withColumn("has_tool_calls", F.col("pos") % 4 == 1)
    return context.compact_messages(rows, 1500).select("conv_id", "pos", "role", F.length("content").alias("characters"))


REL = f"""{ACTIVE}, mt AS (SELECT *, list_distinct({sql.tokens("source_query || ' ' || content")}) AS m FROM active),
    qq AS (SELECT query_id, user_id % 20 AS owner_id, list_distinct({sql.tokens('text')}) AS q FROM questions),
    sc AS (SELECT qq.query_id, mt.memory_id, mt.owner_id, mt.updated_at, mt.memory_type, mt.confidence, mt.content, round(CASE WHEN len(q) = 0 OR len(m) = 0 THEN 0 ELSE len(list_intersect(q, m)) / sqrt((len(q) * len(m))::DOUBLE) END
      + CASE WHEN memory_type = 'CORRECTION' THEN 0.18::DOUBLE ELSE 0.08::DOUBLE END + least(0.2::DOUBLE, confidence * 0.2::DOUBLE), 9) AS score FROM qq JOIN mt USING (owner_id)),
    sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, updated_at DESC, memory_id DESC) AS rank FROM sc) WHERE rank <= 5)"""


def selected(t):
    questions = t.questions.withColumn("user_id", F.col("user_id") % 20)
    return memory.relevant_memories(questions, t.memories, F.expr(_NOW), 5)


@query("f23_memory_relevance", f"WITH {REL} SELECT query_id, memory_id, owner_id, rank, score FROM sel")
def _relevance(t):
    return selected(t)


@query("f24_memory_upsert", rf"""WITH r AS (SELECT *, lower(rating) = 'bad' AS bad, correction IS NOT NULL AND trim(correction) <> '' AS stated FROM feedback),
    c AS (SELECT *, CASE WHEN stated THEN correction WHEN reason IS NOT NULL AND trim(reason) <> '' THEN reason WHEN bad THEN '{memory.BAD_DEFAULT}' ELSE '{memory.GOOD_DEFAULT}' END AS content,
      CASE WHEN bad THEN 'CORRECTION' ELSE 'PREFERENCE' END AS kind FROM r),
    k AS (SELECT *, sha256(kind || '|' || lower(trim(regexp_replace(content, '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS memory_key FROM c)
    SELECT user_id AS owner_id, memory_key, min(ts) AS created_at, max(ts) AS updated_at, arg_max(kind, ts) AS memory_type, arg_max(content, ts) AS content,
      arg_max(CASE WHEN bad AND NOT stated THEN 'PROPOSED' ELSE 'ACTIVE' END, ts) AS status, arg_max(CASE WHEN stated THEN 0.95::DOUBLE ELSE 0.78::DOUBLE END, ts) AS confidence FROM k GROUP BY user_id, memory_key""")
def _upsert(t):
    return memory.memories_from_feedback(t.feedback).drop("source_query")


@query("f25_memory_guidance", f"""WITH {REL} SELECT query_id, '{memory.GUIDANCE_HEAD}' || chr(10) || string_agg('- [' || memory_type || ', confidence=' || printf('%.2f', confidence) || '] ' || content, chr(10) ORDER BY rank) AS guidance FROM sel GROUP BY query_id""")
def _guidance(t):
    return memory.guidance(selected(t), t.memories)


@query("f25_recent_feedback", "SELECT user_id, feedback_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, feedback_id DESC) AS rank FROM feedback) WHERE rank <= 5")
def _recent(t):
    return memory.recent_feedback(t.feedback).select("user_id", "feedback_id", "rank")


@query("f26_access_counters", f"WITH {REL}, a AS (SELECT memory_id, count(*) AS n FROM sel GROUP BY 1) SELECT m.memory_id, coalesce(a.n, 0) AS access_count, CASE WHEN a.n IS NOT NULL THEN epoch_us({_NOW}) END AS last_us FROM memories m LEFT JOIN a ON a.memory_id = m.memory_id")
def _access(t):
    return memory.count_access(t.memories, selected(t), F.expr(_NOW)).select("memory_id", "access_count", F.unix_micros("last_accessed").alias("last_us"))


@query("f27_summary_sources", f"""{RECALL}, fused AS (SELECT query_id, doc_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 12) AS rrf_score FROM lists GROUP BY 1, 2), top12 AS ({sql.topk('fused', 12, score='rrf_score')})
    SELECT query_id, count(*) AS source_count, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS sources FROM top12 GROUP BY query_id""")
def _summary(t):
    lists = fuse.recall_round(variants_with_user(t), index_of(t), t.vectors, 12)
    top = fuse.rrf(lists, max(1, min(20, 12)))
    packed = top.groupBy("query_id").agg(F.count("*").alias("source_count"), F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("_l"))
    return packed.select("query_id", "source_count", F.array_join(F.transform("_l", lambda x: x["doc_id"].cast("string")), ",").alias("sources"))


@query("k16_memory_decisions", """WITH d AS (SELECT memory_id * 3 + j AS decision_id, owner_id + CASE WHEN (memory_id + j) % 3 = 0 THEN 1 ELSE 0 END AS user_id, memory_id,
      CASE CAST((memory_id + j) % 4 AS INT) WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'EXPIRED' ELSE 'DELETED' END AS target FROM memories, (SELECT unnest([0, 1, 2]) AS j)),
    v AS (SELECT d.memory_id, arg_max(target, decision_id) AS t FROM d JOIN memories m ON m.memory_id = d.memory_id AND m.owner_id = d.user_id WHERE target <> 'DELETED' GROUP BY 1)
    SELECT m.memory_id, coalesce(v.t, m.status) AS status FROM memories m LEFT JOIN v ON v.memory_id = m.memory_id""")
def _decisions(t):
    # three decisions on every memory, some by another user and some to no valid state
    each = t.memories.select("memory_id", "owner_id", "updated_at", F.explode(F.array(*[F.lit(j) for j in range(3)])).alias("j"))
    nth = F.col("memory_id") + F.col("j")
    target = F.get(F.array(*[F.lit(s) for s in ("active", "Rejected", "EXPIRED", "DELETED")]), (nth % 4).cast("int"))
    decisions = each.select((F.col("memory_id") * 3 + F.col("j")).alias("decision_id"), (F.col("owner_id") + F.when(nth % 3 == 0, 1).otherwise(0)).alias("user_id"), "memory_id",
                            target.alias("target"), (F.col("updated_at").cast("timestamp") + F.make_dt_interval(mins=F.col("j"))).alias("ts"))
    return memory.decide(t.memories, decisions)
