"""Column expressions over text: trimming, tokens, estimates, anchors, redaction.

All of them are built-in Spark expressions. Lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
STOP_WORDS_QUESTION = (
    "什么", "怎么", "如何", "为什么", "是否", "可以", "一下", "这个", "那个", "相关", "介绍", "请问", "帮我",
)
STOP_WORDS_LATIN = ("the", "a", "an", "is", "are", "of", "to", "and", "or", "how", "what", "why")
STOP_WORDS = STOP_WORDS_QUESTION + STOP_WORDS_LATIN
ASCII_TOKEN_RATIO, CJK_TOKEN_RATIO, OTHER_TOKEN_RATIO, TEXT_TOKEN_BASE = 0.30, 0.95, 0.55, 12
EMBEDDING_TOKEN_MARGIN, EMBEDDING_TEXT_EXTRA, CHAT_MESSAGE_EXTRA = 1.15, 4, 8
ANCHOR_LENGTH = 120
CONTEXT_SNIPPET_LENGTH, MATCHED_CHUNK_LENGTH, EVIDENCE_SNIPPET_LENGTH = 300, 800, 160
TOOL_TEXT_LENGTH, TITLE_LENGTH, ERROR_LENGTH, AUDIT_LENGTH = 1200, 50, 1000, 200
ELLIPSIS = "…"
# ----------------------------------------------------------------------------------------------

WORD_BREAK = r"[^\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def jtrim(c: Column | str) -> Column:
    """Strip every character up to U+0020 on both ends (Spark's ``trim`` strips spaces only)."""
    return F.regexp_replace(_col(c), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(c: Column | str) -> Column:
    return F.coalesce(jtrim(c), F.lit("")) == ""


def squeeze(c: Column | str) -> Column:
    """Whitespace runs become one space, ends are trimmed, null becomes empty."""
    return jtrim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\s+", " "))


def fingerprint(c: Column | str) -> Column:
    """Key under which two spellings of one query are the same query."""
    return F.lower(squeeze(c))


def _han_bigrams(normalized: Column) -> Column:
    """Pairs of neighbouring Han characters, other characters left out. The range test is a cheap first look: Han starts
    at U+2E80, and most text has no character from there on."""
    none = F.array().cast("array<string>")
    han = F.regexp_replace(normalized, r"[^\p{IsHan}]", "")

    def pairs(h):
        cut = F.transform(F.sequence(F.lit(1), F.length(h) - 1), lambda i: F.substring(h, i, F.lit(2)))
        return F.when(F.length(h) >= 2, cut).otherwise(none)

    return F.when(normalized.rlike(r"[\u2E80-\x{10FFFF}]"), let(han, pairs)).otherwise(none)


def tokens(c: Column | str, stop_words: tuple[str, ...] = ()) -> Column:
    """Letter/digit words of two or more characters plus bigrams of Han characters, in order, with repeats."""
    normalized = F.lower(F.coalesce(_col(c), F.lit("")))
    words = F.filter(F.split(normalized, WORD_BREAK), lambda t: F.length(t) >= 2)
    found = F.concat(words, _han_bigrams(normalized))
    if not stop_words:
        return found
    return F.filter(found, lambda t: ~t.isin(*stop_words))


def evidence_terms(c: Column | str) -> Column:
    return F.array_distinct(tokens(c, STOP_WORDS))


def memory_terms(c: Column | str) -> Column:
    return F.array_distinct(tokens(c))


def rerank_terms(c: Column | str) -> Column:
    """ASCII alphanumeric or Han words longer than one character."""
    lowered = F.lower(F.coalesce(_col(c), F.lit("")))
    return F.array_distinct(F.filter(F.split(lowered, "[^a-z0-9一-龥]+"), lambda t: F.length(t) > 1))


def limit_text(c: Column | str, length: int, suffix: str = ELLIPSIS) -> Column:
    value = _col(c)
    return F.when(F.length(value) > length, F.concat(F.left(value, F.lit(length)), F.lit(suffix))).otherwise(value)


def limit_text_within(c: Column | str, length: int, suffix: str = ELLIPSIS) -> Column:
    """Like ``limit_text`` but the suffix counts toward the length."""
    value = _col(c)
    keep = max(0, length - len(suffix))
    return F.when(F.length(value) > length, F.concat(F.left(value, F.lit(keep)), F.lit(suffix))).otherwise(value)


def anchor(c: Column | str) -> Column:
    """One-line heading of a passage; null for a blank passage."""
    line = squeeze(c)
    return F.when(line != "", limit_text(line, ANCHOR_LENGTH))


def contextual_text(parent_text: Column | str, child_text: Column | str, page: Column | str) -> Column:
    """Child passage behind its page line and the heading of its parent."""
    heading = anchor(parent_text)
    return F.concat(
        F.when(_col(page).isNotNull(), F.concat(F.lit("文档第"), _col(page).cast("string"), F.lit("页。\n"))).otherwise(""),
        F.when(heading.isNotNull(), F.concat(F.lit("上下文主题："), heading, F.lit("\n"))).otherwise(""),
        _col(child_text),
    )


def token_estimate(c: Column | str) -> Column:
    """Tokens of a text from the share of ASCII, CJK and other characters; blank text has none."""
    value = F.coalesce(_col(c), F.lit(""))
    cjk = F.regexp_count(value, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"))
    ascii_ = F.regexp_count(value, F.lit(r"[\x00-\x08\x0E-\x1B\x21-\x7F]"))
    spaces = F.regexp_count(value, F.lit(r"[\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]"))
    other = F.regexp_count(value, F.lit(r"[^\x00-\x7F]")) - cjk - spaces
    raw = ascii_ * F.lit(ASCII_TOKEN_RATIO) + cjk * F.lit(CJK_TOKEN_RATIO) + other * F.lit(OTHER_TOKEN_RATIO) + TEXT_TOKEN_BASE
    return F.when(is_blank(value), F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(raw))).cast("long")


def html_to_text(c: Column | str) -> Column:
    """Visible text of an HTML page on single-spaced lines of prose."""
    text = F.regexp_replace(_col(c), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return squeeze(text)


def _contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | c.contains(needle)
    return hit


# --- fixed values: error categories and masks --------------------------------------------------
ERROR_CATEGORIES = (
    ("AUTHENTICATION", ("401", "403", "unauthorized", "forbidden", "authentication fails", "invalid api key")),
    ("RATE_LIMIT", ("429", "too many requests", "rate limit", "quota exceeded")),
    ("TIMEOUT", ("timeout", "timed out", "超时")),
    ("NETWORK", ("connection refused", "connection reset", "unknown host", "dns", "network")),
)
MASKS = (
    (r"(?i)https?://\S+", "[provider-endpoint]"),
    (r"(?i)bearer\s+[a-z0-9._~+/=-]+", "Bearer [redacted]"),
    (r"(?i)(api[-_ ]?key\s*[:=]\s*)\S+", "$1[redacted]"),
    (r"\b(?:sk|ak)-[A-Za-z0-9_-]{8,}\b", "[redacted-token]"),
)
# ----------------------------------------------------------------------------------------------


def error_category(message: Column | str) -> Column:
    lowered = F.lower(F.coalesce(_col(message), F.lit("")))
    result = None
    for name, needles in ERROR_CATEGORIES:
        test = _contains_any(lowered, needles)
        result = F.when(test, name) if result is None else result.when(test, name)
    return result.otherwise("UNKNOWN")


def mask_secrets(c: Column | str) -> Column:
    """Endpoints, bearer values, API keys and secret tokens replaced by placeholders."""
    text = _col(c)
    for pattern, replacement in MASKS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def audit_message(message: Column | str) -> Column:
    """What may be stored about an error: its category, else the masked text cut to the audit length."""
    category = error_category(message)
    masked = limit_text(mask_secrets(jtrim(message)), AUDIT_LENGTH, "...")
    return F.when((category != "UNKNOWN") | is_blank(message), category).otherwise(masked)


def citation_ids(answer: Column | str) -> Column:
    """Numbers cited as ``[n]``, each once, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(_col(answer), F.lit("")), F.lit(r"\[(\d+)\]"), F.lit(1)))


def evidence_snippet(anchor_text: Column | str, matched: Column | str, question: Column | str) -> Column:
    """Anchor, else the first sentence of 12+ characters, else the passage, else the question."""
    heading = squeeze(anchor_text)
    passage = limit_text(squeeze(matched), MATCHED_CHUNK_LENGTH)
    sentences = F.filter(F.transform(F.split(passage, "(?<=[。！？!?；;])"), jtrim), lambda s: F.length(s) >= 12)
    best = (
        F.when(heading != "", heading)
        .when(passage == "", squeeze(question))
        .otherwise(F.coalesce(F.get(sentences, F.lit(0)), passage))
    )
    return limit_text(best, EVIDENCE_SNIPPET_LENGTH)


# --- fixed values: layout rules of extracted pages ---------------------------------------------
PAGE_FOOTER = r"(?i)^No\.\s*\d+\s*/\s*\d+%?$"
LINE_RULES = (
    (r"[ \t\x0B\f]+", " "),
    (r"(?<=\p{IsHan})\s+(?=\p{IsHan})", ""),
    (r"(?<=[A-Za-z0-9])\s+(?=\p{IsHan})", ""),
    (r"(?<=\p{IsHan})\s+(?=[A-Za-z0-9])", ""),
    (r"\s+([，。！？；：、）】》])", "$1"),
    (r"([，。！？；：、])\s+(?=\p{IsHan})", "$1"),
    (r"([（【《])\s+", "$1"),
)
# ----------------------------------------------------------------------------------------------


def _clean_line(line: Column) -> Column:
    cleaned = jtrim(line)
    for pattern, replacement in LINE_RULES:
        cleaned = F.regexp_replace(cleaned, pattern, replacement)
    cleaned = jtrim(cleaned)
    return F.when(cleaned.rlike(PAGE_FOOTER), F.lit("")).otherwise(cleaned)


def clean_page_text(c: Column | str) -> Column:
    """Page text with tidy spacing, no page footers and at most one empty line in a row."""
    plain_spaces = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\u00A0", " ")
    unified = F.regexp_replace(plain_spaces, r"\r\n?", "\n")
    lines = F.transform(F.split(unified, "\n"), _clean_line)
    return jtrim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))
