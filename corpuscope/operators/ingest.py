"""Document ingestion: file gate, upload parts, duplicates, versions, chunk numbering, parents, parsing state, embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.chunking import GROUP_SIZE, chunk_table
from corpuscope.functions.text import EMBEDDING_TEXT_EXTRA, EMBEDDING_TOKEN_MARGIN, anchor, contextual_text, token_estimate, tokens
from corpuscope.operators.access import first_rows
from corpuscope.session import ship_package, spread

# --- fixed values -----------------------------------------------------------------------------
SUPPORTED_EXTENSIONS = (
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "rtf", "md", "odt", "ods", "odp",
    "html", "htm", "xml", "json", "csv", "epub", "pages", "numbers", "keynote",
)
UNSUPPORTED_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "bmp", "svg", "webp", "tiff", "ico", "psd",
    "mp3", "wav", "flac", "aac", "ogg", "wma", "m4a",
    "mp4", "avi", "mov", "wmv", "flv", "mkv", "webm", "m4v", "3gp",
    "zip", "rar", "7z", "tar", "gz", "bz2", "xz",
    "exe", "msi", "dmg", "pkg", "deb", "rpm",
    "ttf", "otf", "woff", "woff2", "eot",
    "dwg", "dxf", "step", "iges", "db", "sqlite", "mdb", "accdb", "bin", "dat", "iso", "img",
)
TYPE_NAMES = {
    "pdf": "PDF文档", "doc": "Word文档", "docx": "Word文档", "xls": "Excel表格", "xlsx": "Excel表格",
    "ppt": "PowerPoint演示文稿", "pptx": "PowerPoint演示文稿", "txt": "文本文件", "rtf": "富文本文档", "md": "Markdown文档",
    "odt": "OpenDocument文本", "ods": "OpenDocument表格", "odp": "OpenDocument演示文稿", "html": "HTML文档", "htm": "HTML文档",
    "xml": "XML文档", "json": "JSON文件", "csv": "CSV文件", "epub": "EPUB电子书", "pages": "Apple Pages文档",
    "numbers": "Apple Numbers表格", "keynote": "Apple Keynote演示文稿", "jpg": "JPEG图片", "jpeg": "JPEG图片", "png": "PNG图片",
    "gif": "GIF图片", "bmp": "BMP图片", "svg": "SVG图片", "mp4": "MP4视频", "avi": "AVI视频", "mov": "MOV视频",
    "mp3": "MP3音频", "wav": "WAV音频", "zip": "ZIP压缩包", "rar": "RAR压缩包", "7z": "7Z压缩包",
}
PART_SIZE = 5 * 1024 * 1024
STATUS_COMPLETED = 1
EMBEDDING_DIMENSIONS = 64
# ----------------------------------------------------------------------------------------------

#: words whose place and sign a task remembers
WORDS = 200_000


def file_gate(files: DataFrame) -> DataFrame:
    """Add extension, file_type, verdict (SUPPORTED, UNSUPPORTED, UNKNOWN, NO_EXTENSION, EMPTY_NAME) and valid."""
    ext = F.lower(F.nullif(F.regexp_extract("file_name", r"\.([^.]+)$", 1), F.lit("")))
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    known = F.col("extension")
    file_type = F.when(known.isNull(), "unknown").otherwise(F.coalesce(names[known], F.concat(F.upper(known), F.lit("文件"))))
    verdict = (F.when(F.trim(F.coalesce("file_name", F.lit(""))) == "", "EMPTY_NAME").when(known.isNull(), "NO_EXTENSION")
               .when(known.isin(*SUPPORTED_EXTENSIONS), "SUPPORTED")
               .when(known.isin(*UNSUPPORTED_EXTENSIONS), "UNSUPPORTED").otherwise("UNKNOWN"))
    return (files.withColumn("extension", ext).withColumn("file_type", file_type).withColumn("verdict", verdict)
            .withColumn("valid", F.col("verdict") == "SUPPORTED"))


def expected_parts(size: Column | str = "total_size", part_size: int = PART_SIZE) -> Column:
    value = F.col(size) if isinstance(size, str) else size
    return F.ceil(value / part_size).cast("long")


def missing_parts(files: DataFrame, parts: DataFrame, *, part_size: int = PART_SIZE) -> DataFrame:
    """(file_id, chunk_index) of parts that were never uploaded."""
    wanted = files.withColumn("_n", expected_parts(part_size=part_size)).where("_n > 0").select(
        "file_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("chunk_index"))
    return wanted.join(parts.select("file_id", "chunk_index"), ["file_id", "chunk_index"], "left_anti")


def upload_progress(files: DataFrame, parts: DataFrame, *, part_size: int = PART_SIZE) -> DataFrame:
    """(file_id, expected, uploaded, complete)."""
    have = parts.groupBy("file_id").agg(F.countDistinct("chunk_index").alias("uploaded"))
    return (files.select("file_id", expected_parts(part_size=part_size).alias("expected")).join(have, "file_id", "left")
            .select("file_id", "expected", F.coalesce("uploaded", F.lit(0)).alias("uploaded"),
                    (F.coalesce("uploaded", F.lit(0)) == F.col("expected")).alias("complete")))


def latest_file_rows(files: DataFrame) -> DataFrame:
    """One row per (file_md5, user_id): completed first, then latest merged_at, created_at and id."""
    order = [F.desc((F.col("status") == STATUS_COMPLETED).cast("int")), F.desc_nulls_last("merged_at"),
             F.desc_nulls_last("created_at"), F.desc("doc_id")]
    return first_rows(files, ["file_md5", "user_id"], order)


def version_cleanup(files: DataFrame) -> DataFrame:
    """Add action per row: keep (newest row of the newest content), duplicate (same content), stale (older content)."""
    key = ["user_id", "file_name"]
    newest = files.groupBy(*key).agg(F.max(F.struct("created_at", "doc_id", "file_md5")).alias("_newest"))
    joined = files.join(newest, key)
    action = (F.when(F.col("doc_id") == F.col("_newest.doc_id"), "keep")
              .when(F.col("file_md5") == F.col("_newest.file_md5"), "duplicate").otherwise("stale"))
    return joined.withColumn("action", action).drop("_newest")


def delete_by_key(table: DataFrame, keys: DataFrame, key: str = "file_md5") -> DataFrame:
    """Rows of ``table`` whose key is not in the delete set; apply it to every table of the cascade."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def knowledge_stats(files: DataFrame, fragments: DataFrame) -> DataFrame:
    """One row: documents, fragments, bytes, latest update."""
    of_files = files.agg(F.count("*").alias("documents"), F.sum("total_size").alias("bytes"),
                         F.max(F.coalesce("merged_at", "created_at")).alias("latest_update"))
    n_fragments = fragments.select(F.count("*")).scalar()
    return of_files.withColumn("fragments", n_fragments)


def duplicate_texts(docs: DataFrame) -> DataFrame:
    """(fingerprint, copies, first_doc_id) of texts that occur more than once; counts combine before the shuffle."""
    return (docs.groupBy(F.md5("text").alias("fingerprint"))
            .agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id")).where("copies > 1"))


def number_chunks(passages: DataFrame) -> DataFrame:
    """Add chunk_id 1..n per document over pages, and the position inside the page (from 0).

    A document is numbered in one window group: it holds the passages of one document only.
    """
    doc = Window.partitionBy("doc_id").orderBy("page", "pos")
    page = Window.partitionBy("doc_id", "page").orderBy("pos")
    return passages.withColumn("chunk_id", F.row_number().over(doc)).withColumn("in_page", F.row_number().over(page) - 1)


def parent_chunks(numbered: DataFrame, group_size: int = GROUP_SIZE) -> DataFrame:
    """(doc_id, page, parent_index, parent_text, children): groups of ``group_size`` passages of one page."""
    group = F.floor(F.col("in_page") / group_size)
    ordered = F.sort_array(F.collect_list(F.struct("in_page", "text")))
    return (numbered.groupBy("doc_id", "page", group.alias("_group"))
            .agg(F.min("chunk_id").alias("parent_index"), ordered.alias("_rows"), F.count("*").alias("children"))
            .select("doc_id", "page", "parent_index", F.array_join(F.transform("_rows", lambda r: r["text"]), "\n").alias("parent_text"), "children"))


def child_chunks(numbered: DataFrame, parents: DataFrame, group_size: int = GROUP_SIZE) -> DataFrame:
    """Children with parent_index, anchor and the contextual text that is embedded."""
    first = F.col("chunk_id") - F.col("in_page") % group_size
    keyed = numbered.withColumn("parent_index", first)
    return (keyed.join(parents.select("doc_id", "parent_index", "parent_text"), ["doc_id", "parent_index"])
            .withColumn("anchor_text", anchor("text"))
            .withColumn("contextual_text", contextual_text("parent_text", "text", "page")).drop("parent_text"))


def embedding_tokens(total: Column) -> Column:
    return F.ceil(total * F.lit(EMBEDDING_TOKEN_MARGIN)).cast("long")


def ingestion_estimate(passages: DataFrame) -> DataFrame:
    """(doc_id, chunks, tokens): the margin is rounded per page, pages are then summed."""
    per_page = (passages.groupBy("doc_id", "page")
                .agg(F.count("*").alias("_n"), F.sum(token_estimate("text") + EMBEDDING_TEXT_EXTRA).alias("_t")))
    return per_page.groupBy("doc_id").agg(F.sum("_n").alias("chunks"), F.sum(embedding_tokens(F.col("_t"))).alias("tokens"))


def counts_by_file(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """(file_md5, chunks, paged_chunks, parents)."""
    c = chunks.groupBy("file_md5").agg(F.count("*").alias("chunks"), F.count("page").alias("paged_chunks"))
    p = parents.groupBy("file_md5").agg(F.count("*").alias("parents"))
    return c.join(p, "file_md5", "full").fillna(0, ["chunks", "paged_chunks", "parents"])


def parsing_state(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Per file_md5 (its newest row): REUSE a complete result, CLEAN_AND_PARSE a partial one, else PARSE."""
    newest = files.groupBy("file_md5").agg(F.max_by("est_chunks", F.struct("created_at", "doc_id")).alias("expected"))
    joined = newest.join(counts, "file_md5", "left").fillna(0, ["chunks", "parents"])
    complete = (F.coalesce("expected", F.lit(0)) > 0) & (F.col("chunks") == F.col("expected")) & (F.col("parents") > 0)
    action = F.when(complete, "REUSE").when((F.col("chunks") > 0) | (F.col("parents") > 0), "CLEAN_AND_PARSE").otherwise("PARSE")
    return joined.select("file_md5", "expected", "chunks", "parents", action.alias("action"))


def backfill_status(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Vectorization status of completed files that never got one, with the reason."""
    todo = files.where(F.col("vectorization_status").isNull() & (F.col("status") == STATUS_COMPLETED))
    joined = todo.join(counts.select("file_md5", "chunks"), "file_md5", "left").fillna(0, ["chunks"])
    status = (F.when(F.col("actual_tokens").isNotNull() | (F.col("chunks") > 0), "COMPLETED")
              .when(F.col("est_chunks").isNotNull(), "FAILED"))
    reason = (F.when(F.col("actual_tokens").isNotNull(), "USAGE_RECORDED").when(F.col("chunks") > 0, "VECTORS_WITHOUT_USAGE")
              .when(F.col("est_chunks").isNotNull(), "ESTIMATED_ONLY"))
    return joined.select("doc_id", status.alias("new_status"), reason.alias("reason")).where("new_status IS NOT NULL")


def hashed_embedding(texts: DataFrame, key: list[str], *, text_col: str = "text", dimensions: int = EMBEDDING_DIMENSIONS) -> DataFrame:
    """Default embedder: signed feature hashing of words, unit length; (key, embedding). Needs no model or network, and no shuffle: a text is folded where it is read.

    Words met before are remembered, ``WORDS`` of them in a task.
    """
    ship_package(texts.sparkSession)
    split = spread(texts.select(*key, text_col), *key).select(*key, tokens(text_col).alias("_words"))

    def run(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, int]] = {}
        for block in blocks:
            vectors = []
            for words in block["_words"]:
                weights = np.zeros(dimensions)
                for word in words:
                    spot = known.get(word)
                    if spot is None:
                        digest = hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
                        spot = int(digest[:4], 16) % dimensions, 1 if int(digest[4], 16) % 2 == 0 else -1
                        if len(known) < WORDS:
                            known[word] = spot
                    weights[spot[0]] += spot[1]
                norm = np.sqrt((weights * weights).sum())
                vectors.append((weights / (norm if norm > 0 else 1.0)).astype(np.float32))
            yield block[key].assign(embedding=vectors)

    kinds = dict(split.dtypes)
    return split.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "embedding array<float>"]))


def embed_chunks(chunks: DataFrame, *, embedder: Callable[..., DataFrame] = hashed_embedding, model_version: str = "hashed-64",
                 key: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """Add embedding, model_version and the token usage of the embedded text (contextual text, else the passage).

    ``embedder(texts, key)`` maps (key, text) rows to (key, embedding); a batch pandas UDF over a model fits as well.
    """
    body = chunks.withColumn("_body", F.coalesce("contextual_text", "text"))
    vectors = embedder(body.select(*key, F.col("_body").alias("text")), list(key))
    usage = token_estimate("_body") + EMBEDDING_TEXT_EXTRA
    return (body.withColumn("tokens", usage).drop("_body").join(vectors, list(key))
            .withColumn("model_version", F.lit(model_version)))


def chunk_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, page, pos, text) passages of documents given as (doc_id, text[, page])."""
    keyed = docs if "page" in docs.columns else docs.withColumn("page", F.lit(None).cast("int"))
    return chunk_table(keyed, ["doc_id", "page"])
