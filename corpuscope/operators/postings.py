"""BM25 over stored postings: words are split once, at ingestion, and a search reads the postings of its words only.

Documents are dealt into blocks. One row per block holds its documents, with length and access columns. One row per block and term holds the places of the documents that have the term, with
term frequency, and what bounds the impact of the term in the block: its highest frequency and the shortest of its documents, which hold for
any mean length. A search brings the rows of its words together by block. Each task goes through its blocks in turn, adds up the bounds of the terms per question, skips the block for every
question whose bound is below the k-th best score that the task has found so far, and multiplies the rest in numpy: no text is split, and no row of a question
and a document is formed. At most k rows per question leave a task.

Questions travel to the tasks; so many that their terms and tags exceed ``GROUP_CELLS`` are searched in groups, one pass over their postings each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.text import tokens
from corpuscope.operators.access import first_rows, is_restricted
from corpuscope.operators.bm25 import ACCESS_COLUMNS, B, K1, MIN_SCORE, SCORE_DIGITS, bm25_topk
from corpuscope.session import ship_package, task_count

#: documents of a block: as many as leave four blocks to a core, within these bounds (most rows are of words that few documents have, so larger blocks have far fewer rows)
BLOCK_DOCUMENTS = 1_024, 8_192
BLOCKS_PER_CORE = 4
GROUP_CELLS = 1_000_000
#: question terms up to which the scan itself gets the list of terms, so that row groups without any are not read
PUSHED_TERMS = 200
#: cells of a score block (questions x documents) that a task holds at most
SCORE_CELLS = 4_000_000
#: bytes of text (or one longer text) that a task splits into words at a time
SPLIT_BYTES = 8 << 20
#: characters that the tables of bytes do not know: all but those up to U+017F and the punctuation and currency signs from U+2000 (ranges to look for: a negated class takes twenty times as long)
OTHER = r"[\u0180-\u1FFF\u2070-\u209F\u20D0-\x{10FFFF}]"
#: the one character below whose lower case is two
DOTTED_I = "\u0130"


def _is_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


_ONE = np.array([ord(chr(b).lower()) if b > 127 or _is_word(chr(b)) else 32 for b in range(128)] + list(range(128, 256)), np.uint8)
_TWO = np.array([list(c.lower().encode() if c != DOTTED_I and _is_word(c) else c.encode() if c == DOTTED_I else b"  ") for c in map(chr, range(0x80, 0x180))], np.uint8)


def lower_words(texts: pa.Array) -> pa.Array:
    """Texts without nulls in lower case, a space in the place of every byte that belongs to no letter or digit.

    Only for texts without ``DOTTED_I`` and characters of ``OTHER``, and for words that are lower already, which stay as they are.
    """
    large = pa.types.is_large_string(texts.type)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    held = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    out = _ONE[held]
    two = np.flatnonzero(held - np.uint8(0xC2) < 4)
    pairs = _TWO[(held[two] - np.uint8(0xC2)).astype(np.int64) * 64 + (held[two + 1] & 63)]
    out[two], out[two + 1] = pairs[:, 0], pairs[:, 1]
    three = np.flatnonzero(held == 0xE2)
    mid, last = held[three + 1], held[three + 2]
    sign = three[(mid == 0x80) | (mid == 0x81) & (last < 0xB0) | (mid == 0x82) & (last >= 0xA0) | (mid == 0x83) & (last < 0x90)]
    for at in range(3):
        out[sign + at] = 32
    kind = pa.LargeStringArray if large else pa.StringArray
    return kind.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(ends - ends[0])), pa.py_buffer(out))


@dataclass(frozen=True)
class Postings:
    """``terms``: block, term, df, total, highest, shortest, place[], tf[] and, in the row of a block's empty term, doc_id[], length[] and the access columns of its documents."""

    terms: DataFrame
    n_docs: int
    mean_length: float


class _Packer:
    """Counts the words of one block as its documents arrive; what is held are the counts, not the words."""

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.rows: list[pa.RecordBatch] = []
        self.counts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.documents = 0

    def add(self, batch: pa.RecordBatch) -> None:
        """``batch``: ``words`` and the columns ``keys`` but ``length`` of some documents."""
        ends = np.cumsum(pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + SPLIT_BYTES, "right")))
            self._count(batch.slice(begin, end - begin))
            begin = end

    def _count(self, batch: pa.RecordBatch) -> None:
        many = batch.num_rows
        words = pc.split_pattern(lower_words(batch.column("words")), " ")
        flat = words.flatten()
        real = pc.greater_equal(pc.utf8_length(flat), 2)
        of = np.repeat(np.arange(many), words.value_lengths().to_numpy(zero_copy_only=False))[real.to_numpy(zero_copy_only=False)]
        lengths = np.bincount(of, minlength=many)
        coded = flat.filter(real).dictionary_encode()
        cells, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * many + of, return_counts=True)
        self.counts.append((coded.dictionary, cells // many, cells % many + self.documents, tf))
        columns = [pa.array(lengths, pa.int32()) if c == "length" else batch.column(c) for c in self.keys]
        self.rows.append(pa.RecordBatch.from_arrays(columns, names=self.keys))
        self.documents += many

    def packed(self, block: int, access: list[str], by_place: bool) -> pa.RecordBatch:
        """A row per term with the columns of its documents or, ``by_place``, with their places in a first row of the empty term, which holds all documents of the block."""
        rows = pa.Table.from_batches(self.rows)
        # rows equal in all of their columns are one document; ``standing`` is its first row
        numbered = rows.append_column("_row", pa.array(np.arange(rows.num_rows)))
        codes = [pc.fill_null(c.combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in rows.columns]
        _, standing, same = np.unique(np.stack(codes), axis=1, return_index=True, return_inverse=True)
        standing = standing[same.reshape(-1)]
        # places in the order of the ids, and of all columns, nulls first
        plain = pa.table({c: v.cast(pa.int8()) if pa.types.is_boolean(v.type) else v for c, v in zip(numbered.column_names, numbered.columns, strict=True)})
        order = pc.sort_indices(plain, sort_keys=[(c, "ascending") for c in plain.column_names], null_placement="at_start").to_numpy()
        by_all, by_id = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        by_all[order] = np.arange(len(order))
        ids = codes[self.keys.index("doc_id")][order]
        by_id[order] = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]]))
        names = pa.concat_arrays([c[0] for c in self.counts]).dictionary_encode()
        ends = np.cumsum([0, *(len(c[0]) for c in self.counts)])
        numbers = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        term = np.concatenate([numbers[ends[i] + c[1]] for i, c in enumerate(self.counts)])
        row = standing[np.concatenate([c[2] for c in self.counts])]
        tf = np.concatenate([c[3] for c in self.counts])
        cells, at = np.unique(term * rows.num_rows + row, return_inverse=True)
        tf = np.bincount(at, weights=tf, minlength=len(cells)).astype(np.int32)
        term, row = cells // rows.num_rows, cells % rows.num_rows
        order = np.lexsort((by_all[row], tf, by_id[row], term))
        term, row, tf = term[order], row[order], tf[order]
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        offsets = pa.array(np.concatenate([starts, [len(term)]]).astype(np.int32))
        length = rows.column("length").to_numpy()[row]
        total, highest, shortest = (np.add.reduceat(tf.astype(np.int64), starts), np.maximum.reduceat(tf, starts), np.minimum.reduceat(length, starts)) if len(starts) else (tf, tf, length)
        head = pa.table([pa.array(np.full(len(starts), block, np.int32)), names.dictionary.take(pa.array(term[starts])), pa.array(np.diff(offsets.to_numpy()).astype(np.int64)),
                         pa.array(total.astype(np.int64)), pa.array(highest.astype(np.int32)), pa.array(shortest.astype(np.int32))], names=["block", "term", "df", "total", "highest", "shortest"])
        of_documents = ["doc_id", "length", *access]
        if not by_place:
            entries = rows.take(pa.array(row)).append_column("tf", pa.array(tf))
            lists = {c: pa.ListArray.from_arrays(offsets, entries.column(c).combine_chunks()) for c in ("doc_id", "tf", "length", *access)}
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in head.columns), *lists.values()], names=[*head.column_names, *lists])
        first = pa.table([pa.array([block], pa.int32()), pa.array([""]), *(pa.array([0], head.schema.field(c).type) for c in head.column_names[2:])], names=head.column_names)
        lists = {"place": pa.ListArray.from_arrays(offsets, pa.array(row.astype(np.int32))), "tf": pa.ListArray.from_arrays(offsets, pa.array(tf))}
        lists = {c: pa.concat_arrays([pa.nulls(1, v.type), v]) for c, v in lists.items()}
        for c in of_documents:
            whole = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(c).combine_chunks())
            lists[c] = pa.concat_arrays([whole, pa.nulls(len(starts), whole.type)])
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in pa.concat_tables([first, head]).columns), *lists.values()], names=[*head.column_names, *lists])


def packed_terms(docs: DataFrame, blocks: int, *, by_place: bool = False) -> DataFrame:
    """A row per block and term of ``docs``; ``by_place`` as it is stored, with the documents once per block.

    Text is shuffled once, by block, and sorted there; a task then counts and packs one block after the other, so no row of a word and a document is formed.
    Rows equal in id, length and access columns are one document, whose frequencies add up.
    """
    spark = docs.sparkSession
    ship_package(spark)
    access = [c for c in ACCESS_COLUMNS if c in docs.columns]
    placed = docs.select("doc_id", "text", *access, F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"))
    # blocks are dealt in turn: a hash of so few numbers would leave some tasks without one and give others several
    width = min(blocks, max(task_count(spark), BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism))
    near = placed.repartitionById(width, F.pmod("block", F.lit(width))).sortWithinPartitions("block")
    # texts of common characters are split in the task, by tables of bytes; the words of others travel as one string (words hold no spaces)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = near.select("block", "doc_id", *access, F.when(text.contains(DOTTED_I) | text.rlike(OTHER), F.array_join(tokens(text), " ")).otherwise(text).alias("words"))
    kinds = dict(docs.dtypes)
    schema = ("block int, term string, df bigint, total bigint, highest int, shortest int, " + ("place array<int>, tf array<int>, " if by_place else "")
              + f"doc_id array<{kinds['doc_id']}>, " + ("" if by_place else "tf array<int>, ") + "length array<int>" + "".join(f", {c} array<{kinds[c]}>" for c in access))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, packer = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if of[begin] != last:
                    if packer is not None:
                        yield packer.packed(last, access, by_place)
                    last, packer = int(of[begin]), _Packer(["doc_id", "length", *access])
                packer.add(batch.slice(begin, end - begin))
        if packer is not None:
            yield packer.packed(last, access, by_place)

    return words.mapInArrow(pack, schema)


def block_count(n_docs: int, cores: int) -> int:
    """Blocks of a table of ``n_docs`` documents that is written on ``cores`` cores."""
    least, most = BLOCK_DOCUMENTS
    return max(1, -(-n_docs // most), min(-(-n_docs // least), BLOCKS_PER_CORE * cores))


def write_postings(docs: DataFrame, path: str, block_documents: int | None = None) -> None:
    """Write the postings of ``docs`` (doc_id, text and, for searches under permissions, owner_id, org_tag, is_public) below ``path``."""
    spark = docs.sparkSession
    n_docs = docs.count()
    blocks = max(1, -(-n_docs // block_documents)) if block_documents else block_count(n_docs, spark.sparkContext.defaultParallelism)
    packed_terms(docs, blocks, by_place=True).sortWithinPartitions("term", "block").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/terms")
    # a document without words still counts
    total = spark.read.parquet(f"{path}/terms").agg(F.sum("total")).first()[0] or 0
    spark.createDataFrame([(n_docs, total)], "n_docs bigint, total bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def open_postings(spark: SparkSession, path: str) -> Postings | None:
    """The postings below ``path``, None where there are none."""
    try:
        stats = spark.read.parquet(f"{path}/stats").first()
        terms = spark.read.parquet(f"{path}/terms")
    except AnalysisException:
        return None
    n_docs = stats["n_docs"]
    return Postings(terms, n_docs, (stats["total"] or 0) / n_docs if n_docs else 0.0)


@dataclass
class _Asked:
    """Questions of one group, as arrays: per term the questions that have it, and its weight."""

    ids: pa.Array
    rows: dict[str, np.ndarray]
    weights: dict[str, float]
    users: np.ndarray | None
    tags: list[frozenset] | None


def _impact(tf: np.ndarray, length: np.ndarray, mean_length: float, k1: float, b: float) -> np.ndarray:
    return tf / (tf + k1 * (1 - b + b * length / mean_length))


class _Search:
    """What one task has found: the best ``k`` documents of every question, and the score that a further one has to beat."""

    def __init__(self, asked: _Asked, index: tuple[int, float], k: int, least: float, k1: float, b: float):
        self.asked, self.mean_length, self.k, self.least, self.k1, self.b = asked, index[1], k, least, k1, b
        many = len(asked.ids)
        self.best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.bar = np.full(many, least)
        self.skipped = self.scored = 0

    def block(self, rows: pa.Table, documents: dict[str, pa.Array] | None = None) -> None:
        """Scores one block: its rows of the asked terms, in the order of the terms, with the columns of their documents or else with places in ``documents``."""
        terms = rows.column("term").to_pylist()
        highest, shortest = (rows.column(c).to_numpy().astype(float) for c in ("highest", "shortest"))
        bound = np.zeros(len(self.bar))
        for term, most in zip(terms, _impact(highest, shortest, self.mean_length, self.k1, self.b).tolist(), strict=True):
            bound[self.asked.rows[term]] += self.asked.weights[term] * most
        # scores are rounded, so a bound a little below the bar may still reach it
        open_ = np.nonzero((bound > 0) & (bound + 1e-8 >= self.bar))[0]
        self.skipped += int((bound > 0).sum()) - len(open_)
        if not len(open_):
            return
        tf = rows.column("tf").combine_chunks()
        sizes, tf = tf.value_lengths().to_numpy(), tf.flatten().to_numpy().astype(float)
        ends = np.cumsum(sizes)
        if documents is None:
            documents = {c: rows.column(c).combine_chunks().flatten() for c in ("doc_id", "length", *ACCESS_COLUMNS) if c in rows.column_names}
            at = np.arange(len(tf))
        else:
            at = rows.column("place").combine_chunks().flatten().to_numpy()
        met = np.zeros(len(documents["doc_id"]), bool)
        met[at] = True
        docs, number = np.unique(documents["doc_id"].filter(pa.array(met)).to_numpy(zero_copy_only=False), return_inverse=True)
        place = np.zeros(len(met), np.int64)
        place[met] = number
        place = place[at]
        first = np.zeros(len(docs), np.int64)
        first[place[::-1]] = at[::-1]
        impact = _impact(tf, documents["length"].to_numpy().astype(float)[at], self.mean_length, self.k1, self.b)
        step = max(1, SCORE_CELLS // max(1, len(docs)))
        for begin in range(0, len(open_), step):
            some = open_[begin : begin + step]
            spot = np.full(len(self.bar), -1)
            spot[some] = np.arange(len(some))
            scores, matched = np.zeros((len(some), len(docs))), np.zeros((len(some), len(docs)), np.int32)
            for nth, term in enumerate(terms):
                who = spot[self.asked.rows[term]]
                who = who[who >= 0]
                if len(who):
                    span = slice(ends[nth] - sizes[nth], ends[nth])
                    cells = np.ix_(who, place[span])
                    scores[cells] += self.asked.weights[term] * impact[span]
                    matched[cells] += 1
            self.scored += int((matched > 0).sum())
            scores = np.round(scores, SCORE_DIGITS)
            allowed = (matched > 0) & (scores >= self.bar[some][:, None])
            if self.asked.users is not None:
                allowed &= self.visible(some, {c: documents[c].take(pa.array(first)) for c in ACCESS_COLUMNS})
            self.keep(some, docs, np.where(allowed, scores, -np.inf), matched)

    def visible(self, some: np.ndarray, access: dict[str, pa.Array]) -> np.ndarray:
        """Questions x documents: owner, public, or tagged with one of the user's tags."""
        coded = access["org_tag"].dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        holds = np.array([[n in self.asked.tags[q] for n in names] + [False] for q in some.tolist()], bool).reshape(len(some), len(names) + 1)
        known = access["owner_id"].is_valid().to_numpy(zero_copy_only=False)
        owner = (pc.fill_null(access["owner_id"], 0) if pa.types.is_integer(access["owner_id"].type) else access["owner_id"]).to_numpy(zero_copy_only=False)
        mine = (self.asked.users[some][:, None] == owner[None, :]) & known[None, :]
        return holds[:, codes] | mine | pc.fill_null(access["is_public"], False).to_numpy(zero_copy_only=False)[None, :]

    def keep(self, some: np.ndarray, docs: np.ndarray, scores: np.ndarray, matched: np.ndarray) -> None:
        for row in np.nonzero(np.isfinite(scores).any(axis=1))[0].tolist():
            question = int(some[row])
            new = np.nonzero(np.isfinite(scores[row]))[0]
            found = (docs[new], scores[row, new], matched[row, new])
            if question in self.best:
                found = tuple(np.concatenate(x) for x in zip(self.best[question], found, strict=True))
            order = np.lexsort((found[0], -found[1]))[: self.k]
            self.best[question] = tuple(x[order] for x in found)
            if len(order) == self.k:
                self.bar[question] = max(self.least, float(self.best[question][1][-1]))

    def rows(self) -> pa.RecordBatch | None:
        if not self.best:
            return None
        which = np.concatenate([np.full(len(v[0]), q) for q, v in self.best.items()])
        docs, scores, matched = (np.concatenate([v[i] for v in self.best.values()]) for i in range(3))
        return pa.RecordBatch.from_arrays([self.asked.ids.take(pa.array(which)), pa.array(docs), pa.array(scores), pa.array(matched.astype(np.int64))], names=["query_id", "doc_id", "score", "matched"])


def _group(queries: DataFrame, index: Postings, restricted: bool) -> _Asked:
    """The questions of one group on the driver (their cells are counted before), with the weights of their terms."""
    held = queries.select("query_id", F.array_distinct(tokens("text")).alias("terms"), *(["user_id", "user_tags"] if restricted else [])).toArrow()
    rows: dict[str, list[int]] = {}
    for at, terms in enumerate(held.column("terms").to_pylist()):
        for term in terms:
            rows.setdefault(term, []).append(at)
    frequency = {r["term"]: r["df"] for r in _of_terms(index, list(rows)).groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weights = {t: float(np.log(1 + (index.n_docs - df + 0.5) / (df + 0.5))) for t, df in frequency.items()}
    users = tags = None
    if restricted:
        who = held.column("user_id")
        users = (pc.fill_null(who, np.iinfo(np.int64).min) if pa.types.is_integer(who.type) else who).to_numpy()
        tags = [frozenset(x or ()) for x in held.column("user_tags").to_pylist()]
    ids = held.column("query_id").combine_chunks()
    return _Asked(ids, {t: np.array(rows[t]) for t in weights}, weights, users, tags)


def _of_terms(index: Postings, terms: list[str]) -> DataFrame:
    spark = index.terms.sparkSession
    if len(terms) <= PUSHED_TERMS:
        return index.terms.where(F.col("term").isin(terms))
    return index.terms.join(F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string")), "term", "left_semi")


def search(queries: DataFrame, index: Postings, k: int, *, min_score: float = MIN_SCORE, k1: float = K1, b: float = B, open_access: bool = False) -> DataFrame:
    """(query_id, doc_id, score, matched, rank): the best ``k`` visible documents of every question.

    ``queries``: query_id, text, user_id, user_tags (the last two not with ``open_access``).
    """
    restricted = is_restricted(queries, open_access)
    if restricted and not set(ACCESS_COLUMNS) <= set(index.terms.columns):
        raise ValueError("these postings hold no access columns; search them with open_access=True")
    spark = index.terms.sparkSession
    ship_package(spark)
    queries = queries.select("query_id", "text", *(["user_id", "user_tags"] if restricted else []))
    cells = queries.agg(F.sum(F.size(tokens("text")) * (1 + F.size("user_tags") if restricted else F.lit(1))).alias("n")).first()["n"] or 0
    groups = max(1, -(-cells // GROUP_CELLS))
    kinds = dict(queries.dtypes)
    schema = f"query_id {kinds['query_id']}, doc_id {index.terms.schema['doc_id'].dataType.elementType.simpleString()}, score double, matched bigint"
    out = None
    for group in range(groups):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == group) if groups > 1 else queries
        asked = _group(some, index, restricted)
        size = (index.n_docs, index.mean_length)

        def score(found: _Search, rows: pa.Table) -> None:
            if rows.num_rows > 1:  # more than the documents
                documents = rows.slice(0, 1)
                found.block(rows.slice(1), {c: documents.column(c).combine_chunks().flatten() for c in rows.column_names if c in ("doc_id", "length", *ACCESS_COLUMNS)})

        def run(batches: Iterator[pa.RecordBatch], asked: _Asked = asked, size: tuple = size) -> Iterator[pa.RecordBatch]:
            found, rest = _Search(asked, size, k, min_score, k1, b), None
            for batch in batches:
                held = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                blocks = held.column("block").to_numpy()
                edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1])
                for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    score(found, held.slice(begin, end - begin))
                rest = held.slice(int(edges[-1])) if held.num_rows else None  # the last block may go on
            if rest is not None:
                score(found, rest)
            rows = found.rows()
            if rows is not None:
                yield rows

        wanted = [c for c in index.terms.columns if c != "total" and (restricted or c not in ACCESS_COLUMNS)]
        # only the matched postings move, to the task of their block
        met = _of_terms(index, ["", *asked.weights]).select(*wanted).repartition(task_count(spark), "block").sortWithinPartitions("block", "term")
        part = met.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return first_rows(out, ["query_id"], [F.desc("score"), F.asc("doc_id")], k, "rank")


def lexical_topk(queries: DataFrame, docs: DataFrame | Postings, k: int, *, min_score: float = MIN_SCORE, open_access: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank) from stored postings, or from the texts themselves where nothing is stored."""
    if isinstance(docs, Postings):
        return search(queries, docs, k, min_score=min_score, open_access=open_access).drop("matched")
    return bm25_topk(queries, docs, k, min_score=min_score, open_access=open_access)


def all_terms_rescore(queries: DataFrame, index: Postings, k: int, window: int, *, first_weight: float = 0.2, all_terms_weight: float = 1.0, open_access: bool = False) -> DataFrame:
    """Rescore the recall window: first pass times 0.2, plus the full score where all terms match."""
    recall = search(queries, index, window, min_score=0.0, open_access=open_access).drop("rank")
    n_terms = queries.select("query_id", F.size(F.array_distinct(tokens("text"))).alias("n_terms"))
    bonus = F.when(F.col("matched") == F.col("n_terms"), F.col("score")).otherwise(0.0)
    final = F.round(first_weight * F.col("score") + all_terms_weight * bonus, SCORE_DIGITS)
    return first_rows(recall.join(n_terms, "query_id").select("query_id", "doc_id", final.alias("score")), ["query_id"], [F.desc("score"), F.asc("doc_id")], k, "rank")
