"""Alignment of two tokenizers over the same texts, by windows between white-space anchors.

Every text is tokenised in full by a byte-level BPE (A, over space + text) and by SentencePiece (B, which adds the space). The bytes of both token
sequences are verified against space + text; from then on an end of a token is a byte offset in both. A shared end before a token that is marked
by a space on both sides is an anchor; anchors split a text into windows of ids, mostly words. A window is aligned once: inside it all shared ends cut the tokens
into groups, and groups, links and id pairs are remembered under the tuples of its ids (their bytes), until ``MEMO`` windows are known and the memory starts anew. A pair of ids is linked where their tokens share a group; its count is the number of documents (rows) that hold it linked.

Pairs travel as sorted distinct codes (A id times 2^32 plus B id) with multiplicities in a table of the shared folder, so that no text is tokenised
twice; tasks count their documents per pair before anything is shuffled. Counts of up to ``LISTED`` pairs go to the tasks as a sorted list, more by a salted
join; both give the same rows.

Cases: null and empty texts, and texts whose joined bytes differ from space + text (such as one that holds U+2581), have no tokens: zeros and an
empty digest. Strings of special tokens inside texts are plain text. Texts of over ``LONG_TEXT`` characters are tokenised in pieces cut before
a space between two letters, where neither tokenizer can merge across, so memory is bounded by the longest stretch without such a place. Repeated rows
count as documents of their own and get equal results; a null doc_id stays null; extra columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.base import row_key, salted_join, small_enough, stored, text_of
from corpuscope.session import cut_lineage, ship_package

BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MEMO, LONG_TEXT, AT_ONCE = 500_000, 400_000, 1_000_000
#: pairs up to which the counts travel as a list (16 bytes each); a physical choice only
LISTED = 2_000_000
#: distinct pairs that a task counts before it hands on what it has
HELD = 2_000_000

#: links of a group up to which its pairs are written out one by one
WIDE_GROUP = 4_096

# --- fixed values: how byte-level BPE files cut texts before merging ------------------------------
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# --------------------------------------------------------------------------------------------------

_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _byte_level(spec: str) -> tuple:
    """Of a byte-level BPE file: a function from texts to arrays of ids, the bytes of its letters, its vocabulary, and its special tokens (plain text here).

    Where the merges number the tokens in their order, as they do in files of this kind, the ids are ranks and the faster library gives the same ones.
    """
    import tiktoken
    from tokenizers import Tokenizer

    held, letters = json.loads(spec), byte_alphabet()
    own = Tokenizer.from_str(spec)
    special = {i: t.content for i, t in own.get_added_tokens_decoder().items()}
    vocabulary = own.get_vocab(with_added_tokens=False)
    merges = [m if isinstance(m, str) else " ".join(m) for m in held["model"].get("merges", [])]
    singles = sorted(vocabulary[c] for c in letters if c in vocabulary)
    plain = held.get("normalizer") is None and held["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and singles == list(range(256)) and len(vocabulary) == 256 + len(merges) and all(vocabulary.get(m.replace(" ", "")) == 256 + i for i, m in enumerate(merges)):
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
        fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [fast.encode_to_numpy(t).astype(np.int64) for t in texts], letters, vocabulary, special
    own.encode_special_tokens = True
    return lambda texts: [np.array(e.ids, np.int64) for e in own.encode_batch_fast(texts, add_special_tokens=False)], letters, vocabulary, special


def _distinct(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, upto_a: np.ndarray, from_b: np.ndarray, upto_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each group of equal windows, and the number of the group of every window. Hashes only name whom to compare: ids decide."""
    total = np.zeros(len(from_a), np.uint64)
    for ids, begin, end, seed in ((a, from_a, upto_a, 0x9E3779B97F4A7C15), (b, from_b, upto_b, 0xC2B2AE3D27D4EB4F)):
        size = end - begin
        powers = np.cumprod(np.full(int(size.max()), seed, np.uint64))  # wraps
        nth = np.arange(len(ids)) - np.repeat(begin, size)
        total = total * np.uint64(0xD6E8FEB86659FD93) + np.add.reduceat((ids.astype(np.uint64) + np.uint64(1)) * powers[nth], begin)
    _, first, which = np.unique(total, return_index=True, return_inverse=True)
    same = np.ones(len(from_a), bool)
    for ids, begin, end in ((a, from_a, upto_a), (b, from_b, upto_b)):
        size, like = end - begin, first[which]
        same &= size == size[like]
        other = np.repeat(begin[like] - begin, size) + np.arange(len(ids))
        same &= np.logical_and.reduceat(ids == ids[np.minimum(other, len(ids) - 1)], begin)
    alone = np.nonzero(~same)[0]  # a hash that two windows share: they are looked up one by one
    which[alone] = len(first) + np.arange(len(alone))
    return np.concatenate([first, alone]), which


class Tokenizers:
    """Both tokenizers, the bytes of their ids, and the windows aligned so far."""

    def __init__(self, spec: str, model: bytes):
        import sentencepiece

        self.encode_a, letters, vocabulary, special = _byte_level(spec)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for i, content in special.items():
            self.bytes_a[i] = content.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_unknown(i) or self.b.is_control(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        # between a letter and a space no merge is possible where no piece has a space behind something else
        self.splits = not any("▁" in p.lstrip("▁") for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.space_a, self.space_b = (np.array([x[:1] == b" " for x in table]) for table in (self.bytes_a, self.bytes_b))
        self.bits = len(self.bytes_b).bit_length()  # a pair's number in a batch: text, A id, B id
        # ids as written, with what follows inside a group and at its end
        named = lambda many, end: np.array([f"{i}{end}" for i in range(many)], dtype=object)
        self.name_a = named(len(self.bytes_a), ","), named(len(self.bytes_a), "|")
        self.name_b = named(len(self.bytes_b), ","), named(len(self.bytes_b), ";")
        self.forget()

    def forget(self) -> None:
        """Starts the memory of windows anew: per window its number of groups and links, and the end of its linked pairs in ``codes`` and ``times``."""
        self.known: dict[bytes, int] = {}
        self.n_groups, self.n_links, self.ends, self.codes, self.times = (array("q") for _ in range(5))

    def pieces_of(self, text: str) -> list[str]:
        """The text itself, or, if very long, parts whose leading space is left out."""
        if len(text) <= LONG_TEXT or not self.splits:
            return [text]
        parts, begin = [], 0
        for cut in _CUT.finditer(text):
            if cut.start() - begin >= LONG_TEXT:
                parts.append(text[begin : cut.start()])
                begin = cut.end()
        return [*parts, text[begin:]]

    def tokens(self, texts: list[str]) -> list[tuple[str, np.ndarray, list[int]]]:
        """(part, A ids, B ids) of every part."""
        return list(zip(texts, self.encode_a([" " + t for t in texts]), self.b.encode(texts, num_threads=1) if texts else [], strict=True))

    def right(self, part: str, ids_a: np.ndarray, ids_b: list[int]) -> bool:
        """Whether the joined bytes of both token sequences are those of the part with its space."""
        data = b" " + part.encode("utf-8", "surrogatepass")
        return b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == data and b"".join(map(self.bytes_b.__getitem__, ids_b)) == data

    def windows(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of two verified token sequences: the numbers of their windows, the byte offset where each ends, the ids as written in the order of the groups, and the end
        of each window in that order."""
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        spot = np.searchsorted(ends_b, ends_a)
        shared = ends_b[spot] == ends_a
        next_a, next_b = np.nonzero(shared)[0] + 1, spot[shared] + 1  # where the group behind each shared end begins
        first_a, first_b = (np.concatenate([[0], x[:-1]]).astype(np.int64) for x in (next_a, next_b))
        many_a, many_b = next_a - first_a, next_b - first_b
        written = np.empty(len(a) + len(b), dtype=object)
        last_b = np.zeros(len(b), bool)
        last_b[next_b - 1] = True
        for ids, last, names, place in ((a, shared, self.name_a, np.arange(len(a)) + np.repeat(first_b, many_a)), (b, last_b, self.name_b, np.arange(len(b)) + np.repeat(next_a, many_b))):
            written[place] = names[0][ids]
            written[place[last]] = names[1][ids[last]]
        anchor = np.ones(len(next_a), bool)  # the last shared end closes the last window
        anchor[:-1] = self.space_a[a[next_a[:-1]]] & self.space_b[b[next_b[:-1]]]
        closing = np.nonzero(anchor)[0]
        upto_a, upto_b = next_a[closing], next_b[closing]
        from_a, from_b = (np.concatenate([[0], x[:-1]]).astype(np.int64) for x in (upto_a, upto_b))
        first, which = _distinct(a, b, from_a, upto_a, from_b, upto_b)
        # ids of A carry a mark, so that the bytes of both tuples in a row tell where the second begins
        raw_a, raw_b = (a | 1 << 31).astype("<u4").tobytes(), b.astype("<u4").tobytes()
        numbers, fresh, known = [], [], self.known
        for at, i, j, x, y in zip(first.tolist(), *((4 * side[first]).tolist() for side in (from_a, upto_a, from_b, upto_b)), strict=True):
            key = raw_a[i:j] + raw_b[x:y]
            number = known.get(key)
            if number is None:
                number = known[key] = len(known)
                fresh.append(at)
            numbers.append(number)
        opening = np.concatenate([[0], closing[:-1] + 1]).astype(np.int64)
        self.align(a, b, opening[fresh], closing[fresh] + 1, first_a, first_b, many_a, many_b)
        return np.array(numbers, np.int64)[which], ends_a[upto_a - 1], written, upto_a + upto_b

    def align(self, a: np.ndarray, b: np.ndarray, opening: np.ndarray, closing: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, many_a: np.ndarray, many_b: np.ndarray) -> None:
        """Remembers new windows, given by their first group and the one behind their last: all pairs of ids that share a group."""
        groups = closing - opening
        group = np.repeat(opening - np.concatenate([[0], np.cumsum(groups)])[:-1].astype(np.int64), groups) + np.arange(groups.sum())
        window = np.repeat(np.arange(len(groups)), groups)
        links = many_a[group] * many_b[group]
        wide = links > WIDE_GROUP  # few and large, as in a text without spaces: pairs of distinct ids with their products
        narrow = group[~wide]
        count = links[~wide]
        nth = np.arange(count.sum()) - np.repeat(np.concatenate([[0], np.cumsum(count)])[:-1].astype(np.int64), count)
        width = np.repeat(many_b[narrow], count)
        codes = [a[np.repeat(first_a[narrow], count) + nth // width] << 32 | b[np.repeat(first_b[narrow], count) + nth % width]]
        owner, times = [np.repeat(window[~wide], count)], [np.ones(len(nth), np.int64)]
        for at in np.nonzero(wide)[0].tolist():
            g = group[at]
            (x, n), (y, m) = np.unique(a[first_a[g] : first_a[g] + many_a[g]], return_counts=True), np.unique(b[first_b[g] : first_b[g] + many_b[g]], return_counts=True)
            codes.append((x[:, None] << 32 | y[None, :]).ravel())
            times.append((n[:, None] * m[None, :]).ravel())
            owner.append(np.full(len(codes[-1]), window[at]))
        owners = np.concatenate(owner)
        order = np.argsort(owners, kind="stable") if wide.any() else np.arange(len(owners))
        begin = len(self.codes)
        self.codes.frombytes(np.concatenate(codes)[order].astype(np.int64).tobytes())
        self.times.frombytes(np.concatenate(times)[order].astype(np.int64).tobytes())
        self.ends.frombytes((begin + np.cumsum(np.bincount(owners, minlength=len(groups)))).astype(np.int64).tobytes())
        self.n_groups.frombytes(groups.astype(np.int64).tobytes())
        self.n_links.frombytes(np.bincount(window, links, len(groups)).astype(np.int64).tobytes())

    def summarised(self, texts: list[str | None], whole: bool) -> list[pa.Array]:
        """Columns: tokens of A, of B, groups, links, digest, distinct pair codes, their multiplicities, and the groups as text if ``whole``."""
        if len(self.known) > MEMO or len(self.codes) > HELD:
            self.forget()
        parts = [self.pieces_of(t) if t else [] for t in texts]
        owners = [at for at, some in enumerate(parts) for _ in some]
        made = self.tokens([p for some in parts for p in some])
        wrong = {o for o, one in zip(owners, made, strict=True) if not self.right(*one)}
        good = [(o, one) for o, one in zip(owners, made, strict=True) if o not in wrong]
        owner = np.array([o for o, _ in good], np.int64)
        none = np.zeros(0, np.int64)
        a, b = (np.concatenate([np.asarray(one[k], np.int64) for _, one in good]) if good else none for k in (1, 2))
        per_text = lambda of, n: np.bincount(of, n, len(texts)).astype(np.int64) if len(of) else np.zeros(len(texts), np.int64)
        n_a, n_b = (per_text(owner, [len(one[k]) for _, one in good]) for k in (1, 2))
        number, end, names, upto = self.windows(a, b) if len(a) else (none, none, none, none)
        part_ends = np.cumsum([1 + len(one[0].encode("utf-8", "surrogatepass")) for _, one in good])
        of = owner[np.searchsorted(part_ends, end)]
        n_groups, n_links, ends, codes, times = (np.array(x, np.int64) for x in (self.n_groups, self.n_links, self.ends, self.codes, self.times))
        first = np.concatenate([[0], ends]).astype(np.int64)[number]
        many = ends[number] - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(many)])[:-1].astype(np.int64), many) + np.arange(many.sum())
        code, every = codes[at], times[at]
        number_of = np.repeat(of, many) << (32 + self.bits) | (code >> 32) << self.bits | code & 0xFFFFFFFF
        if (every == 1).all():
            pair, pair_times = np.unique(number_of, return_counts=True)
        else:
            pair, where = np.unique(number_of, return_inverse=True)
            pair_times = np.bincount(where, every, len(pair))
        held = pair & (1 << (32 + self.bits)) - 1
        distinct = (held >> self.bits) << 32 | held & (1 << self.bits) - 1
        offsets = pa.array(np.searchsorted(pair >> (32 + self.bits), np.arange(len(texts) + 1)), pa.int32())
        bounds = np.concatenate([[0], upto]).astype(np.int64)[np.searchsorted(of, np.arange(len(texts) + 1))].tolist()
        names = names.tolist()
        written = ["".join(names[i:j])[:-1] for i, j in zip(bounds, bounds[1:], strict=False)]
        digests = [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]
        return [pa.array(n_a), pa.array(n_b), pa.array(per_text(of, n_groups[number])), pa.array(per_text(of, n_links[number])), pa.array(digests, pa.string()),
                pa.ListArray.from_arrays(offsets, pa.array(distinct, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(pair_times.astype(np.int64))),
                pa.array(written if whole else [None] * len(texts), pa.string())]


@lru_cache(maxsize=2)
def _loaded(spec: str, model: bytes) -> Tokenizers:
    return Tokenizers(spec, model)


def alignments(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, whole: bool = True) -> DataFrame:
    """Per row: ``doc_id``, ``text_hash``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``pairs``, ``times`` and, if ``whole``, ``groups``.

    The tokenizer files are read on the driver and shipped; their size is fixed.
    """
    ship_package(docs.sparkSession)
    spec, model = Path(byte_bpe).read_text(), Path(pieces).read_bytes()
    rows = docs.select(row_key(docs).alias("key"), text_of(docs).alias("text")).select("key.doc_id", "key.text_hash", "text")
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "groups"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _loaded(spec, model)
        for every in batches:
            sizes = np.cumsum(pc.utf8_length(every.column("text")).to_numpy(zero_copy_only=False))
            at = 0
            while at < every.num_rows:  # slices of about AT_ONCE characters
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, "right")))
                batch, at = every.slice(at, upto - at), upto
                made = both.summarised(batch.column("text").to_pylist(), whole)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *made], names=["doc_id", "text_hash", *names])

    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                               "pairs array<long>, times array<long>, groups string")
    return out if whole else out.drop("groups")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair`` and ``n``: the number of rows that hold it. Each task counts before the shuffle and keeps ``HELD`` pairs at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        give = lambda codes, n: pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["pair", "n"])
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                codes = batch.column("pairs").slice(start, 2_000).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(codes):
                    codes, n = np.unique(codes, return_counts=True)
                    parts, held = [*parts, (codes, n)], held + len(codes)
                if held >= HELD:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if 2 * held >= HELD:
                        yield give(*parts[0])
                        parts, held = [], 0
        if parts:
            yield give(*_merged(parts))

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _scored_by_list(rows: DataFrame, counts: DataFrame, kept: list[str]) -> DataFrame:
    """``n_best`` and ``count_sum`` from all counts, as sorted arrays in every task."""
    table = counts.toArrow()
    codes, n = (table.column(c).to_numpy().astype(np.int64) for c in ("pair", "n"))
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    best = np.zeros(int(codes[-1] >> 32) + 1 if len(codes) else 1, np.int64)
    np.maximum.at(best, codes >> 32, n)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2_000):
                batch = whole.slice(start, 2_000)
                sizes = batch.column("pairs").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                own = batch.column("pairs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                count = n[np.searchsorted(codes, own)] if len(own) else own
                ends = np.cumsum(sizes)
                sums = []
                for values in (times * (count == best[own >> 32]) if len(own) else own, times * count):
                    upto = np.concatenate([[0], np.cumsum(values)]).astype(np.int64)
                    sums.append(pa.array(upto[ends] - upto[ends - sizes]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *sums], names=[*kept, "n_best", "count_sum"])

    return rows.select(*kept, "pairs", "times").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "n_best long, count_sum long"]))


def _scored_by_join(rows: DataFrame, counts: DataFrame, kept: list[str]) -> DataFrame:
    """The same by a salted join; rows equal in id and text meet under one key and share their sums."""
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("best"))
    ranked = salted_join(counts.withColumn("a", F.shiftright("pair", 32)), best, ["a"], F.xxhash64("pair")).select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("top"))
    key = F.struct("doc_id", "text_hash").alias("key")
    each = rows.select(key, F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("key", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = salted_join(each, ranked, ["pair"], F.xxhash64("key")).groupBy("key").agg(F.sum(F.col("times") * F.col("top")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    copies = rows.groupBy(key).agg(F.count("*").alias("copies"))
    each = copies.join(sums, "key", "left").select("key", *(F.coalesce(F.expr(f"{c} div copies"), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")))
    every = rows.select(key, *kept)
    return salted_join(every, each, ["key"], F.xxhash64("n_a", "groups_sha256", F.rand(7))).select(*kept, "n_best", "count_sum")


def linked(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, listed: int = LISTED) -> DataFrame:
    """Per row: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    ``n_best`` are the links whose pair has the highest count of its A id in the corpus (ties included), ``count_sum`` adds up the counts over all links.
    """
    rows = stored(alignments(docs, byte_bpe, pieces, whole=False))
    counts = cut_lineage(pair_counts(rows))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return (_scored_by_list if small_enough(counts, listed) else _scored_by_join)(rows, counts, kept)
