"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The pass keeps, for every boundary of the text, the piece that ends there on the surviving path, and looks back no further than the
longest piece. Whenever the backpointer paths of all boundaries that a later piece could still start from meet in one boundary, the ids
up to it are committed and forgotten. For a unigram model the surviving piece is the one of highest total score. The scores of a BPE model are
merge ranks, and adding them up does not give its segmentation; there the surviving piece is the one that the merges leave: a sequence of pieces
is the BPE result exactly when each piece and each pair of neighbours merges to itself, so every boundary has one such piece. Either
way ids equal the library's.

Cases: null counts as empty and has no ids; otherwise the text gets a space in front, spaces become U+2581, and characters without a piece
become byte pieces. U+2581 itself is written as bytes, so decoding restores every text exactly. Rows equal in doc_id and text get equal results, an empty table gives no rows, and columns of other names are left out. Boundaries that no piece of
the vocabulary spans (before a space, around a line end) are met by all paths; the stretches between them, all worked by the same pass, are remembered, up to
``MEMO`` of them. The vocabulary is read on the driver and shipped; its size is fixed.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame

from corpuscope.llm.base import map_text, row_key

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, MEMO, SHORT, COMMIT_EVERY = "▁", 400_000, 64, 256
#: letters of the scripts that word pieces are made of; other characters end a stretch of letters
LETTERS = "a-zA-Z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u0370-\u03FF\u0400-\u052F"
LETTER = f"[{LETTERS}]"


class Vocabulary:
    """Pieces with scores; ``kinds`` marks byte (b), control (c), unknown (u) and unused (x) entries."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: dict[int, str], unigram: bool = False):
        self.pieces, self.scores, self.kinds, self.unigram = pieces, scores, kinds, unigram
        self.ids = {p: i for i, p in enumerate(pieces) if i not in kinds}
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.made: dict[str, tuple[float, str, str]] = {}
        if not unigram:
            self.halve()
        self.byte_ids = {int(pieces[i][3:5], 16): i for i, k in kinds.items() if k == "b"}
        self.memo: dict[str, bytes] = {}
        self.prefixes: dict[str, str] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        kinds = {i: k for i in every for k, test in (("b", model.is_byte), ("c", model.is_control), ("u", model.is_unknown), ("x", model.is_unused)) if test(i)}
        return cls([model.id_to_piece(i) for i in every], [model.get_score(i) for i in every], kinds)

    @cached_property
    def stretches(self) -> re.Pattern | None:
        """Stretches of text between boundaries that no piece spans, as far as the vocabulary has such boundaries."""
        many = [p for p in self.ids if len(p) > 1]
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in many):
            return None
        crossing = re.compile(f"{LETTER}[^{SPACE}{LETTERS}]|[^{SPACE}{LETTERS}]{LETTER}")
        if any(crossing.search(p) for p in many):
            return re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
        return re.compile(f"\n|{SPACE}*{LETTER}+|{SPACE}*[^{SPACE}\n{LETTERS}]+|{SPACE}+")

    @cached_property
    def raw(self) -> list[bytes]:
        out = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i, kind in self.kinds.items():
            out[i] = bytes([int(self.pieces[i][3:5], 16)]) if kind == "b" else " ⁇ ".encode() if kind == "u" else b""
        return out

    def merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Pieces that merging the best-ranked pair again and again leaves, and the two halves of the last merge."""
        rank, none, halves = self.rank.get, np.inf, None
        parts = list(text)
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            halves = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], none)
        return parts, halves

    def halve(self) -> None:
        """Keep the pieces that the merges make from their own characters, each with its formation rank and last two halves."""
        for piece in list(self.ids):
            if len(piece) == 1:
                self.made[piece] = (-1, piece, piece)
                continue
            parts, halves = self.merged(piece)
            if len(parts) == 1:
                self.made[piece] = (self.rank[piece], *halves)
        self.ids = {p: i for p, i in self.ids.items() if p in self.made}

    def stays(self, left: str, piece: str) -> bool:
        """Whether ``piece`` may follow ``left`` (empty: the start): no merge across their boundary comes before those inside them.

        Undoes the later of the two last merges again and again, so that only the parts that touch are left to compare.
        """
        if not left:
            return True
        known = self.pairs.get((left, piece))
        if known is not None:
            return known
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        key, limit, rank, made = (left, piece), np.inf, self.rank.get, self.made
        while True:
            across = rank(left + piece)
            if across is not None and across < limit:
                self.pairs[key] = False
                return False
            a, b = made[left], made[piece]
            if a[0] > b[0]:
                limit, left = a[0], a[2]
            elif b[0] < 0:
                self.pairs[key] = True
                return True
            else:
                limit, piece = b[0] + 1, b[1]

    def spell(self, char: str) -> list[int]:
        return [self.byte_ids.get(b, 0) for b in char.encode("utf-8")]

    def stream(self, chars: str) -> Iterator[int]:
        """Ids of normalised text, committed as soon as all surviving paths meet.

        In a BPE model the piece that ends at a boundary depends on the characters before it only, so short stretches with the same beginning share their backpointers.
        """
        known = self.prefixes if len(chars) <= SHORT and not self.unigram else None
        if known is not None and len(known) >= MEMO:
            known.clear()
        ids, stays, longest, unigram, long = self.ids, self.stays, self.longest, self.unigram, len(chars) > COMMIT_EVERY
        done = 0  # boundary up to which ids are out
        back: dict[int, str] = {0: ""}  # boundary -> piece that ends there on the surviving path
        score = {0: 0.0}
        floor = 0  # no piece crosses this boundary: the text start, or a character without a piece
        for end in range(1, len(chars) + 1):
            if known is not None and (piece := known.get(chars[:end])) is not None:
                back[end] = piece
                continue
            last = chars[end - 1]
            if last not in ids:
                yield from self._out(back, done, end - 1)
                yield from self.spell(last)
                done = floor = end
                back, score = {end: ""}, {end: 0.0}
                continue
            begin = end - longest
            if begin < floor:
                begin = floor
            if unigram:
                total, _, piece = max((score[a] + self.scores[ids[p]], a, p) for a in range(begin, end) if a in back and (p := chars[a:end]) in ids)
                back[end], score[end] = piece, total
            else:
                while True:
                    piece = chars[begin:end]
                    if piece in ids and begin in back and stays(back[begin], piece):
                        back[end] = piece
                        break
                    begin += 1
                if known is not None:
                    known[chars[:end]] = piece
            if long and end - done >= COMMIT_EVERY and end % 32 == 0:
                meet = self._meeting(back, done, end)
                if meet > done:
                    yield from self._out(back, done, meet)
                    for old in range(done, meet):
                        back.pop(old, None), score.pop(old, None)
                    done = meet
        yield from self._out(back, done, len(chars))

    def _meeting(self, back: dict[int, str], done: int, end: int) -> int:
        live = {at for at in range(max(done, end - self.longest + 1), end + 1) if at in back}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(max(done, top - len(back[top])))
        return live.pop()

    def _out(self, back: dict[int, str], done: int, end: int) -> list[int]:
        ids = []
        while end > done:
            ids.append(self.ids[back[end]])
            end -= len(back[end])
        return ids[::-1]

    def packed(self, chars: str) -> bytes:
        """Ids of normalised text as 32-bit little-endian numbers."""
        if self.stretches is None:
            return np.fromiter(self.stream(chars), "<i4").tobytes()
        out = []
        for stretch in self.stretches.findall(chars):
            ids = self.memo.get(stretch)
            if ids is None:
                ids = array("i", self.stream(stretch)).tobytes()
                if len(stretch) <= SHORT:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    self.memo[stretch] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<i4")
        parts = (" " + text).split(SPACE)
        literal = np.array(self.spell(SPACE), "<i4").tobytes()
        return np.frombuffer(literal.join(self.packed(p.replace(" ", SPACE)) for p in parts), "<i4")

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids; ids outside the vocabulary raise IndexError, bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("pieces", "scores", "kinds", "unigram", "ids", "rank", "made", "longest", "byte_ids")} | {"memo": {}, "pairs": {}, "prefixes": {}}


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row: ``doc_id``, ``_key`` parts and ``ids``."""
    return _with_vocabulary(docs, model, "ids array<int>", lambda voc, texts: [(voc.encode(t),) for t in texts])


def round_trips(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row: ``doc_id``, ``n_ids``, ``ids_sha256`` (32-bit little-endian ids), ``decoded_sha256`` and ``exact``: decoding gives the text."""

    def run(voc: Vocabulary, texts: list) -> list[tuple]:
        out = []
        for text in texts:
            ids = voc.encode(text)
            back = voc.decode(ids)
            out.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
        return out

    return _with_vocabulary(docs, model, "n_ids long, ids_sha256 string, decoded_sha256 string, exact boolean", run)


def _with_vocabulary(docs: DataFrame, model: str, added: str, run) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    rows = docs.select(docs["doc_id"].alias("doc_id"), row_key(docs)["text_hash"].alias("text_hash"), docs["text"].cast("string").alias("text"))
    return map_text(rows, "text", added, lambda texts: run(shared.value, texts))
