"""SentencePiece ids of whole texts by a table of every prefix's last token, and texts from ids.

A merge-type vocabulary merges the neighbours whose joined piece has the highest score, leftmost first, until no two join. Two facts
replace the merging. A run of tokens is what merging leaves exactly if each pair of neighbours is what merging leaves of
their two texts. And a prefix of that run is what merging leaves of the prefix. So each prefix of a text has one last token:
of the tokens that an automaton finds to end there, the one that goes with the last token of the prefix before it. The ids
then follow from the end of the text backwards.
"""

from __future__ import annotations

import re
import struct
import sys
import types
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievelab.llm.common import full_text, id_key, text_groups, with_null_ids
from sievelab.llm.word_ids import Memory

SPACE = "▁"  # stands for a space in pieces
UNKNOWN_TEXT = " ⁇ "
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in the model file
MERGE_TYPE = 2  # kind of model in the model file
CACHED_WORDS = 400_000
CACHED_PAIRS = 1_000_000
CACHED_CHARS = 64  # longer words are not kept
GROUP_CHARS = 1 << 21
NEVER = float("-inf")


def message_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else number()
        yield key >> 3, raw[at : at + size]
        at += size


class Piece(NamedTuple):
    text: str
    score: float
    kind: int


class Run(NamedTuple):
    """How a token comes about from its characters: the score of each merge, and the first and last symbol before each one."""

    scores: list[float]
    firsts: list[str]
    lasts: list[str]


def read_model(path: str) -> tuple[list[Piece], bool]:
    """The pieces of a model file by id, and whether a space is put before each text."""
    with open(path, "rb") as file:
        raw = file.read()
    pieces, trainer, normalizer = [], {}, {}
    for field, value in message_fields(raw):
        if field == 1:
            found = dict(message_fields(value))
            pieces.append(Piece(found[1].decode(), struct.unpack("<f", found.get(2, bytes(4)))[0], found.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(message_fields(value))
        elif field == 3:
            normalizer = dict(message_fields(value))
    kinds = {p.kind for p in pieces}
    if trainer.get(3) != MERGE_TYPE or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or sum(p.kind == BYTE for p in pieces) != 256:
        raise ValueError("only merge-type models with all bytes and no user-defined pieces are known")
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("only models that leave texts as they are, but for spaces, are known")
    return pieces, bool(normalizer.get(3, 1))


class PieceModel:
    """Ids of texts and texts of ids, as the sentencepiece library gives them for the same model file.

    Texts are cut before they are looked at where no piece reaches across: before spaces, if no piece has one behind another character,
    and around characters that no piece holds. The ids of short words are kept in a memory of bounded size.
    """

    def __init__(self, path: str, words: int = CACHED_WORDS):
        self.pieces, self.space_before = read_model(path)
        normal = [(i, p) for i, p in enumerate(self.pieces) if p.kind == NORMAL]
        self.score = {p.text: p.score for _, p in normal}
        self.tokens = [p.text for p in self.pieces]  # characters that are no piece come behind
        self.lone: dict[str, int] = {}
        self.runs: dict[int, Run | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = Memory(words)
        self.automaton = ahocorasick.Automaton()
        for i, p in normal:
            self.automaton.add_word(p.text, (i, len(p.text)))
        self.automaton.make_automaton()
        self.dtype = np.dtype("<u2" if len(self.pieces) <= 1 << 16 else "<u4")
        byte = {int(p.text[3:-1], 16): i for i, p in enumerate(self.pieces) if p.kind == BYTE}
        self.byte_ids = [byte[b] for b in range(256)]
        self.byte_of = {i: bytes([b]) for b, i in byte.items()}
        self.control = {i for i, p in enumerate(self.pieces) if p.kind == CONTROL}
        self.raw = [self._surface(i, p) for i, p in enumerate(self.pieces)]
        self.cut = self._cut([p.text for _, p in normal])

    def _surface(self, token: int, piece: Piece) -> bytes:
        if piece.kind == BYTE:
            return self.byte_of[token]
        if piece.kind == CONTROL:
            return b""
        return (UNKNOWN_TEXT if piece.kind == UNKNOWN else piece.text.replace(SPACE, " ")).encode()

    @staticmethod
    def _cut(pieces: list[str]) -> re.Pattern | None:
        held = set().union(*pieces)
        alone = re.escape("".join(c for c in map(chr, range(32)) if c not in held))
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            return None
        return re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]+" if alone else ""))

    def _run(self, token: int) -> Run | None:
        """The merges of a token's own text; none if they end otherwise, so that no text ever holds the token."""
        symbols = list(self.tokens[token])
        run = Run([], [symbols[0]], [symbols[-1]])
        while len(symbols) > 1:
            best, at = NEVER, -1
            for i in range(len(symbols) - 1):
                score = self.score.get(symbols[i] + symbols[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            run.scores.append(best)
            run.firsts.append(symbols[0])
            run.lasts.append(symbols[-1])
        return run

    def run(self, token: int) -> Run | None:
        if token not in self.runs:
            self.runs[token] = self._run(token)
        return self.runs[token]

    def _goes_with(self, left: int, right: int) -> bool:
        """Whether merging leaves these two tokens of their joined texts.

        Each token's merges go on as if it were alone until a merge across the border comes before the next one of either. Equal
        scores go from left to right.
        """
        a, b = self.run(left), self.run(right)
        if a is None or b is None:
            return False
        i = j = 0
        while True:
            next_a = a.scores[i] if i < len(a.scores) else NEVER
            next_b = b.scores[j] if j < len(b.scores) else NEVER
            across = self.score.get(a.lasts[i] + b.firsts[j])
            if across is not None and across > next_a and across >= next_b:
                return False
            if next_a == next_b == NEVER:
                return True
            if next_a >= next_b:
                i += 1
            else:
                j += 1

    def goes_with(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self._goes_with(left, right)
        return found

    def _lone(self, char: str) -> int:
        """A number for a character that is no piece."""
        if char not in self.lone:
            self.lone[char] = len(self.tokens)
            self.tokens.append(char)
        return self.lone[char]

    def last_tokens(self, text: str) -> list[int]:
        """The last token of each prefix of ``text``, from the first character on."""
        last: list[int] = []
        done, known = 0, self.pairs.get
        for end, (token, length) in self.automaton.iter(text):
            if end < done:
                continue  # found already, there is only one
            while done < end:
                last.append(self._lone(text[done]))
                done += 1
            before = end - length
            if before < 0:
                fits = self.run(token) is not None
            else:
                fits = known((last[before], token))
                if fits is None:
                    fits = self.goes_with(last[before], token)
            if fits:
                last.append(token)
                done += 1
        while len(last) < len(text):
            last.append(self._lone(text[len(last)]))
        return last

    def _word(self, word: str) -> bytes:
        last, at, ids = self.last_tokens(word), len(word), []
        while at:
            token = last[at - 1]
            at -= len(self.tokens[token])
            if token < len(self.pieces):
                ids.append(token)
            else:
                ids.extend(self.byte_ids[b] for b in reversed(self.tokens[token].encode()))
        return np.array(ids[::-1], dtype=self.dtype).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, without begin and end."""
        if not text:
            return np.zeros(0, dtype=self.dtype)
        escaped = (SPACE if self.space_before else "") + text.replace(" ", SPACE)
        words = self.cut.findall(escaped) if self.cut else [escaped]
        found = list(map(self.words.new.get, words))  # older entries are looked up below
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    word = words[i]
                    found[i] = self.words.get(word)
                    if found[i] is None:
                        found[i] = self._word(word)
                        if len(word) <= CACHED_CHARS:
                            self.words.new[word] = found[i]
            self.words.trim()
        return np.frombuffer(b"".join(found), dtype=self.dtype)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids. Bytes that are no UTF-8 become U+FFFD one by one; control ids have no text."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        first = next((i for i in ids if self.pieces[i].kind != CONTROL), None)
        stripped = self.space_before and first is not None and self.pieces[first].kind == NORMAL and self.pieces[first].text[0] == SPACE
        raw = b"".join(map(self.raw.__getitem__, ids))
        try:
            text = raw.decode() if self.control.isdisjoint(ids) else None
        except UnicodeDecodeError:
            text = None
        if text is None:
            text = "".join(self._decoded(ids))
        return text[1:] if stripped else text

    def _decoded(self, ids: list[int]) -> Iterator[str]:
        """The same where bytes may form no character; any other id, control ids too, ends a run of bytes."""
        held = b""
        for i in [*ids, None]:
            if i is not None and i in self.byte_of:
                held += self.byte_of[i]
                continue
            while held:
                size = next((n for n in range(1, 5) if _is_character(held[:n])), 0)
                yield held[:size].decode() if size else "�"
                held = held[max(size, 1) :]
            if i is not None:
                yield self.raw[i].decode()


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def piece_model(path: str) -> PieceModel:
    """This process's model; a worker keeps it from task to task (in a module of its own, as Spark may ship this by value)."""
    kept = sys.modules.setdefault("sievelab_kept_pieces", types.ModuleType("sievelab_kept_pieces")).__dict__
    if path not in kept:
        kept[path] = PieceModel(path)
    return kept[path]


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every document of ``docs`` (doc_id, text), by the model file at ``path``.

    The file must be at the same place on every worker. Null and empty texts have no ids, null doc_ids stay null, repeated rows stay
    repeated, other columns are ignored. A very long text is encoded whole, in memory of a few times its size.
    """

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for group in text_groups(texts, GROUP_CHARS):
                ids = [model.encode(texts[i]) for i in group]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = np.concatenate(ids).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(group.start, len(ids)), lists], names=["doc_id", "ids"])

    rows = docs.select(id_key(), full_text().alias("text"))
    return with_null_ids(rows.mapInArrow(ids_of, "doc_id long, ids array<int>"))


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and text of every row of ``encoded`` (doc_id, ids); null ids read as none. An id that the model lacks is an error."""

    def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            column = batch.column("ids")
            flat = column.values.to_numpy(zero_copy_only=False)
            offsets, known = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            spans = zip(offsets[:-1], offsets[1:], known, strict=True)
            texts = [model.decode(flat[a:b]) if ok else "" for a, b, ok in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(texts_of, "doc_id long, ids array<int>, text string")
