"""Token ids of whole texts by a public tokenizer, with a bounded memory of words already encoded."""

from __future__ import annotations

import os
import sys
import types
from array import array
from collections.abc import Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from sievelab.llm.common import text_groups

CACHED_CORES = 600_000  # words without the signs after them, where white space is dropped; about 120 MB
CACHED_PIECES = 400_000  # the same where spaces are kept; about 80 MB
GROUP_CHARS = 1 << 22
LEARNED = 1 << 15  # pieces tokenized at once
SPECIAL = "<|"  # how the vocabularies' own tokens begin
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WHITE, SIGN, LETTER = 1, 2, 3  # bytes: white space, SIGNS, ASCII letters and digits
KEPT, DROPPED = b" \n", b" \t\n\v\f\r"  # white space that begins a word, and that only parts words
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)  # A-Z


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be printed, else one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printed]
    return dict(zip(printed, printed, strict=True)) | {b: 256 + i for i, b in enumerate(rest)}


def byte_kinds(white: bytes = KEPT) -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    for kind, chars in ((WHITE, white), (SIGN, SIGNS.encode()), (LETTER, bytes(b for b in range(128) if chr(b).isalnum()))):
        kinds[list(chars)] = kind
    return kinds


def pieces(texts: Sequence[str], kinds: np.ndarray, keeps_space: bool = True) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Words of all texts, each with the white space before it, and how many end in each text or before it.

    The signs that end a word are a piece of their own if an ASCII letter or digit or a letter from U+00C0 to U+023F but U+0130
    is before them. The pieces of a text, joined, are the text; unless ``keeps_space``, without white space and with A-Z lower-cased.
    """
    joined = pa.array(texts, pa.large_string())
    _, offsets, data = joined.buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
    code = np.frombuffer(data, np.uint8)[: offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    kind = kinds[code]
    first = np.zeros(len(code) + 1, dtype=bool)
    first[:-1] = kind == WHITE
    first[offsets] = True
    sign = np.append(kind == SIGN, False)
    last = np.flatnonzero(sign[:-1] & (~sign[1:] | first[1:]))  # of each run of signs
    at = np.flatnonzero(sign[1:] & ~sign[:-1] & ~first[1:]) + 1
    at = at[first[last[np.searchsorted(last, at)] + 1]]
    before, lead = code[at - 1], code[at - 2]
    latin = (before & 0xC0 == 0x80) & (lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7)))
    latin &= ~((lead == 0xC4) & (before == 0xB0))  # the lower case of U+0130 ends in a mark
    first[at[(kind[at - 1] == LETTER) | latin]] = True
    starts = np.flatnonzero(first[:-1])
    if not keeps_space:
        kept = kind != WHITE
        upto = np.r_[0, np.cumsum(kept)]
        starts, offsets, code = upto[starts], upto[offsets], LOWER[code[kept]]
        starts = starts[np.diff(starts, append=len(code)) > 0]
        data = pa.py_buffer(code)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(code))), data or pa.py_buffer(b""))
    return found, np.searchsorted(starts, offsets[1:])


class Memory:
    """A map of bounded size: the entries of the last half are kept, and older ones as they are used."""

    def __init__(self, most: int):
        self.half, self.new, self.old = most // 2, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.new[key] = found
        return found

    def trim(self) -> None:
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}


class WordEncoder:
    """Ids of texts, equal to the tokenizer's own.

    Both public vocabularies cut a text at white space, and between letters and signs, before they merge. So a word's ids do
    not depend on its neighbours. All words of a group of texts are numbered by Arrow; each distinct one is encoded once, its
    letters and the signs after them apart, and the texts' ids are gathered by number. ``keeps_space``: the vocabulary joins a space
    to the word that follows (byte-level), otherwise white space is dropped and case too. What is not of this form goes to the
    tokenizer whole, as do texts where a cut could depend on more than the word (adjacent white space that is kept) or
    that may spell one of the vocabulary's own tokens. At most ``words`` are known at a time, or ``cores`` where white space is
    dropped; beyond, those met once are forgotten.
    """

    def __init__(self, path: str, keeps_space: bool, words: int = CACHED_PIECES, cores: int = CACHED_CORES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if not all(token.content.startswith(SPECIAL) for token in added):
            raise ValueError(f"added tokens that do not begin with {SPECIAL}")
        self.keeps_space = keeps_space
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        letters = byte_letters()
        self.letters = np.array([0, *(letters[b] for b in range(1, 256))], dtype="<u4")  # byte 0 parts words
        self.kinds = byte_kinds(KEPT if keeps_space else DROPPED)
        self.most_words = words if keeps_space else cores
        self.newline = self._encode(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        """No word is known; number 0 stands for words that cannot be told alone."""
        self.numbers: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, dtype=self.dtype)  # the ids of all known words, one after the other
        self.start, self.size, self.uses = array("q", [0]), array("q", [0]), array("q", [0])

    def trim(self) -> None:
        """Forget words met only once; the uses of the others count half from now on, so that words no longer met go too."""
        uses = np.frombuffer(self.uses, np.int64)
        kept = (uses >= 2).tolist()
        words = [word for word, n in self.numbers.items() if n and kept[n]]
        number = np.array([self.numbers[word] for word in words], dtype=np.int64)
        words = pa.array(words, pa.large_string()).to_numpy(zero_copy_only=False).tolist()  # copies, so that the memory among the old ones is given back
        ids, upto = self._gather(number)
        halved = uses[number] // 2
        self._forget()
        self._add(words, ids, np.diff(upto))
        self.uses[1:] = array("q", halved.tobytes())

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _tokenized(self, words: list[str]) -> list[list[int]]:
        """Ids of runs of letters, which the tokenizer does not cut further."""
        raw = np.frombuffer("\0".join(words).encode(), np.uint8)
        forms = self.letters[raw].tobytes().decode("utf-32-le").split("\0") if words else []
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(form)] for form in forms]

    def _learn_words(self, words: list[str]) -> None:
        """Number words that are not known yet, where white space is dropped."""
        plain, forms, others = [], [], []
        for word in words:
            form = word.lower()
            # characters below U+0250 are their own normal form, and all but one have a single lower case
            if form.isalpha() and (form.isascii() or (max(form) < "ɐ" and "İ" not in word)):
                plain.append(word)
                forms.append(form)
            else:
                others.append(word)
        self._add_lists(plain, self._tokenized(forms))
        self._add_encoded(others)

    def _learn_pieces(self, words: list[str]) -> None:
        """The same where spaces are kept."""
        plain, lines, others, odd = [], [], [], []
        for word in words:
            if word.isalpha() or (word[0] == " " and word[1:].isalpha()):
                plain.append(word)
            elif word[0] == "\n" and word[1:].isalpha():
                lines.append(word)
            elif any(map(str.isspace, word[1:])):  # other white space in a word may touch the next cut
                odd.append(word)
            else:
                others.append(word)
        found = self._tokenized([*plain, *(word[1:] for word in lines)])
        line = np.frombuffer(self.newline, self.dtype).tolist()
        found[len(plain) :] = [line + ids for ids in found[len(plain) :]]
        self._add_lists(plain + lines, found)
        self._add_encoded(others)
        self.numbers.update(dict.fromkeys(odd, 0))

    def _add_lists(self, words: list[str], found: list[list[int]]) -> None:
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self._add(words, np.fromiter(chain.from_iterable(found), dtype=self.dtype, count=int(size.sum())), size)

    def _add_encoded(self, words: list[str]) -> None:
        found = self._encode(words)
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.dtype.itemsize
        self._add(words, np.frombuffer(b"".join(found), dtype=self.dtype), size)

    def _add(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        held = self.start[-1] + self.size[-1]
        if held + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:held], np.zeros(held // 2 + 2 * len(ids), dtype=self.dtype)])
        self.flat[held : held + len(ids)] = ids
        self.numbers.update(zip(words, range(len(self.start), len(self.start) + len(words)), strict=True))
        self.start.frombytes((held + np.cumsum(size) - size).tobytes())
        self.size.frombytes(size.tobytes())
        self.uses.frombytes(bytes(size.nbytes))

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words, one after the other, and where each begins and the last one ends."""
        length = np.frombuffer(self.size, dtype=np.int64)[numbers]
        start = np.frombuffer(self.start, dtype=np.int64)[numbers]
        upto = np.r_[0, np.cumsum(length)]
        place = np.repeat(start - upto[:-1], length)
        place += np.arange(upto[-1])
        return self.flat[place], upto

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Number of each of these distinct words."""
        find = lambda: np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))
        found = find()
        crowded = lambda: len(self.numbers) + np.count_nonzero(found < 0) > self.most_words
        if (found < 0).any() and crowded():
            self.trim()
            found = find()
        if (found < 0).any() and crowded():
            self._forget()
            found = find()
        new = np.flatnonzero(found < 0)
        missing = [words[i] for i in new.tolist()]
        for i in range(0, len(missing), LEARNED):
            (self._learn_pieces if self.keeps_space else self._learn_words)(missing[i : i + LEARNED])
        found[new] = np.fromiter(map(self.numbers.get, missing), np.int64, len(missing))
        return found

    def _odd(self, words: list[str], numbers: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Words, by place, that show that their text cannot be cut."""
        if not self.keeps_space:
            return np.zeros(len(codes), dtype=bool)
        # a lone space or line break is beside white space, but for the text's end
        lone = np.array([word in (" ", "\n") for word in words], dtype=bool)
        found = lone[codes]
        found[ends[ends > 0] - 1] = False
        return found | (numbers == 0)[codes]

    def _cut(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of texts word by word; none where words cannot be told alone."""
        every, ends = pieces(texts, self.kinds, self.keeps_space)
        coded = every.dictionary_encode()
        codes = coded.indices.to_numpy()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = self._numbers(words)
        odd = np.r_[0, np.cumsum(self._odd(words, numbers, codes, ends))]
        np.frombuffer(self.uses, np.int64)[numbers] += np.bincount(codes, minlength=len(words))
        ids, upto = self._gather(numbers)
        ids, offsets = pa.py_buffer(ids), pa.py_buffer(upto * self.dtype.itemsize)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, offsets, ids]).take(coded.indices)
        _, offsets, ids = found.buffers()
        upto = np.frombuffer(offsets, np.int64)[: len(codes) + 1] // self.dtype.itemsize
        every = np.frombuffer(ids or b"", dtype=self.dtype)
        spans = zip(upto[np.r_[0, ends[:-1]]].tolist(), upto[ends].tolist(), np.diff(odd[np.r_[0, ends]]).tolist(), strict=True)
        return [None if bad else every[a:b] for a, b, bad in spans]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text, as arrays of ``dtype``."""
        out: list[np.ndarray] = []
        for group in text_groups(texts, GROUP_CHARS):
            part = [texts[i] for i in group]
            whole = [SPECIAL in t for t in part]
            found = self._cut(["" if w else t for w, t in zip(whole, part, strict=True)])
            for text, w, ids in zip(part, whole, found, strict=True):
                out.append(np.frombuffer(self._encode([text])[0], dtype=self.dtype) if w or ids is None else ids)
        return out


def _kept() -> dict[tuple[str, bool], WordEncoder]:
    return sys.modules.setdefault("sievelab_kept_encoders", types.ModuleType("sievelab_kept_encoders")).__dict__


def encoder(path: str, keeps_space: bool) -> WordEncoder:
    """This process's encoder for a vocabulary; a worker keeps it from task to task.

    Spark may ship this function by value, so what is kept lives in a module of its own, not among this one's globals.
    """
    kept = _kept()
    if (path, keeps_space) not in kept:
        kept[path, keeps_space] = WordEncoder(path, keeps_space)
    return kept[path, keeps_space]


def forget_encoders() -> None:
    """Give back what this process's encoders hold; for tasks that follow the last encoding, as workers live on through other stages."""
    kept = _kept()
    for key in [key for key in kept if isinstance(key, tuple)]:
        del kept[key]
    pa.default_memory_pool().release_unused()
