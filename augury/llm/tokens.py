"""Token ids of whole texts by the tokenizers library, with a bounded memory of recent pieces.

The pre-tokenizer of byte-level BPE cuts a text into pieces that are encoded one by one. Some of its
cuts follow from a few neighbouring bytes alone; the texts of a batch are cut there, as one byte
array, and each distinct piece of the batch is encoded by the library unless it is remembered.
The ids of the texts are then gathered with numpy. Where a cut isn't certain none is made: what
is between two certain cuts goes to the library whole, and so do the texts of any other tokenizer.
"""

from __future__ import annotations

import functools
import json
import os
from itertools import compress, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from augury.llm.common import release_memory

#: Bytes that the remembered pieces, their ids and the table of them may take.
MEMORY_BYTES = 48 << 20
#: What an entry takes beside its piece and its ids.
ENTRY_BYTES = 160
#: Longer pieces hardly repeat and are not remembered.
LONGEST = 64
#: Words that the model is given at once.
WORDS = 256
#: Texts are encoded in groups of about so many bytes.
GROUP_BYTES = 4 << 20
_OTHER, _LETTER, _DIGIT, _SIGN, _BLANK, _SPACE = range(6)


def _classes() -> np.ndarray:
    """The class of each byte; control characters and all from 0x80 on are other."""
    out = np.full(256, _OTHER, np.uint8)
    out[0x21:0x7F] = _SIGN
    out[0x30:0x3A] = _DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = _LETTER
    out[0x09:0x0E] = _SPACE
    out[0x20] = _BLANK
    return out


_CLASS = _classes()
#: A run of letters below U+0250, with or without a blank before it, is one piece whatever stands around.
_WORD = f"^ ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]{{1,{LONGEST}}}$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def certain_cuts(data: np.ndarray) -> np.ndarray:
    """Whether the pre-tokenizer starts a piece at each byte, as far as that is certain.

    Certain are: white space after anything else; a letter, digit or sign after one of another of
    these classes, but no letter after an apostrophe (it may be a contraction); anything of these
    classes after a single white space other than a blank.
    """
    n = len(data)
    kind = np.concatenate((np.zeros(3, np.uint8), _CLASS[data]))  # three more at the start: looking back never wraps
    wide = np.concatenate((np.zeros(3, np.uint8), data))
    now, before, second = kind[3:], kind[2:-1], kind[1:-2]
    in_class = (now >= _LETTER) & (now <= _SIGN)
    solid = (kind >= _LETTER) & (kind <= _SIGN)
    # The last byte of a character of two or more bytes whose lead is that of no white space.
    high = wide >= 0x80
    two = (wide[2:-1] >= 0xC3) & (wide[2:-1] <= 0xDF)
    three = (wide[1:-2] >= 0xE4) & (wide[1:-2] <= 0xF4)
    solid[3:] |= high[3:] & (two | three)
    letter = kind == _LETTER
    letter[3:] |= high[3:] & (wide[2:-1] == 0xC3) & (wide[3:] != 0x97) & (wide[3:] != 0xB7)
    cut = (now >= _BLANK) & solid[2:-1]
    other_class = in_class & (before >= _LETTER) & (before <= _SIGN) & (now != before)
    cut |= other_class & ((wide[2:-1] != 0x27) | (now != _LETTER))
    cut |= ((now == _DIGIT) | (now == _SIGN)) & letter[2:-1]
    cut |= in_class & (before == _SPACE) & solid[1:-2]
    return cut if n else np.zeros(0, bool)


class _Memory:
    """Pieces and their ids, in one flat array; when it is full, what was used in the fewest groups of texts goes, half of it or more."""

    def __init__(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = np.zeros(1 << 14, np.int64)
        self.n_ids = self.n = self.key_bytes = 0

    def bytes(self) -> int:
        return self.key_bytes + 4 * self.n_ids + ENTRY_BYTES * self.n

    def add(self, pieces: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        """Adds pieces, whose ids stand in flat one after another."""
        n, ids = self.n + len(pieces), self.n_ids + len(flat)
        if ids > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(ids - len(self.ids), len(self.ids)), np.uint32)))
        if n > len(self.start):
            more = np.zeros(max(n - len(self.start), len(self.start)), np.int64)
            self.start, self.size, self.used = (np.concatenate((a, more)) for a in (self.start, self.size, self.used))
        self.ids[self.n_ids : ids] = flat
        self.start[self.n : n] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[self.n : n] = sizes
        self.used[self.n : n] = 1
        self.slots.update(zip(pieces, range(self.n, n), strict=True))
        self.n, self.n_ids, self.key_bytes = n, ids, self.key_bytes + sum(map(len, pieces))

    def forget(self) -> None:
        """Keeps the half that was used most, and counts its uses half from now on."""
        used = self.used[: self.n]
        keep = used > np.median(used) if self.n else np.zeros(0, bool)
        pieces = list(compress(self.slots, keep.tolist()))  # slots are numbered in order
        sizes, kept = self.size[: self.n][keep], used[keep]
        flat = gather(self.ids, self.start[: self.n][keep], sizes)
        self.__init__()
        self.add(pieces, sizes, flat)
        self.used[: self.n] = (kept + 1) // 2


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts of flat that start there and are so long, one after another."""
    upto = np.cumsum(size)
    total = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    where = np.repeat((start - (upto - size)).astype(kind), size)
    where += np.arange(total, dtype=kind)
    return flat[where]


class Encoder:
    """encode(texts) gives the ids of a column of texts as one array, and where each text's end."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = special_as_text
        self.vocabulary = self._tok.get_vocab_size(with_added_tokens=True)
        made = json.loads(Path(path).read_text(encoding="utf-8"))
        cutter = made.get("pre_tokenizer") or {}
        self._cuts = not made.get("normalizer") and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space", True)
        # Texts that hold an added token, which pieces might cut, are encoded whole.
        self._added = [] if special_as_text else [t["content"].encode() for t in made.get("added_tokens", [])]
        self._memory = _Memory()
        if self._cuts:
            self._prepare_words()

    def _prepare_words(self) -> None:
        """The library's model behind a splitter at line breaks, for words in the letters of byte-level BPE."""
        from tokenizers import Tokenizer, pre_tokenizers

        self._words = Tokenizer(self._tok.model)
        self._words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        # The letter of each byte, as the pre-tokenizer itself writes it.
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._letters = {byte: spell(chr(byte))[0][0][-1] for byte in range(0x80) if byte != 0x0A}
        for byte in range(0x80, 0xC0):  # as the second byte of a character
            self._letters[byte] = spell(bytes((0xC3, byte)).decode())[0][0][1]
        for byte in (*range(0xC3, 0xCA),):  # leads of the characters that words may hold
            self._letters[byte] = spell(bytes((byte, 0x80)).decode())[0][0][0]
        self._letters[0xC2] = spell("\xaa")[0][0][0]
        self._bytes = np.ones(self.vocabulary, np.int64)
        for token, k in self._tok.get_vocab(with_added_tokens=False).items():
            self._bytes[k] = len(token)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, ids of all). Words go to the model many at a time, all else to the tokenizer."""
        sizes = np.full(len(pieces), -1, np.int64)
        order, flat = [], []
        plain = pc.match_substring_regex(pa.array(pieces, pa.large_string()), _WORD).to_numpy(zero_copy_only=False) if self._cuts else np.zeros(len(pieces), bool)
        words = np.flatnonzero(plain)
        if len(words):
            raw = "\n".join(compress(pieces, plain)).encode()
            mapped = raw.decode("latin-1").translate(self._letters).split("\n")
            for at in range(0, len(words), WORDS):
                some = mapped[at : at + WORDS]
                ids = np.array(self._words.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, np.int64)
                # A token's letters are the bytes it stands for, so words end where the sums of both agree.
                ends = np.searchsorted(np.cumsum(self._bytes[ids]), np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))) + 1
                sizes[words[at : at + WORDS]] = np.diff(ends, prepend=0)
                flat.append(ids.astype(np.uint32))
            order.append(words)
        rest = np.flatnonzero(sizes < 0).tolist()
        for at in range(0, len(rest), 256):
            some = rest[at : at + 256]
            found = self._raw([pieces[k] for k in some])
            sizes[some] = list(map(len, found))
            order.append(np.array(some, np.int64))
            flat += found
        if not order:
            return sizes, np.zeros(0, np.uint32)
        by = np.concatenate(order)
        start = np.zeros(len(pieces), np.int64)
        start[by] = np.cumsum(sizes[by]) - sizes[by]
        return sizes, gather(np.concatenate(flat), start, sizes)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, the end of each text in them); null is empty. end_id, if given, closes each text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        ids, sizes, at = [], [], 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + GROUP_BYTES, "right")) - 1)
            made = self._group(data[ends[at] : ends[upto]], ends[at : upto + 1] - ends[at], end_id)
            ids.append(made[0])
            sizes.append(made[1])
            at = upto
        release_memory()
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))

    def _group(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        begins, n = offsets[:-1], len(offsets) - 1
        cut = certain_cuts(data) if self._cuts else np.zeros(len(data), bool)
        if self._cuts and self._added:
            raw = data.tobytes()
            for token in self._added:
                place = raw.find(token)
                while place >= 0:
                    k = int(np.searchsorted(offsets, place, "right")) - 1
                    cut[offsets[k] : offsets[k + 1]] = False
                    place = raw.find(token, int(offsets[k + 1]))
        cut[begins[begins < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        many = np.searchsorted(starts, offsets)  # pieces before each text
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = parts.dictionary_encode()
        start, size, flat = self._entries(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if end_id is not None:
            index = np.insert(index, many[1:], len(start))
            start, size, flat = np.append(start, len(flat)), np.append(size, 1), np.append(flat, np.uint32(end_id))
            many = many + np.arange(n + 1)
        sizes = size[index]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        return gather(flat, start[index], sizes), np.diff(upto[many])

    def _entries(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size) of each distinct piece in a flat array of ids, and that array."""
        memory = self._memory
        if memory.bytes() > MEMORY_BYTES:
            memory.forget()
        slot = np.fromiter(map(memory.slots.get, pieces, repeat(-1)), np.int64, len(pieces))
        memory.used[slot[slot >= 0]] += 1
        missing = np.flatnonzero(slot < 0)
        new = list(map(pieces.__getitem__, missing.tolist()))
        sizes, ids = self._learn(new)
        begin = np.cumsum(sizes) - sizes
        start, size = memory.start[slot], memory.size[slot]
        start[missing], size[missing] = memory.n_ids + begin, sizes
        flat = np.concatenate((memory.ids[: memory.n_ids], ids))
        # What doesn't fit is used now and not remembered.
        room = max(0, MEMORY_BYTES + MEMORY_BYTES // 4 - memory.bytes()) // (ENTRY_BYTES + LONGEST)
        kept = np.flatnonzero(np.fromiter(map(len, new), np.int64, len(new)) <= LONGEST)[:room]
        if len(kept) == len(new):
            memory.add(new, sizes, ids)
        else:
            memory.add(list(map(new.__getitem__, kept.tolist())), sizes[kept], gather(ids, begin[kept], sizes[kept]))
        return start, size, flat


@functools.lru_cache(maxsize=2)
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One per Python worker."""
    return Encoder(path, special_as_text)
