"""Byte-level BPE ids of whole texts, at corpus speed.

A text is cut before every blank that a non-blank follows. No pre-token of the vocabulary's pattern crosses
such a cut, so the ids of the pieces joined are the ids of the text. Each distinct piece of a slice is encoded once,
frequent ones are kept for the life of the worker, and the ids are gathered with numpy. An added token of the vocabulary that
stands in a text is one id, and the texts before and after it are encoded as texts of their own.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Pieces kept by a worker between slices; others are encoded again when they come back.
KEPT_PIECES = 400_000
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = r"^[A-Za-z]+[!-/:-@\[-`{-~]*$"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Place of an installed vocabulary file; a name with a slash is taken as a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _printable_bytes() -> dict[int, str]:
    """Byte-level vocabularies write bytes as printable characters: their own, or the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Many short-lived objects without cycles are made here, which the collector would look through again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class PieceEncoder:
    """Encodes arrays of texts; one per worker and vocabulary."""

    _by_path: dict[str, PieceEncoder] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.byte_chars = _printable_bytes()
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        #: Added tokens that take blanks around them or depend on neighbours: texts with any are encoded in one go.
        self.by_context = any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        self.added_pattern = "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.kept: dict[str, bytes] = {}
        #: Ids by word that has a blank before it.
        self.words: dict[str, bytes] = {}
        #: Ids by run of marks.
        self.marks: dict[str, bytes] = {}
        self.tails = {c: [t.id for t in self.model.tokenize(c)] for c in ",.:;!?"}
        self.newline = np.array([t.id for t in self.model.tokenize(self.byte_chars[10])], np.uint32).tobytes()

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _encode(self, piece: str) -> bytes:
        """Ids as 32-bit integers in bytes, which take a fifth of the memory of Python's integers."""
        if "\n" in piece:
            # A newline between other characters than blanks is a pre-token of its own.
            lines = piece.split("\n")
            if all(x.strip() == x and x for x in [lines[0][1:] if piece[0] == " " else lines[0], *lines[1:]]):
                return self.newline.join(map(self.ids, lines))
        # A run of Latin letters with at most one blank before it is a single pre-token, whatever the Unicode version; a mark after it is another.
        blank = piece[:1] == " "
        word = piece[1:] if blank else piece
        tail = self.tails.get(word[-1:], [])
        stem = word[:-1] if tail else word
        if stem.isalpha() and (stem.isascii() or max(stem) < "ɐ"):
            written = stem if stem.isascii() else "".join(map(self.byte_chars.__getitem__, stem.encode()))
            ids = [t.id for t in self.model.tokenize(self.byte_chars[32] + written if blank else written)] + tail
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def ids(self, piece: str) -> bytes:
        found = self.kept.get(piece)
        if found is None:
            found = self._encode(piece)
            if len(self.kept) < KEPT_PIECES and len(piece) < 64:
                self.kept[piece] = found
        return found

    def _tail(self, marks: str) -> bytes:
        """Ids of a run of ASCII marks after letters, a pre-token of its own."""
        found = self.marks.get(marks)
        if found is None:
            found = array("I", [t.id for t in self.model.tokenize(marks)]).tobytes()
            if len(self.marks) < KEPT_PIECES and len(marks) < 64:
                self.marks[marks] = found
        return found

    def after_blank(self, words: list[str]) -> list[bytes]:
        """Ids of words with a blank before each; words of ASCII letters, with marks after them or not, take a short path, and their letters are looked up alone."""
        kept, tokenize, blank = self.words, self.model.tokenize, self.byte_chars[32]
        found = [kept.get(w) for w in words]
        new = [i for i, known in enumerate(found) if known is None]
        if not new:
            return found
        plain = pc.match_substring_regex(pa.array([words[i] for i in new]), _PLAIN).to_pylist()
        room = KEPT_PIECES - len(kept)
        with _no_cycles():
            for i, short in zip(new, plain, strict=True):
                word = words[i]
                if short:
                    stem = word.rstrip(_MARKS)
                    ids = kept.get(stem)
                    if ids is None:
                        ids = array("I", [t.id for t in tokenize(blank + stem)]).tobytes()
                        if room > 0 and len(stem) < 64:
                            kept[stem] = ids
                            room -= 1
                    found[i] = ids + self._tail(word[len(stem) :]) if len(stem) < len(word) else ids
                    continue
                found[i] = (self.newline + self.ids(word[1:]) if word[1:] else b"") if word[:1] == "\n" else self._encode(f" {word}")
                if room > 0 and len(word) < 64:
                    kept[word] = found[i]
                    room -= 1
        return found

    def _irregular(self, text: str) -> list[str]:
        """Pieces of a text that has runs of blanks: a cut must have a non-blank after it."""
        out: list[str] = []
        for i, part in enumerate(text.split(" ")):
            if i and (not part or part[0].isspace()):
                out[-1] += " " + part
            else:
                out.append(part if not i else " " + part)
        return out

    def _with_added(self, text: str) -> bytes:
        """Ids of a text that has added tokens in it."""
        if self.by_context:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        parts = re.split(f"({self.added_pattern})", text)
        return b"".join(self.added[x] if i % 2 else b"".join(map(self.ids, self._irregular(x))) for i, x in enumerate(parts))

    def _has_added(self, texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts), bool)
        for token in self.added:
            found |= pc.match_substring(texts, token).fill_null(False).to_numpy(zero_copy_only=False)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts one after another, and the offsets (n + 1) of each text's ids."""
        texts = texts.cast(pa.string()) if not pa.types.is_string(texts.type) else texts
        # A newline between other characters than blanks is a pre-token of its own, so texts are cut before it too: words after one differ less than pairs do.
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_pylist()
        after = pc.replace_substring(coded.dictionary, "\n", "", max_replacements=1)  # newlines are at the head of a word only
        head = pc.utf8_slice_codeunits(after, 0, 1)
        odd_word = pc.or_(pc.equal(head, ""), pc.utf8_is_space(head)).to_numpy(zero_copy_only=False)
        first = np.zeros(len(index), bool)
        first[ends[:-1]] = True
        odd = odd_word[index] & ~first
        ids_of = self.after_blank(words)
        # First pieces have no blank before them, and texts with runs of blanks get pieces of their own.
        n_texts = len(texts)
        odd_text = np.zeros(n_texts, bool)
        if odd.any():
            odd_text[np.searchsorted(ends, np.flatnonzero(odd), "right") - 1] = True
        added_text = self._has_added(texts)
        odd_text |= added_text
        extra: list[bytes] = []
        for i, at in enumerate(ends[:-1]):
            if odd_text[i]:
                text = texts[i].as_py()
                extra.append(self._with_added(text) if added_text[i] else b"".join(map(self.ids, self._irregular(text))))
                index[at : ends[i + 1]] = -1
            else:
                word = words[index[at]]
                extra.append(self.ids(word) if word else b"")
            index[at] = len(ids_of) + len(extra) - 1
        ids_of += [*extra, b""]  # the last, at -1, is empty
        lengths = np.fromiter(map(len, ids_of), np.int64, len(ids_of)) // 4
        values = np.frombuffer(b"".join(ids_of), np.uint32)
        starts = np.cumsum(lengths) - lengths
        took = lengths[index]
        after = np.cumsum(took)
        total = int(after[-1]) if len(after) else 0
        out = values[np.repeat(starts[index] - (after - took), took) + np.arange(total)]
        offsets = np.concatenate([[0], after])[ends]
        return out, offsets


def forget() -> None:
    """Drop the encoders of this worker with the pieces that they keep, for work without tokens that comes after."""
    PieceEncoder._by_path.clear()
