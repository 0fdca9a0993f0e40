"""Token ids of whole texts, with a bounded memory of words already seen."""

from __future__ import annotations

import codecs
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
from tokenizers import Tokenizer

#: Bytes of each of the two generations of words that a process remembers, about; what a word takes besides its letters and ids.
REMEMBERED, ENTRY = 56 << 20, 190
#: Words that are kept between tasks and generations: the first ones met, which are the most frequent.
KEPT = 80_000
#: Code points of a word from which it is not remembered.
LONG = 64

#: A word of letters with ASCII marks before and behind. An apostrophe before letters may bind them, so none is allowed there.
_SHAPE = re.compile(r"([!-&(-/:-@\[-`{-~]*)([^\W\d_]+)([!-/:-@\[-`{-~]*)")
_loaded: dict[str, WordTokens] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> str:
    """Byte-level letters: printable bytes stand for themselves, the others for what follows U+00FF."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


def word_tokens(path: str) -> WordTokens:
    """The process's own, so that what it remembers outlives a task."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def _plain(core: str) -> bool:
    """Whether a word is letters alone whose lower case is beyond doubt: as the whole tokenizer would make it."""
    return bool(core) and core.isalpha() and (core.isascii() or ("Σ" not in core and core.lower().isalpha() and unicodedata.is_normalized("NFC", core)))


class _Memory(dict):
    """Ids by word; what is missing is learned."""

    def __init__(self, learn) -> None:
        super().__init__()
        self.learn = learn

    def __missing__(self, part: str) -> bytes:
        return self.learn(part)


class WordTokens:
    """Ids by a lower-casing, byte-level tokenizer whose pre-tokens never hold white space.

    For such a tokenizer a text's ids are those of its parts between spaces and
    line feeds, one after another; so each part is encoded once and looked up
    after that. A part of letters, with or without ASCII marks around it, is lower-cased here
    and given to the merges at once, its marks are looked up; any other goes through the whole
    tokenizer. What is remembered is bounded in bytes. A vocabulary of another kind is refused.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        #: Bytes an id takes, and its little-endian type: the narrower one where all ids fit.
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.code = "H" if self.width == 2 else "I"
        self.native = sys.byteorder == "little" and array(self.code).itemsize == self.width
        self.merges = self.tokenizer.model
        self.letters = _byte_letters()
        self.marks: dict[str, bytes] = {"": b""}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.young, self.old, self.bytes = _Memory(self._learn), {}, 0
        self._check(path)

    def _check(self, path: str) -> None:
        """Refuse a vocabulary for which a text's ids are not those of its parts, or letters not merged as they are here."""
        texts = ["The quick, brown\nfox isn't  here", " a  b", "x\n\ny z.", "Éa ñ-o (Straße) 中文 9a", "''s 't re'd a'b !?a"]
        for text in texts:
            if np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes() != next(self.encode([text])):
                raise ValueError(f"{path} does not tell words apart at white space, or does not lower-case them byte by byte")

    def _whole(self, part: str) -> bytes:
        return self._packed(self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids)

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if self.native else np.array(ids, self.dtype).tobytes()

    def _word(self, core: str) -> bytes:
        """Ids of a word that _plain accepts."""
        low = core.lower()
        if not low.isascii():
            low = codecs.charmap_decode(low.encode(), "strict", self.letters)[0]
        return self._packed([t.id for t in self.merges.tokenize(low)])

    def _around(self, marks: str) -> bytes:
        """Ids of marks that stand beside letters."""
        found = self.marks.get(marks)
        if found is None:
            found = self._whole(marks)
            if len(marks) <= 4 and len(self.marks) < 10_000:
                self.marks[marks] = found
        return found

    def _learn(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            shape = _SHAPE.fullmatch(part)
            core = shape[2] if shape else ""
            if not _plain(core) or self.added.search(part):
                ids = self._whole(part)
            elif core == part:
                ids = self._word(core)
            else:
                ids = dict.get(self.young, core) or self.old.get(core)
                if ids is None:
                    ids = self._word(core)
                    if len(core) <= LONG:
                        self._remember(core, ids)
                ids = self._around(shape[1]) + ids + self._around(shape[3])
        if len(part) <= LONG:
            self._remember(part, ids)
        return ids

    def _remember(self, part: str, ids: bytes) -> None:
        if self.bytes > REMEMBERED:
            self.old = dict(self.young)
            self._keep()
        self.young[part] = ids
        self.bytes += len(part) + len(ids) + ENTRY

    def _keep(self) -> None:
        # the first words met go on to be the first ones
        kept = list(islice(self.young.items(), KEPT))
        self.young.clear()
        self.young.update(kept)
        self.bytes = sum(len(k) + len(v) + ENTRY for k, v in kept)

    def shrink(self) -> None:
        """Forget all but the first words met; an idle process keeps no more."""
        self.old = {}
        self._keep()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as bytes, of dtype, without special tokens added."""
        ids = self.young.__getitem__
        for text in texts:
            yield b"".join(map(ids, text.replace("\n", " ").split(" ")))
