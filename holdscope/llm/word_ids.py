"""Token ids of whole texts, with each distinct word segmented once per task.

For a tokenizer that drops white space and cannot join across it, the ids of a text are the ids of its words, one
after another. A task keeps a bounded table from word to ids and looks words up. A new word takes what it shares with
others from the table too: small letters, and the letters before its closing punctuation. Only what is new then reaches
the tokenizer.
"""

from __future__ import annotations

import re
from functools import lru_cache
from os.path import commonprefix

from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: Words in the younger half of a task's table; when it is full, it becomes the older half and a new one begins.
TABLE_WORDS = 350_000
#: Longer words are segmented, but not kept.
KEPT_CHARS = 64
#: ``str.split`` also cuts at these, which are no white space to a tokenizer.
NOT_SPACE = re.compile("[\x1c-\x1f]")
CLOSING = ".,;:!?"
#: Below this no character combines with another, so case and letters of a word can be looked at one by one.
COMBINING = "̀"
ODD_CASE = "İ"
PROBES = ("the", "thanonontioniner", "\xe9leai", "stra\xdfe", "\xf1andu", "zqxj", "a", "internationalization")


class WordTable(dict):
    """Word to the little-endian unsigned 32-bit ids that the tokenizer gives it."""

    def __init__(self, path: str):
        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        added = tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens of this tokenizer depend on what stands around them")
        packed = [i.to_bytes(4, "little") for i in range(max([tokenizer.get_vocab_size() - 1, *added]) + 1)]
        self._packed = packed.__getitem__
        # A text is cut at its added tokens first; what stands between is encoded apart.
        self._added = {t.content: packed[i] for i, t in added.items()}
        contents = sorted(self._added, key=len, reverse=True)
        self._opens = commonprefix(contents)
        self._cut = re.compile("(" + "|".join(map(re.escape, contents)) + ")").split if contents else None
        tokenizer.encode_special_tokens = True  # a word that looks like one in small letters is none
        self._encode = tokenizer.encode
        self._model = tokenizer.model
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: How a byte above ASCII is written in the vocabulary.
        self._bytes = {}
        for lead, tail in [(c, d) for c in range(0xC3, 0xCD) for d in range(0x80, 0xC0)]:
            first, second = shown(bytes([lead, tail]).decode())[0][0]
            self._bytes |= {lead: first, tail: second}
        whole = lambda w: self._encode(w, add_special_tokens=False).ids
        # Whether letters are one word to it whatever their case, and punctuation after them another.
        self._apart = all(
            self.letters(w) == whole(w) == whole(w.capitalize()) and whole(w.upper()) == whole(w.upper().lower())
            and all(whole(w + p) == whole(w) + whole(p) for p in (*CLOSING, "..", "!?"))
            for w in PROBES
        )
        self._older: dict[str, bytes] = {}

    def letters(self, word: str) -> list[int]:
        """Ids of small letters, from the model alone: nothing is left to normalise or to cut."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self._bytes)
        return [t.id for t in self._model.tokenize(word)]

    def _pack(self, ids: list[int]) -> bytes:
        return b"".join(map(self._packed, ids))

    def segment(self, word: str) -> bytes:
        plain = word.isascii() or (max(word) < COMBINING and ODD_CASE not in word)
        if plain and self._apart and len(word) <= KEPT_CHARS:
            small = word.lower()
            if small != word:
                return self[small]
            if word.isalpha():
                return self._pack(self.letters(word))
            stem = word.rstrip(CLOSING)
            if stem and stem != word and stem.isalpha():
                return self[stem] + self[word[len(stem) :]]
        return self._pack(self._encode(word, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        if not word:
            return b""
        ids = self._older.get(word)
        if ids is None:
            ids = self.segment(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= TABLE_WORDS:
                self._older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """All ids of a text; none for a null."""
        if not text:
            return b""
        if self._cut and self._opens in text:
            parts = self._cut(text)
            if len(parts) > 1:
                return b"".join([self._added.get(p) or self._words(p) for p in parts])
        return self._words(text)

    def _words(self, text: str) -> bytes:
        words = text.split(" ") if NOT_SPACE.search(text) else text.split()
        return b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def word_table(path: str) -> WordTable:
    """The table of this Python worker; it lives as long as the worker does."""
    return WordTable(path)
