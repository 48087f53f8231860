"""Texts to token ids of a public vocabulary, inside tasks.

The vocabulary splits at white space and drops it, so a text's ids are those of
its words in turn.  A task process keeps the ids of the words it has met and
looks words up; new words are encoded many at a time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Entries of a process's caches of written and of encoded words, about 120
#: and 180 MB when full; a full one is emptied.  They only save time.
WORDS, CORES = 600_000, 900_000
#: New words, and words of texts that wait for them, before they are encoded.
NEW_WORDS, WAITING_WORDS = 20_000, 400_000

#: Letters that normalisation leaves alone and that make one pre-token however
#: many stand together: a-z and the Latin ones U+00DF .. U+00FF but U+00F7.
_LETTERS = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"
#: Ascii marks, no apostrophe (that may begin a contraction): after a letter,
#: at a word's end, always pre-tokens of their own.
_MARKS = rb"[!-&(-/:-@\[-`{-~]*"
_PLAIN = re.compile(rb"^(" + _LETTERS + rb")(" + _MARKS + rb")$", re.MULTILINE)
_TAILED = re.compile(rb"^(.*(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf]))(" + _MARKS + rb")$", re.DOTALL)


class Encoder:
    """``Tokenizer.encode(text, add_special_tokens=False)`` by looking words up.
    (Ascii white space and case alone are treated here, the rest is left to the
    tokenizer.)"""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {b"": b""}
        ends = {i: t.endswith("</w>") for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.ends = np.array([ends.get(i, False) for i in range(max(ends) + 1)])

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The little-endian 32-bit ids of each text."""
        waiting: list[list[bytes]] = []
        new: set[bytes] = set()
        n = 0
        for text in texts:
            raw = text.encode()
            words = (raw if b"<|" in raw else raw.lower()).split()  # special tokens have a case
            if not waiting:
                try:
                    yield b"".join(map(self.words.__getitem__, words))
                    continue
                except KeyError:
                    pass
            waiting.append(words)
            new.update(set(words).difference(self.words))
            n += len(words)
            if len(new) >= NEW_WORDS or n >= WAITING_WORDS:
                yield from self._encoded(waiting, new)
                waiting, new, n = [], set(), 0
        yield from self._encoded(waiting, new)

    def _encoded(self, waiting: list[list[bytes]], new: set[bytes]) -> Iterator[bytes]:
        self._learn(new)
        for words in waiting:
            yield b"".join(map(self.words.__getitem__, words))
        if len(self.words) > WORDS:
            self.words.clear()
        if len(self.cores) > CORES:
            self.cores = {b"": b""}

    def _learn(self, words: set[bytes]) -> None:
        """A word with a tail of marks after a letter is its two parts.  Words
        and cores of plain letters are encoded together, in one string."""
        plain = _PLAIN.findall(b"\n".join(words))  # a word holds no line end
        parts = {core + tail: (core, tail) for core, tail in plain}
        other = {}
        for w in words.difference(parts):
            m = None if b"<|" in w else _TAILED.match(w)
            other[w] = m.groups() if m else (w, b"")
        letters = sorted({core for core, _ in plain}.difference(self.cores))
        if letters:
            self._fill_letters(letters)
        parts |= other
        rest = sorted({p for pair in parts.values() for p in pair}.difference(self.cores))
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        self.cores.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest, encoded, strict=True))
        cores = self.cores
        self.words.update((w, cores[core] + cores[tail]) for w, (core, tail) in parts.items())

    def _fill_letters(self, words: list[bytes], together: int = 200) -> None:
        """Each of these words is one pre-token, whose last token says so."""
        lots = [words[i:i + together] for i in range(0, len(words), together)]
        encoded = self.tokenizer.encode_batch_fast([b" ".join(some).decode() for some in lots], add_special_tokens=False)
        for some, e in zip(lots, encoded, strict=True):
            ids = np.array(e.ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) == len(some):  # else the vocabulary is of another kind: they are encoded one by one
                buffer, start = ids.tobytes(), 0
                for w, stop in zip(some, stops.tolist(), strict=True):
                    self.cores[w] = buffer[start:stop]
                    start = stop


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The task process's encoder; ``vocabulary`` names a file of the public
    tokenizers, installed on every executor, or is a path."""
    if vocabulary not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        path = vocabulary
        if not os.path.isabs(vocabulary):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _ENCODERS[vocabulary] = Encoder(path)
    return _ENCODERS[vocabulary]
