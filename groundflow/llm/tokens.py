"""Exact tokenization with a word cache inside each Python worker.

A public BPE tokenizer first splits a text into pieces that no merge crosses. Where a single space or
line break stands between two other characters there is always such a border, so a text is cut there
with plain string operations, each distinct chunk is encoded once per worker by the tokenizers library,
and the ids of a text are the joined ids of its chunks. Texts have few distinct chunks against their
length; the whole is several times as fast as encoding every text and gives the same ids.

A sign behind a letter starts a piece too (an apostrophe may not), so texts are cut there as well, and where the
tokenizer ignores case, A-Z are put in lower case first. New chunks of letters alone are encoded many at a time
and told apart by the tokens that mark a word's start or end.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import LOWER_BYTES

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks remembered by a worker: two generations of about this many; a full one replaces the older one.
CACHE_ENTRIES = 350_000

_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
#: ASCII signs that start a piece behind a letter (all but the apostrophe), and ASCII letters, as tables over bytes.
_SIGN, _LETTER = (np.array([b in range(33, 127) and not chr(b).isalnum() and b != 39 for b in range(256)]), np.array([b < 128 and chr(b).isalpha() for b in range(256)]))
_held: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """Ids of whole texts; `keeps_space` says that a word's leading space belongs to its ids."""

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keeps_space = keeps_space
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.entries = CACHE_ENTRIES * 2 if keeps_space else CACHE_ENTRIES  # case tells more chunks apart
        vocabulary = self.tokenizer.get_vocab()
        self.border = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that start (end) a word
        for token, k in vocabulary.items():
            self.border[k] = token.startswith("\u0120") if keeps_space else token.endswith("</w>")
        self.ignores_case = self.tokenizer.encode("A b", add_special_tokens=False).ids == self.tokenizer.encode("a b", add_special_tokens=False).ids

    def chunks(self, texts: list[str]) -> list[list[str]]:
        """Each text's chunks."""
        odd = [k for k, x in enumerate(texts) if "\0" in x or "\x01" in x or self.keeps_space and " ".join(x.split()) != x.replace("\n", " ")]
        blank = list(texts)
        for k in odd:
            blank[k] = ""
        data = "\x01".join(blank).encode("utf-8", "surrogatepass")
        a = np.frombuffer(data.translate(LOWER_BYTES) if self.ignores_case else data, np.uint8)
        if len(a) > 2:
            letter = _LETTER[a]
            letter[1:] |= (a[:-1] == 0xC3) & (a[1:] != 0x97) & (a[1:] != 0xB7)  # U+00C0 to U+00FF in UTF-8, but for two signs
            a = np.insert(a, np.flatnonzero(_SIGN[a[1:]] & letter[:-1]) + 1, 0)
        joined = a.tobytes().decode("utf-8", "surrogatepass")
        joined = joined.replace(" ", "\0 ").replace("\n", "\0\n\0") if self.keeps_space else joined.replace("\n", "\0").replace(" ", "\0")
        found = [x.split("\0") for x in joined.split("\x01")]
        for k in odd:  # other white space than single spaces and line breaks, or a separator in the text
            x = texts[k]
            found[k] = [x] if "\0" in x or not self.keeps_space else _CUT.sub("\0", x).split("\0")
        return found

    def plain(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids, by the library."""
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters (each with its leading space if that counts), encoded together."""
        found: list[bytes] = []
        for k in range(0, len(words), 100):
            part = words[k : k + 100]
            ids = np.array(self.tokenizer.encode_batch_fast([("" if self.keeps_space else " ").join(part)], add_special_tokens=False)[0].ids, self.dtype)
            marks = np.flatnonzero(self.border[ids])
            cuts = np.append(marks, len(ids)) if self.keeps_space else np.append(0, marks + 1)
            if len(cuts) == len(part) + 1 and cuts[0] == 0 and cuts[-1] == len(ids):
                data, at = ids.tobytes(), (cuts * self.dtype.itemsize).tolist()
                found += [data[x:y] for x, y in zip(at, at[1:], strict=False)]
            else:
                found += self.plain(part)
        return found

    def learn(self, new: list[str]) -> None:
        """Put new chunks into the cache."""
        words = [w for w in new if (w[1:].isalpha() and w[0] == " " if self.keeps_space else w.isalpha())]
        others = list(set(new).difference(words))
        self.cache.update(zip(words, self.words(words), strict=True))
        self.cache.update(zip(others, self.plain(others), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids for each text."""
        cut = self.chunks(texts)
        if len(self.cache) > self.entries:
            self.older, self.cache = self.cache, {"": b""}
        missing = set().union(*cut).difference(self.cache)
        again = missing.intersection(self.older)
        self.cache.update(zip(again, map(self.older.__getitem__, again), strict=True))
        self.learn(list(missing - again))
        look = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(look, c)), self.dtype) for c in cut]


def encoder(path: str, keeps_space: bool) -> Encoder:
    """This worker's encoder; kept between tasks."""
    if (path, keeps_space) not in _held:
        _held[path, keeps_space] = Encoder(path, keeps_space)
    return _held[path, keeps_space]


def slices(texts: list[str], most_chars: int = 3_000_000):
    """Runs of texts of bounded total length, so that one batch's chunks stay in memory."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most_chars:
            yield held
            held, size = [], 0
    if held:
        yield held
