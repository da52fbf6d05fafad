"""Word-cached encoding with a public vocabulary of the ``tokenizers`` library.

The vocabulary's pre-tokenizer never joins text across white space, so the ids of a text
are the ids of its blank-separated parts, one after another. Each worker encodes a part
once with the library and then looks it up; the cache is bounded.
"""

from __future__ import annotations

import os
import string

import numpy as np

CACHE = 1_000_000
LINE = 500

# The public byte-level alphabet shows bytes 127 to 160 and 173 by the characters from 289 on.
_SHOWN = np.arange(256, dtype="<u4")
_SHOWN[127:161] += 162
_SHOWN[173] = 323


def _bytes_as_letters(text: str) -> str:
    """Lower-cased, and each byte of UTF-8 as its letter in the byte-level alphabet (of words and blanks only)."""
    text = text.lower()
    return text if text.isascii() else _SHOWN[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")


class _Parts(dict):
    """ids by part; notes the parts that it misses."""

    missed: list[str]

    def __init__(self) -> None:
        super().__init__({"": b""})
        self.missed = []

    def __missing__(self, part: str) -> None:
        self.missed.append(part)


class WordEncoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.bare = self._bare()
        self.parts = _Parts()
        self.stems: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.letters = set(string.ascii_letters)
        self.others: set[str] = set()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _bare(self):
        """The same model behind blanks alone, for words that need no normalizer; none if it differs on the vocabulary's own words."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        bare = Tokenizer(self.tokenizer.model)
        bare.pre_tokenizer = WhitespaceSplit()
        known = sorted({w for w in (x.removesuffix("</w>") for x in self.tokenizer.get_vocab()) if w.isascii() and w.isalpha()})[:: 1 + len(self.ends) // 2000]
        tried = " ".join([*known, *(chr(c) + "x" + chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha())])
        same = bare.encode(_bytes_as_letters(tried), add_special_tokens=False).ids == self.tokenizer.encode(tried, add_special_tokens=False).ids
        return bare if same else None

    def _all_letters(self, stem: str) -> bool:
        """Whether the tokenizer keeps punctuation after the stem apart: each character's normal form must be letters in its own eyes."""
        for c in set(stem) - self.letters:
            if c in self.others:
                return False
            form = self.tokenizer.normalizer.normalize_str(c) if self.tokenizer.normalizer is not None else c
            pieces = [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(form + "a.")]
            if pieces != [(0, len(form) + 1), (len(form) + 1, len(form) + 2)]:
                self.others.add(c)
                return False
            self.letters.add(c)
        return True

    def _learn_stems(self, new: list[str], latin: bool) -> None:
        """A word of letters alone is one pre-token, whose last id ends a word."""
        if not new:
            return
        plain = latin and self.bare is not None  # Latin-1: as in _cut
        lines = [" ".join(new[i : i + LINE]) for i in range(0, len(new), LINE)]
        encode = self.bare.encode_batch_fast if plain else self.tokenizer.encode_batch_fast
        found = encode([_bytes_as_letters(x) for x in lines] if plain else lines, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, "<u4") for x in found])
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(new):  # a vocabulary of another shape: one by one
            self.stems.update((w, self._whole(w)) for w in new)
            return
        raw, at = ids.tobytes(), 0
        for word, to in zip(new, (last * 4).tolist(), strict=True):
            self.stems[word] = raw[at:to]
            at = to

    def _learn(self, new: set[str]) -> None:
        if len(self.stems) > CACHE:
            self.stems = {}
        stems, tails, parts = self.stems, self.tails, self.parts
        fresh, split, rest = {False: set(), True: set()}, [], []
        for part in new:
            stem = part.rstrip(string.punctuation)
            if stem.isalpha() and len(stem) < 200 and (stem.isascii() or self._all_letters(stem)):
                split.append((part, stem))
                if stem not in stems:
                    fresh[stem.isascii() or max(stem) <= "\xff"].add(stem)
            else:
                rest.append(part)
        for part, found in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            parts[part] = np.array(found.ids, "<u4").tobytes()
        for latin, some in fresh.items():
            self._learn_stems(list(some), latin)
        for part, stem in split:
            tail = part[len(stem) :]
            if tail not in tails:  # a run of punctuation is one pre-token
                if len(tails) > CACHE:
                    tails.clear()
                    tails[""] = b""
                tails[tail] = self._whole(tail)
            parts[part] = stems[stem] + tails[tail]

    @staticmethod
    def _cut(text: str) -> list[str]:
        try:  # within Latin-1, lower case and composed form are those of the normalizer; special tokens are found in the text as it is
            text.encode("latin-1")
            text = text if "<|" in text else text.lower()
        except UnicodeEncodeError:
            pass
        return text.replace("\n", " ").split(" ")

    def encode(self, batch: list[str]) -> list[bytes]:
        cut = [self._cut(x) for x in batch]
        parts, out, holes = self.parts, [], []
        parts.missed, missed, look = [], 0, parts.__getitem__
        for text in cut:
            found = list(map(look, text))
            if len(parts.missed) > missed:
                holes.append((len(out), text, found))
                missed = len(parts.missed)
                out.append(b"")
            else:
                out.append(b"".join(found))
        new, parts.missed = set(parts.missed), []
        if len(parts) + len(new) > CACHE:
            self.parts = _Parts()
        if new:
            self._learn(new)
        look = self.parts.__getitem__
        for i, text, found in holes:
            out[i] = b"".join([look(p) if ids is None else ids for p, ids in zip(text, found, strict=True)])
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker and vocabulary, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
