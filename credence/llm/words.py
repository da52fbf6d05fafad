"""Vectorised word hashing over Arrow string columns (no Python object per word).

A word's hash is a polynomial over its bytes modulo 2**64, taken for all words of a
piece at once from one running sum, and then mixed. Texts are cut into pieces of
about a megabyte at word boundaries, so memory is bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
GROUP = 4 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    step = base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done += more
        step = step * step % (1 << 64)
    return out


_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, PIECE + 1024)
        _tables["up"] = _powers(int(_BASE), size)
        _tables["down"] = _powers(pow(int(_BASE), -1, 1 << 64), size)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_map(separators: bytes) -> np.ndarray:
    """A table that lower-cases A-Z and sends every separator to 0; a NUL that is none, to a byte outside UTF-8."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 255
    table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


#: ASCII white space.
SPACE = byte_map(b" \t\n\v\f\r")
#: Every ASCII character that is neither letter nor digit.
PUNCT = byte_map(bytes(c for c in range(128) if not chr(c).isalnum()))




def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; nulls are empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column = column.cast(pa.string())
        kind = np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def groups(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about four megabytes of text each: slice, bytes, offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offs = string_parts(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offs, offs[first] + GROUP, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), raw, offs[first : last + 1]
            first = last


def word_hashes(raw: np.ndarray, offs: np.ndarray, table: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and where each text's words begin (n + 1 offsets).

    With ``prefix``, hashes of the words' first so many bytes instead.

    ``table`` decides what a word is: bytes that it maps to 0 separate words.
    """
    hashes: list[np.ndarray] = []
    places: list[np.ndarray] = []
    lo, end = int(offs[0]), int(offs[-1])
    at = lo
    while at < end:
        to = min(at + PIECE, end)
        if to < end:  # back to the last separator, or on to the next one or the text's end
            window = table[raw[at:to]]
            gaps = np.flatnonzero(window == 0)
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                while to < end and table[raw[to]] != 0 and to not in offs:
                    to += 1
        low = table[raw[at:to]]
        is_word = low != 0
        cut = np.zeros(to - at + 1, bool)
        inner = offs[(offs >= at) & (offs <= to)] - at
        cut[inner] = True
        cut[0] = cut[-1] = True
        before = np.empty_like(is_word)
        before[0] = False
        before[1:] = is_word[:-1]
        starts = np.flatnonzero(is_word & (~before | cut[:-1]))
        after = np.empty_like(is_word)
        after[-1] = False
        after[:-1] = is_word[1:]
        ends = np.flatnonzero(is_word & (~after | cut[1:])) + 1
        place = starts + at
        if prefix:
            ends = np.minimum(ends, starts + prefix)
        up, down = _power_tables(to - at + 1)
        total = np.zeros(to - at + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: to - at], out=total[1:])
        hashes.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        places.append(place)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    place = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(place, offs, side="left")


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words inside a text, and each text's bounds among them.

    A text with fewer words has its whole sequence as its one run; one without words has none.
    """
    n_words = np.diff(bounds)
    n_runs = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    out_bounds = np.concatenate([[0], np.cumsum(n_runs)])
    out = np.empty(int(out_bounds[-1]), np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    whole = n_words >= size
    if len(hashes) >= size:
        runs = len(hashes) - size + 1
        acc = np.zeros(runs, np.uint64)
        for j in range(size):
            acc = acc * step + hashes[j : runs + j]
        acc = mix(acc + np.uint64(size))
        inside = np.arange(runs) + size <= np.repeat(bounds[1:], n_words)[:runs]
        out[np.repeat(whole, n_runs)] = acc[inside]
    for i in np.flatnonzero(~whole & (n_words > 0)):
        one = np.zeros(1, np.uint64)
        for h in hashes[bounds[i] : bounds[i + 1]]:
            one = one * step + h
        out[out_bounds[i]] = mix(one + np.uint64(n_words[i]))[0]
    return out, out_bounds
