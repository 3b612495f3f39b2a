"""Cutting of text batches into arrays that numpy works on as a whole."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Characters or bytes that are worked on at once; longer texts are cut.
SLICE = 1 << 18
#: Where a text may be cut: at white space, as in ``common.WORD``, or at any character that is no letter.
WHITE, NO_LETTER = re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[\W\d_]")


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def slices(texts: list[str], most: int = SLICE, cut: re.Pattern = WHITE) -> Iterator[tuple[list[int], list[str]]]:
    """Index and text of pieces, in slices of about ``most`` characters.

    A longer text is cut behind matches of ``cut``, the first in the second half of each slice or behind it.  Where there is
    none the text stays whole, as a cut anywhere else would change what is found.
    """
    index: list[int] = []
    out: list[str] = []
    total = 0
    for k, text in enumerate(texts):
        start = 0
        while len(text) - start > most and (found := cut.search(text, start + most // 2)) is not None and found.end() < len(text):
            yield [k], [text[start : found.end()]]
            start = found.end()
        rest = text[start:] if start else text
        if total + len(rest) > most and out:
            yield index, out
            index, out, total = [], [], 0
        index.append(k)
        out.append(rest)
        total += len(rest)
    if out:
        yield index, out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place of weak low bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_P = np.uint64(0x9E3779B97F4A7C15)
_held: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64, and of its inverse, for ``n`` places at least."""
    size = 1 << max(10, n.bit_length())
    if size not in _held:
        _held.clear()
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        _held[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, p)])) for p in (_P, inverse))
    return _held[size]


def prefix_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums whose differences, times the second array, are hashes of any span."""
    power, inverse = powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[: len(codes)], out=sums[1:])
    return sums, inverse


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


#: By module, what frees the tables that its tasks keep in a worker.
KEPT: dict[str, Callable[[], None]] = {}


def begins(module: str) -> None:
    """A task of ``module`` begins in this worker: what other modules' tasks kept goes, as workers serve one after another."""
    for name, free in KEPT.items():
        if name != module:
            free()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives free memory back: it waits for its next task beside the JVM."""

    module = run.__module__

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins(module)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
