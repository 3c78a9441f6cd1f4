"""Per-text splitters, applied batch-wise inside tasks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from gridlake.functions.fixed_values import SENTENCE_ENDS


def _parts(text: str, separator: str) -> list[str]:
    """Text cut before each separator, which stays at the head of its part."""
    if separator == "":
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def _packed(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring parts joined up to size; a chunk starts with up to overlap of the last."""
    window: deque[str] = deque()
    width = 0
    for part in parts:
        if window and width + len(part) > size:
            yield "".join(window)
            while width > overlap or (width and width + len(part) > size):
                width -= len(window.popleft())
        window.append(part)
        width += len(part)
    if window:
        yield "".join(window)


def recursive_chunks(text: str, size: int, overlap: int, separators: list[str]) -> Iterator[str]:
    """Chunks of at most size characters, cut at the coarsest separator that suffices."""
    level = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[level + 1:]
    small: list[str] = []
    for part in _parts(text, separators[level]):
        if len(part) < size:
            small.append(part)
            continue
        yield from filter(None, map(str.strip, _packed(small, size, overlap)))
        small = []
        if finer:
            yield from recursive_chunks(part, size, overlap, finer)
        else:
            yield part
    yield from filter(None, map(str.strip, _packed(small, size, overlap)))


def sentence_chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, chunk) cut at the last sentence end in reach, else at white space.

    A text within the size is one chunk as it is; pieces of longer ones are stripped.
    """
    if len(text) <= size:
        yield 0, len(text), text
        return
    start = 0
    while start < len(text):
        stop = min(start + size, len(text))
        if stop < len(text):
            reach = text[start:stop]
            cut = 1 + max(reach.rfind(mark) for mark in SENTENCE_ENDS)
            if cut == 0:
                cut = next((i + 1 for i in range(len(reach) - 1, -1, -1) if reach[i].isspace()), 0)
            stop = start + cut if cut else stop
        chunk = text[start:stop].strip()
        if chunk:
            yield start, stop, chunk
        if stop >= len(text):
            return
        start = stop - overlap if stop - overlap > start else stop
