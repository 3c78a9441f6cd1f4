"""Whole texts to token ids or token counts, each distinct piece of a text encoded once.

A text is cut where no token can span the cut: before white space that follows a character
that is not white space. Pieces repeat far more often than texts, so the library encodes
each distinct piece of a batch only, many pieces joined to one input, and a worker keeps
what it has encoded up to a fixed number of pieces.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gridlake.llm.arrow import raw_bytes, texts

#: Words that a counter keeps, and pieces and ids that an encoder keeps.
KEPT_WORDS = 300_000
KEPT_PIECES = 250_000
KEPT_IDS = 4_000_000
KEPT_BYTES = 64
JOINED_PIECES = 4096
JOINED_CHARS = 1 << 18
#: White space or control characters on which tokenizers may disagree with ASCII white
#: space, and the opening of special strings: such texts are encoded whole.
UNSAFE = (r"[\x00-\x08\x0e-\x1f\x7f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}"
          r"\x{202f}\x{205f}\x{3000}\x{feff}]|<\|")
PIECE = re.compile(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
BREAK = "\x01"
#: How a byte-level vocabulary writes space, tab, line feed, VT, FF and CR.
OPENING = "\u0120\u0109\u010a\u010b\u010c\u010d"
SPACES = " \t\n\r\f\v"
MARKS = ",.;:!?"
#: A letter (of the Latin blocks) and a mark that end a piece.
MARKED = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f][,.;:!?]$"


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def joined_groups(pieces: list[str]):
    """Slices of the pieces of bounded number and length."""
    lo, chars = 0, 0
    for i, piece in enumerate(pieces):
        if i > lo and (i - lo >= JOINED_PIECES or chars + len(piece) > JOINED_CHARS):
            yield lo, i
            lo, chars = i, 0
        chars += len(piece)
    if lo < len(pieces):
        yield lo, len(pieces)


def encode_joined(tokenizer, pieces: list[str], opens: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces, number of ids by piece); every cut between pieces must be safe.

    opens tells which ids open a piece, where pieces begin with white space and hold no
    other; offsets tell it otherwise.
    """
    ids, counts = [], []
    for lo, hi in joined_groups(pieces):
        group = pieces[lo:hi]
        text = "".join(group)
        if opens is not None and sum(map(text.count, SPACES)) == hi - lo:
            own = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            first = np.flatnonzero(opens[own])
            if len(first) == hi - lo:
                ids.append(own)
                counts.append(np.diff([*first, len(own)]))
                continue
        lengths = np.fromiter(map(len, group), np.int64, hi - lo)
        got = tokenizer.encode(text, add_special_tokens=False)
        at = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
        starts = np.cumsum(lengths) - lengths
        filled = np.flatnonzero(lengths)
        owner = filled[np.searchsorted(starts[filled], at, side="right") - 1] if len(at) else at
        ids.append(np.array(got.ids, dtype=np.uint32))
        counts.append(np.bincount(owner, minlength=hi - lo))
    if not counts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(counts).astype(np.int64)


def ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[s], ..., values[s + n - 1] for each (s, n), one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    shift = np.repeat(starts - (ends - counts), counts)
    return values[shift + np.arange(total, dtype=np.int64)]


class Counter:
    """Token counts for a tokenizer that drops white space and cuts words there."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.kept: dict[str, int] = {}

    def __call__(self, column: pa.Array) -> np.ndarray:
        column = texts(column)
        for mark in "\n\t\r\f\v":
            column = pc.replace_substring(column, mark, " ")
        words = pc.split_pattern(column, " ")
        n_words = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        counts = np.fromiter((self.kept.get(p, -1) for p in pieces), np.int64, len(pieces))
        missing = np.flatnonzero(counts < 0)
        if len(missing):
            _, counts[missing] = encode_joined(self.tokenizer, [pieces[i] + " " for i in missing])
            if len(self.kept) + len(missing) > KEPT_WORDS:
                self.kept = {}
            self.kept.update((pieces[i], int(counts[i])) for i in missing[:KEPT_WORDS] if len(pieces[i]) <= KEPT_BYTES)
        total = np.concatenate(([0], np.cumsum(counts[coded.indices.to_numpy()])))
        ends = np.cumsum(n_words)
        return total[ends] - total[ends - n_words]


class Encoder:
    """Token ids for a byte-level tokenizer, where a space belongs to the word after it.

    A worker's known pieces are one array of texts and one of ids. When they are too many,
    those that met one batch only go.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t[0] in OPENING]] = True
        self.marks = np.full(256, -1, np.int64)
        for mark in MARKS:
            ids = self._whole(mark)
            if len(ids) == 1:
                self.marks[ord(mark)] = ids[0]
        self._forget(np.zeros(0, np.int64))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _forget(self, kept: np.ndarray) -> None:
        """Keep these rows of the known pieces only."""
        if not len(kept):
            self.names, self.ids = pa.array([], pa.large_binary()), np.zeros(0, np.uint32)
            self.starts, self.counts, self.met = (np.zeros(0, np.int64) for _ in range(3))
            return
        self.names = self.names.take(pa.array(kept))
        self.ids = ragged(self.ids, self.starts[kept], self.counts[kept])
        self.counts = self.counts[kept]
        self.starts = np.cumsum(self.counts) - self.counts
        self.met = np.zeros(len(kept), np.int64)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids by piece)."""
        # white space alone ends a text, and a piece without white space before it starts
        # one; next to another piece they would join it
        joined = np.array([p[:1] in SPACES and not p.isspace() for p in pieces], bool)
        joined[[i for i, p in enumerate(pieces) if not p]] = False
        ids, some = encode_joined(self.tokenizer, [p for p, j in zip(pieces, joined) if j], self.opens)
        if joined.all():
            return ids, some
        alone = [self._whole(p) for p, j in zip(pieces, joined) if not j]
        counts = np.zeros(len(pieces), np.int64)
        counts[joined], counts[~joined] = some, [len(a) for a in alone]
        out = np.zeros(int(counts.sum()), np.uint32)
        of_joined = np.repeat(joined, counts)
        out[of_joined], out[~of_joined] = ids, np.concatenate(alone)
        return out, counts

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces stand among the known ones; new ones are encoded."""
        if len(self.names) > KEPT_PIECES or len(self.ids) > KEPT_IDS:
            kept = np.flatnonzero(self.met > 1)
            self._forget(kept if 2 * len(kept) < KEPT_PIECES and 2 * self.counts[kept].sum() < KEPT_IDS else kept[:0])
        rows = pc.index_in(pieces, value_set=self.names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = pieces.take(pa.array(missing))
            ids, counts = self._encode(new.cast(pa.large_string()).to_pylist())
            rows[missing] = len(self.names) + np.arange(len(missing))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.names, self.ids = pa.concat_arrays([self.names, new]), np.concatenate([self.ids, ids])
            self.counts = np.concatenate([self.counts, counts])
            self.met = np.concatenate([self.met, np.zeros(len(missing), np.int64)])
        self.met[rows] += 1
        return rows

    def _known(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, counts) of distinct pieces, given as large strings."""
        data, offsets = raw_bytes(pieces)
        filled = np.diff(offsets) > 0
        last = np.zeros(len(pieces), np.uint8)
        last[filled] = data[offsets[1:][filled] - 1]
        # a mark after a letter is a token run of its own, so words share their encoding
        marked = (self.marks[last] >= 0) & pc.match_substring_regex(pieces, MARKED).to_numpy(zero_copy_only=False)
        named = pieces.cast(pa.large_binary())
        stems = pc.if_else(pa.array(marked), pc.binary_slice(named, 0, -1), named).dictionary_encode()
        rows = self._rows(stems.dictionary)[stems.indices.to_numpy()]
        own = self.counts[rows]
        counts = own + marked
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        is_mark = np.zeros(len(ids), bool)
        is_mark[ends[marked] - 1] = True
        ids[is_mark] = self.marks[last[marked]]
        ids[~is_mark] = ragged(self.ids, self.starts[rows], own)
        return ids, ends - counts, counts

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids by text)."""
        column = texts(column)
        n = len(column)
        whole = pc.match_substring_regex(column, UNSAFE).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(column, r"[ \t\n\r\f\v]{2}|^[ \t\n\r\f\v]|[ \t\n\r\f\v]$").to_numpy(zero_copy_only=False)
        plain = ~whole & ~odd
        if plain.all() and n:
            return self._plain(column)
        sizes, parts = np.zeros(n, np.int64), {}
        flat = np.zeros(0, np.uint32)
        if plain.any():
            flat, sizes[plain] = self._plain(column.take(pa.array(np.flatnonzero(plain))))
        for row in np.flatnonzero(~plain).tolist():
            text = column[row].as_py()
            if whole[row]:
                parts[row] = self._whole(text)
            else:
                pieces = pa.array(PIECE.findall(text), pa.large_string()).dictionary_encode()
                ids, starts, counts = self._known(pieces.dictionary)
                at = pieces.indices.to_numpy()
                parts[row] = ragged(ids, starts[at], counts[at])
            sizes[row] = len(parts[row])
        out = np.empty(int(sizes.sum()), np.uint32)
        of_plain = np.repeat(plain, sizes)
        out[of_plain] = flat
        if parts:
            out[~of_plain] = np.concatenate([parts[row] for row in sorted(parts)])
        return out, sizes

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts with single white space between words and none around them."""
        words = pc.split_pattern(pc.replace_substring(column, "\n", " " + BREAK), " ")
        sizes = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        # the first word of a text has no space before it; it gets a code of its own
        firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        head_codes, head_at = np.unique(index[firsts], return_inverse=True)
        is_inner = np.zeros(len(coded.dictionary), bool)
        used = np.ones(len(index), bool)
        used[firsts] = False
        is_inner[index[used]] = True
        inner = np.flatnonzero(is_inner)
        spaced = pc.binary_join_element_wise(pa.scalar(" ", coded.dictionary.type), coded.dictionary.take(pa.array(inner)),
                                             pa.scalar("", coded.dictionary.type))
        ids, starts, counts = self._known(pa.concat_arrays([
            pc.replace_substring(spaced, " " + BREAK, "\n"), coded.dictionary.take(pa.array(head_codes))]))
        place = np.zeros(len(coded.dictionary), np.int64)
        place[inner] = np.arange(len(inner))
        at = place[index]
        at[firsts] = len(inner) + head_at
        lengths = counts[at]
        upto = np.cumsum(lengths)
        ends = upto[np.cumsum(sizes) - 1]
        return ragged(ids, starts[at], lengths), np.diff(ends, prepend=0)


_loaded: dict = {}


def worker_copy(kind, path: str):
    """One tokenizer and its kept pieces for each worker process, shared by its tasks."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
