"""Words of texts as numbers inside Arrow batches: terms are counted and weighed without a string per occurrence.

Texts are words joined by blanks, from :func:`rankloom.functions.tokens.spaced`. They
are taken in parts of bounded size, so that a task never holds the words of a whole batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 8 << 20
# Keys of a part, made of two words and a row, stay within 64 bits.
PART_ROWS = 1 << 16


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts within both bounds, one text at least."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        end = int(np.searchsorted(ends, done + PART_BYTES, side="right"))
        end = max(at + 1, min(end, at + PART_ROWS))
        yield texts.slice(at, end - at)
        at = end


def coded(texts: pa.Array):
    """(row, code) of all words of two characters or more, in order, and the words by code."""
    lists = pc.split_pattern(texts, " ")
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    found = lists.flatten().dictionary_encode()
    code = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keep = (pc.utf8_length(found.dictionary).to_numpy(zero_copy_only=False) > 1)[code]
    return row[keep], code[keep], found.dictionary


def _neighbours(row, code, size):
    """(row, key) of all pairs of neighbouring words whose codes aren't negative."""
    first, second = code[:-1], code[1:]
    met = (row[1:] == row[:-1]) & (first >= 0) & (second >= 0)
    return row[1:][met], first[met] * size + second[met]


def _tally(row, key, rows):
    """(key, occurrences, rows holding it) of every key."""
    key, row = np.divmod(np.sort(key * rows + row), rows)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    opened = new.copy()
    opened[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(new)
    held = np.diff(np.append(np.cumsum(opened)[first] - 1, opened.sum()))
    return key[first], np.diff(np.append(first, len(key))), held


def count_terms(texts: pa.Array, words: bool = True, pairs: bool = True, among: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    """(term, total, df) of the words, the pairs or both, by part; pairs only of words in ``among`` if given."""
    for part in parts(texts):
        row, code, names = coded(part)
        found = []
        if words:
            key, *counts = _tally(row, code, len(part))
            found.append((names.take(pa.array(key)), *counts))
        if pairs:
            if among is not None:
                wanted = pc.is_in(names, value_set=among).to_numpy(zero_copy_only=False)
                code = np.where(wanted[code], code, -1)
            row, key = _neighbours(row, code, len(names))
            key, *counts = _tally(row, key, len(part))
            first, second = (names.take(pa.array(x)) for x in np.divmod(key, max(1, len(names))))
            found.append((pc.binary_join_element_wise(first, second, " "), *counts))
        for term, total, held in found:
            yield pa.RecordBatch.from_arrays([term, pa.array(total), pa.array(held)], ["term", "total", "df"])


class Weigher:
    """Unit-length sparse vectors of texts over a vocabulary of words and pairs."""

    def __init__(self, terms: Sequence[str], idf: Sequence[float]):
        split = [t.split(" ") for t in terms]
        known = list(dict.fromkeys(w for t in split for w in t))
        place = {w: i for i, w in enumerate(known)}
        self.known = pa.array(known, pa.string())
        self.idf = np.array(idf, dtype=float)
        # One more place, for unknown words.
        self.word = np.full(len(known) + 1, -1)
        pairs = []
        for ix, term in enumerate(split):
            if len(term) == 1:
                self.word[place[term[0]]] = ix
            elif len(term) == 2:
                pairs.append((place[term[0]] * len(known) + place[term[1]], ix))
        # One more pair, which is never found.
        pairs = np.array([*sorted(pairs), (np.iinfo(np.int64).max, -1)], dtype=np.int64)
        self.pair, self.pair_term = pairs[:, 0], pairs[:, 1]

    def _weigh(self, part):
        """(entries of each text, indices, weights)"""
        row, code, names = coded(part)
        place = pc.fill_null(pc.index_in(names, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = place[code]
        paired, key = _neighbours(row, code, len(self.known))
        at = np.searchsorted(self.pair, key)
        term = np.concatenate([self.word[code], np.where(self.pair[at] == key, self.pair_term[at], -1)])
        row = np.concatenate([row, paired])
        cell, count = np.unique((row * len(self.idf) + term)[term >= 0], return_counts=True)
        row, index = np.divmod(cell, max(1, len(self.idf)))
        weight = count * self.idf[index]
        length = np.sqrt(np.bincount(row, weight * weight, len(part)))
        return np.bincount(row, minlength=len(part)), index.astype(np.int32), weight / length[row]

    def __call__(self, texts: pa.Array) -> pa.Array:
        found = [self._weigh(part) for part in parts(texts)]
        sizes, indices, weights = (np.concatenate([f[i] for f in found] or [np.empty(0)]) for i in range(3))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(indices, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(weights, pa.float64()))]
        return pa.StructArray.from_arrays(lists, ["indices", "weights"])
