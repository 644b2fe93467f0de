"""Suffix arrays of byte texts by induced sorting, and permuted common prefixes, on numpy arrays.

``suffix_array`` classifies suffixes, sorts the leftmost-smaller (LMS) substrings by induction, names them, sorts the
reduced text by its own call, and induces the full order from it. Induction runs bucket by bucket with vector
operations: what a bucket's entries induce is split by first symbol with a stable radix sort, so the work stays linear.
Texts over many symbols, as reduced ones are, have too many buckets for that and are ranked by doubling instead.
"""

from __future__ import annotations

import numpy as np

#: Symbols up to which buckets are walked one by one.
MOST_BUCKETS = 1024


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its right neighbour; the last one, a unique smallest symbol, is."""
    n = len(text)
    rises = np.zeros(n, np.int8)
    rises[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    rises[-1] = 1
    decided = np.where(rises != 0, np.arange(n), n)
    following = np.minimum.accumulate(decided[::-1])[::-1]
    return rises[following] > 0


def _split_by_symbol(places: np.ndarray, text: np.ndarray) -> list[tuple[int, np.ndarray]]:
    symbols = text[places]
    order = np.argsort(symbols, kind="stable")
    places, symbols = places[order], symbols[order]
    at = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]])) if len(places) else []
    return [(int(symbols[a]), places[a:b]) for a, b in zip(at, [*at[1:], len(places)], strict=False)]


def _induced(text: np.ndarray, smaller: np.ndarray, lms: list[np.ndarray], symbols: int) -> np.ndarray:
    """The suffix array induced by LMS suffixes that are given per symbol, in order."""
    waiting: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    larger_part: list[np.ndarray] = []
    none = np.zeros(0, np.int64)
    for c in range(symbols):
        found, wave = [], np.concatenate(waiting[c]) if waiting[c] else none
        while True:
            last = not len(wave)
            source = lms[c] if last else wave
            if not last:
                found.append(wave)
            before = source[source > 0] - 1
            before = before[~smaller[before]]
            own = none
            for symbol, places in _split_by_symbol(before, text):
                if symbol == c and not last:
                    own = places
                else:
                    waiting[symbol].append(places)
            if last:
                break
            wave = own
        larger_part.append(np.concatenate(found) if found else none)
    waiting = [[] for _ in range(symbols)]
    out: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):
        found, wave = [], np.concatenate(waiting[c]) if waiting[c] else none
        while True:
            last = not len(wave)
            source = larger_part[c][::-1] if last else wave
            if not last:
                found.append(wave)
            before = source[source > 0] - 1
            before = before[smaller[before]]
            own = none
            for symbol, places in _split_by_symbol(before, text):
                if symbol == c and not last:
                    own = places
                else:
                    waiting[symbol].append(places)
            if last:
                break
            wave = own
        if c == 0:
            found = [np.array([len(text) - 1])]  # the unique smallest symbol has no right neighbour to induce it
        out.append(np.concatenate([larger_part[c], np.concatenate(found)[::-1]]) if found else larger_part[c])
    return np.concatenate(out[::-1])


def _ranked(text: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only groups that are not yet single are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    starts = np.concatenate([[True], text[order][1:] != text[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    width = 1
    while True:
        single = starts & np.concatenate([starts[1:], [True]])
        open_ = np.flatnonzero(~single)
        if not len(open_):
            return order
        places = order[open_]
        behind = places + width
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        again = np.argsort(rank[places] * (n + 1) + second, kind="stable")
        places, second = places[again], second[again]
        first = rank[places]
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        order[open_] = places
        starts[open_] = fresh
        rank[places] = np.maximum.accumulate(np.where(fresh, open_, 0))
        width *= 2


def _names(text: np.ndarray, smaller: np.ndarray, order: np.ndarray, length_of: np.ndarray) -> np.ndarray:
    """True where an LMS substring differs from the one before it in ``order``."""
    a, b = order[:-1], order[1:]
    differs = length_of[a] != length_of[b]
    open_ = np.flatnonzero(~differs)
    step = 0
    while len(open_):
        x, y = a[open_] + step, b[open_] + step
        unequal = (text[x] != text[y]) | (smaller[x] != smaller[y])
        differs[open_[unequal]] = True
        open_ = open_[~unequal]
        step += 1
        open_ = open_[step < length_of[a[open_]]]
    return np.concatenate([[True], differs])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of non-negative symbols that end with a unique smallest one."""
    n, symbols = len(text), int(text.max()) + 1
    if n <= 2:
        return np.arange(n)[::-1].copy()
    if symbols > MOST_BUCKETS:
        return _ranked(text)
    smaller = _types(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    narrow = text.astype(np.uint16)

    def per_symbol(places: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(0, np.int64)] * symbols
        for symbol, some in _split_by_symbol(places, narrow):
            out[symbol] = some
        return out

    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = _induced(narrow, smaller, per_symbol(lms), symbols)
    order = rough[is_lms[rough]]
    length_of = np.ones(n, np.int64)
    length_of[lms[:-1]] = np.diff(lms) + 1
    names = np.cumsum(_names(narrow, smaller, order, length_of)) - 1
    if names[-1] + 1 < len(lms):
        name_of = np.empty(n, np.int64)
        name_of[order] = names
        order = lms[suffix_array(name_of[lms])]
    return _induced(narrow, smaller, per_symbol(order), symbols)


#: Every so many places a prefix is compared from its start; the places between begin with what is left of it.
STRIDE = 16


def permuted_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(common prefix with the suffix before it in ``order``, that suffix), both by place; lengths stop at ``most``.

    A place shares at least one symbol less with its predecessor than the place before it shares, so lane after lane of
    places STRIDE apart goes on from there, all places of a lane at once, eight symbols at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text.astype(np.uint64), np.zeros(most + 16, np.uint64)])
    # nine bits a symbol: seven symbols a word
    words = np.zeros(n + most + 9, np.uint64)
    for i in range(7):
        words |= padded[i : i + len(words)] << np.uint64(9 * i)
    common = np.zeros(n, np.int64)
    for lane in range(STRIDE):
        places = np.arange(lane, n, STRIDE)
        length = np.maximum(common[places - 1] - 1, 0) if lane else np.zeros(len(places), np.int64)
        open_ = np.flatnonzero((before[places] >= 0) & (length < most))
        while len(open_):
            x, y = places[open_] + length[open_], before[places[open_]] + length[open_]
            differing = words[np.minimum(x, len(words) - 1)] ^ words[np.minimum(y, len(words) - 1)]
            equal = np.where(differing == 0, 7, _trailing_zero_bits(differing) // 9)
            length[open_] += equal
            open_ = open_[(equal == 7) & (length[open_] < most)]
        common[places] = np.minimum(length, most)
    return common, before


def _trailing_zero_bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64)
