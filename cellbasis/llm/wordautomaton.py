"""An Aho-Corasick automaton over words, in arrays whose size follows the items' words and not their windows.

All windows of an item overlap, so the trie of windows is that of the item text's substrings of up to `window` words. A state is
named by the first place in the item text where its words stand and by their number, and needs no storage of its own: the child
that the text itself goes on to is the same place with one word more; only where another occurrence goes on differently is
there a branch, at most one a word. The failure link drops the first word: it is the next place, under its first
occurrence. Texts walk side by side, in pieces that overlap by a window less one word, which leaves no match out.
"""

from __future__ import annotations

import numpy as np

_END = -2  # after each item's words; no word of a text is this number
_UNKNOWN = -1
_PIECE = 128  # words of a text that walk as one


def _hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Open addressing over distinct keys: slots (key or -1), values, bits."""
    bits = max(4, (2 * len(keys)).bit_length())
    slots = np.full(1 << bits, -1, dtype=np.int64)
    held = np.zeros(1 << bits, dtype=np.int32)
    at, left = _slot(keys, bits), np.arange(len(keys))
    while len(left):
        free = slots[at] < 0
        slots[at[free]] = keys[left[free]]  # of those that want one slot the last gets it
        mine = free & (slots[at] == keys[left])
        held[at[mine]] = values[left[mine]]
        left, at = left[~mine], (at[~mine] + 1) & ((1 << bits) - 1)
    return slots, held, bits


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Automaton:
    """The automaton of the windows of `items` (id, words): `window` consecutive words each, or all of fewer."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.ids = sorted({i for i, words in items if words})
        rank_of = {i: k for k, i in enumerate(self.ids)}
        flat: list[int] = []
        owner, left = [], []
        for item, words in items:
            if words:
                flat += [self.numbers.setdefault(w, len(self.numbers)) for w in words]
                flat.append(_END)
                owner += [rank_of[item]] * (len(words) + 1)
                left += range(len(words), -1, -1)
        self.text = np.array(flat, dtype=np.int32)
        n, many = len(flat), len(self.numbers) + 1
        owner, left = np.array(owner, dtype=np.int64), np.array(left, dtype=np.int64)
        # by number of words and place: the first place with the same words; -1 where the item ends before
        self.first = np.full((window + 1, n), -1, dtype=np.int32)
        rank = np.zeros(n, dtype=np.int64)
        keys, values = [], []
        for size in range(1, window + 1):
            at = np.flatnonzero(left >= size)
            _, firsts, same = np.unique(rank[at] * many + self.text[at + size - 1], return_index=True, return_inverse=True)
            self.first[size, at] = at[firsts][same]
            rank[at] = same
            if size > 1:
                new = at[(self.first[size, at] == at) & (self.first[size - 1, at] != at)]
                keys.append((self.first[size - 1, new].astype(np.int64) * (window + 1) + size - 1) * many + self.text[new + size - 1])
                values.append(new)
        self.start = np.zeros(many, dtype=np.int32)
        at = np.flatnonzero(left >= 1)
        self.start[self.text[at]] = self.first[1, at]
        empty = np.zeros(0, dtype=np.int64)
        self.slots, self.held, self.bits = _hash_table(np.concatenate(keys or [empty]), np.concatenate(values or [empty]))
        # which items have a window, by its words' number and first place
        whole = np.zeros(n, dtype=bool)  # places where a short item is one window
        if n:
            starts = np.concatenate([[0], np.flatnonzero(self.text == _END)[:-1] + 1])
            whole[starts[left[starts] < window]] = True
        at = np.flatnonzero(whole | (left >= window))
        size = np.minimum(left[at], window)
        codes = self.first[size, at].astype(np.int64) * (window + 1) + size
        both = np.unique(np.stack([codes, owner[at]]), axis=1) if n else np.zeros((2, 0), dtype=np.int64)
        self.codes, edges = np.unique(both[0], return_index=True)
        self.edges, self.items = np.append(edges, both.shape[1]), both[1].astype(np.int32)
        self.sizes = [int(s) for s in np.unique(self.codes % (window + 1))]

    def numbered(self, words: list[bytes]) -> list[int]:
        get = self.numbers.get
        return [get(w, _UNKNOWN) for w in words]

    def _advance(self, place: np.ndarray, size: np.ndarray, word: np.ndarray) -> None:
        """Move the states (`place`, `size`), in place, by one known word each."""
        window, many = self.window, len(self.numbers) + 1
        todo = np.arange(len(word))
        while len(todo):
            p, s, w = place[todo], size[todo], word[todo]
            full = s == window
            if full.any():  # nothing is longer than a window
                p = np.where(full, self.first[window - 1, np.minimum(p + 1, len(self.text) - 1)] if window > 1 else 0, p)
                s = np.where(full, window - 1, s)
            root = s == 0
            p = np.where(root, self.start[w], p)
            done = root | (self.text[p + s] == w)
            rest = np.flatnonzero(~done)
            if len(rest):
                key = (p[rest].astype(np.int64) * (window + 1) + s[rest]) * many + w[rest]
                at = _slot(key, self.bits)
                open_ = np.arange(len(rest))
                while len(open_):
                    seen = self.slots[at]
                    hit = seen == key[open_]
                    p[rest[open_[hit]]] = self.held[at[hit]]
                    done[rest[open_[hit]]] = True
                    go_on = ~hit & (seen >= 0)
                    open_, at = open_[go_on], (at[go_on] + 1) & (len(self.slots) - 1)
            place[todo], size[todo] = p, s + done
            todo, p, s = todo[~done], p[~done], s[~done] - 1
            # the failure link: one word less from the next place on
            place[todo], size[todo] = np.where(s > 0, self.first[s, p + 1], 0), s

    def scan(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence of a window in `numbers` (texts' word numbers, _UNKNOWN for other words and between texts):
        first word, number of words, and the window's place in `codes`."""
        none = np.zeros(0, dtype=np.int64)
        if not self.sizes or not len(numbers):
            return none, none, none
        known = np.concatenate([[False], numbers >= 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        run, end = edge[::2], edge[1::2]
        long = end - run >= self.sizes[0]
        run, end = run[long], end[long]
        pieces = -(-(end - run) // _PIECE)
        of = np.repeat(np.arange(len(run)), pieces)
        own = run[of] + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _PIECE
        begin, stop = np.maximum(own - (self.window - 1), run[of]), np.minimum(own + _PIECE, end[of])
        order = np.argsort(begin - stop, kind="stable")  # longest first: those still walking are always the first ones
        begin, length = begin[order], (stop - begin)[order]
        place, size = np.zeros(len(order), dtype=np.int32), np.zeros(len(order), dtype=np.int32)
        alive = len(order)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(int(length[0]) if len(length) else 0):
            while alive and length[alive - 1] <= step:
                alive -= 1
            at = begin[:alive] + step
            self._advance(place[:alive], size[:alive], numbers[at])
            for n in self.sizes:
                deep = np.flatnonzero(size[:alive] >= n)
                if len(deep):
                    # the last n words that were read, under their first place
                    code = self.first[n, place[deep] + size[deep] - n].astype(np.int64) * (self.window + 1) + n
                    k = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                    is_window = self.codes[k] == code
                    found.append((at[deep[is_window]] - n + 1, np.full(int(is_window.sum()), n), k[is_window]))
        if not found:
            return none, none, none
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def items_of(self, code: int) -> list[str]:
        return [self.ids[k] for k in self.items[self.edges[code] : self.edges[code + 1]].tolist()]
