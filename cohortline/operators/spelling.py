"""Known names nearest to asked ones, by edits or by shared bigrams, within a block of each."""

from __future__ import annotations

import numpy as np

WIDE = 1 << 16  # beginnings of names that are looked at together
TOGETHER = 256  # asked names that are


def _signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signs of the texts in a row, where each text begins, and its length."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(lengths) - lengths, lengths


class Trie:
    """Distinct names by their beginnings: ``levels[t]`` has a node per beginning of t + 1 signs, in the order of the names."""

    def __init__(self, names: list[str]):
        signs, starts, self.lengths = _signs(names)
        order = np.asarray(sorted(range(len(names)), key=names.__getitem__), np.int64)
        alive, node, nodes = order, np.zeros(len(order), np.int64), 1
        self.levels = []
        for t in range(int(self.lengths.max(initial=0))):
            longer = self.lengths[alive] > t
            alive, parent = alive[longer], node[longer]
            sign = signs[starts[alive] + t]
            new = np.r_[True, (parent[1:] != parent[:-1]) | (sign[1:] != sign[:-1])]
            first = np.flatnonzero(new)
            node = np.cumsum(new) - 1
            held = self.lengths[alive]
            self.levels.append((
                np.searchsorted(parent[first], np.arange(nodes + 1)),  # the children of each node one level up
                sign[first], np.minimum.reduceat(held, first), np.maximum.reduceat(held, first),  # sign, least and most length below
                np.where(held[first] == t + 1, alive[first], -1)))  # the name that ends here
            nodes = len(first)

    def within(self, texts: np.ndarray, lengths: np.ndarray, lost: np.ndarray, edits: int):
        """``(asked, name, edits)`` for names at most ``edits`` away, nor more than the share ``lost`` of the longer of both.

        A beginning is left as soon as no name that has it can be near enough: its row of the
        table of distances, with the signs that must still be added or left out, says so.
        """
        width = np.arange(texts.shape[1] + 1)
        found = [(np.empty(0, np.int64),) * 3]
        open_ = [(0, np.arange(len(texts)), np.zeros(len(texts), np.int64), np.repeat(width[None], len(texts), 0).astype(np.int32))]
        while open_:
            t, asked, node, rows = open_.pop()
            if t == len(self.levels) or not len(asked):
                continue
            children, sign, least, most, ends = self.levels[t]
            n = children[node + 1] - children[node]
            if n.sum() > WIDE and len(asked) > 1:
                half = len(asked) // 2
                open_ += [(t, asked[p], node[p], rows[p]) for p in (slice(half), slice(half, None))]
                continue
            of = np.repeat(np.arange(len(asked)), n)
            child = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + children[node][of]
            asked, rows = asked[of], rows[of]
            size, most, least = lengths[asked], most[child], least[child]
            bound = np.minimum(edits, np.floor(lost[asked] * np.maximum(size, most) + 1e-6)).astype(np.int32)
            row = np.minimum(rows + 1, t + 1)
            row[:, 1:] = np.minimum(rows[:, 1:] + 1, rows[:, :-1] + (texts[asked] != sign[child][:, None]))
            row[:, 0] = t + 1
            row = np.minimum.accumulate(row - width, axis=1) + width
            left = size[:, None] - width  # signs of the asked name that are not in the row's column
            missing = np.maximum(np.maximum(left - (most - t - 1)[:, None], (least - t - 1)[:, None] - left), 0)
            can = (np.where(left >= 0, row + missing, np.iinfo(np.int32).max).min(1) <= bound)
            asked, child, row, size = asked[can], child[can], row[can].astype(np.int32), size[can]
            name = ends[child]
            away = row[np.arange(len(row)), size]
            hit = (name >= 0) & (away <= np.minimum(edits, np.floor(lost[asked] * np.maximum(size, self.lengths[name]) + 1e-6)))
            found.append((asked[hit], name[hit], away[hit].astype(np.int64)))
            open_.append((t + 1, asked, child, row))
        return tuple(np.concatenate(c) for c in zip(*found))


def nearest(asked: list[str], lost: np.ndarray, names: list[str], values: list[str]) -> np.ndarray:
    """Of the ``names`` at most the share ``lost`` of the longer name away from each asked one the most alike (equals: the least value), -1 if none.

    Bounds grow by one edit until no name further away could be more alike.
    """
    trie, rank = Trie(names), np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=values.__getitem__)] = np.arange(len(names))
    signs, starts, sizes = _signs(asked)
    best, alike = np.full(len(asked), -1), np.full(len(asked), -1.0)
    longest = trie.lengths.max(initial=0)
    order = np.argsort(sizes, kind="stable")
    for a in range(0, len(order), TOGETHER):
        left, edits = order[a:a + TOGETHER], 0
        texts = np.zeros((len(asked), 0), np.uint32)
        while len(left):
            edits += 1
            size = sizes[left]
            texts = np.zeros((len(left), int(size.max())), np.uint32)
            inside = np.arange(texts.shape[1]) < size[:, None]
            texts[inside] = signs[(starts[left][:, None] + np.arange(texts.shape[1]))[inside]]
            of, name, d = trie.within(texts, size, lost[left], edits)
            share = 1 - d / np.maximum(np.maximum(size[of], trie.lengths[name]), 1)
            first = np.lexsort((rank[name], -np.round(share, 9), of))
            first = first[np.r_[True, np.diff(of[first]) > 0][:len(first)]]
            best[left[of[first]]], alike[left[of[first]]] = name[first], share[first]
            further = np.minimum(size / (size + edits + 1), 1 - (edits + 1) / np.maximum(size, longest))
            left = left[(alike[left] <= further + 1e-9) & (edits < np.floor(lost[left] * np.maximum(size, longest) + 1e-6))]
    return best


class Bigrams:
    """Which of the names hold each pair of neighbouring signs, with a mark before the first and one after the last."""

    def __init__(self, names: list[str]):
        name, gram = _pairs(names)
        self.grams, gram = np.unique(gram, return_inverse=True)
        both = np.unique(gram * len(names) + name)
        self.holders = both % max(1, len(names))
        self.of = np.searchsorted(both // max(1, len(names)), np.arange(len(self.grams) + 1))
        common = np.flatnonzero(np.diff(self.of) > len(names) / 64)  # 64 times the pairs of a name at most
        self.bit = np.full(len(self.grams), -1)
        self.bit[common] = np.arange(len(common))
        self.bits = np.zeros((len(names), -(-len(common) // 64)), np.uint64)
        for i, g in enumerate(common):
            self.bits[self._holding(g), i // 64] |= np.uint64(1 << i % 64)
        self.counted = np.zeros(len(names), np.int64)
        self.rank = np.empty(len(names), np.int64)
        self.rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))

    def _holding(self, gram: int) -> np.ndarray:
        return self.holders[self.of[gram]:self.of[gram + 1]]

    def number(self, gram: np.ndarray) -> np.ndarray:
        """The numbers of those grams that any name holds."""
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        return np.unique(at[self.grams[at] == gram])

    def sharing(self, asked: str, rare: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the names that hold one of the ``rare`` pairs the ``most`` that share most pairs with the asked one (equals: the first), and how many."""
        holds = np.zeros(len(self.counted), bool)
        for g in self.number(_codes(rare)):
            holds[self._holding(g)] = True
        met = np.flatnonzero(holds)
        if not len(met):
            return met, met
        grams = self.number(_pairs([asked])[1])
        bits = self.bit[grams][self.bit[grams] >= 0]
        sought = np.zeros(self.bits.shape[1], np.uint64)
        np.bitwise_or.at(sought, bits // 64, np.uint64(1) << (bits % 64).astype(np.uint64))
        words = np.flatnonzero(sought)
        shared = np.bitwise_count(self.bits[np.ix_(met, words)] & sought[words]).sum(1, dtype=np.int64)
        seldom = [self._holding(g) for g in grams[self.bit[grams] < 0]]
        for names in seldom:
            self.counted[names] += 1
        shared += self.counted[met]
        for names in seldom:
            self.counted[names] = 0
        if len(met) > most:
            some = shared >= np.partition(shared, -most)[-most]
            met, shared = met[some], shared[some]
        best = np.lexsort((self.rank[met], -shared))[:most]
        return met[best], shared[best]


def _codes(pairs: list[str]) -> np.ndarray:
    signs = _signs(pairs)[0].astype(np.uint64).reshape(-1, 2)
    return signs[:, 0] << np.uint64(32) | signs[:, 1]


def _pairs(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row per name and pair: the name's number and the pair."""
    signs, starts, lengths = _signs([f"^{n}$" for n in names])
    name = np.repeat(np.arange(len(names)), lengths)
    last = np.zeros(len(signs), bool)
    last[starts + lengths - 1] = True
    at = np.flatnonzero(~last)
    return name[at], signs[at].astype(np.uint64) << np.uint64(32) | signs[at + 1]
