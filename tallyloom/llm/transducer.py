"""A minimal acyclic transducer: words to id sequences, shared prefixes and suffixes.

Built from sorted words (Mihov and Maurel, 2001): outputs stand as early on a path as all words
below allow, and equal states are merged as soon as no later word can change them. The finished
machine is a few flat arrays in one file, which readers map into memory.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

Ids = tuple[int, ...]

_ARRAYS = (("arc_key", np.int64), ("arc_next", np.int32), ("arc_at", np.int32), ("arc_len", np.int32),
           ("end_at", np.int32), ("end_len", np.int32), ("pool", np.uint32))


class _State:
    __slots__ = ("arcs", "final", "end")

    def __init__(self) -> None:
        self.arcs: list[list] = []  # [byte, target, output]
        self.final = False
        self.end: Ids = ()


class _Builder:
    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []

    def freeze(self, state: _State) -> int:
        """The number of the state; one that is already there is shared."""
        form = (state.final, state.end, tuple((b, t, o) for b, t, o in state.arcs))
        number = self.known.get(form)
        if number is None:
            number = self.known[form] = len(self.states)
            self.states.append(form)
        return number

    def build(self, words: Iterable[tuple[bytes, Ids]]) -> int:
        path, last = [_State()], b""
        for word, ids in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            self._close(path, same)
            for byte in word[same:]:
                path[-1].arcs.append([byte, -1, ()])
                path.append(_State())
            path[-1].final = True
            for depth in range(same):
                arc = path[depth].arcs[-1]
                common = _common(arc[2], ids)
                if rest := arc[2][common:]:
                    below = path[depth + 1]
                    for each in below.arcs:
                        each[2] = rest + each[2]
                    if below.final:
                        below.end = rest + below.end
                arc[2], ids = ids[:common], ids[common:]
            if same < len(word):
                path[same].arcs[-1][2] = ids
            else:  # only the empty word, which sorts first
                path[same].end = ids
            last = word
        self._close(path, 0)
        return self.freeze(path[0])

    def _close(self, path: list[_State], depth: int) -> None:
        while len(path) > depth + 1:
            done = self.freeze(path.pop())
            path[-1].arcs[-1][1] = done


def _common(a: Ids, b: Ids) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def compiled(entries: Iterable[tuple[bytes, Ids]]) -> bytes:
    """The machine of distinct words and their ids, as the bytes of its file."""
    words = sorted(entries)
    builder = _Builder()
    start = builder.build(words)
    pool: list[int] = []
    places: dict[Ids, int] = {}

    def place(ids: Ids) -> int:
        if ids not in places:
            places[ids] = len(pool)
            pool.extend(ids)
        return places[ids]

    arcs = sorted((s << 8 | b, t, place(o), len(o))
                  for s, (_, _, out) in enumerate(builder.states) for b, t, o in out)
    ends = [(place(e) if f else 0, len(e) if f else -1) for f, e, _ in builder.states]
    columns = dict(zip(("arc_key", "arc_next", "arc_at", "arc_len"), zip(*arcs) if arcs else [()] * 4))
    columns |= {"end_at": [a for a, _ in ends], "end_len": [n for _, n in ends], "pool": pool}
    arrays = [np.asarray(columns[name], kind) for name, kind in _ARRAYS]
    longest = max((len(w) for w, _ in words), default=0)
    header = np.array([start, longest, *map(len, arrays)], np.int64)
    return b"".join([header.tobytes(), *(_padded(a.tobytes()) for a in arrays)])


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


class Transducer:
    """Looks up many words at once, one byte of all of them a step."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        head = 8 * (2 + len(_ARRAYS))
        self.start, self.longest, *sizes = whole[:head].view(np.int64).tolist()
        for (name, kind), size in zip(_ARRAYS, sizes):
            end = head + size * np.dtype(kind).itemsize
            setattr(self, name, whole[head:end].view(kind))
            head = end + -end % 8

    def __len__(self) -> int:
        return len(self.end_len)

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, ids, sizes): which words are known, the ids of those one after another in
        the order of the words, and how many each word has (0 if unknown)."""
        n = len(starts)
        state = np.full(n, self.start, np.int64)
        known = lengths <= self.longest
        at = np.flatnonzero(known)
        owners, places, sizes = [], [], []
        for step in range(self.longest):
            at = at[lengths[at] > step]
            if not len(at) or not len(self.arc_key):
                break
            key = state[at] << 8 | data[starts[at] + step]
            arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            hit = self.arc_key[arc] == key
            known[at[~hit]] = False
            at, arc = at[hit], arc[hit]
            state[at] = self.arc_next[arc]
            self._note(at, self.arc_at[arc], self.arc_len[arc], owners, places, sizes)
        if not len(self.arc_key):
            known &= lengths == 0
        known &= self.end_len[state] >= 0
        done = np.flatnonzero(known)
        self._note(done, self.end_at[state[done]], self.end_len[state[done]], owners, places, sizes)
        owner, place, size = (np.concatenate([np.empty(0, np.int64), *x]) for x in (owners, places, sizes))
        keep = known[owner]
        owner, place, size = owner[keep], place[keep], size[keep]
        order = np.argsort(owner, kind="stable")  # events of a word stay in the order of its bytes
        ids = self.pool[spread(place[order], size[order])]
        return known, ids, np.bincount(owner, size, n).astype(np.int64)

    @staticmethod
    def _note(owner, place, size, owners, places, sizes) -> None:
        says = size > 0
        owners.append(owner[says])
        places.append(place[says].astype(np.int64))
        sizes.append(size[says].astype(np.int64))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
