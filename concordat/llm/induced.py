"""Induced suffix sorting with common-prefix values, over disk-backed queues.

The text is an array of small integers in which 0 separates strings and ends the last. Its suffixes fall into L (greater
than their successor) and S; an S suffix after an L suffix is a seed. Seeds are ranked through the string of their
phrases (from seed to seed): phrases are named in order, and the named string, at most half as long, is ranked by
doubling, which also yields the common prefixes of neighbouring seeds. From the seeds all L suffixes are induced in
ascending order, and from those all S suffixes in descending order. A queue keyed by first character holds the tuples
still to come (suffix, and the place of the suffix that induced it); it hands out the whole front of equal keys at once,
so numpy works on long runs. The common prefix of two suffixes induced one after the other is one more than the least
common prefix between those that induced them. Tuples beyond ``memory`` bytes wait in a file, and arrays beyond it are
memory-mapped from the task's temporary folder, which is emptied at the end.
"""

from __future__ import annotations

import tempfile

import numpy as np

WIDTH = 7  # characters of 9 bits in a 64-bit key
PAD = 257


class Scratch:
    """Arrays and queues that go to a temporary folder once they outgrow memory."""

    def __init__(self, memory: int) -> None:
        self.memory, self.folder = memory, tempfile.TemporaryDirectory(prefix="suffix-")
        self.made = 0

    def array(self, n: int, dtype: type) -> np.ndarray:
        if n * np.dtype(dtype).itemsize <= self.memory:
            return np.empty(n, dtype)
        self.made += 1
        return np.memmap(f"{self.folder.name}/{self.made}", dtype, "w+", shape=(n,))

    def close(self) -> None:
        self.folder.cleanup()


class Queue:
    """Tuples (position, place of the inducing suffix) by first character; a key's tuples come back in order of arrival."""

    def __init__(self, scratch: Scratch) -> None:
        self.scratch, self.held, self.size, self.file = scratch, {}, 0, None

    def push(self, key: int, rows: np.ndarray) -> None:
        self.held.setdefault(key, []).append(rows)
        self.size += rows.nbytes
        if self.size > self.scratch.memory:
            self.file = self.file or tempfile.TemporaryFile(dir=self.scratch.folder.name)
            for parts in self.held.values():
                for i, part in enumerate(parts):
                    if isinstance(part, np.ndarray):
                        self.file.seek(0, 2)
                        parts[i] = (self.file.tell(), part.size)
                        self.file.write(np.ascontiguousarray(part).tobytes())
            self.size = 0

    def pop(self, key: int) -> np.ndarray | None:
        parts = self.held.pop(key, None)
        if not parts:
            return None
        out = []
        for part in parts:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(8 * part[1]), np.int64).reshape(2, -1)
            else:
                self.size -= part.nbytes
            out.append(part)
        return out[0] if len(out) == 1 else np.concatenate(out, axis=1)


def _refine(rank: np.ndarray, some: np.ndarray, key: np.ndarray) -> None:
    """Orders the groups of equal rank by key; a rank is the place of its group's first member, so others stay as they are."""
    order = np.lexsort((key, rank[some]))
    s, k = some[order], key[order]
    r = rank[s]
    at = np.arange(len(s))
    group = np.ones(len(s), bool)
    group[1:] = r[1:] != r[:-1]
    part = group.copy()
    part[1:] |= k[1:] != k[:-1]
    rank[s] = r + np.maximum.accumulate(np.where(part, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))


def rank_seeds(text: np.ndarray, seeds: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The seeds' order and the common prefixes (at most ``cap``) of each with the one before."""
    m = len(seeds)
    length = np.append(np.diff(seeds) + 1, 1)
    rank = np.zeros(m, np.int64)
    some, at = np.arange(m), 0
    while len(some):  # phrases that are a prefix of another come after it
        key = np.zeros(len(some), np.uint64)
        for j in range(at, at + WIDTH):
            held = length[some] > j
            value = np.full(len(some), PAD, np.uint64)
            value[held] = text[seeds[some[held]] + j]
            key = key << np.uint64(9) | value
        _refine(rank, some, key)
        at += WIDTH
        some = some[length[some] >= at]
    ends = np.flatnonzero(text[seeds] == 0)  # every separator is a character of its own
    rank[ends] = np.arange(len(ends))
    levels, step = [], 1
    while True:
        levels.append((step, rank.copy()))
        some = np.flatnonzero(np.bincount(rank, minlength=m)[rank] > 1)
        if not len(some) or step > cap:
            break
        key = np.full(len(some), -1)
        inside = some + step < m
        key[inside] = levels[-1][1][some[inside] + step]
        _refine(rank, some, key)
        step *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    for step, ranks in reversed(levels):
        same = (a + step <= m - 1) & (b + step <= m - 1)
        same[same] = ranks[a[same]] == ranks[b[same]]
        a[same] += step
        b[same] += step
    common = seeds[a] - seeds[order[:-1]]
    x, y = seeds[a], seeds[b]
    live = np.flatnonzero(common < cap)
    while len(live):
        live = live[(text[x[live] + (j := common[live] - (x[live] - seeds[order[:-1]][live]))] == text[y[live] + j]) & (text[x[live] + j] != 0)]
        common[live] += 1
        live = live[common[live] < cap]
    return order, np.minimum(np.concatenate([[0], common]), cap)


def neighbours(text: np.ndarray, least: int, memory: int = 64 << 20) -> np.ndarray:
    """All suffixes that share ``least`` characters with a neighbour in suffix order. ``text`` ends with 0."""
    n = len(text)
    scratch = Scratch(memory)
    try:
        change = np.flatnonzero(text[:-1] != text[1:])
        ends = np.append(change, n - 1)
        runs = np.diff(ends, prepend=-1)
        rising = np.append(text[change + 1] > text[change], True)
        small = np.repeat(rising, runs)  # S suffixes
        run_end = np.repeat(ends, runs)
        seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
        order, common = rank_seeds(text, seeds, 2 * least)
        seeds = seeds[order]
        first = np.searchsorted(text[seeds], np.arange(text.max() + 2))

        def induce(wanted: np.ndarray, characters: list[int], rest: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
            """Walks the buckets in order. A bucket is what was induced into it, wave by wave, then what ``rest`` has for it."""
            size = int(wanted.sum()) + sum(len(p) for p, _ in rest.values())
            place, prefix = scratch.array(size, np.int64), scratch.array(size, np.int32)
            queue, done, made = Queue(scratch), 0, {}

            def emit(at: np.ndarray, shared: np.ndarray) -> None:
                nonlocal done
                place[done : done + len(at)], prefix[done : done + len(at)] = at, shared
                before = at - 1
                keep = np.flatnonzero((before >= 0) & wanted[before])
                if len(keep):
                    char = text[before[keep]]
                    by = np.argsort(char, kind="stable")
                    keep, char = keep[by], char[by]
                    cuts = [0, *(np.flatnonzero(char[1:] != char[:-1]) + 1).tolist(), len(char)]
                    rows = np.stack([before[keep], keep + done])
                    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                        queue.push(int(char[i]), rows[:, i:j])
                done += len(at)

            for c in characters:
                start, wave = done, 0
                while (rows := queue.pop(c)) is not None:
                    at, source = rows
                    shared = np.full(len(at), wave, np.int32)
                    if len(at) > 1:
                        lo = source[0] + 1
                        shared[1:] = 1 + np.minimum.reduceat(prefix[lo : source[-1] + 1], source[:-1] + 1 - lo)
                    emit(at, np.minimum(shared, 2 * least))
                    wave += 1
                made[c] = (np.array(place[start:done]), np.array(prefix[start:done]))
                if c in rest and len(rest[c][0]):
                    at, shared = rest[c][0], rest[c][1].copy()
                    shared[0] = min(run_end[place[done - 1]] - place[done - 1], run_end[at[0]] - at[0]) + 1 if done > start else 0
                    emit(at, shared)
            return place[:done], prefix[:done], made

        characters = np.flatnonzero(np.bincount(text)).tolist()
        of = {c: (seeds[first[c] : first[c + 1]], common[first[c] : first[c + 1]]) for c in characters}
        _, _, large = induce(~small, characters, of)
        back = {c: (at[::-1], np.append(0, shared[:0:-1]).astype(np.int32)[: len(at)]) for c, (at, shared) in large.items()}
        place, prefix, _ = induce(small, characters[::-1], back)
        hit = np.flatnonzero(prefix >= least)
        return np.unique(np.concatenate([place[hit], place[hit - 1]]))
    finally:
        scratch.close()
