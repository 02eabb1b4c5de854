"""Minimal acyclic transducer: words in, lists of integers out, suffixes shared, walked for whole arrays of words at once.

The automaton is built from sorted words by keeping a register of finished states. Every arc carries the number of words
that sort before those behind it, so the sum along a path is the word's index, and the index leads to the word's ids.
Arcs lie in a double array (base, check); the arrays go into one file that workers map into memory.
"""

from __future__ import annotations

import os

import numpy as np

MAGIC = 0x4C455832


class _State:
    __slots__ = ("arcs", "final", "words")

    def __init__(self):
        self.arcs, self.final, self.words = {}, False, 0

    def key(self):
        return (self.final, *((b, id(s)) for b, s in self.arcs.items()))


def minimal(words: list[bytes]) -> tuple[_State, list[_State]]:
    """Root and distinct states of the minimal automaton of strictly ascending words."""
    root, register, path, before = _State(), {}, [], b""

    def finish(depth: int) -> None:
        while len(path) > depth:
            parent, byte, state = path.pop()
            known = register.setdefault(state.key(), state)
            if known is not state:
                parent.arcs[byte] = known

    for word in words:
        if word <= before and before:
            raise ValueError("words must be distinct and ascending")
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        finish(shared)
        state = path[-1][2] if path else root
        for byte in word[shared:]:
            state.arcs[byte] = child = _State()
            path.append((state, byte, child))
            state = child
        state.final = True
        before = word
    finish(0)
    states = [root, *register.values()]
    return root, states


def _count(root: _State) -> None:
    stack = [(root, False)]
    while stack:
        state, seen = stack.pop()
        if seen:
            state.words = int(state.final) + sum(s.words for s in state.arcs.values())
        elif not state.words:
            stack.append((state, True))
            stack.extend((s, False) for s in state.arcs.values() if not s.words)


class Transducer:
    """base, check, add and final per slot; pool and where hold the ids of word i at pool[where[i]:where[i + 1]]."""

    def __init__(self, base, check, add, final, where, pool, longest):
        self.base, self.check, self.add, self.final, self.where, self.pool, self.longest = base, check, add, final, where, pool, longest

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Transducer:
        words = sorted(w for w in entries if w)
        root, states = minimal(words)
        _count(root)
        order = [root] + sorted((s for s in states if s is not root and s.arcs), key=lambda s: -len(s.arcs))
        # One base per state; all slots that lead to a state share it, so check holds the state's base rather than the slot.
        bases: dict[int, int] = {}
        used, taken, free, near = bytearray(4096), {0}, 1, 1
        used[0] = 1
        for state in order:
            codes = list(state.arcs)
            low, b, tries = min(codes), 0, 0
            if len(codes) == 1:
                at = free
                while used[at] or at - low in taken or at <= low:
                    at += 1
                    if at + 512 >= len(used):
                        used.extend(bytes(len(used)))
                while used[free]:
                    free += 1
                b = at - low
            else:
                b = near
                while b in taken or any(used[b + c] for c in codes):
                    b, tries = b + 1, tries + 1
                    if b + 512 >= len(used):
                        used.extend(bytes(len(used)))
                if tries > 64:  # that region is nearly full
                    near += (b - near + 1) // 2
            taken.add(b)
            bases[id(state)] = b
            for c in codes:
                used[b + c] = 1
            if b + 1024 >= len(used):
                used.extend(bytes(len(used)))
        base, check, add, final = (np.zeros(len(used), np.int32) for _ in range(4))
        check[:] = -1
        for state in order:
            b, ahead = bases[id(state)], int(state.final)
            for byte in sorted(state.arcs):
                child, slot = state.arcs[byte], b + byte
                check[slot], add[slot], final[slot] = b, ahead, int(child.final)
                base[slot] = bases.get(id(child), 0)
                ahead += child.words
        base[0] = bases[id(root)]
        end = int(np.flatnonzero(check >= 0).max(initial=0)) + 257
        counts = np.array([len(entries[w]) for w in words], np.int64)
        where = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        pool = np.array([i for w in words for i in entries[w]], np.int32)
        return cls(base[:end], check[:end], add[:end], final[:end], where, pool, max(map(len, words), default=0))

    def save(self, path: str) -> None:
        """Write one file, under its name only when complete."""
        head = np.array([MAGIC, len(self.base), len(self.where), len(self.pool), self.longest], np.int64)
        with open(f"{path}.{os.getpid()}", "wb") as out:
            for part in (head, self.where, *(np.ascontiguousarray(x, np.int32) for x in (self.base, self.check, self.add, self.final, self.pool))):
                out.write(part.tobytes())
        os.replace(f"{path}.{os.getpid()}", path)

    @classmethod
    def map(cls, path: str) -> Transducer:
        """The saved transducer, its arrays mapped read-only so that the workers of a machine share the pages."""
        head = np.fromfile(path, np.int64, 5)
        if len(head) < 5 or head[0] != MAGIC:
            raise ValueError(f"{path} is no transducer")
        slots, wheres, pool, longest = (int(x) for x in head[1:])
        at = 40
        where = np.memmap(path, np.int64, "r", at, (wheres,))
        at += 8 * wheres
        parts = []
        for n in (slots, slots, slots, slots, pool):
            parts.append(np.memmap(path, np.int32, "r", at, (n,)) if n else np.zeros(0, np.int32))
            at += 4 * n
        return cls(*(np.asarray(p) for p in parts[:4]), np.asarray(where), np.asarray(parts[4]), longest)

    def find(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Index of each word data[begin:begin + length], -1 where the word isn't in the lexicon."""
        found = np.full(len(begin), -1, np.int64)
        live = np.flatnonzero((length > 0) & (length <= self.longest))
        slots = len(self.base)
        at, left = begin[live].astype(np.int64), length[live].astype(np.int32)
        node = np.full(len(live), self.base[0], np.int32)
        total = np.zeros(len(live), np.int32)
        while len(live):
            slot = node + data[at]
            np.minimum(slot, slots - 1, out=slot)
            good = (self.check[slot] == node) & (node > 0)
            total += self.add[slot]
            left -= 1
            ended = left == 0
            hit = good & ended & (self.final[slot] > 0)
            found[live[hit]] = total[hit]
            keep = np.flatnonzero(good & ~ended)
            live, total, left = live[keep], total[keep], left[keep]
            node, at = self.base[slot[keep]], at[keep] + 1
        return found


class Chain:
    """Two transducers as one: the second is asked for what the first doesn't hold."""

    def __init__(self, first: Transducer, second: Transducer):
        self.first, self.second = first, second
        self.where = np.concatenate([first.where[:-1], second.where + len(first.pool)])
        self.pool = np.concatenate([first.pool, second.pool])

    def find(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        found = self.first.find(data, begin, length)
        open_words = np.flatnonzero(found < 0)
        got = self.second.find(data, begin[open_words], length[open_words])
        found[open_words] = np.where(got >= 0, got + len(self.first.where) - 1, -1)
        return found
