"""Whole-array routines on bytes and 64-bit integers (no Spark)."""

from __future__ import annotations

import numpy as np

U64 = np.uint64

# Fixed values of the XXH64 specification.
P1, P2, P3, P4, P5 = (U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))

WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of many texts. data: their bytes, each word followed by one
    space, then 40 zero bytes; start and size: of each word; count: words of
    each text; first: index of each text's first word."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        white = WHITE[raw]
        before = np.empty_like(white)
        before[0] = True
        before[1:] = white[:-1]
        keep = ~(white & before)
        kept_white = white[keep]
        data = (LOWER[raw] if lower else raw)[keep]
        self.data = np.concatenate([np.where(kept_white, np.uint8(32), data), np.zeros(40, np.uint8)])
        ends = np.flatnonzero(kept_white)
        self.start = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
        self.size = ends - self.start
        # words that begin before each text's end, counted on the raw bytes
        begun = np.cumsum(~white & before)
        stop = np.cumsum([len(t) + 1 for t in texts]) - 1
        upto = begun[stop]
        self.count = np.diff(upto, prepend=0)
        self.first = upto - self.count


def lanes(data: np.ndarray) -> np.ndarray:
    """Little-endian 64-bit words at every byte offset."""
    return np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42, block: int = 16384) -> np.ndarray:
    """XXH64 of the spans data[start:start+size]; data needs 40 bytes of slack."""
    out = np.empty(len(start), dtype=U64)
    at8 = lanes(data)
    for i in range(0, len(start), block):
        out[i : i + block] = _xxh64(data, at8, start[i : i + block], size[i : i + block], U64(seed))
    return out


def _xxh64(data, at8, start, size, seed):
    with np.errstate(over="ignore"):
        h = np.full(len(start), seed + P5, dtype=U64)
        pos = start.astype(np.int64)
        rest = size.astype(np.int64)
        if (wide := np.flatnonzero(rest >= 32)).size:
            acc = [np.full(len(wide), s, dtype=U64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            todo, p, left = np.arange(len(wide)), pos[wide], rest[wide]
            while todo.size:
                for k in range(4):
                    acc[k][todo] = _round(acc[k][todo], at8[p[todo] + 8 * k])
                p[todo] += 32
                left[todo] -= 32
                todo = todo[left[todo] >= 32]
            x = rotl(acc[0], 1) + rotl(acc[1], 7) + rotl(acc[2], 12) + rotl(acc[3], 18)
            for k in range(4):
                x = (x ^ _round(np.zeros(1, U64), acc[k])) * P1 + P4
            h[wide], pos[wide], rest[wide] = x, p, left
        h += size.astype(U64)
        for _ in range(3):
            on = rest >= 8
            if not on.any():
                break
            x = rotl(h ^ _round(np.zeros(1, U64), at8[pos]), 27) * P1 + P4
            h = np.where(on, x, h)
            pos = pos + 8 * on
            rest = rest - 8 * on
        on = rest >= 4
        if on.any():
            x = rotl(h ^ ((at8[pos] & U64(0xFFFFFFFF)) * P1), 23) * P2 + P3
            h = np.where(on, x, h)
            pos = pos + 4 * on
            rest = rest - 4 * on
        for _ in range(3):
            on = rest >= 1
            if not on.any():
                break
            x = rotl(h ^ (data[pos].astype(U64) * P5), 11) * P1
            h = np.where(on, x, h)
            pos = pos + on
            rest = rest - on
        h ^= h >> U64(33)
        h *= P2
        h ^= h >> U64(29)
        h *= P3
        return h ^ (h >> U64(32))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(32))) * P2
        x = (x ^ (x >> U64(29))) * P3
        return x ^ (x >> U64(32))


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 joined by links a-b: the smallest node of each one's component."""
    parent = np.arange(n)
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b replaced by (node, smallest node of its component), node > that."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = roots(code[: len(a)], code[len(a) :], len(nodes))
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def span_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; data needs 40 bytes of slack."""
    at8 = lanes(data)
    with np.errstate(over="ignore"):
        h = size.astype(U64) * P5
        todo, pos, rest = np.arange(len(start)), start.astype(np.int64), size.astype(np.int64)
        while todo.size:
            lane = at8[pos]
            short = rest < 8
            lane = np.where(short, lane & ((U64(1) << (U64(8) * np.minimum(rest, 7).astype(U64))) - U64(1)), lane)
            x = (h[todo] ^ lane) * P1
            h[todo] = (x ^ (x >> U64(29))) * P2
            more = rest > 8
            todo, pos, rest = todo[more], pos[more] + 8, rest[more] - 8
        return mix(h)


def rolled(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of every width consecutive values."""
    base = int(P4) | 1
    power, size, have, done = base, 1, None, 0
    run = values
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                if have is None:
                    have = run
                else:
                    n = len(run) - done
                    have = have[: max(n, 0)] * U64(power) + run[done:]
                done += size
            if done == width:
                return have[: max(len(values) - width + 1, 0)]
            n = max(len(run) - size, 0)
            run = run[:n] * U64(power) + run[size : size + n]
            power = power * power % 2**64
            size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every width consecutive values."""
    size, run = 1, values
    while 2 * size <= width:
        run = np.minimum(run[:-size], run[size:])
        size *= 2
    over = width - size
    return np.minimum(run[: len(run) - over], run[over:]) if over else run


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., count[0] of them; then those of start[1] ..."""
    total = int(count.sum())
    offset = np.cumsum(count) - count
    return np.repeat(start - offset, count) + np.arange(total)
