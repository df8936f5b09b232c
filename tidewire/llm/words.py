"""Words of many texts at once, with constant-time hashes of word sequences.

A word is a run of bytes other than space and 0x09 to 0x0D.  The words of a
batch are laid out with one space after each; prefix sums of a polynomial hash
(random byte values, arithmetic modulo 2**64) then give the hash of any sequence
of words from two look-ups, in numpy throughout.  Long sequences of a certain build
collide in it whatever the base, so it serves to look for candidates alone.
``sequence_hashes`` tell sequences apart: a word's bytes, eight at a time, and then the
words' values go one by one into a state that a bijection moves after each, so that
what collides does so by chance, at one in 2**64.

Defined cases: texts without words have no sequence; words that repeat, and equal
sequences, have equal hashes wherever they stand; no text is too long.
"""

from __future__ import annotations

import numpy as np
import xxhash

from tidewire.llm.common import IS_SPACE

#: Bytes of words that are hashed in numpy; longer ones are hashed one by one.
LONG_WORD = 64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20_240_501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def absorb(state: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values into a state, in place; for any value this is a bijection of states."""
    state ^= values
    state *= np.uint64(0xC4CEB9FE1A85EC53)
    state ^= state >> np.uint64(32)
    return state


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Hasher:
    """Keeps the powers of the base from one batch to the next."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)


class Words:
    """``first[d]`` to ``first[d + 1]`` are the words of text ``d``."""

    def __init__(self, texts: list[bytes], hasher: Hasher | None = None) -> None:
        raw = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        space = IS_SPACE[raw]
        keep = ~space
        keep[1:] |= ~space[:-1]
        self.data = np.where(space, np.uint8(0x20), raw)[keep]
        self.ends = np.flatnonzero(self.data == 0x20)
        self.starts = np.empty_like(self.ends)
        self.starts[:1] = 0
        self.starts[1:] = self.ends[:-1] + 1
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(sizes)])]
        self.first = np.searchsorted(self.ends, kept)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        if hasher is not None:
            n = len(self.data) + 1
            hasher.grow(n)
            self.down = hasher.down
            self.prefix = np.zeros(n, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[self.data] * hasher.up[: n - 1], dtype=np.uint64, out=self.prefix[1:])

    def __len__(self) -> int:
        return len(self.ends)

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """Of the ``length`` words from each word of ``at`` on."""
        s, e = self.starts[at], self.ends[at + length - 1]
        return mix((self.prefix[e] - self.prefix[s]) * self.down[s])

    def word_values(self) -> np.ndarray:
        """A 64-bit value of each word."""
        size = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray((len(self.data),), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
        state = mix(size.astype(np.uint64) * np.uint64(_BASE))
        at = np.arange(len(size))
        for done in range(0, LONG_WORD, 8):
            at = at[size[at] > done]
            if not len(at):
                break
            chunk = eight[self.starts[at] + done]
            chunk <<= np.maximum(8 - (size[at] - done), 0).astype(np.uint64) << np.uint64(3)
            state[at] = absorb(chunk, state[at])
        out = mix(state)
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.data[self.starts[k] : self.ends[k]].tobytes())
        return out

    def sequence_hashes(self, values: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """Of the ``length`` words from each word of ``at`` on (neighbours), by the words' values."""
        state = np.full(len(at), mix(np.array([length], dtype=np.uint64))[0], dtype=np.uint64)
        first = int(at[0]) if len(at) else 0
        for k in range(length):
            absorb(state, values[first + k : first + k + len(at)])
        return mix(state)

    def within(self, at: np.ndarray, length: int) -> np.ndarray:
        """Whether ``length`` words from each word of ``at`` on are of one text."""
        last = at + length - 1
        ok = last < len(self)
        ok[ok] = self.doc[last[ok]] == self.doc[at[ok]]
        return ok

    def joined(self, d: int, keep: np.ndarray | None = None) -> bytes:
        """The words of text ``d`` (those in ``keep``) joined by one space."""
        a, b = self.first[d], self.first[d + 1]
        if a == b:
            return b""
        if keep is None or keep.all():
            return self.data[self.starts[a] : self.ends[b - 1]].tobytes()
        mask = np.repeat(keep, self.ends[a:b] - self.starts[a:b] + 1)
        return self.data[self.starts[a] : self.ends[b - 1] + 1][mask].tobytes()[:-1]
