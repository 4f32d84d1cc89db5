"""Pairs of ids with the least MD5, by numpy: many short messages are hashed at
once, and only as far as their digests' first words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Messages hashed at once: a dozen buffers of so many words stay in a core's cache.
#: Pairs whose masks are held at once, and those a src has left of a block, at most.
LANES, MASKED, LEFT_OVER = 32768, 1 << 21, 32

SINES = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0**32).astype(np.uint32)
START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
#: Steps read the message's words in this order.  The digest's first word is done
#: after step 60; the three steps after it make the other words.
STEPS = 61
WORD = np.array([(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)])
TURN = [((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))[i // 16][i % 4] for i in range(64)]
LEFT, RIGHT = ([np.array(x, np.uint32) for x in y] for y in (TURN, [32 - s for s in TURN]))


class Heads:
    """Buffers for LANES messages of one block (55 bytes at most) each."""

    def __init__(self, lanes: int = LANES):
        self.lanes, self.buffers, self.sums = lanes, np.empty((7, lanes), np.uint32), np.empty(64, np.uint32)
        self.sum = [self.sums[i, ...] for i in range(64)]

    def of(self, fixed: np.ndarray, words: dict[int, np.ndarray], n: int) -> np.ndarray:
        """The first words of the digests, as MD5 holds them (little-endian), of n
        messages; valid until the next call.

        ``fixed`` are the 16 words all messages share, zero where they differ;
        ``words`` are the others, by their place.
        """
        a, b, c, d, t, u, x = self.buffers[:, :n]
        for y, z in zip((a, b, c, d), START, strict=True):
            y.fill(z)
        np.add(SINES, fixed[WORD], out=self.sums)
        for i in range(STEPS):
            if i < 16:
                np.bitwise_xor(c, d, t)
                np.bitwise_and(t, b, t)
                np.bitwise_xor(t, d, t)
            elif i < 32:
                np.bitwise_xor(b, c, t)
                np.bitwise_and(t, d, t)
                np.bitwise_xor(t, c, t)
            elif i < 48:  # the step after has b ^ c as its c ^ d
                if i % 2 == 0:
                    np.bitwise_xor(b, c, x)
                np.bitwise_xor(x, b if i % 2 else d, t)
            else:
                np.invert(d, t)
                np.bitwise_or(t, b, t)
                np.bitwise_xor(t, c, t)
            np.add(t, a, t)
            np.add(t, self.sum[i], t)
            if (w := words.get(int(WORD[i]))) is not None:
                np.add(t, w, t)
            np.left_shift(t, LEFT[i], u)
            np.right_shift(t, RIGHT[i], t)
            np.bitwise_or(t, u, t)
            np.add(t, b, a)
            a, b, c, d = d, a, b, c
        # step 60 made b
        return np.add(b, START[0], b)


def by_length(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and bytes (a row each) of the decimal forms of one length, ascending."""
    text = ids.astype(np.int64).astype("S20")
    size = np.char.str_len(text)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        at = at[np.argsort(ids[at], kind="stable")]
        yield at, np.ascontiguousarray(text[at]).view(np.uint8).reshape(-1, 20)[:, :n]


def words_of(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Words of the messages 'left-right': of the left part, of the right one with
    the end mark (each 16 rows, to be or-ed), and the length in bits."""
    n, m = left.shape[1], right.shape[1]
    a, b = np.zeros((len(left), 64), np.uint8), np.zeros((len(right), 64), np.uint8)
    a[:, :n], a[:, n] = left, ord("-")
    b[:, n + 1 : n + 1 + m], b[:, n + 1 + m] = right, 0x80
    return np.ascontiguousarray(a.view("<u4").T), np.ascontiguousarray(b.view("<u4").T), 8 * (n + 1 + m)


def least_pairs(src: np.ndarray, dst: np.ndarray, k: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray], lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst): of each src's ``wanted`` pairs the k with the least MD5 of
    'src-dst', and all that equal the k-th in the digest's first word.

    ``wanted`` gets two arrays that meet by broadcasting.
    """
    heads, out = Heads(lanes), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    columns = list(by_length(dst))
    for places, left in by_length(src):
        groups = [(at, *words_of(left, right)) for at, right in columns]
        rows = max(1, MASKED // max(1, len(dst)))
        for s in range(0, len(places), rows):
            own = src[places[s : s + rows]]
            part = [(at, a[:, s : s + rows], b, n, np.broadcast_to(wanted(own[:, None], dst[at][None, :]), (len(own), len(at)))) for at, a, b, n in groups]
            many = sum((mask.sum(1) for *_, mask in part), np.zeros(len(own), np.int64))
            bits = np.ceil(np.log2(np.maximum(many, LEFT_OVER) / LEFT_OVER)).astype(np.int64)
            open_rows = np.flatnonzero(many)
            while len(open_rows):
                row, col, head = under(heads, part, open_rows, bits)
                enough = np.bincount(row, minlength=len(own)) >= np.minimum(many, k)
                keep = np.flatnonzero(enough[row])
                keep = keep[np.lexsort((head[keep], row[keep]))]
                row, col, head = row[keep], col[keep], head[keep]
                first = np.searchsorted(row, row)
                last = np.minimum(first + k, np.searchsorted(row, row, "right")) - 1
                least = head <= head[last]
                out.append((own[row[least]], dst[col[least]]))
                # the others again, with fewer leading zeros, at last with none
                open_rows, bits = open_rows[~enough[open_rows]], np.maximum(0, bits - 4)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def under(heads: Heads, part: list[tuple], rows: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place of dst and first word, big-endian as in the digest, of the wanted
    pairs of ``rows`` whose digests begin with so many zero bits as their row asks."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))]
    zero = (2**32 - (1 << (32 - bits))).astype(np.uint32).byteswap()
    for at, left, right, length, mask in part:
        step = max(1, heads.lanes // len(at))
        for s in range(0, len(rows), step):
            some = rows[s : s + step]
            seen = mask[some].any(0)
            lo, hi = int(seen.argmax()), len(at) - int(seen[::-1].argmax())
            if not seen[lo]:
                continue
            pieces = -(-(hi - lo) * len(some) // heads.lanes)
            for p in range(pieces):
                i, j = (lo + (hi - lo) * x // pieces for x in (p, p + 1))
                fixed, words = np.zeros(16, np.uint32), {}
                fixed[14] = length
                for w in range(length // 32 + 1):
                    a, b = left[w, some], right[w, i:j]
                    if len(some) == 1 and not b[0]:
                        fixed[w] = a[0]
                    else:
                        words[w] = (a[:, None] | b[None, :]).ravel()
                head = heads.of(fixed, words, len(some) * (j - i)).reshape(len(some), j - i)
                r, c = np.nonzero((head & zero[some][:, None]) == 0)
                good = mask[some[r], i + c]
                r, c = r[good], c[good]
                found.append((some[r], at[i + c], head[r, c].byteswap()))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
