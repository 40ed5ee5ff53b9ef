"""Which of many pairs of texts may be within a number of edits, by Myers' bit-parallel columns.

A column of the table of edits is kept as the steps from row to row, 64 rows a word.
Many pairs go through their columns at once, a word of each pair at a time, over the
rows alone by which a path of so few edits can lead.  A pair ends at the column whose
least number is above its own.  Grams of the right text that the left one lacks cost
edits too, a gram of q characters 1/q at least: those that begin behind the column are
added to its number, so texts that are nothing alike end after a tenth of their length.
Rare characters share a number, which can only make a pair seem nearer.
"""

from __future__ import annotations

import math

import numpy as np

#: Numbers of characters: the most frequent have their own, the last few are shared.
LETTERS, SHARED = 128, 16
#: Pairs that go through their columns together, and how many are too few for that.
BATCH, ALONE = 4096, 48
#: Words of all rows of the pairs that go together.
WORDS = 1 << 22
#: Columns read at once, and the share of them after which a pair counts as near.
COLUMNS, FAR = 32, 0.6

_ONE, _TOP = np.uint64(1), np.uint64(63)


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """Of eight rows (up << 8 | down): what they add up to, and the least sum on the way."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int8)
    sums = np.cumsum(bits[:, None, :] - bits[None, :, :], axis=2, dtype=np.int8).reshape(65536, 8)
    return sums[:, -1].copy(), sums.min(1)


_SUM, _LEAST = _steps()


def _earliest(most: np.ndarray, lacks: np.ndarray, q: int) -> np.ndarray:
    """The first column that may be above ``most``, as its least number is at most its place."""
    return np.minimum(most, np.maximum(most - lacks / q, 0) / (1 - 1 / q)) if q > 1 else most


class Edits:
    """Texts of two sides whose pairs are asked for."""

    def __init__(self, left: list[str], right: list[str]):
        self.n, self.m = (np.array([len(t) for t in side], dtype=np.int64) for side in (left, right))
        self.exact = np.frombuffer("".join(left + right).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        times = np.bincount(self.exact)
        letters = np.flatnonzero(times)
        own = letters[np.argsort(-times[letters], kind="stable")][: LETTERS - SHARED]
        number = (len(own) + np.arange(len(times)) % SHARED).astype(np.uint8)
        number[own] = np.arange(len(own))
        self.letters = len(own) + (SHARED if len(letters) > len(own) else 0)
        flat = number[self.exact]
        ends = np.cumsum(np.concatenate([self.n, self.m]))
        self.left, self.starts = flat[: self.n.sum()], ends[: len(left)] - self.n
        self.right, self.at = flat, ends[len(left) :] - self.m
        self.words = (int(self.n.max()) + 63) >> 6
        self._masks = None

    def masks(self) -> np.ndarray:
        """The rows at which each left text has each letter: words, one text and letter after the other."""
        if self._masks is None:
            row = np.arange(len(self.left)) - np.repeat(self.starts, self.n)
            word = (np.repeat(np.arange(len(self.n)), self.n) * self.letters + self.left) * self.words + (row >> 6)
            self._masks = np.zeros(len(self.n) * self.letters * self.words, dtype=np.uint64)
            np.bitwise_or.at(self._masks, word, _ONE << (row & 63).astype(np.uint64))
        return self._masks

    def within(self, u: np.ndarray, v: np.ndarray, most: np.ndarray, lacks: np.ndarray, q: int) -> np.ndarray:
        """For pairs (u of the left, v of the right): false only where they are more than ``most`` edits apart, and nearly always there; the right one has ``lacks`` grams of ``q`` characters, at least, that the left one lacks."""
        out = np.zeros(len(u), dtype=bool)
        if not len(u):
            return out
        apart = self.n[u] - self.m[v]
        order = np.lexsort((u, apart // max(32, int(most.max()) // 2)))
        batch = max(min(BATCH, WORDS // self.words), 1)
        for at in range(0, len(u), batch):
            some = order[at : at + batch]
            if len(some) >= ALONE:
                some = some[self._together(u[some], v[some], most[some], lacks[some], q)]
                if len(some) >= ALONE:
                    out[some] = True
                    continue
            out[some] = self._alone(u[some], v[some], most[some], lacks[some], q)
        return out

    def _together(self, u: np.ndarray, v: np.ndarray, most: np.ndarray, lacks: np.ndarray, q: int) -> np.ndarray:
        """The pairs that are left when few are, or after so many columns that they are near."""
        masks, words = self.masks(), self.words
        apart = self.n[u] - self.m[v]
        low, high = int(((apart - most) // 2).min()), int(((apart + most + 1) // 2).max())
        columns = math.ceil(FAR * int(np.minimum(self.n[u], self.m[v]).min()))
        often = max(12, columns // 32)
        check = max(int(_earliest(most, lacks, q).min() * 1.3), 8)
        left = np.arange(len(u))
        base, start = u * (self.letters * words), self.at[v]
        up, down = np.full((words, len(u)), ~np.uint64(0)), np.zeros((words, len(u)), dtype=np.uint64)
        top = np.zeros(len(u), dtype=np.int32)  # the number above the first row that is kept
        first, fresh = 0, True
        for j in range(1, columns + 1):
            if (j - 1) % COLUMNS == 0 or fresh:
                begin = j - 1
                span = np.arange(begin, min((begin // COLUMNS + 1) * COLUMNS, columns))
                read = base + self.right[start + span[:, None]].astype(np.int64) * words
                eq, xv, xh, ph, mh, hp, hm = (np.empty(len(left), dtype=np.uint64) for _ in range(7))
                fresh = False
            while first < max(0, (j + low - 1) >> 6):
                top += np.bitwise_count(up[first]).astype(np.int32) - np.bitwise_count(down[first])
                first += 1
            last = min(words - 1, max(0, j + high - 1) >> 6)
            index = read[j - 1 - begin]
            for w in range(first, last + 1):
                pv, mv = up[w], down[w]
                np.take(masks[w:], index, out=eq, mode="clip")
                np.bitwise_or(eq, mv, out=xv)
                if w > first:
                    np.bitwise_or(eq, hm, out=eq)
                np.bitwise_and(eq, pv, out=xh)
                np.add(xh, pv, out=xh)
                np.bitwise_xor(xh, pv, out=xh)
                np.bitwise_or(xh, eq, out=xh)
                np.bitwise_or(xh, pv, out=ph)
                np.invert(ph, out=ph)
                np.bitwise_or(ph, mv, out=ph)
                np.bitwise_and(pv, xh, out=mh)
                if w < last:
                    np.right_shift(ph, _TOP, out=xh)
                    np.right_shift(mh, _TOP, out=eq)
                np.left_shift(ph, _ONE, out=ph)
                np.left_shift(mh, _ONE, out=mh)
                if w > first:
                    np.bitwise_or(ph, hp, out=ph)
                    np.bitwise_or(mh, hm, out=mh)
                else:
                    np.bitwise_or(ph, _ONE, out=ph)
                np.bitwise_and(ph, xv, out=mv)
                np.bitwise_or(xv, ph, out=pv)
                np.invert(pv, out=pv)
                np.bitwise_or(pv, mh, out=pv)
                if w < last:
                    hp, xh, hm, eq = xh, hp, eq, hm
            top += 1
            if j >= check or j == columns:
                check = j + often
                keep = self._least(up[first : last + 1], down[first : last + 1], top) + np.maximum(lacks[left] - j + q - 1, 0) // q <= most[left]
                n = np.count_nonzero(keep)
                if n < 0.8 * len(left):
                    left, base, start, top = left[keep], base[keep], start[keep], top[keep]
                    if n < ALONE:
                        return left
                    up, down, fresh = np.compress(keep, up, axis=1), np.compress(keep, down, axis=1), True
        return left

    @staticmethod
    def _least(up: np.ndarray, down: np.ndarray, top: np.ndarray) -> np.ndarray:
        """The least number of a column."""
        here, least = top.copy(), top.copy()
        for pv, mv in zip(up, down, strict=True):
            ups, downs = pv.view(np.uint8).reshape(-1, 8), mv.view(np.uint8).reshape(-1, 8)
            for b in range(8):
                step = ups[:, b].astype(np.int32) << 8 | downs[:, b]
                np.minimum(least, here + _LEAST[step], out=least)
                here += _SUM[step]
        return least

    def _alone(self, u: np.ndarray, v: np.ndarray, most: np.ndarray, lacks: np.ndarray, q: int) -> np.ndarray:
        """One pair after the other, a column as one long number."""
        out, known, rows = np.zeros(len(u), dtype=bool), -1, {}
        early = _earliest(most, lacks, q)
        for p in np.argsort(u, kind="stable"):
            n, m, few, without = int(self.n[u[p]]), int(self.m[v[p]]), int(most[p]), int(lacks[p])
            if u[p] != known:
                known = u[p]
                text, rows = self.left[self.starts[known] : self.starts[known] + n], {}
            full = (1 << n) - 1
            pv, mv, size = full, 0, (n + 7) >> 3
            often, last = max(8, m // 32), math.ceil(FAR * m)
            check = max(int(early[p] * 1.3), 8)
            for j, c in enumerate(self.right[self.at[v[p]] : self.at[v[p]] + last].tolist(), 1):
                eq = rows.get(c)
                if eq is None:
                    eq = rows[c] = int.from_bytes(np.packbits(text == c, bitorder="little").tobytes(), "little")
                xv = eq | mv
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph = mv | (full & ~(xh | pv))
                mh = (pv & xh) << 1
                ph = ph << 1 | 1
                pv = (mh | ~(xv | ph)) & full
                mv = ph & xv & full
                if j == check or j == last:
                    check += often
                    step = np.frombuffer(pv.to_bytes(size, "little"), dtype=np.uint8).astype(np.int32) << 8 | np.frombuffer(mv.to_bytes(size, "little"), dtype=np.uint8)
                    sums = _SUM[step].astype(np.int64)
                    if j + min(int((np.cumsum(sums) - sums + _LEAST[step]).min()), 0) + max(without - j + q - 1, 0) // q > few:
                        break
            else:
                out[p] = True
        return out

    def apart(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The edits between the texts of each pair, by their characters themselves."""
        out, known = np.zeros(len(u), dtype=np.int64), -1
        for p in np.argsort(u, kind="stable"):
            n, m = int(self.n[u[p]]), int(self.m[v[p]])
            if u[p] != known:
                known = u[p]
                text, rows = self.exact[self.starts[known] : self.starts[known] + n], {}
            full = (1 << n) - 1
            pv, mv = full, 0
            for c in self.exact[self.at[v[p]] : self.at[v[p]] + m].tolist():
                eq = rows.get(c)
                if eq is None:
                    eq = rows[c] = int.from_bytes(np.packbits(text == c, bitorder="little").tobytes(), "little")
                xv = eq | mv
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph = (mv | (full & ~(xh | pv))) << 1 | 1
                pv = ((pv & xh) << 1 | ~(xv | ph)) & full
                mv = ph & xv & full
            out[p] = m + pv.bit_count() - mv.bit_count()
        return out
