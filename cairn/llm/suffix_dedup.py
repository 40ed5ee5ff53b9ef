"""Suffix-array removal of repeated byte strings, built one suffix bucket at a time.

Every window of ``width`` bytes is dealt to a bucket by the least hash of the
``gram``-byte strings in it, so equal windows meet in one bucket whatever document
they come from.  Neighbouring windows with the same least hash travel together as
one segment.  Inside a bucket the suffixes that start a window are sorted by their
first bytes, one suffix bucket at a time; ties longer than that are resolved by
ranks of a difference-cover sample, computed beforehand by prefix doubling.
Neighbours in suffix order that share ``width`` bytes form a group, and every
member from a document with a larger id than the group's least is a repeat.

Equal segments are put together by their hash before that, and compared byte by byte
before any of them counts as a repeat, so they go only where the suffix order would
send them.  Of the segments of one task, ``PART`` bytes are in work at a time, whole
buckets of them; a bucket above that is worked on in parts of its windows.  Disk is
bounded by the blocks of buckets that are built one after the other.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cairn.llm.scratch import Scratch

WIDTH = 50
GRAM = 16
#: Bytes of text that are hashed at once.
CHUNK = 1 << 17
#: A least hash with this share of all runs is hot: its windows are dealt by the whole of them.
HOT_SHARE = 1e-4
#: Of so many tasks on, least hashes are counted on every SAMPLED-th document, and the MOST_HOT most frequent of those that fill a quarter of a task are hot.
MANY_TASKS, SAMPLED, MOST_HOT = 512, 512, 1 << 20
#: Bytes of segments that a task works on at a time.
PART = 4 << 20
#: Suffixes that are sorted at once.
SUFFIXES = 1 << 20
PERIOD, COVER = 3, (0, 1)
#: For residues a and b of two suffixes: the offset at which both are in the cover.
OFFSET = [[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)]

_rng = np.random.default_rng(7)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LAST = np.iinfo(np.int64).max

#: ``more`` holds the further places of a segment that its text has several times, as 32-bit integers.
SEGMENTS = pa.schema([("m", pa.int64()), ("doc", pa.int64()), ("tag", pa.int32()), ("start", pa.int32()), ("seg", pa.binary()), ("n", pa.int32()), ("more", pa.binary())])
SEGMENTS_DDL = "m long, doc long, tag int, start int, seg binary, n int, more binary"
SPANS = pa.schema([("doc", pa.int64()), ("tag", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
SPANS_DDL = "doc long, tag int, start int, end int"


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (8 to 16) from each place."""
    # a gram's first and last eight bytes are all of it
    k = _load8(buf, "<u8")
    h = k[: len(buf) - gram + 1] * _BASE
    h ^= h >> np.uint64(31)
    h += k[gram - 8 :]
    h *= _BASE2
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def least_in_window(h: np.ndarray, want: int) -> np.ndarray:
    """The least of each ``want`` neighbouring hashes."""
    have = 1
    while have < want:
        step = min(have, want - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def split_hot(h: np.ndarray, start: np.ndarray, end: np.ndarray, m: np.ndarray, width: int, gram: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows; those with a hot least hash become runs of equal windows, dealt by a hash of the whole window.

    The last array has the least hashes, which name the block: the windows of one
    run stay in one block, so what collapses there can be joined again.

    Where a common passage borders on other text, every document has windows of its
    own with the passage's least hash; so they spread, and those inside the passage
    collapse, as all documents have them alike.
    """
    is_hot = hot[np.minimum(np.searchsorted(hot, m), len(hot) - 1)] == m
    if not is_hot.any():
        return start, end, m, m
    size = (end - start)[is_hot]
    first = np.cumsum(size) - size
    w = np.repeat(start[is_hot] - first, size) + np.arange(size.sum())
    whole = h[w]
    for at in (*range(gram, width - gram, gram), width - gram):
        whole = (whole ^ (whole >> np.uint64(29))) * _BASE + h[w + at]
    whole = (whole ^ (whole >> np.uint64(32))) * _MIX
    fresh = np.ones(len(w), bool)
    fresh[1:] = whole[1:] != whole[:-1]
    fresh[first] = True
    a = np.flatnonzero(fresh)
    b = np.append(a[1:], len(w))
    return np.concatenate([start[~is_hot], w[a]]), np.concatenate([end[~is_hot], w[b - 1] + 1]), np.concatenate([m[~is_hot], whole[a]]), np.concatenate([m[~is_hot], np.repeat(m[is_hot], size)[a]])


def _load8(buf: np.ndarray, kind: str) -> np.ndarray:
    """Integers of the eight bytes from each place."""
    return np.lib.stride_tricks.as_strided(buf[:8].view(kind), (len(buf) - 7,), (1,)).astype(np.uint64)


def segment_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ``buf[start:end]`` from one prefix sum."""
    back, forth = _powers(1 << int(len(buf) + 1).bit_length())
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * back[: len(buf)], out=sums[1:])
    return (sums[end] - sums[start]) * forth[start]


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the inverse base and of the base."""
    out = []
    for base in (pow(int(_BASE2), -1, 2**64), int(_BASE2)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``buf[start:start+size]`` one after the other, and their offsets."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return buf[at], offsets


def _pieces(texts: pa.Array, width: int):
    """Row ranges of about CHUNK bytes: (first row, offsets, bytes, place of the first byte in its text)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        j = min(j, len(texts))
        if offsets[j] - offsets[i] <= 2 * CHUNK:
            yield i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], 0
        else:
            for a in range(int(offsets[i]), int(offsets[j]), CHUNK):
                b = min(a + CHUNK + width - 1, int(offsets[j]))
                yield i, np.array([0, b - a]), data[a:b], a - int(offsets[i])
        i = j


def _runs(buf: np.ndarray, offs: np.ndarray, width: int, gram: int, hot: np.ndarray | None):
    """Runs of windows with one least hash, within texts: (start, end, hash that deals them, least hash, number of the text)."""
    h = gram_hashes(buf, gram)
    m = least_in_window(h, width - gram + 1)
    full = np.diff(offs) >= width
    first, last = offs[:-1][full], offs[1:][full] - width + 1
    fresh = np.zeros(len(m) + 1, bool)
    fresh[1:-1] = m[1:] != m[:-1]
    fresh[first] = True
    fresh[last] = True
    start = np.flatnonzero(fresh)
    end = np.append(start[1:], len(m))
    doc = np.searchsorted(first, start, "right") - 1
    ok = (start < len(m)) & (doc >= 0)
    ok[ok] = start[ok] < last[doc[ok]]
    start, end = start[ok], end[ok]
    mine = least = m[start]
    if hot is not None and len(hot):
        start, end, mine, least = split_hot(h, start, end, mine, width, gram, hot)
    return start, end, mine, least, np.flatnonzero(full)[np.searchsorted(first, start, "right") - 1]


def cut_segments(block: int, blocks: int, width: int, gram: int, hot=None):
    """Documents to the segments of one block of buckets; where the repeat is already certain, n is its windows and seg is empty.

    Equal segments of one chunk are sent once, from the least document; the others
    are known to be repeats there and then, and those that touch become one row,
    which keeps very common passages small.
    """
    def run(batches):
        hot_ = hot.value if hot is not None else None
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            for row, offs, buf, base in _pieces(batch.column(2), width):
                if len(buf) < width:
                    continue
                start, end, mine, least, text = _runs(buf, offs, width, gram, hot_)
                ok = least % np.uint64(blocks) == block
                start, end, mine, text = start[ok], end[ok], mine[ok], text[ok]
                if not len(start):
                    continue
                doc_id, tag, place = ids[row + text], tags[row + text], (base + start - offs[text]).astype(np.int32)
                size = end - start + width - 1
                rows, known, more = _collapsed(buf, start, size, mine, doc_id, tag, place)
                if known.any():
                    own, a, b = _touching(text[rows[known]], place[rows[known]], size[rows[known]] - width + 1, more.filter(pa.array(known)))
                    bytes_, offsets = np.zeros(0, np.uint8), np.zeros(len(a) + 1, np.int64)
                    yield _segment_batch(_spread(ids[row + own], a), ids[row + own], tags[row + own], a, bytes_, offsets, b - a, pa.nulls(len(a), pa.binary()))
                    rows, more = rows[~known], more.filter(pa.array(~known))
                bytes_, offsets = _gather(buf, start[rows], size[rows])
                yield _segment_batch(mine[rows], doc_id[rows], tag[rows], place[rows], bytes_, offsets, np.zeros(len(rows)), more)

    return run


def _segment_batch(m, doc, tag, start, bytes_, offsets, n, more) -> pa.RecordBatch:
    seg = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(bytes_)])
    return pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(doc), pa.array(tag.astype(np.int32)), pa.array(start.astype(np.int32)), seg, pa.array(n.astype(np.int32)), more], schema=SEGMENTS)


def _spread(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash that deals rows evenly which no bucket needs."""
    return (doc.astype(np.int64).view(np.uint64) * _BASE + place.astype(np.uint64)) * _MIX


def _touching(text: np.ndarray, place: np.ndarray, n: np.ndarray, more: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``n`` windows at all their places, joined where they touch within a text: (text, first place, place after the last)."""
    row, at = _places(place, more)
    begin = text[row].astype(np.int64) * (1 << 32) + at
    end = begin + n[row]
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], np.maximum.accumulate(end[by])
    first = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    a, b = begin[first], end[np.append(first[1:], len(end)) - 1]
    return a >> 32, a & 0xFFFFFFFF, b - (a >> 32 << 32)


def _collapsed(buf, start, size, m, doc, tag, place):
    """Of equal segments in one text the first: (rows, whether a smaller document has the segment, the other places)."""
    by = np.argsort(m, kind="stable")
    several = np.sort(by[_ties(m[by])]) if len(m) > 1 else np.array([], int)
    single = np.ones(len(m), bool)
    single[several] = False
    rows = np.flatnonzero(single)
    if not len(several):
        return rows, np.zeros(len(rows), bool), pa.nulls(len(rows), pa.binary())
    bytes_, offsets = _gather(buf, start[several], size[several])
    h = _told_apart(m[several], segment_hashes(bytes_, offsets[:-1], offsets[1:]), bytes_, offsets)
    m, d, t, at = m[several], doc[several], tag[several], place[several]
    known = ~_of_least(m, h, d)
    by = np.lexsort((at, t, d, h, m))
    new = np.ones(len(by), bool)
    new[1:] = (m[by][1:] != m[by][:-1]) | (h[by][1:] != h[by][:-1]) | (d[by][1:] != d[by][:-1]) | (t[by][1:] != t[by][:-1])
    first = np.flatnonzero(new)
    rest = at[by][~new]
    n = np.diff(np.append(first, len(by))) - 1
    ends = np.concatenate([np.zeros(len(rows) + 1, np.int64), np.cumsum(n)]) * 4
    has = np.concatenate([np.zeros(len(rows), bool), n > 0])
    more = pa.Array.from_buffers(pa.binary(), len(has), [pa.py_buffer(np.packbits(has, bitorder="little")), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rest, np.int32))])
    return np.concatenate([rows, several[by[first]]]), np.concatenate([np.zeros(len(rows), bool), known[by[first]]]), more


def _places(start: np.ndarray, more: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All places of each row's segment: (row, place)."""
    parts = more.chunks if isinstance(more, pa.ChunkedArray) else [more]
    flat = [_flat(c.fill_null(b"")) for c in parts]
    rest = np.concatenate([f[0] for f in flat]) if flat else np.zeros(0, np.uint8)
    offs = np.concatenate([[0], *[np.diff(f[1]) for f in flat]]).cumsum()
    n = np.diff(offs) // 4
    return np.concatenate([np.arange(len(start)), np.repeat(np.arange(len(start)), n)]), np.concatenate([start, np.frombuffer(rest.tobytes(), np.int32)])


def _of_least(m: np.ndarray, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a segment's document is the least of those with the same segment."""
    by = np.lexsort((doc, h, m))
    new = np.ones(len(by), bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (m[by][1:] != m[by][:-1])
    least = np.empty(len(by), np.int64)
    least[by] = doc[by][np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    return doc == least


def _count_grams(width: int, gram: int, share: float):
    """Texts to (m, n): the least hashes that have a share of a task's runs, with -1 for the number of all runs."""
    def run(batches):
        seen, total = [], 0
        counts: dict[int, int] = {}
        for batch in batches:
            for _, offs, buf, _ in _pieces(batch.column(2), width):
                if len(buf) >= width:
                    seen.append(_runs(buf, offs, width, gram, None)[2])
            if sum(map(len, seen)) > 1 << 23:
                total += _add(counts, seen, share)
        total += _add(counts, seen, share)
        keys = [k for k, n in counts.items() if n >= share * total]
        yield pa.RecordBatch.from_arrays([pa.array(np.array([*keys, 0], np.uint64).view(np.int64)), pa.array([*[counts[k] for k in keys], total], pa.int64()), pa.array([False] * len(keys) + [True])], names=["m", "n", "whole"])

    return run


def _add(counts: dict[int, int], seen: list[np.ndarray], share: float) -> int:
    """Add the frequent values of ``seen`` to the counts and empty it; how many there were."""
    if not seen:
        return 0
    all_ = np.concatenate(seen)
    seen.clear()
    values, n = np.unique(all_, return_counts=True)
    often = n >= share * len(all_) / 2
    for v, k in zip(values[often].tolist(), n[often].tolist(), strict=True):
        counts[v] = counts.get(v, 0) + k
    return len(all_)


def hot_grams(rows: DataFrame, width: int, gram: int, share: float = HOT_SHARE) -> np.ndarray:
    """The least hashes that at least about ``share`` of all runs have, in order: at most 2 / share of them.

    They only deal rows out more evenly; the result does not depend on them.
    """
    found = rows.mapInArrow(_count_grams(width, gram, share), "m long, n long, whole boolean").groupBy("m", "whole").agg(F.sum("n").alias("n"))
    total = found.where("whole").agg(F.sum("n")).first()[0] or 0
    hot = found.where(~F.col("whole") & (F.col("n") >= max(64, share * total / 2))).select("m").collect()
    return np.sort(np.array([r["m"] for r in hot], np.int64).view(np.uint64))


def hot_of_sample(rows: DataFrame, width: int, gram: int, tasks: int, blocks: int, sampled: int = SAMPLED, most: int = MOST_HOT) -> np.ndarray:
    """The least hashes whose runs fill a quarter of a task or more, by a sample of documents; ``most`` of them at most.

    They only deal rows out more evenly; the result does not depend on them.
    """
    sample = rows.where(F.pmod(F.xxhash64("doc", "tag"), F.lit(sampled)) == 0)
    found = sample.mapInArrow(_all_grams(width, gram), "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = found.where(F.col("n") >= max(8, total / (4 * tasks * blocks))).orderBy(F.desc("n"), "m").limit(most).select("m").toArrow()
    return np.sort(hot["m"].to_numpy().view(np.uint64))


def _all_grams(width: int, gram: int):
    """Texts to the least hashes of their runs and how many runs have them."""
    def run(batches):
        for batch in batches:
            for _, offs, buf, _ in _pieces(batch.column(2), width):
                if len(buf) >= width:
                    m, n = np.unique(_runs(buf, offs, width, gram, None)[2], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(n.astype(np.int64))], names=["m", "n"])

    return run


def cover_ranks(text: np.ndarray, key: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Ranks of the cover sample's suffixes by their first ``depth`` bytes or more, by prefix doubling."""
    at = np.arange(n)
    at = at[np.isin(at % PERIOD, COVER)]
    ranks = np.zeros(n + depth + 16, np.int64)
    _, ranks[at] = np.unique(key[at], return_inverse=True)
    have = 8
    while have < depth:
        step = have // PERIOD * PERIOD
        _, r = np.unique(ranks[at] * np.int64(n + 1) + ranks[at + step], return_inverse=True)
        ranks[at] = r
        have += step
    return ranks


def _ties(group: np.ndarray) -> np.ndarray:
    """Of a sorted array, the members of groups of two or more."""
    same = group[1:] == group[:-1]
    tied = np.zeros(len(group), bool)
    tied[1:] |= same
    tied[:-1] |= same
    return tied


def suffix_groups(text: np.ndarray, starts: np.ndarray, width: int):
    """Yield (places in suffix order, group numbers) of window starts that share ``width`` bytes with another.

    ``width`` is 16 at least, and ``text`` has ``2 * width`` spare bytes at its end.
    """
    n = len(text) - 2 * width
    key = _load8(text, ">u8")
    top = (key[starts] >> np.uint64(48)).astype(np.int64)
    count = np.bincount(top, minlength=1 << 16)
    bounds, total = [0], 0
    for b in np.flatnonzero(count):
        if total and total + count[b] > SUFFIXES:
            bounds.append(int(b))
            total = 0
        total += count[b]
    bounds.append(1 << 16)
    ranks = None
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        here = starts[(top >= lo) & (top < hi)] if len(bounds) > 2 else starts
        group = np.zeros(len(here), np.int64)
        for depth in (0, 8):  # short ties by further bytes
            k = key[here + depth]
            by = np.argsort(k, kind="stable") if depth == 0 else np.lexsort((k, group))
            here, k, group = here[by], k[by], group[by]
            new = np.ones(len(here), bool)
            new[1:] = (k[1:] != k[:-1]) | (group[1:] != group[:-1])
            group = np.cumsum(new)
            tied = _ties(group)
            here, group = here[tied], group[tied]
        if not len(here):
            continue
        if ranks is None:
            ranks = cover_ranks(text, key, n, width + PERIOD)
        most = np.int64(ranks.max() + 1)
        residue = here % PERIOD
        classes = [np.flatnonzero(residue == a) for a in range(PERIOD)]
        place = np.zeros(len(here), np.int64)
        for a in range(PERIOD):
            for b in range(PERIOD):
                d = OFFSET[a][b]
                theirs = np.sort(group[classes[b]] * most + ranks[here[classes[b]] + d])
                place[classes[a]] += np.searchsorted(theirs, group[classes[a]] * most + ranks[here[classes[a]] + d])
        here = here[np.argsort(place, kind="stable")]
        equal = np.ones(len(here) - 1, bool)
        for d in (*range(0, width - 7, 8), width - 8):
            k = key[here + d]
            equal &= k[1:] == k[:-1]
        number = np.zeros(len(here), np.int64)
        np.cumsum(~equal, out=number[1:])
        tied = _ties(number)
        if tied.any():
            yield here[tied], number[tied]


def repeats_in_bucket(doc: np.ndarray, data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """For each byte place of ``data``, whether a window starts there that also starts in a smaller document."""
    text = np.concatenate([data, np.zeros(2 * width, np.uint8)])
    size = np.diff(offsets) - width + 1
    starts = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    owner = np.zeros(len(data), np.int32)
    owner[offsets[1:-1]] = 1
    owner = np.cumsum(owner, dtype=np.int32)
    hit = np.zeros(len(data) + 1, bool)
    for here, number in suffix_groups(text, starts, width):
        d = doc[owner[here]]
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        least = np.minimum.reduceat(d, first)
        least = np.repeat(least, np.diff(np.append(first, len(d))))
        hit[here[d > least]] = True
    return hit


def _spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(hit.astype(np.int8), prepend=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def find_repeats(width: int, gram: int):
    """The segments of whole buckets to the spans of bytes that repeat a smaller document.

    Equal segments are grouped first: all but those of the least document repeat
    wholly, and one of them stands for the group.  What is left goes to the suffix
    order if its bucket still has two documents.
    """
    def work(m, doc, tag, start, data, offs, more):
        """The spans of some whole buckets."""
        h = segment_hashes(data, offs[:-1], offs[1:])
        h = _told_apart(m, h, data, offs)
        whole = ~_of_least(m, h, doc)
        row, place = _places(start, more)
        gone = whole[row]
        yield _span_batch(doc[row[gone]], tag[row[gone]], place[gone], place[gone] + np.diff(offs)[row[gone]])
        rest = np.flatnonzero(~whole)
        rest = rest[_several(m[rest], doc[rest])]
        if not len(rest):
            return
        data, offs = _gather(data, offs[rest], np.diff(offs)[rest])
        doc, tag = doc[rest], tag[rest]
        own, a, b = _found(doc, data, offs, width)
        # a span of a segment is one at each of its places
        row, place = _places(start[rest], more.take(pa.array(rest)))
        by = np.argsort(row, kind="stable")
        n = np.bincount(row, minlength=len(rest))
        first = np.cumsum(n) - n
        k = n[own]
        span = np.repeat(np.arange(len(own)), k)
        at = place[by][np.repeat(first[own] - np.cumsum(k) + k, k) + np.arange(k.sum())]
        yield _span_batch(doc[own][span], tag[own][span], a[span] + at, b[span] - 1 + width + at)

    def run(batches):
        batches = list(batches)
        if not batches:
            return
        m, doc, tag, start = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in range(4))
        flat = [_flat(b.column(4)) for b in batches]
        more = pa.chunked_array([b.column(6) for b in batches], pa.binary())
        batches.clear()
        data = np.concatenate([f[0] for f in flat])
        size = np.concatenate([np.diff(f[1]) for f in flat])
        del flat
        begin = np.cumsum(size) - size
        rows = _several(m, doc)
        rows = rows[np.argsort(m[rows], kind="stable")]
        if not len(rows):
            return
        fresh = np.flatnonzero(np.concatenate([[True], m[rows[1:]] != m[rows[:-1]]]))
        held = np.add.reduceat(size[rows], fresh)
        ends = np.append(fresh[1:], len(rows))
        a = 0
        while a < len(fresh):
            b, total = a, 0
            while b < len(fresh) and (b == a or total + held[b] <= PART):
                total += held[b]
                b += 1
            part = rows[fresh[a] : ends[b - 1]]
            bytes_, offs = _gather(data, begin[part], size[part])
            yield from work(m[part], doc[part], tag[part], start[part], bytes_, offs, more.take(pa.array(part)))
            a = b

    return run


def _told_apart(m: np.ndarray, h: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The hashes of segments, those that agree for different bytes made distinct: nothing is equal by its hash alone."""
    size = np.diff(offs)
    by = np.lexsort((size, h, m))
    a, b = by[:-1], by[1:]
    pair = np.flatnonzero((m[a] == m[b]) & (h[a] == h[b]))
    if not len(pair):
        return h
    a, b = a[pair], b[pair]
    bad = size[a] != size[b]
    same = np.flatnonzero(~bad)
    for k in range(0, len(same), 1 << 15):
        part = same[k : k + (1 << 15)]
        x, ends = _gather(data, offs[a[part]], size[a[part]])
        y, _ = _gather(data, offs[b[part]], size[b[part]])
        bad[part] |= np.add.reduceat((x != y).astype(np.int64), ends[:-1]) > 0
    if bad.any():
        h = h.copy()
        clash = np.isin(h, h[b[bad]])
        h[clash] = np.arange(int(clash.sum())).astype(np.uint64)  # these go to the suffix order one by one
    return h


def _found(doc: np.ndarray, data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first window, window after the last) of the runs of windows that repeat a smaller document.

    Above PART bytes the windows are dealt by a hash of all of them, and each share is
    put in suffix order by itself, as equal windows are in one share.
    """
    windows = np.diff(offs) - width + 1
    if len(data) <= 2 * PART:
        hit = repeats_in_bucket(doc, data, offs, width)
    else:
        hit = np.zeros(len(data) + 1, bool)
        shares = -(-int(windows.sum()) * width // PART)
        for share in range(shares):
            starts, owner = [], []
            for a in range(0, len(offs) - 1, 1 << 12):
                first, n = offs[a : a + (1 << 12)][: len(windows[a : a + (1 << 12)])], windows[a : a + (1 << 12)]
                w = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                mine = segment_hashes(data[first[0] : offs[min(a + (1 << 12), len(offs) - 1)]], w - first[0], w - first[0] + width) * _MIX % np.uint64(shares) == share
                starts.append(w[mine])
                owner.append(np.repeat(np.arange(a, a + len(n)), n)[mine])
            starts, owner = np.concatenate(starts), np.concatenate(owner)
            if len(starts):
                bytes_, ends = _gather(data, starts, np.full(len(starts), width))
                hit[starts[repeats_in_bucket(doc[owner], bytes_, ends, width)[ends[:-1]]]] = True
    a, b = _spans(hit)
    own = np.searchsorted(offs, a, "right") - 1
    return own, a - offs[own], b - offs[own]


def _several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows whose key occurs with two documents or more."""
    if not len(key):
        return np.array([], int)
    by = np.argsort(key, kind="stable")
    k, d = key[by], doc[by]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    shared = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    return np.sort(by[np.repeat(shared, np.diff(np.append(first, len(k))))])


def _flat(seg: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array and their offsets."""
    if not len(seg):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(seg.buffers()[1], np.int32)[seg.offset : seg.offset + len(seg) + 1].astype(np.int64)
    return np.frombuffer(seg.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def _span_batch(doc, tag, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int32()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], schema=SPANS)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, blocks: int = 4, task_bytes: int = 24 << 20) -> DataFrame:
    """Spans of bytes covered by a ``width``-byte string that also starts in a document with a smaller id.

    Rows: doc (the id; a null id counts as the largest), tag (a hash of the text,
    which tells rows with one id apart), start, end; spans of a text may
    overlap.  Null and short texts have none.  The buckets are built in ``blocks``
    passes over the text, each written before the next begins.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    rows = keyed(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * 6 // (blocks * task_bytes)))
    hot = spark.sparkContext.broadcast(hot_grams(rows, width, gram) if tasks < MANY_TASKS else hot_of_sample(rows, width, gram, tasks, blocks))
    for block in range(blocks):
        segments = rows.mapInArrow(cut_segments(block, blocks, width, gram, hot), SEGMENTS_DDL)
        spans = segments.repartition(tasks, "m").mapInArrow(_either(width, gram), SPANS_DDL)
        scratch.append(spans, "spans")
        del segments, spans
        scratch.release()
    return scratch.load("spans", T._parse_datatype_string(SPANS_DDL))


def _either(width: int, gram: int):
    search = find_repeats(width, gram)

    def run(batches):
        rest = []
        for b in batches:
            n = b.column(5).to_numpy()
            if (n > 0).any():
                k = b.filter(pa.array(n > 0))
                place = k.column(3).to_numpy()
                yield _span_batch(k.column(1).to_numpy(), k.column(2).to_numpy(), place, place + k.column(5).to_numpy() + width - 1)
                b = b.filter(pa.array(n == 0))
            rest.append(b)
        yield from search(rest)

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, text): the id with null as the largest, and what tells rows of one id apart."""
    text = F.col(text_col)
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.hash(text).alias("tag"), text.alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, **how) -> DataFrame:
    """``docs`` with columns n_bytes, n_removed, n_spans, kept (bytes), kept_text and kept_sha256.

    A byte goes if it is covered by a ``width``-byte string that also starts in a
    document with a smaller id, judged on the input.  Null text counts as empty.
    Rows that share an id never remove one another's bytes; a null id counts as the
    largest; other columns pass through, and an input column with the name of a new
    one is replaced.
    """
    new = "_n_bytes long, _n_removed long, _n_spans long, _kept binary, _kept_text string, _kept_sha256 string"
    spans = repeated_spans(docs, id_col, text_col, width, **how)
    spans = spans.groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_tag")).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    text = F.col(text_col)
    left = docs.withColumns({"_doc": F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), "_tag": F.hash(text), "_raw": text.cast("binary")})
    joined = left.join(spans, ["_doc", "_tag"], "left")
    keep = [c for c in docs.columns if c not in {x.strip().split()[0][1:] for x in new.split(",")}]
    joined = joined.select(*keep, "_raw", F.col("_spans.start").alias("_start"), F.col("_spans.end").alias("_end"))
    schema = T.StructType([*joined.select(*keep).schema.fields, *T._parse_datatype_string(new).fields])
    out = joined.mapInArrow(_cut_out(len(keep)), schema)
    return out.select(*keep, *[F.col(f.name).alias(f.name[1:]) for f in T._parse_datatype_string(new).fields])


def _cut_out(others: int):
    def run(batches):
        for batch in batches:
            rows = [[] for _ in range(6)]
            for raw, start, end in zip(batch.column(others), batch.column(others + 1), batch.column(others + 2), strict=True):
                raw = (raw.as_py() if raw.is_valid else None) or b""
                removed = spans = 0
                kept = raw
                if start.is_valid and len(start):
                    a, b = start.values.to_numpy(zero_copy_only=False), end.values.to_numpy(zero_copy_only=False)
                    by = np.argsort(a, kind="stable")
                    a, b = a[by], np.maximum.accumulate(b[by])
                    apart = np.flatnonzero(a[1:] > b[:-1])
                    a, b = a[np.append(0, apart + 1)], b[np.append(apart, len(b) - 1)]
                    kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
                    removed, spans = len(raw) - len(kept), len(a)
                for column, value in zip(rows, (len(raw), removed, spans, kept, kept.decode(errors="ignore"), hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string())
            new = [pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:others], *new], names=[*batch.schema.names[:others], *"_n_bytes _n_removed _n_spans _kept _kept_text _kept_sha256".split()])

    return run


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the texts; columns stay as they are.

    What is left of a character that was cut in two goes too; a null text stays null.
    """
    cut = remove_repeats(docs, id_col, text_col, width)
    text = F.when(F.col(text_col).isNotNull(), F.col("kept_text"))
    return cut.withColumn(text_col, text).select(*docs.columns)
