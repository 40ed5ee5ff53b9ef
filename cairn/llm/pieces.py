"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces.

Pieces and their scores come from a public model file, whose path is a parameter.
Of a model whose scores are merge ranks, the log score of a piece is Zipf's law of
its rank, -ln(rank + 1) less the logarithm of the law's sum; nothing is fitted, as
tokenizers are not trained here.  Scores are rounded to 16 binary places, so sums are
exact and the best path does not depend on where a text is cut.  Space is the marker
U+2581 in pieces; a marker that stands in a text itself is spelled in byte pieces,
as is every character that no piece covers, so decoding gives back every text
exactly.

A piece has markers at its start only, so the best path of a text is made of the
best paths of its words with the spaces before them.  Each distinct word of a task
is searched once; words of similar length take the steps of the search together,
and a text's pieces are then looked up word by word.  Long words, such as text of a
script without spaces, are cut where no piece in them spans; what has no such place
is searched step by step over its own matches.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: Bytes of words and ids that a task remembers, and the longest word that is remembered.
REMEMBERED, REMEMBERED_WORD = 64 << 20, 256
#: Words above this are cut where no piece spans, and parts above the second number are searched by themselves.
LONG, ALONE = 64, 256
#: Places of a long word that are matched at once.
PLACES = 1 << 18
#: Bytes of text that are encoded at once.
CHUNK = 1 << 22

_WORDS = re.compile(rb" *[^ ]+| +")


class Pieces:
    """Pieces, scores and byte pieces of one model."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        ids = range(n)
        self.bytes = [b""] * n
        self.byte_ids = np.full(256, -1, np.int64)
        plain = []
        for i in ids:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and " " not in piece:
                self.bytes[i] = piece.replace(MARKER, " ").encode()
                plain.append((i, model.get_score(i)))
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces, so it cannot spell every text")
        if any(re.search(rb"[^ ] ", self.bytes[i]) for i, _ in plain):
            raise ValueError("a piece has a marker that is not at its start")
        ranked = sorted(plain, key=lambda x: -x[1])
        whole = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
        self.scores = np.full(n, -np.inf)
        merges = all(float(s).is_integer() for _, s in plain)
        for rank, (i, score) in enumerate(ranked):
            self.scores[i] = -math.log(rank + 1) - whole if merges else score
        self.scores = np.round(self.scores * 65536) / 65536
        self.unknown = float(self.scores[np.isfinite(self.scores)].min()) - 10
        self.base, self.check, self.value = double_array({self.bytes[i]: i for i, _ in plain})
        self.longest = max(map(len, self.bytes))
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.spelled = np.frombuffer(b"".join(self.bytes), np.uint8)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): the child of state s by byte c is t = base[s] + c if check[t] == s; value[t] is -1 inside."""
    trie: list[dict[int, int]] = [{}]
    ends = [-1]
    for word, value in words.items():
        node = 0
        for c in word:
            if c not in trie[node]:
                trie[node][c] = len(trie)
                trie.append({})
                ends.append(-1)
            node = trie[node][c]
        ends[node] = value
    size = 2 * len(trie) + 1024
    used = bytearray(size)
    used[0] = 1
    chosen = [0] * len(trie)
    start: dict[int, int] = {}
    for node in sorted(range(len(trie)), key=lambda i: -len(trie[i])):  # wide nodes first, lone children fill the gaps
        if keys := sorted(trie[node]):
            b = start.get(len(keys), 1)
            while any(used[b + c] for c in keys):
                b += 1
            start[len(keys)] = chosen[node] = b
            for c in keys:
                used[b + c] = 1
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    place = [0] * len(trie)
    for node, children in enumerate(trie):  # a node's number is above its parent's
        s = place[node]
        base[s] = b = chosen[node]
        for c, child in children.items():
            place[child] = b + c
            check[b + c], value[b + c] = s, ends[child]
    return base, check, value


def _char_sizes(text: np.ndarray) -> np.ndarray:
    """Bytes of the character that starts at each place."""
    return np.where(text < 0x80, 1, np.where(text < 0xC0, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))).astype(np.int64)


def viterbi(pieces: Pieces, words: list[bytes]) -> list[np.ndarray]:
    """The ids of the best path of each word; of equal paths, the one whose last pieces are longest."""
    parts: dict[bytes, int] = {}
    made: list[list[int]] = []
    alone: dict[int, np.ndarray] = {}
    for w in words:
        if len(w) <= LONG:
            made.append([parts.setdefault(w, len(parts))])
            continue
        text = np.frombuffer(w, np.uint8)
        start, size, ids = matches(pieces, text)
        cuts = _cuts(start, size, len(w))
        numbers = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = w[a:b]
            if part not in parts:
                parts[part] = len(parts)
                if b - a > ALONE:
                    lo, hi = np.searchsorted(start, [a, b])
                    alone[parts[part]] = _search(pieces, text[a:b], start[lo:hi] - a, size[lo:hi], ids[lo:hi])
            numbers.append(parts[part])
        made.append(numbers)
    texts = list(parts)
    paths = _together(pieces, [b"" if i in alone else t for i, t in enumerate(texts)])
    for i, ids in alone.items():
        paths[i] = ids
    return [paths[n[0]] if len(n) == 1 else np.concatenate([paths[i] for i in n]) for n in made]


def matches(p: Pieces, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, id) of every piece in a text, by start and size; -1 for a character that is no piece by itself."""
    found = []
    char = np.minimum(_char_sizes(text), len(text) - np.arange(len(text)))
    for a in range(0, len(text), PLACES):
        at = np.arange(a, min(a + PLACES, len(text)))
        state, lone = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for d in range(1, p.longest + 1):
            go = at + d <= len(text)
            at, state = at[go], state[go]
            to = p.base[state] + text[at + d - 1]
            go = p.check[to] == state
            at, state = at[go], to[go]
            if not len(at):
                break
            ends = p.value[state] >= 0
            s = at[ends]
            lone[s[char[s] == d] - a] = False
            found.append((s, np.full(len(s), d), p.value[state[ends]]))
        s = np.flatnonzero(lone) + a
        found.append((s, char[s], np.full(len(s), -1)))
    start, size, ids = (np.concatenate([f[k] for f in found]) for k in range(3))
    by = np.lexsort((size, start))
    return start[by], size[by], ids[by]


def _cuts(start: np.ndarray, size: np.ndarray, n: int) -> list[int]:
    """Where no match spans, both ends included."""
    change = np.zeros(n + 2, np.int64)
    np.add.at(change, start + 1, 1)
    np.add.at(change, start + size, -1)
    free = np.flatnonzero(np.cumsum(change)[1:n] == 0) + 1
    return [0, *free.tolist(), n]


def _search(p: Pieces, text: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The best path over the matches of one text."""
    n = len(text)
    score = np.where(ids < 0, p.unknown, p.scores[ids]).tolist()
    best, back = [-math.inf] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for k, (s, d) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
        value = best[s] + score[k]
        if value > best[s + d]:
            best[s + d], back[s + d] = value, k
    out, at = [], n
    while at:
        k = back[at]
        a = int(start[k])
        out.append([int(ids[k])] if ids[k] >= 0 else p.byte_ids[text[a:at]].tolist())
        at = a
    return np.array([i for x in reversed(out) for i in x], np.int32)


def _together(pieces: Pieces, words: list[bytes]) -> list[np.ndarray]:
    """The best paths of short words, those of similar length together."""
    out: list[np.ndarray] = [np.array([], np.int32)] * len(words)
    by = sorted(range(len(words)), key=lambda i: len(words[i]))
    a = 0
    while a < len(by):
        b = a
        longest = 0
        while b < len(by) and b - a < 1 << 15 and (b == a or len(words[by[b]]) <= max(16, 2 * len(words[by[a]]))):
            longest = len(words[by[b]])
            b += 1
            if (b - a) * longest > 1 << 21:
                break
        for i, ids in zip(by[a:b], _viterbi(pieces, [words[i] for i in by[a:b]], longest), strict=True):
            out[i] = ids
        a = b
    return out


def _viterbi(p: Pieces, words: list[bytes], longest: int) -> list[np.ndarray]:
    n = len(words)
    size = np.array([len(w) for w in words])
    text = np.zeros((n, longest + 1), np.uint8)
    flat = np.frombuffer(b"".join(words), np.uint8)
    row = np.repeat(np.arange(n), size)
    text[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    best = np.full((n, longest + 1), -np.inf)
    best[:, 0] = 0
    step = np.zeros((n, longest + 1), np.int32)
    piece = np.full((n, longest + 1), -1, np.int32)
    for s in range(longest):
        rows = np.flatnonzero(np.isfinite(best[:, s]) & (size > s))
        if not len(rows):
            continue
        char = np.minimum(_char_sizes(text[rows, s]), size[rows] - s)
        lone = np.ones(len(rows), bool)
        at, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for d in range(1, min(p.longest, longest - s) + 1):
            go = size[rows[at]] >= s + d
            at, state = at[go], state[go]
            to = p.base[state] + text[rows[at], s + d - 1]
            go = p.check[to] == state
            at, state = at[go], to[go]
            if not len(at):
                break
            ends = p.value[state] >= 0
            end, ids = at[ends], p.value[state[ends]]
            lone[end[char[end] == d]] = False
            r = rows[end]
            score = best[r, s] + p.scores[ids]
            up = score > best[r, s + d]
            r, ids = r[up], ids[up]
            best[r, s + d], step[r, s + d], piece[r, s + d] = score[up], d, ids
        r, d = rows[lone], char[lone]
        score = best[r, s] + p.unknown
        up = score > best[r, s + d]
        r, d = r[up], d[up]
        best[r, s + d], step[r, s + d], piece[r, s + d] = score[up], d, -1
    # back from the ends, all words together
    at, rows, trail = size.copy(), np.arange(n), []
    while len(rows := rows[at[rows] > 0]):
        d, ids = step[rows, at[rows]].astype(np.int64), piece[rows, at[rows]]
        known = ids >= 0
        trail.append((rows[known], at[rows[known]], ids[known]))
        for k in range(1, 5):  # the bytes of an unknown character
            spell = ~known & (d >= k)
            r = rows[spell]
            trail.append((r, at[r] - d[spell] + k, p.byte_ids[text[r, at[r] - d[spell] + k - 1]]))
        at[rows] -= d
    row, place, ids = (np.concatenate([t[k] for t in trail]) if trail else np.array([], int) for k in range(3))
    ids = ids[np.lexsort((place, row))].astype(np.int32)
    return np.split(ids, np.cumsum(np.bincount(row, minlength=n))[:-1])


class Encoder:
    """Encodes texts, remembering the words it has seen."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.first, self.size = np.array([], np.int32), np.array([], np.int64), np.array([], np.int64)
        self.held = 0

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, with one space put before it."""
        split = [_WORDS.findall(b" " + t) for t in texts]
        if self.held > REMEMBERED:
            self.clear()
        new = [w for w in dict.fromkeys(w for s in split for w in s) if w not in self.number]
        new.sort(key=lambda w: len(w) > REMEMBERED_WORD)  # long words, which hardly come again, last
        stay = sum(len(w) <= REMEMBERED_WORD for w in new)
        known, keep = len(self.number), len(self.flat)
        flat, first, size = self.flat, self.first, self.size
        if new:
            self.number.update((w, known + i) for i, w in enumerate(new))
            paths = viterbi(self.pieces, new)
            sizes = np.array([len(x) for x in paths], np.int64)
            first = np.concatenate([first, keep + np.cumsum(sizes) - sizes])
            size = np.concatenate([size, sizes])
            flat = np.concatenate([flat, *paths])
            keep += int(sizes[:stay].sum())
        out = []
        get = self.number.__getitem__
        for s in split:
            w = np.fromiter(map(get, s), np.int64, len(s))
            n = size[w]
            total = np.cumsum(n)
            at = np.repeat(first[w] - total + n, n) + np.arange(total[-1])
            out.append(flat[at])
        for w in new[stay:]:
            del self.number[w]
        self.flat, self.first, self.size = flat[:keep], first[: known + stay], size[: known + stay]
        self.held += sum(map(len, new[:stay])) + 100 * stay
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of some ids, without the space that encoding put before it."""
        p = self.pieces
        size = p.sizes[ids]
        total = np.cumsum(size)
        if not len(total):
            return b""
        raw = p.spelled[np.repeat(p.starts[ids] - total + size, size) + np.arange(total[-1])].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


def _chunks(column: pa.Array):
    """(first row, texts) of about CHUNK bytes; a null text is None."""
    texts, size, first = [], 0, 0
    for i, x in enumerate(column):
        texts.append(x.as_buffer().to_pybytes() if x.is_valid else None)
        size += len(texts[-1] or b"")
        if size > CHUNK:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with the column pieces (array of ids); a null text has none (null), an empty one the marker's."""
    keep = [c for c in docs.columns if c != "pieces"]
    at = keep.index(text_col)

    def run(batches):
        encoder = Encoder(load(model))
        for batch in batches:
            ids, valid = [], []
            for texts in _chunks(batch.column(at)):
                ids += encoder.encode([t or b"" for t in texts])
                valid += [t is not None for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids, valid)], names=[*batch.schema.names, "pieces"])

    out = docs.select(*keep)
    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType()))]))


def _lists(ids: list[np.ndarray], valid: list[bool]) -> pa.Array:
    size = [len(x) if v else 0 for x, v in zip(ids, valid, strict=True)]
    flat = np.concatenate([x for x, v in zip(ids, valid, strict=True) if v] or [np.array([], np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat), mask=pa.array([not v for v in valid], pa.bool_()))


def decode(docs: DataFrame, pieces_col: str = "pieces", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``docs`` with the text that its pieces spell; null pieces give null, no pieces the empty text."""
    keep = [c for c in docs.columns if c != text_col]
    at = keep.index(pieces_col)

    def run(batches):
        encoder = Encoder(load(model))
        for batch in batches:
            column = batch.column(at)
            offs = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)
            texts = [encoder.decode(flat[a:b]) if v else None for a, b, v in zip(offs[:-1], offs[1:], column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*batch.schema.names, text_col])

    out = docs.select(*keep)
    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(text_col, T.StringType())]))


def encode_and_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Per document: its id, pieces, n_pieces, n_byte_pieces, pieces_sha256 (ids as decimals with commas), decoded_sha256, round_trip.

    Encoding and decoding in one pass.  A null text has null pieces, no digests and
    a true round trip; repeated rows each come back.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("pieces array<int>, n_pieces long, n_byte_pieces long, pieces_sha256 string, decoded_sha256 string, round_trip boolean").fields])

    def run(batches):
        encoder = Encoder(load(model))
        spells = np.zeros(len(encoder.pieces.bytes), bool)
        spells[encoder.pieces.byte_ids] = True
        for batch in batches:
            rows = [[], [], [], [], []]
            ids, valid = [], []
            for texts in _chunks(batch.column(1)):
                for t, x in zip(texts, encoder.encode([t or b"" for t in texts]), strict=True):
                    ids.append(x)
                    valid.append(t is not None)
                    back = encoder.decode(x)
                    values = (len(x), int(spells[x].sum()), hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest(), hashlib.sha256(back).hexdigest(), back == t)
                    for column, value in zip(rows, values if t is not None else (0, 0, None, None, True), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids, valid), *[pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]], names=schema.names)

    return rows.mapInArrow(run, schema)
