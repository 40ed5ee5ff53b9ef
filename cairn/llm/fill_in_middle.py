"""Fill-in-middle transformation: texts cut at token boundaries into prefix, middle and suffix, and put together again.

A text is decoded to an array of code points.  A token begins at every code point
but those that continue a run of ASCII letters, so comparing the classes of
neighbours and taking the places that differ gives all boundaries at once; the
drawn ranks index them, and the pieces are slices of the array, encoded again.

What is drawn depends on the id alone, so a row that is computed again after a lost
executor comes out the same, and no rows need to meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

MARKS = ("<P>", "<S>", "<M>")
#: Texts of 100 that stay plain are those from here on; of the others, those below SPM have the suffix first.
PLAIN_FROM, SPM = 90, 20
SEED = "1"


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where tokens (runs of ASCII letters, single other characters) begin, and the end of the text."""
    letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    start = np.ones(len(points) + 1, bool)
    start[1:-1] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)[0 if len(points) else 1 :]


def draws(doc_id, seed: str = SEED) -> list[int]:
    """Four numbers below 2**32 from the id; a null id is drawn for as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def cut(text: str, doc_id, marks: tuple[str, str, str] = MARKS, plain_from: int = PLAIN_FROM, spm: int = SPM, seed: str = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, prefix's and middle's code points, output) of one text."""
    raw = text.encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, "<u4")
    edges = boundaries(points) if len(points) else np.zeros(1, np.int64)
    n = len(edges) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in marks) or h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    a, b = (int(edges[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (points[x:y].tobytes().decode("utf-32-le", "surrogatepass") for x, y in ((0, a), (a, b), (b, len(points))))
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{marks[1]}{suffix}{marks[0]}{prefix}{marks[2]}{middle}"
    return n, "psm", a, b - a, f"{marks[0]}{prefix}{marks[1]}{suffix}{marks[2]}{middle}"


NEW = "n long, form string, prefix_chars long, middle_chars long, output string"


def _transformed(others: int, how: tuple):
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = [f"_{c.split()[0]}" for c in NEW.split(", ")]

    def run(batches):
        for batch in batches:
            ids = batch.column(others)
            rows = [[] for _ in kinds]
            for doc_id, text in zip(ids, batch.column(others + 1), strict=True):
                for column, value in zip(rows, cut(text.as_py() or "", doc_id.as_py(), *how), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:others], *[pa.array(r, k) for r, k in zip(rows, kinds, strict=True)]], names=[*batch.schema.names[:others], *names])

    return run


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: tuple[str, str, str] = MARKS, plain_from: int = PLAIN_FROM, spm: int = SPM, seed: str = SEED) -> DataFrame:
    """``docs`` with n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    A text stays plain if it is empty or null, holds one of ``marks``, or is drawn to:
    ``plain_from`` texts of 100 are cut, ``spm`` of 100 of those with the suffix
    first.  Prefix and middle may be empty.  Each row stands for itself, so repeated
    rows come out alike, an empty table gives none, and long texts are cut whole.
    Other columns pass through; one with the name of a new one is replaced.
    """
    new = [f"_{c}" for c in NEW.split(", ")]
    keep = [c for c in docs.columns if c not in {f[1:].split()[0] for f in new}]
    rows = docs.select(*keep, F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, *T._parse_datatype_string(", ".join(new)).fields])
    out = rows.mapInArrow(_transformed(len(keep), (marks, plain_from, spm, seed)), schema)
    return out.select(*keep, *[F.col(f.split()[0]).alias(f[1:].split()[0]) for f in new])


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output stands for: its parts between the marks, in the order of the text.

    A cut text holds no mark, and no mark can begin inside another, so each is found once.
    """
    def after(mark: str) -> Column:
        return F.substring_index(output, mark, -1)

    def between(first: str, second: str) -> Column:
        return F.substring_index(F.substring_index(output, second, 1), first, -1)

    p, s, m = marks
    psm = F.concat(between(p, s), after(m), between(s, m))
    spm = F.concat(between(p, m), after(m), between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
