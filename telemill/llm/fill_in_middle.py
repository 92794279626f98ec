"""Fill-in-the-middle rewriting of texts by displacement scatter.

All texts of an Arrow batch are one byte array. A scan finds the ends of its tokens and with them two cuts per document;
a difference array holds, at the start of each segment, by how much its displacement differs from the one before, so
one cumulative sum gives every byte its shift, and one scatter writes all outputs. Restoring builds the inverse
displacements from the markers found in the outputs and gathers. Nothing loops over bytes, tokens or documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import staging, text

SEED, RATE, SPM = 42, 50, 80
MARKERS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM_FORM = 0, 1, 2
FORMS = ("plain", "psm", "spm")
_LETTER = np.zeros(256, bool)
_LETTER[[ord(m[1]) for m in MARKERS]] = True


def draws(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers per document: the first groups of the SHA-256 of ``seed:identifier``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def cuts(buf: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens per document, and the byte positions where prefix and middle end."""
    _, ends, first = text.spans(buf, offsets, text.NOT_SPACE)
    words = np.diff(first)
    size = np.diff(offsets)
    # blanks after the last word are a token of their own
    trailing = np.zeros(len(words), bool)
    trailing[size > 0] = text.SPACE[buf[offsets[1:][size > 0] - 1]]
    n = words + trailing
    ends = np.append(ends, 0)

    def position(k: np.ndarray) -> np.ndarray:
        inside = ends[np.minimum(first[:-1] + np.maximum(k, 1) - 1, len(ends) - 1)]
        return np.where(k == 0, offsets[:-1], np.where(k > words, offsets[1:], inside))

    a, b = h1 % (n + 1), h2 % (n + 1)
    return n, position(np.minimum(a, b)), position(np.maximum(a, b))


def _displacement(total: int, at: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The shift of every byte, from segment starts in ascending order and their shifts."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, at, np.diff(shift, prepend=0))
    return np.cumsum(steps[:total])


def scatter(buf: np.ndarray, offsets: np.ndarray, cut: np.ndarray, stop: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of all documents as one array with offsets."""
    p, m, s = cut - offsets[:-1], stop - cut, offsets[1:] - stop
    moved = form != PLAIN
    out_offsets = np.concatenate(([0], np.cumsum(np.diff(offsets) + 9 * moved)))
    base = out_offsets[:-1] - offsets[:-1]
    spm = form == SPM_FORM
    shift = np.stack([base + moved * np.where(spm, 6 + s, 3), base + moved * (9 + s), base + moved * np.where(spm, 3 - p - m, 6 - m)], 1)
    at = np.stack([offsets[:-1], cut, stop], 1)
    out = np.empty(out_offsets[-1], np.uint8)
    out[np.arange(len(buf)) + _displacement(len(buf), at.ravel(), shift.ravel())] = buf
    begin = out_offsets[:-1]
    places = (np.where(spm, begin + 3 + s, begin), np.where(spm, begin, begin + 3 + p), begin + 6 + p + s)
    for marker, place in zip(MARKERS, places):
        for k, byte in enumerate(marker.encode()):
            out[place[moved] + k] = byte
    return out, out_offsets


def gather(out: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that ``scatter`` has rewritten, from outputs and forms alone."""
    moved = form != PLAIN
    back = np.concatenate(([0], np.cumsum(np.diff(offsets) - 9 * moved)))
    found = np.flatnonzero((out[:-2] == 0x3C) & _LETTER[out[1:-1]] & (out[2:] == 0x3E)) if len(out) > 2 else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, found, "right") - 1
    found = found[moved[doc] & (found + 3 <= offsets[doc + 1])]
    if len(found) != 3 * moved.sum():
        raise ValueError("an output does not hold its three markers exactly once")
    found = found.reshape(-1, 3)
    # psm: <P> prefix <S> suffix <M> middle; spm: <S> suffix <P> prefix <M> middle
    spm = form[moved] == SPM_FORM
    one, two, three = found[:, 1] - found[:, 0] - 3, found[:, 2] - found[:, 1] - 3, offsets[1:][moved] - found[:, 2] - 3
    p, s = np.where(spm, two, one), np.where(spm, one, two)
    begin = back[:-1]
    at, shift = np.repeat(begin[:, None], 3, 1), np.repeat((offsets[:-1] - begin)[:, None], 3, 1)
    at[moved, 1], at[moved, 2] = begin[moved] + p, begin[moved] + p + three
    shift[moved, 0] = np.where(spm, found[:, 1], found[:, 0]) + 3 - begin[moved]
    shift[moved, 1] = found[:, 2] + 3 - at[moved, 1]
    shift[moved, 2] = np.where(spm, found[:, 0], found[:, 1]) + 3 - at[moved, 2]
    return out[np.arange(back[-1]) + _displacement(back[-1], at.ravel(), shift.ravel())], back


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` for every row of ``docs``, without a shuffle.

    ``rate`` per cent of the documents are rewritten, ``spm`` per cent of those suffix first. A null text is empty; empty
    texts and texts that hold a marker stay as they are (``plain``, without lengths). A null identifier draws as an empty
    one; rows that share an identifier draw alike, and each gives a row. Other columns are not read.
    """
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), body.alias("_text"), *[h.alias(f"_h{k}") for k, h in enumerate(draws(F.col(f"`{id_col}`"), seed))])
    held = F.col("_text") == ""
    for m in MARKERS:
        held = held | F.contains("_text", F.lit(m))
    form = F.when(held | (F.col("_h2") % 100 >= rate), PLAIN).when(F.col("_h3") % 100 < spm, SPM_FORM).otherwise(PSM)
    rows = rows.select("_id", "_text", "_h0", "_h1", form.alias("_form"))

    def run(batches):
        for batch in batches:
            buf, offsets = text.flat(batch.column("_text"))
            h1, h2, form = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_h0", "_h1", "_form"))
            for i, j in text.pieces(offsets):
                part, own, f = buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], form[i:j]
                n, cut, stop = cuts(part, own, h1[i:j], h2[i:j])
                out, ends = scatter(part, own, cut, stop, f)
                chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                plain = f == PLAIN
                yield pa.RecordBatch.from_arrays([
                    batch.column("_id").slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(np.array(FORMS, object)[f], pa.string()),
                    pa.array(chars[cut] - chars[own[:-1]], pa.int64(), mask=plain), pa.array(chars[stop] - chars[cut], pa.int64(), mask=plain),
                    _strings(out, ends)], names=["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    staging.batches(docs.sparkSession)
    kind = dict(rows.dtypes)["_id"]
    out = rows.mapInArrow(run, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("_id", id_col)


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form", to: str = "restored") -> DataFrame:
    """``outputs`` with the original text of every row in the column ``to``. A null output or form is an empty plain text."""
    names = [c for c in outputs.columns if c != to]
    schema = outputs.select(*[f"`{c}`" for c in names]).schema.add(to, "string")

    def run(batches):
        for batch in batches:
            buf, offsets = text.flat(batch.column(output_col))
            kinds = {name: k for k, name in enumerate(FORMS)} | {None: PLAIN}
            form = np.array([kinds[f] for f in batch.column(form_col).to_pylist()], np.int64)
            for i, j in text.pieces(offsets):
                got, ends = gather(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], form[i:j])
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns], _strings(got, ends)], names=[*names, to])

    return outputs.select(*[f"`{c}`" for c in names]).mapInArrow(run, schema)
