"""Octets of many rows at once: transfer encodings, character sets, encoded words, splitting outside of quotes.

Rows lie behind each other in one buffer with offsets, as in Arrow; the steps are array operations over all of
them. Nothing here ever fails on what a row contains.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_HEX = np.full(257, -1, np.int16)  # the last entry stands for "behind the end"
for _i, _c in enumerate(b"0123456789abcdef"):
    _HEX[[_c, bytes([_c]).upper()[0]]] = _i
_SIX = np.full(256, 255, np.uint8)
_SIX[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")] = np.arange(64)
_SIX[list(b"-_")] = 62, 63


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the offsets of its rows; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def octets(column) -> tuple[np.ndarray, np.ndarray]:
    """The low bytes of a string column's UTF-16 units: what was read as Latin-1 gets its bytes back."""
    data, offsets = buffer(column)
    if not len(data) or data.max() < 128:
        return data, offsets
    units = ((data & 0xC0) != 0x80).astype(np.int64) + (data >= 0xF0)
    total = np.concatenate([[0], np.cumsum(units)])
    wide = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-16-le", "surrogatepass"), "<u2")
    return (wide & 0xFF).astype(np.uint8), total[offsets]


def only(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _ends(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the row ends that each position lies in."""
    return offsets[np.searchsorted(offsets, at, "right")]


def without_returns(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line ends of two bytes as one."""
    at = np.flatnonzero(data == 13)
    at = at[at + 1 < _ends(offsets, at)] if len(at) else at
    keep = np.ones(len(data), bool)
    keep[at[data[at + 1] == 10]] = False
    return only(data, offsets, keep)


def quoted_printable(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decoded rows: an equals sign before a line end or at the end joins lines, one without two digits behind it stays."""
    at = np.flatnonzero(data == 61)
    if not len(at):
        return data, offsets
    end = _ends(offsets, at)
    padded = np.concatenate([data, [0, 0]]).astype(np.int16)
    one, two = (np.where(at + k < end, padded[at + k], 256) for k in (1, 2))
    high, low = _HEX[one], _HEX[two]
    both = (high >= 0) & (low >= 0)
    soft = (one == 10) | (one == 256)
    wide = (one == 13) & (two == 10)
    out, keep = data.copy(), np.ones(len(data) + 2, bool)
    out[at[both]] = high[both] * 16 + low[both]
    keep[at[soft | wide]] = False
    keep[at[both | wide | (one == 10)] + 1] = False
    keep[at[both | wide] + 2] = False
    return only(out, offsets, keep[: len(data)])


def base64(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decoded rows of either alphabet; other characters don't count, nor does a last one alone."""
    six = _SIX[data]
    six, offsets = only(six, offsets, six < 64)
    n = np.diff(offsets)
    begin = np.concatenate([[0], np.cumsum(-(-n // 4) * 4)])
    grid = np.zeros(begin[-1], np.uint32)
    grid[np.repeat(begin[:-1] - offsets[:-1], n) + np.arange(len(six))] = six
    grid = grid.reshape(-1, 4)
    word = grid[:, 0] << 18 | grid[:, 1] << 12 | grid[:, 2] << 6 | grid[:, 3]
    out = np.stack([word >> 16, word >> 8, word], axis=1).astype(np.uint8).ravel()
    size = n * 6 // 8
    place = np.arange(len(out)) - np.repeat(begin[:-1] // 4 * 3, np.diff(begin) // 4 * 3)
    return out[place < np.repeat(size, np.diff(begin) // 4 * 3)], np.concatenate([[0], np.cumsum(size)])


# Labels of character sets that stand for another one on the web, and those that are read at all.
_STANDS_FOR = {"ascii": "cp1252", "iso8859-1": "cp1252", "iso8859-9": "cp1254", "iso8859-11": "cp874", "tis-620": "cp874", "gb2312": "gbk", "shift_jis": "cp932", "euc_kr": "cp949", "utf-16": "utf-16-le", "big5": "big5hkscs"}
_READ = {
    "utf-8", "utf-16-le", "utf-16-be", "gbk", "gb18030", "big5hkscs", "euc_jp", "iso2022_jp", "cp932", "cp949", "koi8-r", "koi8-u", "mac-roman", "mac-cyrillic", "cp866", "cp874",
    *(f"cp125{k}" for k in range(9)), *(f"iso8859-{k}" for k in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16)),
}


def _controls(error: UnicodeError) -> tuple[str, int]:
    """Bytes that a code page leaves open are the control characters of their number."""
    return "".join(chr(b) for b in error.object[error.start : error.end]), error.end


codecs.register_error("lettermill-controls", _controls)


@lru_cache(256)
def _codec(label: str) -> tuple[str, str]:
    try:
        name = codecs.lookup(label.strip().lower()).name
    except (LookupError, ValueError, UnicodeError):
        return "latin-1", "strict"
    name = _STANDS_FOR.get(name, name)
    if name not in _READ:
        return "latin-1", "strict"
    return ("utf-8-sig" if name == "utf-8" else name), "lettermill-controls" if name in ("cp1252", "cp1254", "cp1258") else "replace"


def text(data: bytes, label: str | None) -> str:
    """Bytes in a character set as text; an unknown one is read as Latin-1, bytes that it lacks are replaced."""
    name, errors = _codec(re.sub("[\"']", "", label or "utf-8")[:64])
    return data.decode(name, errors).removeprefix("﻿" if name.startswith("utf-16") else "")


def texts(data: np.ndarray, offsets: np.ndarray, labels: list) -> list[str]:
    raw, edges = data.tobytes(), offsets.tolist()
    return [text(raw[i:j], label) for i, j, label in zip(edges, edges[1:], labels, strict=False)]


#: Bytes that are worked on at once: the steps hold several numbers of eight bytes for each.
AT_ONCE = 1 << 20


def runs(sizes, most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of rows that have at most ``most`` bytes, or of one row."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def bodies(column, encodings: list[str | None], labels: list[str | None]) -> list[str]:
    """Texts of parts by transfer encoding and character set."""
    kinds = np.array([{"base64": 1, "quoted-printable": 2}.get((e or "").strip().lower(), 0) for e in encodings], np.int8)
    out: list[str] = [""] * len(kinds)
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for kind in range(3):
        every = np.flatnonzero(kinds == kind)
        for a, b in runs(sizes[every].tolist()):
            at = every[a:b]
            data, offsets = octets(column.take(pa.array(at)))
            if kind == 1:
                data, offsets = base64(data, offsets)
            elif kind == 2:
                data, offsets = quoted_printable(*without_returns(data, offsets))
            for i, t in zip(at.tolist(), texts(data, offsets, [labels[i] for i in at.tolist()]), strict=True):
                out[i] = t
    return out


_GAP = re.compile(r"(\?=)[ \t]+(=\?)")
_WORD = re.compile(r"=\?([^?]+)\?([BbQq])\?([^?]*)\?=")


def words(values: list[str | None]) -> list[str]:
    """Encoded words as text, all rows' words decoded together; white space between two of them goes."""
    out = [v or "" for v in values]
    every = [i for i, v in enumerate(out) if "=?" in v]
    for a, b in runs([len(out[i]) for i in every]):
        _decode(out, every[a:b])
    return out


def _decode(out: list[str], marked: list[int]) -> None:
    for i in marked:
        out[i] = _GAP.sub(r"\1\2", out[i])
    found = [(i, m) for i in marked for m in _WORD.finditer(out[i])]
    kinds = ["base64" if m[2] in "Bb" else "quoted-printable" for _, m in found]
    raw = pa.array([m[3] if m[2] in "Bb" else m[3].replace("_", " ") for _, m in found], pa.string())
    pieces: dict[int, list[str]] = {}
    ends: dict[int, int] = {}
    for (i, m), t in zip(found, bodies(raw, kinds, [m[1] for _, m in found]), strict=True):
        pieces.setdefault(i, []).extend((out[i][ends.get(i, 0) : m.start()], t))
        ends[i] = m.end()
    for i, own in pieces.items():
        out[i] = "".join(own) + out[i][ends[i] :]


def split_outside(column, separator: str) -> pa.Array:
    """Each row's pieces between separators, see ``_split``; null is one empty piece."""
    sizes = pc.binary_length(column).fill_null(0).to_pylist()
    parts = [_split(column.slice(a, b - a), separator) for a, b in runs(sizes)]
    return pa.concat_arrays(parts) if parts else _split(column, separator)


def _split(column, separator: str) -> pa.Array:
    """Each row's pieces between separators that aren't in quotes or angle brackets, nor behind a backslash.

    A state machine for all rows at once: backslashes count by their place in a run, quotes by parity, brackets by a
    sum that can't fall below zero.
    """
    data, offsets = buffer(column)
    n = len(data)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    begins = begins[:n]
    slash = data == 92
    before = np.concatenate([[False], slash[:-1]]) if n else slash
    starts = slash & (~before | begins)
    place = np.arange(n) - np.maximum.accumulate(np.where(starts, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    escapes = slash & (place % 2 == 0)
    escaped = (np.concatenate([[False], escapes[:-1]]) if n else slash) & ~begins
    live = ~escaped & ~escapes

    def within(x):  # running sum in each row
        total = np.cumsum(x)
        base = np.concatenate([[0], total])[offsets[:-1]]
        return total - base[row]

    quoted = within((live & (data == 34)).astype(np.int64)) % 2 == 1
    open_ = live & ~quoted
    level = within((open_ & (data == 60)).astype(np.int64) - (open_ & (data == 62)))
    floor = -row.astype(np.int64) * (2 * n + 2)  # rows can't see the minima of earlier ones
    depth = level + floor - np.minimum.accumulate(np.minimum(level + floor, floor)) if n else level
    cut = open_ & (depth == 0) & (data == ord(separator))
    at = np.flatnonzero(cut)
    kept, total = data[~cut], np.concatenate([[0], np.cumsum(~cut)])
    edges = np.sort(np.concatenate([offsets[:-1] * 2, at * 2 + 1]), kind="stable") // 2
    values = np.append(total[edges], len(kept)).astype(np.int64) if len(edges) else np.zeros(1, np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(values) - 1, pa.py_buffer(values.tobytes()), pa.py_buffer(kept.tobytes())).cast(pa.string())
    each = 1 + np.bincount(row[at], minlength=len(offsets) - 1) if len(offsets) > 1 else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pieces)
