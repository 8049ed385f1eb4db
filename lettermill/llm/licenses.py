"""Licence notices by fuzzy search.

A notice of which up to k edits are allowed is split into k+1 pieces: at least one piece must stand
unchanged in any match. Exact search for the pieces finds the candidates; the regex library's
bounded-error matching verifies each and gives the edits and the span.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lettermill.llm.common import ALNUM, encoded, prepare, released

#: Phrases and labels of the contract, then labels that this method adds.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MORE = {"all rights reserved": "reserved", "gnu lesser general public license": "lgpl", "mozilla public license": "mpl", "bsd license": "bsd", "creative commons attribution": "cc-by", "released into the public domain": "public-domain"}
#: One edit for so many letters of a notice.
LETTERS_AN_EDIT = 9

_TO_SPACE = bytes((b + 32 if 65 <= b < 91 else b) if ALNUM[b] else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_SPACE).split()


class Notice:
    def __init__(self, phrase: str, label: str, edits: int):
        self.phrase, self.label, self.edits = f" {phrase} ".encode(), label, edits
        n = len(self.phrase)
        cut = [round(n * i / (edits + 1)) for i in range(edits + 2)]
        self.seeds = [(a, self.phrase[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        self.pattern = regex.compile(rb"(?be)(?<= )(?:" + regex.escape(phrase.encode()) + rb"){e<=%d}(?= )" % edits)

    def matches(self, text: bytes) -> list[tuple[int, int, int]]:
        """(from, to, edits) in bytes of a text of words with one space around each; the phrase itself without spaces around."""
        places: set[tuple[int, int, int]] = set()
        tried: set[int] = set()
        for offset, seed in self.seeds:
            at = text.find(seed)
            while at >= 0:
                begin = at - offset
                if begin >= 0 and text.startswith(self.phrase, begin):
                    places.add((begin + 1, begin + len(self.phrase) - 1, 0))
                elif self.edits and begin not in tried:
                    tried.add(begin)
                    lo = max(0, begin - self.edits)
                    m = self.pattern.search(text, lo, min(len(text), begin + len(self.phrase) + self.edits))
                    if m:
                        places.add((m.start(), m.end(), sum(m.fuzzy_counts)))
                at = text.find(seed, at + 1)
        exact = [p for p in places if not p[2]]
        fuzzy: list[tuple[int, int, int]] = []
        for p in sorted((p for p in places if p[2]), key=lambda p: (p[2], p)):
            if all(p[1] <= q[0] or q[1] <= p[0] for q in exact + fuzzy):
                fuzzy.append(p)
        return sorted(exact + fuzzy)


@lru_cache(maxsize=4)
def notices(base: tuple, more: tuple, letters: int) -> list[tuple[Notice, bool]]:
    return [(Notice(p, label, len(p) // letters), own) for given, own in ((base, True), (more, False)) for p, label in given]


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, more: dict[str, str] = MORE, letters_an_edit: int = LETTERS_AN_EDIT) -> DataFrame:
    """Licence notices of whole texts, a row for each input row.

    Columns: id, n_words, n_base (places of ``base`` phrases word for word), first_word, last_word
    (their least and greatest start; null without any), base_labels, labels (those of matches with
    edits and of ``more`` too), score (1 for an exact base notice, else the best match's share of
    letters unedited, 0 without any), spans (label, from and to word, edits). Null and empty texts
    have no words and no notices; repeated rows stay; other columns are dropped.
    """
    prepare(df.sparkSession)
    key = dict(df.dtypes)[id_col]
    given = (tuple(base.items()), tuple(more.items()), letters_an_edit)
    span = pa.list_(pa.struct([("label", pa.string()), ("from", pa.int64()), ("to", pa.int64()), ("edits", pa.int32())]))

    def run(batches):
        known = notices(*given)
        for batch in batches:
            texts = encoded(batch.column(1))
            out: list[list] = [[] for _ in range(8)]
            for raw in texts:
                words = words_of(raw)
                text = b" " + b" ".join(words) + b" " if words else b""
                starts: list[int] = []
                firm, labels, spans, score = set(), set(), [], 0.0
                space = None
                for notice, own in known:
                    for a, b, edits in notice.matches(text):
                        if space is None:
                            space = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                        word = int(np.searchsorted(space, a)) - 1
                        labels.add(notice.label)
                        spans.append({"label": notice.label, "from": word, "to": int(np.searchsorted(space, b)), "edits": edits})
                        if own and not edits:
                            starts.append(word)
                            firm.add(notice.label)
                        score = max(score, 1.0 if own and not edits else (0.95 if not edits else 1 - edits / (len(notice.phrase) - 2)))
                row = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(firm)), ",".join(sorted(labels)), score, spans)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["k", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    schema = f"k {key}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, from: long, to: long, edits: int>>"
    return df.select(df[id_col], df[text_col]).mapInArrow(released(run), schema).withColumnRenamed("k", id_col)
