"""BPE by a tokenization automaton.

The merges are compiled, one gadget after the other, into a deterministic automaton over tokens
that accepts exactly the token sequences BPE makes. A word is encoded by walking that automaton
along the word's characters, many words at a time; decoding emits the labels of the arcs that were walked.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from lettermill.llm.common import KEPT_IN_WORKERS, encoded, pieces, prepare, released


class Lookup:
    """Numbers by keys (not negative), looked up many at a time; open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.bits = max(4, keys.size.bit_length() + 2)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, missing, np.int64)
        self.missing, place = missing, placed(keys, self.bits)
        while keys.size:
            free = self.keys[place] < 0
            self.keys[place[free]] = keys[free]  # of several, one stays
            done = self.keys[place] == keys
            self.values[place[done]] = values[done]
            keys, values, place = keys[~done], values[~done], (place[~done] + 1) & (self.keys.size - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        place = placed(keys, self.bits)
        found, values = self.keys[place], self.values[place]
        rest = np.flatnonzero((found != keys) & (found >= 0))
        values[rest] = self.missing
        while rest.size:
            place[rest] = (place[rest] + 1) & (self.keys.size - 1)
            found = self.keys[place[rest]]
            good = found == keys[rest]
            values[rest[good]] = self.values[place[rest[good]]]
            rest = rest[~good & (found >= 0)]
        return values


def placed(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)


class MergeAutomaton:
    """Deterministic automaton of a merge list.

    At first one state loops on every single character. The gadget of a merge (u, v) -> t does
    three things: u gets a state of its own (a copy of the state it led to), that state loses its
    arc for v, and every state that had a path u v gets an arc t to where that path led. So t then
    leads to a copy of the state of v as it was, and a state is named by the token that leads to it; it is stored by what
    sets it apart: the right part it was copied from, when, and the arcs it lost.
    An arc t exists in a state if the arc of t's left part did when t was made; ``step`` resolves
    this and keeps the result in the transition table.
    """

    NEVER = 1 << 60

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix, self.vocab = suffix, vocab
        self.label = [""] * (max(vocab.values()) + 1)
        for text, i in vocab.items():
            self.label[i] = text
        n = self.n = self.start = len(self.label)
        self.made, self.left, self.right = [-1] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        self.lost: dict[int, int] = {}
        #: Tokens that lead nowhere, as their merge can't apply.
        self.barred: set[int] = set()
        for at, (a, b) in enumerate(merges):
            u, v, t = vocab[a], vocab[b], vocab[a + b]
            self.made[t], self.left[t], self.right[t] = at, u, v
            if not self._had(u, v, at):
                self.barred.add(t)
                continue
            self.lost[u * n + v] = at
            if u == v:
                self.lost[u * n + t] = at
        self.table: dict[int, bool] = {}
        #: Arc labels inside a word and at its end, and lengths of inner labels, longest first, by their first three letters.
        self.inner = {x: i for x, i in vocab.items() if not (suffix and x.endswith(suffix))}
        self.final = {x[: len(x) - len(suffix)]: i for x, i in vocab.items() if x.endswith(suffix)} if suffix else vocab
        self.longest = max(map(len, self.final), default=0)
        lengths: dict[str, set[int]] = {}
        for x in self.inner:
            lengths.setdefault(x[:3], {1, 1 + (x[:2] in self.inner)}).add(len(x))
        self.lengths = {x: tuple(sorted(n, reverse=True)) for x, n in lengths.items()}
        self._arrays()

    #: Transitions that ``steps`` remembers, as a power of two: each has one place, where the latest stays.
    PLACES = 20

    def _arrays(self) -> None:
        """The same automaton in arrays, with the labels of its arcs as a trie, for many words at a time."""
        self.mades, self.lefts, self.rights = (np.array(x, np.int64) for x in (self.made, self.left, self.right))
        self.lost_at = Lookup(np.fromiter(self.lost, np.int64, len(self.lost)), np.fromiter(self.lost.values(), np.int64, len(self.lost)), self.NEVER)
        self.places = np.full(1 << self.PLACES, -2, np.int64)
        self.lengths_of = np.zeros(self.n, np.int32)
        letters = sorted({x for label in (*self.inner, *self.final) for x in label})
        self.symbols = np.zeros(max(map(ord, letters), default=0) + 2, np.int64)  # 0: in no label
        for i, x in enumerate(letters, 1):
            self.symbols[ord(x)] = i
        self.wide = len(letters) + 1
        symbol = {x: i for i, x in enumerate(letters, 1)}
        nodes: dict[int, int] = {}
        ends: tuple[dict[int, int], dict[int, int]] = {}, {}
        for labels, end in zip((self.inner, self.final), ends, strict=True):
            for label, token in labels.items():
                node = 0
                for x in label:
                    node = nodes.setdefault(node * self.wide + symbol[x], len(nodes) + 1)
                end[node] = token
                self.lengths_of[token] = len(label)
        self.inner_at, self.final_at = np.full(len(nodes) + 1, -1, np.int64), np.full(len(nodes) + 1, -1, np.int64)
        for at, end in zip((self.inner_at, self.final_at), ends, strict=True):
            at[np.fromiter(end, np.int64, len(end))] = np.fromiter(end.values(), np.int64, len(end))
        self.child = Lookup(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes)), 0)

    def _had(self, state: int, token: int, time: int) -> bool:
        """Whether the state had an arc for the token just before the merge at ``time``."""
        while True:
            if token in self.barred or self.lost.get(state * self.n + token, time) < time:
                return False
            if self.made[state] > self.made[token]:
                time, state = self.made[state], self.right[state]
            elif self.made[token] < 0:
                return True
            else:
                time, token = self.made[token], self.left[token]

    #: Transitions that are tabled at a time; beyond it the table begins anew.
    TABLED = 200_000

    def step(self, state: int, token: int) -> bool:
        key = state * self.n + token
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= self.TABLED:
                self.table.clear()
            known = self.table[key] = self._had(state, token, self.NEVER)
        return known

    def _had_all(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``_had`` of many arcs, after all merges."""
        had = np.ones(state.size, bool)
        left, time = np.arange(state.size), np.full(state.size, self.NEVER)
        while left.size:
            lost = self.lost_at(state * self.n + token) < time
            if self.barred:
                lost |= np.isin(token, list(self.barred))
            had[left[lost]] = False
            older, made = self.mades[state], self.mades[token]
            go = np.flatnonzero(~lost & ((older > made) | (made >= 0)))
            left, state, token, older, made = left[go], state[go], token[go], older[go], made[go]
            up, time = older > made, np.maximum(older, made)
            state, token = np.where(up, self.rights[state], state), np.where(up, token, self.lefts[token])
        return had

    def steps(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``step`` for many arcs."""
        key = state * self.n + token
        place = placed(key, self.PLACES)
        known = self.places[place]
        new = np.flatnonzero(known >> 1 != key)
        if new.size:
            keys, back = np.unique(key[new], return_inverse=True)
            known[new] = (keys * 2 + self._had_all(keys // self.n, keys % self.n))[back]
            self.places[place[new]] = known[new]
        return (known & 1).astype(bool)

    def encode_all(self, words: list[str]) -> list[bytes]:
        """Tokens of many words, given as byte letters, as little-endian unsigned 32-bit integers.

        Just one accepted path leads to each letter of a word, so all words take their first letter, then their second,
        and so on: from the state reached before it, each arc whose label stands there is either accepted or not.
        """
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        symbols = self.symbols[np.minimum(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), self.symbols.size - 1)]
        first, stop = np.repeat(end - size, size), np.repeat(end, size)
        # arcs by their labels: where they begin, how far they reach, their tokens
        at, node, found = np.arange(symbols.size), np.zeros(symbols.size, np.int64), []
        reach = 0
        while at.size:
            node = self.child(node * self.wide + symbols[at + reach])
            some = np.flatnonzero(node)
            at, node = at[some], node[some]
            reach += 1
            last = at + reach == stop[at]
            token = np.where(last, self.final_at[node], self.inner_at[node])
            some = np.flatnonzero(token >= 0)
            found.append((at[some], np.full(some.size, reach), token[some]))
            some = np.flatnonzero(~last)
            at, node = at[some], node[some]
        at, far, token = (np.concatenate(x) for x in zip(*found, strict=True))
        turn = (at - first[at]).astype(np.uint16 if size.max() < 1 << 16 else np.int64)  # numbers of 16 bits are sorted faster
        order = np.argsort(turn, kind="stable")
        at, to, token = at[order], (at + far - 1)[order], token[order]
        path = np.full(symbols.size, -1, np.int64)  # the token that ends with a letter
        begin = 0
        for i, until in enumerate(np.cumsum(np.bincount(turn)).tolist()):
            now = slice(begin, until)
            begin = until
            if i:
                before = path[at[now] - 1]
                live = np.flatnonzero(before >= 0)
                state = before[live]
            else:
                live, state = np.arange(until), np.full(until, self.start)
            arcs = token[now][live]
            good = self.steps(state, arcs)
            path[to[now][live[good]]] = arcs[good]
        kept = np.zeros(symbols.size, bool)
        at = end - 1
        while at.size:
            if (path[at] < 0).any():
                raise ValueError(f"no path for {words[int(np.searchsorted(end, at[path[at] < 0][0], 'right'))][:99]!r}")
            kept[at] = True
            before = at - self.lengths_of[path[at]]
            at = before[before >= first[at]]
        ids = path[kept].astype("<u4").tobytes()
        cuts = (4 * np.cumsum(kept)[end - 1]).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts)]

    def encode(self, letters: str) -> list[int]:
        """Tokens of a word, given as byte letters: the only accepted path along it.

        Longer arcs are tried first; where no arc leads on, the walk takes its last arc back.
        """
        size, inner, final, table, n = len(letters), self.inner.get, self.final.get, self.table.get, self.n
        reach, pairs, longest = self.lengths.get, ((1,), (2, 1)), self.longest
        path: list[int] = []
        lengths: list[int] = []
        dead: set[tuple[int, int]] = set()
        at, state, most = 0, self.start, size
        while at < size:
            arcs, left = state * n, size - at
            if longest >= left <= most:
                token = final(letters[at:])
                if token is not None:
                    alive = table(arcs + token)
                    if self.step(state, token) if alive is None else alive:
                        path.append(token)
                        return path
            if most < left:
                left = most + 1
            for length in reach(letters[at : at + 3]) or pairs[letters[at : at + 2] in self.inner]:
                if length < left:
                    token = inner(letters[at : at + length])
                    if token is not None:
                        alive = table(arcs + token)
                        if (self.step(state, token) if alive is None else alive) and (not dead or (at + length, token) not in dead):
                            path.append(token)
                            lengths.append(length)
                            at, state, most = at + length, token, size
                            break
            else:
                if not path:
                    raise ValueError(f"no path for {letters[:99]!r}")
                dead.add((at, state))
                path.pop()
                length = lengths.pop()
                at, most = at - length, length - 1
                state = path[-1] if path else self.start
        return []

    def decode(self, ids) -> str:
        return " ".join(map(self.label.__getitem__, ids))


class Kept:
    """Ids by piece or word, in two generations: what is asked for again stays. Bounded by bytes, but for what one run of texts adds."""

    #: What an entry costs besides its bytes.
    ENTRY_BYTES = 190

    def __init__(self, most: int, length: int):
        self.young: dict = {}
        self.old: dict = {}
        self.half, self.bytes, self.length = most // 2, 0, length
        self.passing: list = []

    def missing(self, keys: set) -> list:
        """Those of the keys that aren't known; all others are in ``young`` then."""
        for key in self.passing:
            del self.young[key]
        self.passing = []
        if self.bytes > self.half:
            self.old, self.young, self.bytes = self.young, {}, 0
        new = keys.difference(self.young)
        self.put({key: self.old[key] for key in new if key in self.old})
        return [*new.difference(self.young)]

    def put(self, known: dict) -> None:
        """Keys of more than ``length`` stay only until others are asked for."""
        self.young.update(known)
        if max(map(len, known), default=0) > self.length:
            self.passing += [key for key in known if len(key) > self.length]
            known = {key: ids for key, ids in known.items() if len(key) <= self.length}
        self.bytes += sum(map(len, known)) + sum(map(len, known.values())) + len(known) * self.ENTRY_BYTES


class Tokenizer:
    """Encodes and decodes as the vocabulary file says.

    The tokenizers library reads the file's normaliser and word split, and splits what white space
    separates; words then go through the automaton. ASCII white space ends a word in every file of
    this kind and never composes with what follows, so texts are taken in runs, and each different piece of a run once.
    """

    #: Bytes of pieces, and of words, that are kept with their ids in each worker; and the longest that is kept.
    PIECE_BYTES, WORD_BYTES, LENGTH = 24 << 20, 10 << 20, 48
    #: Bytes of text in a run.
    RUN_BYTES = 256 << 10
    #: Stands between pieces, as a number that no other character joins or changes; and, as no four bytes of ids under 2^24 do, between their ids.
    MARK, GAP = "\U00010e7e", b"\xff" * 4

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("special tokens of this kind aren't known here")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.automaton = MergeAutomaton(model["vocab"], [tuple(x) for x in model["merges"]], model["end_of_word_suffix"] or "")
        self.automaton.label.extend([""] * (max(self.special.values(), default=-1) + 1 - len(self.automaton.label)))
        for text, i in self.special.items():
            self.automaton.label[i] = text
        self.marks = re.compile(("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").encode()) if self.special else None
        splitter = Library.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None, "truncation": None, "padding": None, "model": model | {"vocab": {}, "merges": []}}))
        self.normalize, self.split = splitter.normalizer.normalize_str, splitter.pre_tokenizer.pre_tokenize_str
        self.pieces, self.words = Kept(self.PIECE_BYTES, self.LENGTH), Kept(self.WORD_BYTES, self.LENGTH)
        #: The file's own split for lines of printable ASCII, where it needs no Unicode classes and bytes are written as they are.
        self.ascii_split = None
        kinds = [x["type"] for y in (spec["normalizer"], spec["pre_tokenizer"]) for x in y.get("normalizers", y.get("pretokenizers", []))]
        if kinds == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            split, level = spec["pre_tokenizer"]["pretokenizers"]
            if spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]:
                self.ascii_split = regex.compile(f"(?:{split['pattern']['Regex']})|\n").findall
        self.printable, self.blank = re.compile(rb"[!-~\n]+").fullmatch, re.compile(rb"\s").search
        #: The words that the file's split makes of MARK.
        self.mark = [x for x, _ in self.split(self.normalize(self.MARK))]

    def _lines(self, pieces: list[bytes]) -> list[str]:
        """Words of pieces of printable ASCII, and a line end between pieces."""
        return self.ascii_split(b"\n".join(pieces).decode().lower())

    def _others(self, pieces: list[bytes]) -> list[str]:
        """The same for any pieces, by the library. It gets them joined by a mark, or one by one where marks and words can't be told apart."""
        whole = f" {self.MARK} ".join(map(bytes.decode, pieces))
        if len(self.mark) == 1 and whole.count(self.MARK) == len(pieces) - 1:
            mark = self.mark[0]
            found = ["\n" if x == mark else x for x, _ in self.split(self.normalize(whole))]
            if found.count("\n") == len(pieces) - 1:
                return found
        return [x for piece in pieces for x in ("\n", *(x for x, _ in self.split(self.normalize(piece.decode()))))][1:]

    def _learn(self, pieces: set[bytes]) -> None:
        """See that the ids of all these pieces are among what is kept."""
        new = self.pieces.missing(pieces)
        if not new:
            return
        plain = [x for x in new if x.isascii()] if self.ascii_split else []
        if plain and not self.printable(b"\n".join(plain)):
            plain = [x for x in plain if self.printable(x)]
        others = [*set(new).difference(plain)]
        found = (self._lines(plain) if plain else []) + ["\n"] * bool(plain and others) + (self._others(others) if others else [])
        words = self.words.missing({*found} - {"\n"})
        short, long = [x for x in words if len(x) <= self.LENGTH], [x for x in words if len(x) > self.LENGTH]
        self.words.put(dict(zip(short, self.automaton.encode_all(short), strict=True)))
        self.words.put({x: array("I", self.automaton.encode(x)).tobytes() for x in long})
        self.words.young["\n"] = self.GAP
        ids = b"".join(map(self.words.young.__getitem__, found)).split(self.GAP)
        self.pieces.put(dict(zip(plain + others, ids, strict=True)))

    def _parts(self, text: bytes):
        """Pieces of a text in runs with their sizes in bytes, and ids of special tokens."""
        for i, part in enumerate(self.marks.split(text) if self.marks else (text,)):
            if i % 2:
                yield 0, array("I", [self.special[part.decode()]]).tobytes()
                continue
            begin = 0
            while begin < len(part):
                blank = self.blank(part, begin + self.RUN_BYTES)
                end = blank.start() if blank else len(part)
                yield end - begin, part[begin:end].split()
                begin = end

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        run, size = [], 0

        def finish():
            self._learn({*chain.from_iterable(part for _, part in run if isinstance(part, list))})
            ids = self.pieces.young.__getitem__
            for i, part in run:
                out[i].append(b"".join(map(ids, part)) if isinstance(part, list) else part)
            run.clear()

        for i, text in enumerate(texts):
            for more, part in self._parts(text):
                if size + more > self.RUN_BYTES:
                    finish()
                    size = 0
                run.append((i, part))
                size += more
        finish()
        return [*map(b"".join, out)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text.encode()])[0]

    def decode(self, ids: bytes) -> str:
        return self.automaton.decode(array("I", ids))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One per worker process and file, until the worker gets a task of another operator."""
    return Tokenizer(path)


KEPT_IN_WORKERS["bpe"] = tokenizer


def bpe_encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """Encode whole texts and decode them again, a row for each input row.

    Columns: id, n_tokens, ids_sha256, decoded_sha256, with ``with_ids`` token_ids (array<int>) and
    with ``with_decoded`` decoded. A null text counts as empty (no tokens, empty decoded text); null
    ids stay null; repeated rows stay; other columns are dropped, so clashing names can't matter; an
    empty table gives an empty result. ``vocab_path`` must be readable on every worker.
    """
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    types = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batches):
        tok = tokenizer(vocab_path)
        for batch in batches:
            whole = encoded(batch.column(1))
            for begin, end in pieces(whole, tok.RUN_BYTES):
                ids = tok.encode_all(whole[begin:end])
                texts, marks = [], []
                for x in ids:
                    decoded = tok.decode(x)
                    marks.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_decoded:
                        texts.append(decoded)
                values = ([len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], marks)
                cols = {"k": batch.column(0).slice(begin, end - begin), **{c: pa.array(v, types[c]) for c, v in zip(types, values, strict=True)}}
                if with_ids:
                    ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype(np.int32)
                    cols["token_ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                if with_decoded:
                    cols["decoded"] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*cols.values()], names=[*cols])

    schema = f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids + ", decoded string" * with_decoded
    return df.select(df[id_col], df[text_col]).mapInArrow(released(run, keeps="bpe"), schema).withColumnRenamed("k", id_col)


def bpe_decode(df: DataFrame, vocab_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Add the decoded text of an array<int> column; null ids decode to null, no ids to an empty text."""
    prepare(df.sparkSession)

    @F.pandas_udf("string")
    def decode(ids):
        tok = tokenizer(vocab_path)
        return ids.map(lambda x: None if x is None else tok.automaton.decode(x))

    return df.withColumn(out_col, decode(ids_col))
