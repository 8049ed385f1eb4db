"""Toxicity by a support vector machine on a subsequence string kernel.

Words are compared by their common subsequences of three letters, each weighted down by the letters
it spans, so that gaps and inserted letters cost little. The kernel is normalised and sharpened by
a power, and approximated by Nyström landmarks: words of the training sentences. A sentence is the
sum of its words; a linear machine on that, trained on sentences of labelled documents, therefore
gives every word a weight of its own, and a whole text is scored by looking weights up.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import prepare, released

ORDER, DECAY, POWER = 3, 0.8, 3
#: Longer words are read in overlapping stretches of so many letters.
LONGEST = 20
#: At most so many labelled documents are taken to fit, those with the least hash of the id.
TRAIN_DOCS = 4000
LANDMARKS = 72
#: Clean sentences to fit on: so many nearest to toxic landmarks, and as many others.
CLEAN_SENTENCES = 10_000
#: An error on a toxic sentence counts as so many on clean ones.
POSITIVE_COST = 3.0
THRESHOLD = 0.7
_MISS = -1


def letters_of(word: str) -> str:
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


#: Letters with spaces or marks between: "i d i o t".
_SPACED = re.compile(r"(?<!\w)\w(?:[ .*_-]\w){3,}(?!\w)")


def sentences(text: str) -> list[list[str]]:
    """Lower-cased tokens of each sentence; spaced-out letters are put together as one more token."""
    text = text.lower()
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: m[0] + " " + letters_of(m[0]), text)
    text = text.replace(". ", "\n").replace("! ", "\n").replace("? ", "\n")
    return [words for line in text.split("\n") if (words := line.split())]


@lru_cache(maxsize=64)
def _picks(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All choices of ORDER of n places in order, and their weights."""
    at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


def _codes(words: list[str]) -> np.ndarray:
    """Letters (all words of one length) as numbers below 64."""
    raw = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int64)
    return np.where((raw >= 97) & (raw < 123), raw - 96, np.where(raw == ord("^"), 0, 27 + raw % 37))


def features(words: list[str]):
    """For words of one length: feature numbers and weights of their subsequences, and each word's norm."""
    at, weight = _picks(len(words[0]))
    code = _codes(words)
    number = (code[:, at[:, 0]] * 64 + code[:, at[:, 1]]) * 64 + code[:, at[:, 2]]
    # numbers and places in one value: rows are sorted, not indexed
    packed = np.sort((number << 11 | np.arange(len(weight))).astype(np.int32), axis=1)
    ranked = packed >> 11
    value = weight[packed & 2047]
    # a feature's weights add up before they are squared
    new = np.ones(ranked.shape, bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    flat = np.flatnonzero(new.ravel())
    total = np.add.reduceat(value.ravel(), flat)
    norm = np.sqrt(np.bincount(flat // ranked.shape[1], total * total, len(words)))
    return number, weight, norm


class Kernel:
    """Normalised, sharpened kernel of words against landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        table: dict[int, np.ndarray] = {}
        for j, word in enumerate(landmarks):
            number, weight, norm = features([word])
            for f, w in zip(number[0].tolist(), weight, strict=True):
                table.setdefault(f, np.zeros(len(landmarks)))[j] += w / norm[0]
        self.row = np.full(64**3, _MISS, np.int32)
        self.row[list(table)] = np.arange(len(table))
        self.value = np.array([*table.values(), np.zeros(len(landmarks))], np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        width = len(self.value)  # the last feature stands for those of no landmark and weighs nothing
        for n, which in by.items():
            if n < ORDER:
                continue
            step = max(1, min(400_000 // len(_picks(n)[1]), 1_500_000 // width))
            for a in range(0, len(which), step):
                some = which[a : a + step]
                number, weight, norm = features([words[i] for i in some])
                at = self.row[number] % width + np.arange(len(some))[:, None] * width
                mass = np.bincount(at.ravel(), np.broadcast_to(weight, at.shape).ravel(), len(some) * width)
                out[some] = (mass.astype(np.float32).reshape(-1, width) @ self.value / norm[:, None]) ** POWER
        return out


def stretches(word: str) -> list[str]:
    """A token's letters behind a mark of the word's start, in overlapping stretches where they are many."""
    word = "^" + letters_of(word)
    return [word] if len(word) <= LONGEST else [word[a : a + LONGEST] for a in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


@dataclass
class Model:
    kernel: Kernel
    alpha: np.ndarray
    #: Logistic weights of the document's features; the last is the constant.
    doc: np.ndarray

    def word_weights(self, tokens: list[str]) -> list[float]:
        """The machine's weight of each token (of its strongest stretch)."""
        parts = [stretches(t) for t in tokens]
        flat = [p for ps in parts for p in ps]
        g = self.kernel(flat) @ self.alpha if flat else np.zeros(0)
        sizes = np.array([len(ps) for ps in parts], np.int64)
        first = np.cumsum(sizes) - sizes
        best = g[first] if len(g) else g
        for i in np.flatnonzero(sizes > 1).tolist():
            best[i] = max(g[first[i] : first[i] + sizes[i]], key=abs)
        return [float(x) if big else 0.0 for x, big in zip(best.tolist(), (np.abs(best) > 1e-3).tolist(), strict=True)]

    def score(self, gains: list[float], words: int) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(doc_features(gains, words) @ self.doc))))))


def doc_features(gains: list[float], words: int) -> np.ndarray:
    """Of what the words of each sentence add up to: the greatest, the next two, and all of it against the length."""
    top = [max(0.0, min(g, 3.0)) for g in sorted(gains, reverse=True)[:3]] + [0.0] * 3
    mass = sum(g - 0.3 for g in gains if g > 0.3)
    return np.array([top[0], top[1] + top[2], min(5.0, mass / math.sqrt(words + 10.0) * 3), min(3.0, 60 * mass / (words + 40.0)), 1.0])


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last column of x is constant."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for turn in range(25):
        active = y * (x @ w) < 1
        xa, ca = x[active].astype(float), cost * weight[active]
        step = np.linalg.solve(ridge + xa.T @ (xa * ca[:, None]), xa.T @ (ca * y[active]))
        if np.abs(step - w).max() < 1e-6:
            break
        w = 0.5 * (w + step) if turn > 10 else step
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights, none below 0 but the constant: more evidence never lowers a score."""
    use = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        for _ in range(30):
            z = x[:, use]
            p = 1 / (1 + np.exp(-np.clip(z @ w[use], -30, 30)))
            h = z.T @ (z * (p * (1 - p))[:, None]) + ridge * np.eye(z.shape[1])
            d = np.linalg.solve(h, z.T @ (y - p) - ridge * w[use])
            w[use] += d
            if np.abs(d).max() < 1e-6:
                break
        low = np.flatnonzero(w[:-1] < 0)
        if not len(low):
            return w
        use[low[np.argmin(w[low])]] = False


def choose_landmarks(docs: list[list[list[str]]], labels: np.ndarray, n: int = LANDMARKS) -> list[str]:
    """Five in six mark toxic documents, the rest are common in the others; no two are nearly the same.

    Words and beginnings of words are taken, by how much likelier and how often toxic documents have them.
    """
    bad, good = Counter(), Counter()
    for doc, y in zip(docs, labels, strict=True):
        words = {s for line in doc for t in line for s in stretches(t) if len(s) >= 5}
        (bad if y else good).update(words | {w[:n] for w in words for n in range(5, min(len(w), 10))})
    nb, ng = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    lift = {w: (math.log((c + 0.5) / (nb + 1)) - math.log((good[w] + 0.5) / (ng + 1))) * c for w, c in bad.items() if c >= 3}
    marked = sorted((w for w in lift if lift[w] > bad[w]), key=lambda w: (-lift[w], w))[: 8 * n]
    common = sorted(good, key=lambda w: (-good[w], w))[: 8 * n]
    out: list[str] = []
    for pool, most in ((marked, 5 * n // 6), (common, n)):
        seen = np.zeros(len(pool))
        for i, w in enumerate(pool):
            if len(out) >= most:
                break
            if seen[i] < 0.4 and w not in out:
                out.append(w)
                seen = np.maximum(seen, Kernel([w])(pool)[:, 0])
    return out


def train(texts: list[str], labels: list[int]) -> Model | None:
    """Fit on whole labelled texts; None if there are not both labels.

    Sentences of clean texts are negative. Of a toxic text's sentences those are positive that the
    machine of the round before scores so, and always the highest one; the first round takes those
    with a word near a toxic landmark.
    """
    y = np.array(labels, float)
    if not 0 < y.sum() < len(y):
        return None
    once: dict[str, str] = {}  # a token is one object, however often it occurs
    docs = [[[once.setdefault(t, t) for t in s] for s in sentences(x)] for x in texts]
    marks = choose_landmarks(docs, y)
    if not marks:
        return None
    kernel = Kernel(marks)
    tokens = sorted(once)
    del once
    index = {t: i for i, t in enumerate(tokens)}
    k = np.zeros((len(tokens), len(marks)), np.float32)
    for a in range(0, len(tokens), 20_000):
        parts = [stretches(t) for t in tokens[a : a + 20_000]]
        begin = np.cumsum([0] + [len(p) for p in parts])[:-1]
        k[a : a + len(parts)] = np.maximum.reduceat(kernel([p for ps in parts for p in ps]), begin, axis=0)
    gram = kernel(marks)
    val, vec = np.linalg.eigh(gram)
    root = ((vec / np.sqrt(np.maximum(val, 1e-3))) @ vec.T).astype(np.float32)
    lengths = [len(s) for d in docs for s in d]
    place = np.fromiter((index[t] for d in docs for s in d for t in s), np.int32, sum(lengths))
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
    x = np.zeros((len(lengths), len(marks) + 1), np.float32)
    for a in range(0, len(lengths), 5000):  # in parts: a row for each word is large
        b = min(len(lengths), a + 5000)
        last = begin[b] if b < len(lengths) else len(place)
        x[a:b, :-1] = np.add.reduceat(k[place[begin[a] : last]], begin[a:b] - begin[a], axis=0)

    near = np.zeros(len(lengths))  # of the nearest word to a toxic landmark
    np.maximum.at(near, np.repeat(np.arange(len(lengths)), lengths), k[:, : 5 * len(marks) // 6].max(1)[place])
    # most clean sentences are alike: the ones nearest to landmarks, and a share of the others that stands for all
    clean = np.flatnonzero(y[doc] == 0)
    clean = clean[np.argsort(-near[clean], kind="stable")]
    hard, easy = clean[:CLEAN_SENTENCES], clean[CLEAN_SENTENCES:]
    some = easy[np.argsort(np.random.default_rng(7).random(len(easy)), kind="stable")[:CLEAN_SENTENCES]]
    stands = np.ones(len(x))
    stands[some] = len(easy) / max(1, len(some))
    taken = np.sort(np.concatenate([hard, some, np.flatnonzero(y[doc] > 0)]))
    x[:, :-1] = x[:, :-1] @ root
    x[:, -1] = 1

    def machine(which: np.ndarray) -> np.ndarray:
        rows = taken[which[doc[taken]]]
        bad = y[doc[rows]] > 0
        m, w = near[rows], None
        for turn in range(4):
            best = np.full(len(docs), -np.inf)
            np.maximum.at(best, doc[rows], m)
            pick = bad & ((m > (0 if turn else 0.4)) | (m >= best[doc[rows]]))
            use = pick | ~bad
            w = fit_svm(x[rows[use]], np.where(bad[use], 1.0, -1.0), np.where(bad[use], POSITIVE_COST, stands[rows[use]]))
            m = x[rows] @ w
        return w

    fold = np.arange(len(docs)) % 2
    feats = np.zeros((len(docs), 5))
    total = np.bincount(doc, lengths, len(docs)).astype(int)
    edge = np.searchsorted(doc, np.arange(len(docs) + 1))
    for f in (0, 1):
        inside = fold != f
        if not 0 < y[inside].sum() < inside.sum():
            inside = np.ones(len(docs), bool)
        gain = x[:, :-1] @ machine(inside)[:-1]
        for i in np.flatnonzero(fold == f):
            feats[i] = doc_features(gain[edge[i] : edge[i + 1]].tolist(), int(total[i]))
    w = machine(np.ones(len(docs), bool))
    return Model(kernel, root @ w[:-1], fit_logistic(feats, y))


class Scorer:
    """Scores texts; keeps the weights of the letters of tokens it has seen, in two generations of bounded size: what is met again stays."""

    KEPT = 80_000

    def __init__(self, model: Model | None):
        self.model, self.weights, self.old = model, {}, {}

    def __call__(self, texts: list[str | None]) -> list[float]:
        if self.model is None:
            return [0.0] * len(texts)
        if len(self.weights) > self.KEPT:
            self.old, self.weights = self.weights, {}
        docs = [sentences(t or "") for t in texts]
        letters = {t: letters_of(t) for t in {t for d in docs for s in d for t in s}}
        new = set(letters.values()) - self.weights.keys()
        kept = {x: self.old[x] for x in new & self.old.keys()}
        self.weights.update(kept)
        new = list(new - kept.keys())
        self.weights.update(zip(new, self.model.word_weights(new), strict=True))
        known = {t: self.weights[x] for t, x in letters.items()}
        get = known.__getitem__
        return [self.model.score([sum(map(get, s)) for s in d], sum(map(len, d))) for d in docs]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_DOCS) -> Model | None:
    """Train on at most ``most`` labelled documents outside the held-out third (crc32 of the id as text mod 3 is 1)."""
    rows = labels.where(F.col(label_col).isNotNull() & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1))
    rows = rows.groupBy(id_col).agg(F.max(label_col).alias("__y")).orderBy(F.xxhash64(id_col), id_col).limit(most)
    got = docs.select(id_col, text_col).join(F.broadcast(rows), id_col).dropDuplicates([id_col]).toPandas().sort_values(id_col)
    return train([t or "" for t in got[text_col]], got["__y"].astype(int).tolist())


def score_toxicity(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns, and score (0 to 1) and predicted (1 from the threshold on); columns of those names are replaced.

    Null and empty texts have no sentences and get the score of that; without a model (no labelled
    rows of both kinds) every score is 0. Repeated rows stay; whole texts are read.
    """
    prepare(df.sparkSession)
    keep = df.drop("score", "predicted")
    at = keep.columns.index(text_col)

    def run(batches):
        score = Scorer(model)
        for batch in batches:
            found: list[float] = []
            for a in range(0, batch.num_rows, 200):
                found += score(batch.column(at).slice(a, 200).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    schema = StructType([*keep.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return keep.mapInArrow(released(run), schema)
