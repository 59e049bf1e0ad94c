"""Toxicity by a string-kernel support vector machine over words, with Nystroem landmarks.

The kernel of two words sums over their common subsequences of three characters, gaps allowed, each
weighed by DECAY to the power of the span in both words, and is normalised to 1 for equal words: an
insult with inserted or gapped characters stays close to the plain one. A word's features are its
kernels with the landmark words, whitened by the landmarks' own kernel matrix; a linear support
vector machine on them is the kernel machine of that subspace. A word of over LONGEST characters is read by
its parts between punctuation and by overlapping pieces; words of one or two characters in a row are
read as one word too. A text is as toxic as its most toxic
word; a logistic curve over that margin gives the score.

Labels mark texts, not words: training starts from words that stand out in toxic texts and moves to
each toxic text's own worst words for some rounds. It is fitted in one task from a bounded sample:
MOST_TEXTS labelled texts at most, the first in the order of a hash, of MOST_OF_ONE characters at most each and
MOST_CHARACTERS in all. Scoring covers all texts. There the machine is read in its primal form: a word's margin is a
sum over its triples of characters of the landmarks' weighted sum, which is the same number.

Texts that are null, empty or of white space only have no word and get the score of the weakest
margin. Without toxic or without clean learning rows there is nothing to separate: the score is the
learning rows' toxic share, 0 without any. Repeated rows are scored alike; repeated labels of a key
count as toxic where one is. Rows are scored one by one, so ties need no rule.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrier.llm.common import fold, parts, split

#: Labelled texts to fit on, at most, the characters of one that may be drawn and of all that are used; the words of a text that may be its worst; landmarks of toxic and of other words.
MOST_TEXTS, MOST_OF_ONE, MOST_CHARACTERS, WITNESSES, TOXIC_LANDMARKS, OTHER_LANDMARKS = 10_000, 200_000, 60_000_000, 2, 40, 8
#: Weight of a character of span, characters of a word that is compared whole and of a landmark, words in a block.
DECAY, LONGEST, LANDMARK_LONGEST, BLOCK = 0.5, 24, 12, 4096
#: Evidence (a likelihood ratio's chi-square) from which a word counts as marked at the start.
SURE = 16
#: Lengths and strides of the pieces of a long run.
PIECES = ((24, 12), (12, 4), (8, 2), (6, 2))
_ALPHABET = 512


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length, and their characters as small numbers (word, place); BLOCK words at most."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    ends = np.cumsum(np.bincount(sizes, minlength=1))
    for n in np.unique(sizes).tolist():
        for at in range(int(ends[n - 1]) if n else 0, int(ends[n]), BLOCK):
            rows = order[at : min(at + BLOCK, int(ends[n]))]
            points = np.frombuffer("".join([words[i] for i in rows.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield rows, (points % (_ALPHABET - 1) + 1).astype(np.int32).reshape(len(rows), n)


def pieces(run: str) -> set[str]:
    """What a run of over LONGEST characters is read by: its parts between punctuation, and pieces that overlap."""
    out = {x for x in re.split(r"[\W_]+", run) if 3 <= len(x) <= LONGEST}
    for size, stride in PIECES:
        if len(run) > size:
            out.update(run[at : at + size] for at in range(0, len(run) - size, stride))
            out.add(run[-size:])
    return out


def read_units(flat: pa.Array, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words that texts are read by, and the text of each."""
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    sizes = pc.utf8_length(flat).to_numpy()
    more: list[str] = []
    of: list[int] = []
    far = np.flatnonzero(sizes > LONGEST)
    for i, word in zip(far.tolist(), flat.take(pa.array(far)).to_pylist(), strict=True):
        new = pieces(word)
        more += new
        of += [int(rows[i])] * len(new)
    # runs of two or more words of one or two characters
    small = np.concatenate([[False], sizes <= 2, [False]])
    tiny = np.flatnonzero(small[1:-1])
    if len(tiny):
        new = (~small[tiny]) | np.concatenate([[True], rows[tiny[1:]] != rows[tiny[:-1]]])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(tiny)))
        words = flat.take(pa.array(tiny)).to_pylist()
        for at, n in zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            run = "".join(words[at : at + n])
            if len(run) >= 3:
                found = pieces(run) if len(run) > PIECES[-1][0] else set()
                if len(run) <= LONGEST:
                    found.add(run)
                more += found
                of += [int(rows[tiny[at]])] * len(found)
    near = sizes <= LONGEST
    units = pa.concat_arrays([flat.filter(pa.array(near)), pa.array(more, flat.type)])
    return units, np.concatenate([rows[near], np.array(of, rows.dtype)])


class Landmarks:
    """Kernels of words with a fixed list of words.

    The subsequences that the landmarks hold are numbered; a word's kernels are sums over its own triples of
    places. A weighted sum of the kernels needs one number for each subsequence (see `weighted`).
    """

    def __init__(self, words: list[str]):
        codes = [c[0] for w in words for _, c in _by_length([w])]
        used = np.unique(np.concatenate([*codes, np.zeros(1, np.int32)]))
        self.letter = np.zeros(_ALPHABET, np.int64)  # 0: no landmark holds it
        self.letter[used[used > 0]] = np.arange(1, (used > 0).sum() + 1)
        self.size = int((used > 0).sum()) + 1
        keys, weights, of = [], [], []
        for k, c in enumerate(codes):
            c = self.letter[c]
            for i, j, m in _triples(len(c)):
                keys.append((c[i] * self.size + c[j]) * self.size + c[m]), weights.append(DECAY ** (m - i + 1)), of.append(k)
        known, slot = np.unique(np.array(keys, np.int64), return_inverse=True)
        self.slot = np.zeros(self.size**3, np.int32)  # 0: no landmark holds it
        self.slot[known] = np.arange(1, len(known) + 1)
        self.features = np.zeros((len(known) + 1, len(words)), np.float32)
        np.add.at(self.features, (slot + 1, np.array(of, np.int64)), np.array(weights, np.float32))
        self.features /= np.sqrt(np.maximum(np.einsum("ij,ij->j", self.features, self.features), 1e-12))

    def kernel(self, words: list[str]) -> np.ndarray:
        """Normalised kernels (word, landmark); 0 where a word has no subsequence of three characters."""
        return np.minimum(self._sums(words, self.slot, self.features), 1)

    def weighted(self, weights: np.ndarray) -> np.ndarray:
        """A number for each subsequence, of which `total` makes the weighted sums of kernels."""
        return (self.features @ weights).astype(np.float32)[self.slot]

    def total(self, words: list[str], table: np.ndarray) -> np.ndarray:
        return self._sums(words, None, table)

    def _sums(self, words: list[str], slot: np.ndarray | None, table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), *table.shape[1:]), np.float32)
        for rows, codes in _by_length(words):
            n = codes.shape[1]
            if n < 3:
                continue
            c = np.ascontiguousarray(self.letter[codes].T)
            for first in range(n - 2):
                for second in range(first + 1, n - 1):
                    pair = (c[first] * self.size + c[second]) * self.size
                    live = np.flatnonzero((c[first] > 0) & (c[second] > 0))
                    if not len(live):
                        continue
                    for third in range(second + 1, n):
                        key = pair[live] + c[third][live]
                        out[rows[live]] += table[key if slot is None else slot[key]] * np.float32(DECAY ** (third - first + 1))
            own = np.sqrt(np.maximum(_self_kernel(codes), 1e-12))
            out[rows] /= own.reshape(-1, *[1] * (table.ndim - 1))
        return out


def _triples(n: int) -> list[tuple[int, int, int]]:
    return [(i, j, k) for i in range(n - 2) for j in range(i + 1, n - 1) for k in range(j + 1, n)]


def _self_kernel(codes: np.ndarray) -> np.ndarray:
    """Each word's kernel with itself."""
    n, size = codes.shape
    span = np.where(np.arange(size)[:, None] <= np.arange(size), DECAY ** np.abs(np.arange(size)[:, None] - np.arange(size)), 0).astype(np.float32)
    one, two, total = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32), np.zeros(n, np.float32)
    for i in range(size):
        hit = (codes == codes[:, i : i + 1]) * np.float32(DECAY**2)
        if i >= 2:
            total += (hit[:, 1:] * two[:, :-1]).sum(1)
        if i >= 1:
            step = hit.copy()
            step[:, 1:] *= one[:, :-1]
            step[:, 0] = 0
            two *= np.float32(DECAY)
            two += step @ span
        one *= np.float32(DECAY)
        one += hit @ span
    return total


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine by Newton's method on the weighted squared hinge loss; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = weight / weight.sum()
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-9
    w, active = np.zeros(x.shape[1]), np.ones(len(x), bool)
    for _ in range(steps):
        own = x[active] * share[active][:, None]
        new = np.linalg.solve(own.T @ x[active] + ridge, own.T @ y[active])
        w = new if active.all() else (w + new) / 2 if _ > 10 else new
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def _medoids(words: list[str], gain: np.ndarray, most: int) -> list[str]:
    """Words that stand for the others: each next one adds most to the gain-weighted sum of likenesses."""
    kernel = Landmarks(words).kernel(words)
    near, chosen = np.zeros(len(words)), []
    for _ in range(min(most, len(words))):
        added = gain @ np.maximum(kernel - near[:, None], 0)
        added[chosen] = -1
        chosen.append(int(added.argmax()))
        near = np.maximum(near, kernel[:, chosen[-1]])
    return [words[i] for i in chosen]


class Model:
    """Margins of words and scores of texts."""

    def __init__(self, landmarks: Landmarks, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0, constant: float | None = None):
        self.landmarks, self.weights, self.bias, self.slope, self.shift, self.constant = landmarks, weights, bias, slope, shift, constant
        self.table = landmarks.weighted(weights) if landmarks else None

    def margins(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.empty(0, np.float32)
        return np.clip(self.landmarks.total(words, self.table) + np.float32(self.bias), -1.5, 1.5)

    def score(self, margin: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(margin), self.constant)
        return 1 / (1 + np.exp(-(self.slope * np.asarray(margin, np.float64) + self.shift)))


def fit(texts: list[str], labels: np.ndarray, rounds: int = 4) -> Model:
    """The machine from texts and their 0/1 labels."""
    toxic = labels == 1
    if not toxic.any() or toxic.all():
        return Model(None, None, 0.0, constant=float(toxic.mean()) if len(labels) else 0.0)
    # a few texts at a time, so that only distinct words and which text has which are held of all
    known: dict[str, int] = {}
    some: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(texts), 500):
        flat, of = read_units(*split(pa.array(texts[at : at + 500], pa.string())))
        coded = flat.dictionary_encode()
        own = np.fromiter((known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
        pairs = np.unique(of * max(1, len(own)) + coded.indices.to_numpy())
        some.append(((pairs // max(1, len(own)) + at).astype(np.int32), own[pairs % max(1, len(own))]))
    words, (rows, codes) = list(known), map(np.concatenate, zip(*some, strict=True))
    del known, some
    bad = np.bincount(codes[toxic[rows]], minlength=len(words))
    good = np.bincount(codes[~toxic[rows]], minlength=len(words))
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((good + 0.5) / ((~toxic).sum() + 1))
    # twice the gain in log-likelihood from a rate of its own in toxic texts
    base, both = toxic.mean(), bad + good
    gain = 2 * (_xlogx(bad / both, base) + _xlogx(good / both, 1 - base)) * both
    ranked = np.lexsort((np.array(words, object), -np.where(odds > 1, gain, 0)))
    sure = [i for i in ranked[:400] if odds[i] > 1 and gain[i] >= SURE] or [i for i in ranked[:10] if odds[i] > 0]
    fits = lambda i: 3 <= len(words[i]) <= LANDMARK_LONGEST
    marked = [i for i in sure if fits(i)]
    common = [i for i in np.lexsort((np.array(words, object), -good))[:1500] if odds[i] < 0.5 and fits(i)][:400]
    if not marked or not common:
        return Model(None, None, 0.0, constant=float(toxic.mean()))
    marks = _medoids([words[i] for i in marked], gain[marked], TOXIC_LANDMARKS) + _medoids([words[i] for i in common], np.sqrt(good[common]), OTHER_LANDMARKS)
    landmarks = Landmarks(marks)
    values, vectors = np.linalg.eigh(landmarks.kernel(marks).astype(np.float64))
    use = values > 1e-6 * values[-1]
    whiten = vectors[:, use] / np.sqrt(values[use])
    # clean words: the commonest, and a sixteenth of the others by a hash
    usual = [i for i in np.argsort(-good, kind="stable")[:4000] if good[i] and odds[i] < 0.5]
    negative = sorted({*usual, *(i for i in np.flatnonzero((good > 0) & (odds < 1)) if hash_of(words[i]) % 16 == 0)})
    positive = list(sure)
    model, ill = None, np.flatnonzero(toxic[rows])
    for _ in range(rounds):
        ids = np.array([*positive, *negative])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.concatenate([np.sqrt(bad[positive] + 1.0) / np.sqrt(bad[positive] + 1.0).sum(), 8 * np.sqrt(good[negative] + 1.0) / np.sqrt(good[negative] + 1.0).sum()])
        w, b = _svm(landmarks.kernel([words[i] for i in ids]) @ whiten, y, weight)
        model = Model(landmarks, (whiten @ w).astype(np.float32), b)
        margin = model.margins(words)
        worst: Counter = Counter()
        of, at = rows[ill], codes[ill]
        order = np.lexsort((-margin[at], of))
        place = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        for c in at[order[place < WITNESSES]].tolist():
            if margin[c] > 0 and odds[c] > 1:
                worst[c] += 1
        # clean texts' worst words come in as negatives
        hard = {int(c) for c in codes[(margin[codes] > -0.5) & ~toxic[rows]] if odds[c] < 1}
        positive, negative = sorted({*positive, *worst}), sorted({*negative, *hard} - {*worst})
    top = np.full(len(texts), -1.5)
    np.maximum.at(top, rows, margin[codes])
    w, b = _logistic(top, toxic)
    return Model(landmarks, model.weights, model.bias, w, b)


def _xlogx(p: np.ndarray, q: float) -> np.ndarray:
    return np.where(p > 0, p * np.log(np.maximum(p, 1e-300) / q), 0)


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode())


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(y) by Newton's method with a small ridge; classes weigh alike."""
    a = np.stack([x, np.ones(len(x))], 1)
    share = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (share * (p - y)) + 1e-4 * w
        w = w - np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2), grad)
    return float(w[0]), float(w[1])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2500, -1):
            flat, bounds = split(batch.column(batch.num_columns - 1))
            top = np.full(batch.num_rows, -1.5, np.float32)
            if model.constant is None and len(flat):
                units, rows = read_units(flat, bounds)
                coded = units.dictionary_encode()
                np.maximum.at(top, rows, model.margins(coded.dictionary.to_pylist())[coded.indices.to_numpy()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(top), pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    size = 0
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            size += len(text)
            if size <= MOST_CHARACTERS or not texts:
                texts.append(text), labels.append(label)
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, np.array(labels, int)))], pa.binary())], ["model"])


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_TEXTS) -> Model:
    """Fit on `most` labelled texts at most; docs (doc_id, text), labels (doc_id, toxic)."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # the keys are drawn before the texts are read
    drawn = marks.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= MOST_OF_ONE).join(drawn, "doc_id").select("text", "toxic")
    # the sample is fitted in one task; the driver gets the model alone
    got = rows.orderBy(F.xxhash64("text"), "text").limit(most).mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([], np.empty(0, int))


def score(docs: DataFrame, model: Model, keep: list[Column | str]) -> DataFrame:
    rows = docs.select(*keep, F.col("text").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_score(model), f"{kinds}, score double")


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = F.coalesce(fold(5) == 0, F.lit(False))
    model = learn(docs, labels.where(~out))
    got = score(docs, model, ["doc_id", out.alias("held_out")])
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
