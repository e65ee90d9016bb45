"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its hashed character n-grams, a window the
mean of its words, and a linear softmax over that mean gives the two classes;
vectors and softmax are trained jointly in numpy.  A misspelling never seen in
training shares most of its n-grams with the word it stands for.

A few toxic words in a long text vanish in the mean of the whole text, so a text
is scored window by window and its score is that of its worst window.  Training
follows: in each round a toxic text brings its worst window under the model so
far (in the first round its most telling word, by counts of the texts that hold
its n-grams), a clean text its worst window and another.  A word
repeated in a row counts once, so spam of one word is no evidence.

Since the model is linear after the mean, all that scoring needs is one number
per n-gram bucket (256 KiB for all), which is sent to the executors.

Training reads a bounded sample of the labelled rows, ``TRAIN_DOCS`` per class in
the order of a hash of the id, each text in full.  It runs in one task over that sample,
so neither its texts nor its arrays reach the driver, and the task is repeated if its
executor is lost.  Scoring reads every text in full.

Defined results: null counts as empty and scores 0; rows with the same id are
scored each on their own; of several labels of an id the largest counts, null
labels do not; if the labels lack a class, the score of all texts is the share of
toxic ones (0 without labels); an empty table gives an empty result; a null id
counts as held in (not held out); further columns are ignored unless carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import hash_sample, map_slices, small_batches, stored, table, text_of

BUCKETS = 1 << 16
DIM = 16
GRAMS = (3, 4, 5)
WINDOW = 4
TRAIN_DOCS = 1500
ROUNDS = 4
STEPS = 300
FOLDS = 3
RATE = 0.15
THRESHOLD = 0.7
#: Scores of words that a worker keeps from one slice of texts to the next.
CACHE_WORDS = 150_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Lower-case words; a word repeated in a row counts once."""
    return [w for w, _ in groupby(_WORD.findall(text.lower()))]


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all words, ends marked, as one array; each word's first place
    and, of each letter, how many are left in its word (itself included)."""
    letters = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    first = np.r_[0, np.cumsum(sizes)]
    return letters, first, np.repeat(first[1:], sizes) - np.arange(len(letters))


_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX + np.uint64(salt)
    h = (h ^ (h >> np.uint64(32))) * _STEP
    return (h >> np.uint64(48)).astype(np.int64) % BUCKETS


def _gram_hashes(letters: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n letters from each place on."""
    h = np.zeros(max(0, len(letters) - n + 1), np.uint64)
    for k in range(n):
        h = h * _STEP + letters[k:k + len(h)] + np.uint64(1)
    return _bucket(h, n)


def _whole_hashes(letters: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bucket of each word as a whole."""
    place = np.arange(len(letters)) - np.repeat(first[:-1], np.diff(first))
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(np.diff(first).max()), _STEP | np.uint64(1))])
    return _bucket(np.add.reduceat(letters * powers[place], first[:-1]), 0)


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words' n-grams and of the words themselves, word by word,
    and where each word's begin."""
    letters, first, left = _letters(words)
    word_of = np.repeat(np.arange(len(words)), np.diff(first))
    owner, bucket = [np.arange(len(words))], [_whole_hashes(letters, first)]
    for n in GRAMS:
        inside = np.flatnonzero(left >= n)
        owner.append(word_of[inside])
        bucket.append(_gram_hashes(letters, n)[inside])
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    return bucket[np.argsort(owner, kind="stable")], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]


def mean_values(values: np.ndarray, words: list[str]) -> np.ndarray:
    """The mean of ``values`` over each word's buckets."""
    letters, first, left = _letters(words)
    total, count = np.zeros(len(letters)), np.zeros(len(letters))
    for n in GRAMS:
        inside = left[:max(0, len(letters) - n + 1)] >= n
        total[:len(inside)] += np.where(inside, values[_gram_hashes(letters, n)], 0)
        count[:len(inside)] += inside
    return (np.add.reduceat(total, first[:-1]) + values[_whole_hashes(letters, first)]) / (
        np.add.reduceat(count, first[:-1]) + 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class _Adagrad:
    def __init__(self, value: np.ndarray):
        self.value, self.sum = value, np.full(value.shape, 1e-8, np.float32)

    def step(self, grad: np.ndarray, at=slice(None)) -> None:
        self.sum[at] += grad * grad
        self.value[at] -= RATE * grad / np.sqrt(self.sum[at])


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(rows[order], starts)


class Sample:
    """Training texts as arrays of word numbers, and the buckets of the words."""

    def __init__(self, texts: list[np.ndarray], words: list[str], toxic: np.ndarray):
        self.texts, self.toxic = texts, toxic
        self.grams, self.first = gram_buckets(words)


class _Trainer:
    """Vectors and softmax over some texts of a sample."""

    def __init__(self, sample: Sample, some: np.ndarray, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.texts, self.toxic = [sample.texts[i] for i in some], sample.toxic[some]
        self.grams, self.first = sample.grams, sample.first
        self.vectors = _Adagrad(self.rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM)
        self.softmax = _Adagrad(np.zeros((DIM + 1, 2), np.float32))

    def contributions(self) -> np.ndarray:
        """What each bucket adds to the toxic log-odds of a text."""
        w = self.softmax.value
        return self.vectors.value @ (w[:DIM, 1] - w[:DIM, 0])

    def bias(self) -> float:
        w = self.softmax.value
        return float(w[DIM, 1] - w[DIM, 0])

    def word_scores(self) -> np.ndarray:
        return np.add.reduceat(self.contributions()[self.grams], self.first[:-1]) / np.diff(self.first)

    def batch(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        """One step on windows (arrays of word numbers) and their labels."""
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate(rows)
        distinct, inverse = np.unique(flat, return_inverse=True)
        counts = np.diff(self.first)[distinct]
        starts = np.r_[0, np.cumsum(counts)]
        at = self.grams[np.repeat(self.first[distinct] - starts[:-1], counts) + np.arange(starts[-1])]
        word = np.add.reduceat(self.vectors.value[at], starts[:-1]) / counts[:, None]
        ends = np.r_[0, np.cumsum(sizes)]
        hidden = np.add.reduceat(word[inverse], ends[:-1]) / sizes[:, None]
        hidden = np.c_[hidden, np.ones(len(rows), np.float32)].astype(np.float32)
        logits = hidden @ self.softmax.value
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), labels] -= 1
        p /= len(rows)
        back = (p @ self.softmax.value[:DIM].T / sizes[:, None]).astype(np.float32)
        self.softmax.step(hidden.T @ p)
        _, per_word = _summed(inverse, np.repeat(back, sizes, axis=0))
        buckets, grad = _summed(at, np.repeat(per_word / counts[:, None], counts, axis=0))
        self.vectors.step(grad.astype(np.float32), buckets)

    def steps(self, rows: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, size: int = 64) -> None:
        """Batches of half toxic, half clean rows, drawn in shuffled rounds."""
        by = [np.flatnonzero(labels == k) for k in (0, 1)]
        order = [np.concatenate([self.rng.permutation(b) for _ in range(-(-steps * size // 2 // len(b)))]) for b in by]
        for i in range(0, steps * size // 2, size // 2):
            some = np.r_[order[0][i:i + size // 2], order[1][i:i + size // 2]]
            self.batch([rows[j] for j in some], labels[some])

    def telling_words(self) -> list[np.ndarray]:
        """Of each text, the word whose n-grams are the most telling of toxic
        texts, by the number of texts that hold them."""
        held = np.ones((2, BUCKETS))
        for t, y in zip(self.texts, self.toxic):
            words = np.unique(t)
            counts = self.first[words + 1] - self.first[words]
            starts = np.r_[0, np.cumsum(counts)]
            at = np.repeat(self.first[words] - starts[:-1], counts) + np.arange(starts[-1])
            held[y, np.unique(self.grams[at])] += 1
        share = held / (np.bincount(self.toxic, minlength=2)[:, None] + 2)
        odds = np.log(share[1] / share[0])
        scores = np.add.reduceat(odds[self.grams], self.first[:-1]) / np.diff(self.first)
        out = []
        for t in self.texts:
            at = int(np.argmax(scores[t]))
            out.append(t[at:at + 1])
        return out

    def worst_windows(self) -> list[np.ndarray]:
        scores = self.word_scores()
        out = []
        for t in self.texts:
            if len(t) > WINDOW:
                sums = np.r_[0, np.cumsum(scores[t])]
                at = int(np.argmax(sums[WINDOW:] - sums[:-WINDOW]))
                t = t[at:at + WINDOW]
            out.append(t)
        return out

    def fit(self) -> None:
        clean = [t for t, y in zip(self.texts, self.toxic) if not y]
        mined: list[np.ndarray] = []
        for k in range(ROUNDS):
            worst = self.telling_words() if k == 0 else self.worst_windows()
            some = []
            for t in clean:
                at = int(self.rng.integers(0, max(1, len(t) - WINDOW + 1)))
                some.append(t[at:at + WINDOW])
            mined += [w for w, y in zip(worst, self.toxic) if not y]
            positive = [w for w, y in zip(worst, self.toxic) if y]
            rows = positive + mined + some
            self.steps(rows, np.r_[np.ones(len(positive), np.int64), np.zeros(len(mined) + len(some), np.int64)])


class Model:
    """One number per n-gram bucket and a bias; scores texts."""

    def __init__(self, buckets: np.ndarray | None, bias: float, constant: float = 0.0):
        self.buckets, self.bias, self.constant = buckets, bias, constant

    def __getstate__(self):
        return self.buckets, self.bias, self.constant

    def __setstate__(self, state):
        self.__init__(*state)

    def scorer(self):
        """A function from a list of texts to their scores, with a bounded cache of words."""
        buckets = None if self.buckets is None else self.buckets.astype(np.float64)
        known: dict[str, float] = {}

        def scores(texts: list[str]) -> list[float]:
            if buckets is None:
                return [self.constant if t else 0.0 for t in texts]
            cut = [words_of(t) for t in texts]
            new = list(set().union(*cut).difference(known)) if cut else []
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = list(set().union(*cut))
            # Of very many words some at a time, so that their n-grams stay few.
            for at in range(0, len(new), 20_000):
                some = new[at:at + 20_000]
                known.update(zip(some, mean_values(buckets, some).tolist()))
            out = []
            for words in cut:
                if not words:
                    out.append(0.0)
                    continue
                logit = worst_window(np.fromiter(map(known.__getitem__, words), np.float64, len(words))) + self.bias
                out.append(float(1.0 / (1.0 + np.exp(-max(-500.0, logit)))))
            return out

        return scores


def worst_window(values: np.ndarray) -> float:
    """The highest mean of ``WINDOW`` values in a row (of all, if fewer)."""
    if len(values) <= WINDOW:
        return float(values.mean())
    sums = np.r_[0.0, np.cumsum(values)]
    return float((sums[WINDOW:] - sums[:-WINDOW]).max()) / WINDOW


def _calibration(logits: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit, targets smoothed as in Platt's method."""
    n = np.bincount(toxic, minlength=2)
    target = np.where(toxic == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    x = np.c_[logits, np.ones(len(logits))]
    weight = np.where(toxic == 1, 0.5 / n[1], 0.5 / n[0]) * len(toxic)
    beta = np.array([0.1, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hessian, x.T @ (weight * (p - target)) + 1e-3 * beta), -1, 1)
    return max(float(beta[0]), 1e-3), float(beta[1])


def train(sample: Sample, folds: int = FOLDS) -> Model:
    """The mean of ``folds`` models, each trained without one part of the texts;
    the score is calibrated on the parts that were left out."""
    texts, toxic = sample.texts, sample.toxic
    part = np.zeros(len(texts), np.int64)
    for k in (0, 1):
        at = np.flatnonzero(toxic == k)
        part[at] = np.arange(len(at)) % folds
    if np.bincount(toxic, minlength=2).min() < 2 * folds:
        part[:], folds = -1, 1
    total, left = np.zeros(BUCKETS), np.zeros(len(texts))
    for f in range(folds):
        trainer = _Trainer(sample, np.flatnonzero(part != f), seed=f)
        trainer.fit()
        total += trainer.contributions() + trainer.bias()
        words = trainer.word_scores()
        for i in np.flatnonzero(part == f):
            left[i] = worst_window(words[texts[i]]) + trainer.bias()
    if folds == 1:
        return Model(total.astype(np.float32), 0.0)
    slope, intercept = _calibration(left, toxic)
    return Model((total * slope / folds).astype(np.float32), intercept)


def _training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                   train_docs: int) -> DataFrame:
    """The bounded sample, whole texts in one sorted partition: _text, _toxic."""
    ids = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic"))
        .where("_id is not null and _toxic is not null").where(~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    )
    ids = stored(ids, "labels")
    chosen = None
    for k in (0, 1):
        part = hash_sample(ids.where(F.col("_toxic") == k), F.col("_id"), train_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(F.col(text_col)).alias("_text"))
    rows = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))
    return rows.repartition(1).sortWithinPartitions(F.md5(F.col("_id").cast("string").cast("binary")), "_id").select(
        "_text", "_toxic")


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the sample -> one row with the model."""
    numbers: dict[str, int] = {}
    texts, toxic = [], []
    for batch in batches:
        for text, y in zip(*batch.columns):
            words = words_of(text.as_py())
            if words:
                texts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
                toxic.append(int(y.as_py() > 0))
    toxic = np.array(toxic, np.int64)
    if len(set(toxic.tolist())) < 2:
        model = Model(None, 0.0, float(toxic.mean()) if len(toxic) else 0.0)
    else:
        model = train(Sample(texts, list(numbers), toxic))
    buckets = None if model.buckets is None else model.buckets.tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([buckets], pa.binary()), pa.array([model.bias]), pa.array([model.constant])],
                                     names=["buckets", "bias", "constant"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> Model:
    """Train on the sample of labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    rows = _training_rows(docs, labels, id_col, text_col, label_col, train_docs)
    made = rows.mapInArrow(_train_task, "buckets binary, bias double, constant double").first()
    if made is None:  # no rows, so no partition had any
        return Model(None, 0.0, 0.0)
    return Model(None if made.buckets is None else np.frombuffer(made.buckets, np.float32), made.bias, made.constant)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    state = {}

    def per_slice(ids, texts):
        if "score" not in state:
            state["score"] = sent.value.scorer()
        return ids, state["score"](texts)

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs.select(F.col(id_col), text_of(F.col(text_col)).alias("text")), per_slice,
                      f"`{id_col}` {id_type}, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents scored under the threshold, with all their columns: the
    text is scored beside the row, so no join follows."""
    from pyspark.sql.functions import pandas_udf

    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    small_batches(docs.sparkSession)
    state = {}

    @pandas_udf("double")
    def score(texts):
        import pandas as pd

        if "score" not in state:
            state["score"] = sent.value.scorer()
        return pd.Series(state["score"](list(texts)), dtype="float64")

    return docs.where(score(text_of(F.col(text_col))) < THRESHOLD)


def op7_subword_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scores(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
