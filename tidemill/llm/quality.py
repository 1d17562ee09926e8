"""A document quality classifier: random-indexing word vectors, a two-layer network and calibrated probabilities.

Random indexing gives every word a sparse random index vector of -1, 0 and 1 that a hash of the word fixes, so no
table of them is needed. A word's vector is the sum of the index vectors of the words that stand up to ``WINDOW`` places
beside its occurrences in the sample, each by the logarithm of how often it does, scaled to length 1. Vectors are kept
in a table of ``WORD_ROWS`` rows that words are hashed to, so there is no vocabulary: every word of the sample is
learned, and words that share a row share its vector. A word whose row is empty has the vector of its class, its kinds
of characters (``shape``), which is learned in the same way from all words of the class in ``CLASS_ROWS`` rows; a class
whose row is empty has its own index vector.

A document is pooled from the vectors of all its words: their mean, their deviation from it, and their deviation from
one word to the next. A network of two layers gives a logit, which a temperature fitted on rows kept apart divides.
A run of characters without white space that is longer than ``PIECE`` counts as consecutive words of that length.

The model is fitted on at most ``sample_rows`` labelled rows (chosen by a hash of the id), whole texts of any length
among them. Executors count neighbours and pool the sample's texts, a stretch of words at a time; the driver gets the
tables of vectors and a vector for each row of the sample, and no text. Scoring takes every word of every text. Labels,
ids, languages and sources are no inputs of a score.

Defined results: null and wordless texts are the zero vector, both in the sample and when scored; null ids are never
learned from and are not held out; of several texts of a labelled id the least is learned from, of its labels the mean,
halves as 1; with no usable labels, or with those of one class alone, every score is the share of label 1 (one half
without labels); repeated rows stay. Extra columns may have any name and are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Kept, drop_spool, fresh, spool

DIM, NONZERO, WINDOW, PIECE = 96, 6, 2, 64
WORD_ROWS, CLASS_ROWS = 1 << 15, 1 << 13
#: Words of a stretch whose neighbours are counted together.
STRETCH = 40_000
_CLASSES = ((re.compile(r"[a-z]"), "a"), (re.compile(r"[A-Z]"), "A"), (re.compile(r"[0-9]"), "0"), (re.compile(r"[^\x00-\x7f]"), "é"))
_REPEATED = re.compile(r"(.)\1+")


def words_of(text: str | None) -> list[str]:
    """All of a text, between white space; longer runs than ``PIECE`` in pieces."""
    words = text.split() if text else []
    if len(max(words, key=len, default="")) <= PIECE:
        return words
    return [w[at : at + PIECE] for w in words for at in range(0, len(w), PIECE)]


def shape(word: str) -> str:
    """The word's kinds of characters, runs written once: ``Word,`` is ``Aa,``."""
    for pattern, letter in _CLASSES:
        word = pattern.sub(letter, word)
    return _REPEATED.sub(r"\1", word)


def code(word: str) -> int:
    """60 bits of a hash of the word: they fix its row and its index vector."""
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 4


def index_vectors(codes: np.ndarray) -> np.ndarray:
    """The sparse random vectors of words' codes, a row each: a 1 or -1 in each ``NONZERO``-th of the places, by ten bits each."""
    bits = np.asarray(codes, np.int64)[:, None] >> (10 * np.arange(NONZERO)) & 1023
    part = DIM // NONZERO
    out = np.zeros((len(bits), DIM), np.float32)
    out[np.arange(len(bits))[:, None], np.arange(NONZERO) * part + bits % part] = np.where(bits // part & 1, 1, -1)
    return out


def index_vector(word: str) -> np.ndarray:
    return index_vectors(np.array([code(word)]))[0]


def word_row(code_: int) -> int:
    return code_ % WORD_ROWS


def class_row(code_: int) -> int:
    """The row of a class, after those of words."""
    return WORD_ROWS + code_ % CLASS_ROWS


def unit_rows(table: np.ndarray) -> np.ndarray:
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


def unit_table(table: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """``unit_rows`` in single precision, some rows at a time, so that the driver holds no further table of doubles."""
    out = np.empty(table.shape, np.float32)
    for at in range(0, len(table), at_once):
        out[at : at + at_once] = unit_rows(table[at : at + at_once])
    return out


@dataclass
class WordVectors:
    """The rows of words, then those of classes; a row of zeros is empty."""

    table: np.ndarray
    _known: Kept = field(default_factory=lambda: Kept(60_000), repr=False)
    _filled: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"table": self.table}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def row(self, word: str) -> int:
        """The row of a word or of its class in the table; -1 and less where both are empty, then -1 - row of the class's code."""
        found = self._known.get(word)
        if found is None:
            if self._filled is None:
                self._filled = self.table.any(axis=1)
            found = word_row(code(word))
            if not self._filled[found]:
                of_class = code(shape(word))
                found = class_row(of_class)
                if not self._filled[found]:
                    found = -1 - of_class
            if len(word) <= 40:
                self._known.put(word, found)
        return found

    def vectors(self, words: list[str]) -> np.ndarray:
        """The vectors of words, a row each."""
        rows = np.array([self.row(w) for w in words], np.int64)
        out = self.table[np.maximum(rows, 0)]
        empty = np.flatnonzero(rows < 0)
        if len(empty):
            out[empty] = unit_rows(index_vectors(-1 - rows[empty]))
        return out

    def pooled(self, text: str | None) -> np.ndarray:
        """Mean, deviation and step deviation of the vectors of all of a text's words."""
        words = words_of(text)
        total, squares, steps, last = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM), None
        for at in range(0, len(words), 4096):  # bounded memory for very long texts
            part = self.vectors(words[at : at + 4096])
            total += part.sum(axis=0)
            squares += np.einsum("ij,ij->j", part, part)
            step = np.diff(part, axis=0, prepend=part[:1] if last is None else last)
            steps += np.einsum("ij,ij->j", step, step)
            last = part[-1:]
        n = max(len(words), 1)
        mean = total / n
        return np.concatenate([mean, np.sqrt(np.maximum(squares / n - mean**2, 0)), np.sqrt(steps / max(n - 1, 1))]).astype(np.float32)


def neighbour_counts(texts: Iterable[str | None]) -> Iterator[pa.RecordBatch]:
    """(row, beside, n): how often the words of a row, or those of a class's row, have a word of that code beside them.

    Counts are of stretches of ``STRETCH`` words at most; they add up to those of all texts.
    """
    known: Kept = Kept(30_000)

    def rows_of(word: str) -> tuple[int, int, int]:
        found = known.get(word)
        if found is None:
            own = code(word)
            found = (own, word_row(own), class_row(code(shape(word))))
            known.put(word, found)
        return found

    codes, rows, classes, document, at = [], [], [], [], 0

    def counted() -> pa.RecordBatch:
        c, w, k, d = (np.array(x, np.int64) for x in (codes, rows, classes, document))
        of, beside = [], []
        for gap in range(1, WINDOW + 1):
            together = np.flatnonzero(d[gap:] == d[:-gap])
            for own in (w, k):
                of += [own[together], own[together + gap]]
                beside += [c[together + gap], c[together]]
        table = pa.table({"row": np.concatenate(of), "beside": np.concatenate(beside)})
        found = table.group_by(["row", "beside"]).aggregate([([], "count_all")]).combine_chunks()
        return pa.RecordBatch.from_arrays([_chunk(found.column(c)) for c in ("row", "beside", "count_all")], ["row", "beside", "n"])

    for text in texts:
        words = words_of(text)
        for start in range(0, len(words), STRETCH):
            found = [rows_of(w) for w in words[start : start + STRETCH]]
            codes += [x[0] for x in found]
            rows += [x[1] for x in found]
            classes += [x[2] for x in found]
            document += [at] * len(found)
            at += 1
            if start + STRETCH < len(words):
                yield _seam(words, start + STRETCH, rows_of)
            if len(codes) >= STRETCH:
                yield counted()
                codes, rows, classes, document = [], [], [], []
    if codes:
        yield counted()


def _chunk(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) and column.num_chunks != 1 else column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _seam(words: list[str], at: int, rows_of: Callable[[str], tuple[int, int, int]]) -> pa.RecordBatch:
    """The pairs of a text's words across a place in it."""
    out = []
    for left in range(max(0, at - WINDOW), at):
        for right in range(at, min(len(words), left + WINDOW + 1)):
            a, b = rows_of(words[left]), rows_of(words[right])
            out += [(a[1], b[0]), (a[2], b[0]), (b[1], a[0]), (b[2], a[0])]
    return pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([c for _, c in out], pa.int64()), pa.array([1] * len(out), pa.int64())], ["row", "beside", "n"])


def row_sums(batches: Iterable[pa.RecordBatch], at_once: int = 4_000) -> Iterator[pa.RecordBatch]:
    """(row, vector): parts of rows' sums of log(1 + n) times the index vectors beside them, from batches sorted by row."""
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            rows, beside, n = (batch.column(k).slice(start, at_once).to_numpy() for k in range(3))
            starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            sums = np.add.reduceat(index_vectors(beside) * np.log1p(n)[:, None], starts, axis=0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[starts]), pa.array([v.tobytes() for v in sums], pa.binary())], ["row", "vector"])


def learn_vectors(texts: DataFrame) -> WordVectors:
    """Random indexing over a table's column ``text``: its neighbours are counted and summed by executors.

    The driver gets the tables' rows, of which there are ``WORD_ROWS`` + ``CLASS_ROWS`` whatever the texts, and a row's parts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from neighbour_counts(t for b in batches for t in b.column(0).to_pylist())

    parts = max(16, texts.sparkSession.sparkContext.defaultParallelism)
    pairs = texts.select("text").repartition(parts).mapInArrow(count, "row long, beside long, n long")
    # A class may have most words beside it, so its pairs are dealt over all parts; a word's are one part's.
    spread = F.when(F.col("row") >= WORD_ROWS, F.pmod("beside", F.lit(parts))).otherwise(0)
    pairs = pairs.withColumn("spread", spread).repartition(parts, "row", "spread").groupBy("row", "spread", "beside").agg(F.sum("n").alias("n"))
    pairs = pairs.select("row", "beside", "n").sortWithinPartitions("row", "beside")
    table = np.zeros((WORD_ROWS + CLASS_ROWS, DIM), np.float64)
    found = pairs.mapInArrow(row_sums, "row long, vector binary").toArrow()
    for row, vector in zip(found.column(0).to_pylist(), found.column(1), strict=True):
        table[row] += np.frombuffer(vector.as_buffer(), np.float64)
    del found
    return WordVectors(unit_table(table))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return (hidden @ self.w2 + self.b2) / self.temperature


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, np.float64)))


def train(x: np.ndarray, y: np.ndarray, *, hidden: int = 24, epochs: int = 120, rate: float = 0.01, decay: float = 1e-3, seed: int = 11) -> Network:
    """Two layers by Adam on the log loss; every fifth row is kept apart for the temperature."""
    rng = np.random.Generator(np.random.PCG64(seed))
    apart = np.arange(len(x)) % 5 == 4
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        apart[:] = False
    xt, yt = x[~apart].astype(np.float64), y[~apart].astype(np.float64)
    net = Network(xt.mean(axis=0), xt.std(axis=0) + 1e-3, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    xt = (xt - net.mean) / net.scale
    params = {"w1": net.w1, "b1": net.b1, "w2": net.w2, "b2": np.zeros(1)}
    m, v, step = {k: np.zeros_like(p) for k, p in params.items()}, {k: np.zeros_like(p) for k, p in params.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(xt))
        for at in range(0, len(order), 128):
            rows = order[at : at + 128]
            a = np.tanh(xt[rows] @ params["w1"] + params["b1"])
            error = (sigmoid(a @ params["w2"] + params["b2"]) - yt[rows]) / len(rows)
            back = error[:, None] * params["w2"][None, :] * (1 - a * a)
            grads = {"w2": a.T @ error + decay * params["w2"], "b2": np.array([error.sum()]), "w1": xt[rows].T @ back + decay * params["w1"], "b1": back.sum(axis=0)}
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params["w1"], params["b1"], params["w2"], float(params["b2"][0])
    if apart.any():
        z, t = net.logits(x[apart]), y[apart].astype(np.float64)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
        loss = [np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class QualityModel:
    vectors: WordVectors | None
    network: Network | None
    share: float = 0.5

    def scores(self, texts) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        if not len(texts):
            return np.zeros(0)
        return sigmoid(self.network.logits(np.stack([self.vectors.pooled(t) for t in texts])))


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, sample_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, y) of at most ``sample_rows`` labelled rows that are not held out, the same on every run."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter("id is not null and y is not null").filter(~held_out(F.col("id")))
    one = usable.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    chosen = F.broadcast(one.orderBy(F.xxhash64("id"), "id").limit(sample_rows))  # sample_rows rows of two numbers
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    return spool(rows, "quality-sample")


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """The model of a sample of at most ``sample_rows`` labelled rows."""
    sample = labelled_sample(docs, labels, sample_rows=sample_rows, id_col=id_col, text_col=text_col, label_col=label_col)
    found = sample.agg(F.min("y").alias("least"), F.max("y").alias("most"), F.avg("y").alias("share")).first()
    model = QualityModel(None, None, 0.5 if found["share"] is None else found["share"])
    if found["least"] != found["most"]:
        vectors = learn_vectors(sample)
        shared = docs.sparkSession.sparkContext.broadcast(vectors)

        def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    rows = [shared.value.pooled(t).tobytes() for t in part.column(2).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.binary())], ["h", "y", "x"])

        parts = max(16, docs.sparkSession.sparkContext.defaultParallelism)
        pooled = sample.repartition(parts, "id").select(F.xxhash64("id").alias("h"), "y", "text").mapInArrow(pool, "h long, y int, x binary").collect()  # sample_rows rows of 3 * DIM numbers
        pooled.sort(key=lambda r: (r["h"], r["y"], bytes(r["x"])))
        x = np.stack([np.frombuffer(r["x"], np.float32) for r in pooled])
        model = QualityModel(vectors, train(x, np.array([r["y"] for r in pooled])), found["share"])
        shared.destroy()
    drop_spool(sample)
    return model


def scorer(docs: DataFrame, model: QualityModel) -> Callable[[Column], Column]:
    """A column function for scores; the model is broadcast, its size is that of the tables of rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [shared.value.scores([t.as_py() for t in texts.slice(at, 64)]) for at in range(0, len(texts), 64)]
        return pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())

    return score


def score_documents(docs: DataFrame, labels: DataFrame, *, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, held_out, score and predicted (1 where the score is at least ``least``) for each document."""
    score = scorer(docs, fit(docs, labels, id_col=id_col, text_col=text_col, **how))
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents whose score is at least ``least``, with all their columns."""
    score, (found,) = scorer(docs, fit(docs, labels, id_col=id_col, text_col=text_col, **how)), fresh(docs, "score")
    return docs.withColumn(found, score(F.col(text_col))).filter(F.col(found) >= least).select(*docs.columns)
