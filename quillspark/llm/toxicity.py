"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the sum of the embeddings of its hashed features (the word
and its first and last characters).  Filters of several widths run over the
words, max pooling keeps each filter's strongest window, and a linear layer
gives a logit.  Embeddings start from the features' log odds in the training
documents, filters read them, and all is then trained together by Adam.  Last,
each language gets a threshold on rows kept out of training, and its logits are
shifted so that its threshold scores the same 0.7 everywhere.  The language is
guessed from common words of the text, never read from a column.

The model is fitted on the driver on at most ``MAX_ROWS`` labelled rows of each
class; its size is bounded by that sample.  Scoring reads whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspark.llm.quality import COMMON_WORDS
from quillspark.llm.tokens import forget

MAX_ROWS, WIDTHS, FILTERS, DIM, MAX_FEATURES = 2500, (1, 2, 3), 6, 6, 50_000
ACCEPT = 0.7
_words = re.compile(r"\w+").findall


def features_of(word: str) -> list[int]:
    """Hashes of the word, its first four and its last four characters."""
    out = [word]
    if len(word) > 5:
        out += ["^" + word[:5], word[-5:] + "$"]
    return [xxhash.xxh64_intdigest(x) for x in out]


def words_of(text: str) -> list[str]:
    return _words(text.lower())


def guess_language(words: list[str]) -> str:
    """The language with most common words in the text; "" without any."""
    found = Counter(words)
    votes = {lang: sum(found[w] for w in common) for lang, common in COMMON_WORDS.items()}
    lang = max(votes, key=lambda k: (votes[k], k))
    return lang if votes[lang] else ""


class Model:
    """Weights, and scoring with a memory of words."""

    def __init__(self, hashes: np.ndarray, embeddings: np.ndarray, filters: dict[int, np.ndarray], bias: dict[int, np.ndarray], out: np.ndarray, out_bias: float, shifts: dict[str, float]):
        self.hashes, self.embeddings, self.filters, self.bias, self.out, self.out_bias, self.shifts = hashes, embeddings, filters, bias, out, out_bias, shifts

    def start(self) -> "Model":
        """Prepare scoring in a worker: what each word adds to each filter position is remembered."""
        self.row_of = {int(h): i for i, h in enumerate(self.hashes)}
        stacked = np.concatenate([self.filters[w][j] for w in WIDTHS for j in range(w)], 1)
        self.projected = (self.embeddings @ stacked).astype(np.float32)
        model = self

        class Memory(dict):
            def __missing__(memory, word):
                rows = tuple(r for r in map(model.row_of.get, features_of(word)) if r is not None)
                at = model.combined.get(rows)
                if at is None:
                    at = len(model.sums)
                    model.combined[rows] = at
                    model.sums.append(model.projected[list(rows)].sum(0) if rows else np.zeros(stacked.shape[1], np.float32))
                if len(memory) > 400_000:
                    memory.clear()
                memory[word] = at
                return at

        self.combined, self.sums = {(): 0}, [np.zeros(stacked.shape[1], np.float32)]
        self.memory, self.matrix = Memory(), np.zeros((0, stacked.shape[1]), np.float32)
        return self

    def logit(self, text: str) -> float:
        words = words_of(text)
        rows = np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words))
        if len(self.sums) > len(self.matrix):
            # Room to grow, so that a new word does not copy everything each time.
            self.matrix = np.concatenate([self.matrix, np.array(self.sums[len(self.matrix):])])
        pad = np.zeros(max(WIDTHS) - 1, np.int64)
        x = self.matrix[np.concatenate([pad, rows, pad])] if len(self.matrix) else np.zeros((0, 0))
        pooled, at = [], 0
        for w in WIDTHS:
            n = len(x) - w + 1
            total = self.bias[w] + sum(x[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS] for j in range(w))
            pooled.append(np.maximum(total.max(0), 0))
            at += w * FILTERS
        z = float(np.concatenate(pooled) @ self.out + self.out_bias)
        return z + self.shifts.get(guess_language(words), self.shifts[""])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -30, 30))))


def _forward(batch: list[np.ndarray], e: np.ndarray, f: dict, b: dict):
    """Pooled activations, and for each the window that won (position in the stacked batch)."""
    pad = max(WIDTHS) - 1
    x = np.concatenate([np.concatenate([np.zeros((pad, e.shape[1])), d, np.zeros((pad, e.shape[1]))]) for d in batch])
    ends = np.cumsum([len(d) + 2 * pad for d in batch])
    starts = np.concatenate([[0], ends[:-1]])
    pooled, won = [], []
    for w in WIDTHS:
        y = b[w] + sum(x[j : len(x) - w + 1 + j] @ f[w][j] for j in range(w))
        at = np.array([s + y[s : t - w + 1].argmax(0) for s, t in zip(starts, ends)])
        won.append(at)
        pooled.append(np.take_along_axis(y, at, 0))
    return x, starts + pad, pooled, won


def _vocabulary(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Word numbers of each text, the three feature hashes of each word (0 for none), and each text's language."""
    numbers: dict[str, int] = {}
    docs, langs = [], []
    for text in texts:
        words = words_of(text)
        docs.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        langs.append(guess_language(words))
    feats = np.zeros((len(numbers), 3), np.uint64)
    for i, word in enumerate(numbers):
        found = features_of(word)
        feats[i, : len(found)] = found
    return docs, feats, np.array(langs, str)


def train(texts: list[str], labels: np.ndarray, seed: int = 5, epochs: int = 6, rate: float = 0.02, batch_size: int = 64) -> Model:
    """Fit on ``texts``; every fifth row calibrates and is not trained on.  Needs no class to be present."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, float)
    held = np.arange(len(texts)) % 5 == 4
    docs, feats, langs = _vocabulary(texts)
    # Documents of each class that have a feature, by the features' sorted hashes.
    known, at = np.unique(feats, return_inverse=True)
    at = at.reshape(feats.shape)
    seen = np.zeros((2, len(known)))
    for i in np.flatnonzero(~held):
        seen[int(labels[i]), np.unique(at[np.unique(docs[i])])] += 1
    n_bad, n_good = max(1, int(labels[~held].sum())), max(1, int((1 - labels[~held]).sum()))
    # Log odds in units of their deviation; words that are rare in both classes say nothing.
    weight = (np.log((seen[1] + 0.5) / (n_bad + 1)) - np.log((seen[0] + 0.5) / (n_good + 1))) / np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    weight[(np.abs(weight) <= 2.5) | (seen.sum(0) == 0) | (known == 0)] = 0
    order = np.lexsort((known, -np.abs(weight)))
    order = order[weight[order] != 0][:MAX_FEATURES]
    kept = known[order]
    row = np.zeros(len(known), np.int64)
    row[order] = np.arange(1, len(order) + 1)
    e = rng.normal(0, 0.02, (len(kept) + 1, DIM))
    e[1:, 0] = np.clip(weight[order] / 4, -1.5, 1.5)
    e[0] = 0
    f = {w: rng.normal(0, 0.1, (w, DIM, FILTERS)) for w in WIDTHS}
    for w in WIDTHS:
        f[w][:, 0, : FILTERS // 2] += 1 / w
    b = {w: np.zeros(FILTERS) for w in WIDTHS}
    out, out_bias = rng.normal(0, 0.1, FILTERS * len(WIDTHS)), np.zeros(1)
    out.reshape(len(WIDTHS), FILTERS)[:, : FILTERS // 2] += 0.5
    out_bias -= 1
    # Each word's rows of the embedding table; 0 stands for features that are not kept.
    rows_of = row[at]
    flat = []
    for d in docs:
        ids = rows_of[d]
        where, which = np.nonzero(ids)
        flat.append((ids[where, which], where, len(d)))
    del feats, known, at, seen, weight, row, rows_of

    def embed(i: int) -> np.ndarray:
        ids, at, n = flat[i]
        x = np.zeros((n, DIM))
        np.add.at(x, at, e[ids])
        return x

    state: dict[str, list] = {}

    def adam(name: str, value: np.ndarray, grad: np.ndarray, step: int) -> None:
        m, v = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    step, order = 0, np.flatnonzero(~held)
    for _ in range(epochs):
        rng.shuffle(order)
        for part in (order[i : i + batch_size] for i in range(0, len(order), batch_size)):
            step += 1
            x, first, pooled, won = _forward([embed(i) for i in part], e, f, b)
            active = np.concatenate(pooled, 1)
            z = np.maximum(active, 0) @ out + out_bias
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            back = d[:, None] * out * (active > 0)
            grad_x = np.zeros_like(x)
            for k, w in enumerate(WIDTHS):
                g, at = back[:, k * FILTERS : (k + 1) * FILTERS], won[k]
                grad_f = np.zeros_like(f[w])
                for j in range(w):
                    window = x[at + j]
                    grad_f[j] = np.einsum("nfd,nf->df", window, g)
                    np.add.at(grad_x, at + j, g[:, :, None] * f[w][j].T[None])
                adam(f"f{w}", f[w], grad_f + 1e-4 * f[w], step)
                adam(f"b{w}", b[w], g.sum(0), step)
            adam("out", out, np.maximum(active, 0).T @ d + 1e-4 * out, step)
            adam("bias", out_bias, d.sum(keepdims=True), step)
            grad_e = np.zeros_like(e)
            for i, s in zip(part, first):
                ids, at, _ = flat[i]
                np.add.at(grad_e, ids, grad_x[s + at])
            adam("e", e, grad_e, step)
            e[0] = 0
    model = Model(kept, e[1:].astype(np.float32), f, b, out, float(out_bias[0]), {"": 0.0}).start()
    z = np.array([model.logit(t) for t in texts])
    # Languages with few positives share the overall threshold.
    enough = min(labels[held].sum(), (1 - labels[held]).sum()) >= 8
    model.shifts = {"": _shift(z[held], labels[held]) if enough else _shift(z, labels)}
    for lang in COMMON_WORDS:
        take = held & (langs == lang)
        if min(labels[take].sum(), (1 - labels[take]).sum()) >= 8:
            model.shifts[lang] = _shift(z[take], labels[take])
    return model


def _shift(z: np.ndarray, labels: np.ndarray) -> float:
    """What to add to a logit so that the threshold of best F1 scores ``ACCEPT``; the middle of the gap around it.

    Thresholds that would reject more than a twentieth of the clean rows are out.
    """
    target = np.log(ACCEPT / (1 - ACCEPT))
    if not len(z) or labels.min() == labels.max():
        return 0.0
    order = np.argsort(z)
    z, labels = z[order], labels[order]
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2])
    right = labels[::-1].cumsum()[::-1]
    f1 = 2 * right / (np.arange(len(z), 0, -1) + labels.sum())
    f1[cuts < np.quantile(z[labels == 0], 0.95)] = -1
    best = np.flatnonzero(f1 == f1.max())
    return float(target - cuts[best[len(best) // 2]])


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """Up to ``max_rows`` labelled texts of each class, by order of a hash of the id.

    Labels count if their crc32(doc_id as text) mod 3 is not 1.  Ids are chosen
    first, and texts of those alone reach the driver.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)).select("doc_id", "toxic").distinct()
    chosen = None
    for value in (0, 1):
        part = usable.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")).collect()
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["toxic"], r["text"]))
    return [r["text"] for r in rows], np.array([r["toxic"] for r in rows], float)


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "tx_score") -> DataFrame:
    """Every row and column of ``docs``, with the score of its whole text in ``name``."""
    weights = (model.hashes, model.embeddings, model.filters, model.bias, model.out, model.out_bias, model.shifts)
    docs = docs.drop(name)
    at = docs.columns.index(text_col)

    def run(batches: Iterable):
        import pyarrow as pa

        forget()
        scorer = Model(*weights).start()
        for batch in batches:
            scores = [scorer.score(text.as_py() or "") for text in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])
        # The scorer's memory refers to itself, and the worker lives on.
        del scorer
        forget()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and toxic (0, 1; others are ignored).  Null and empty
    texts score what a text without known words scores.  Null ids are never held
    out.  Rows repeated with one text score the same.  Without labels of both
    classes the model stays at its prior, below ``accept``.  Empty tables give
    empty results; other columns are ignored.
    """
    model = train(*training_rows(docs, labels, max_rows))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = with_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held.alias("held_out"), F.col("tx_score").alias("score"), (F.col("tx_score") >= accept).cast("int").alias("predicted"))
