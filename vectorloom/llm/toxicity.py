"""Toxicity by class-conditional Kneser-Ney models of words' spelling.

Each class (toxic, ordinary) has a character model of order 5 within words: P(c | h) discounts the class's own
counts of h c absolutely and gives what that frees to a backoff distribution P(c | h') which both classes share. The
shared one is an interpolated Kneser-Ney model whose continuation counts (in how many contexts an n-gram stands) come from
the whole corpus, labelled or not. So a rare or unseen expression is judged by its parts, and what neither class has
seen has the same backoff in both and cancels out.

A document's evidence is the log-likelihood ratio of its words, normalised by length: the mean over all words, the
best mean over any ``WINDOW`` consecutive words and the share of words beyond ``STRONG``. A ridge-penalised logistic
regression, fitted on labelled documents that the counts did not use, turns it into a score.

Sizes: class counts come from at most ``MAX_LABELLED`` labelled documents of each class (smallest hashes of the ids), so the
model that goes to the tasks (n-grams seen in a class) is bounded by that sample. Corpus-wide counts stay
distributed: words are counted in each task, summed by word, and their n-grams summed by n-gram; only the rows that the
labelled n-grams need are collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, Spool, map_arrow, per_text, quoted, raw_texts, words_of

ORDER = 5
DISCOUNT = 0.75
MAX_LABELLED = 10_000
WINDOW = 20
STRONG = 4.0
#: No word says more than this, so that no single one decides about a long text.
MOST = 8.0
RIDGE = 1e-2
#: Entries of a task's counter before it is sent on.
FLUSH = 200_000
WORDS_KEPT = 300_000
#: Sign of a word's start and end; no word has them.
START, END = "\x02", "\x03"


def folded(text: bytes) -> list[bytes]:
    """Words of the text in lower case, beyond ASCII too."""
    return words_of(text.decode("utf-8", "replace").lower().encode())


def grams(word: bytes) -> list[str]:
    """Each character of a word, and its end, with up to ORDER - 1 characters before it."""
    s = START + word.decode("utf-8", "replace") + END
    return [s[max(0, i + 1 - ORDER) : i + 1] for i in range(1, len(s))]


def _summed(counts: dict, key_type: pa.DataType) -> pa.RecordBatch:
    rows = list(counts.values())
    return pa.RecordBatch.from_arrays([pa.array(list(counts), key_type), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], names=["key", "n", "n0", "n1"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word; in how many documents it stands, of all, of the ordinary sample and of the toxic sample."""
    counts: dict[bytes, list[int]] = {}
    for b in batches:
        for text, toxic in zip(raw_texts(b.column(0)), b.column(1).to_pylist(), strict=True):
            for w in set(folded(text)):  # documents are counted, so that one that repeats itself says it once
                c = counts.get(w)
                if c is None:
                    c = counts[w] = [0, 0, 0]
                c[0] += 1
                if toxic is not None:
                    c[1 + toxic] += 1
        if len(counts) > FLUSH:
            yield _summed(counts, pa.binary())
            counts = {}
    yield _summed(counts, pa.binary())


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}
    for b in batches:
        for w, *n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for g in grams(w):
                c = counts.get(g)
                if c is None:
                    c = counts[g] = [0, 0, 0]
                for k in range(3):
                    c[k] += n[k]
        if len(counts) > FLUSH:
            yield _summed(counts, pa.string())
            counts = {}
    yield _summed(counts, pa.string())


def corpus_grams(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (n-gram), n, n0, n1 over the whole corpus; ``sample``: id, toxic of the documents that count for a class."""
    marked = docs.select(F.col(quoted(id_col)).alias("i"), F.col(quoted(text_col)).cast("string").alias("text")).join(F.broadcast(sample), F.col("i") == F.col("id"), "left").select("text", "toxic")
    sums = [F.sum(c).alias(c) for c in ("n", "n0", "n1")]
    words = map_arrow(marked, _count_words, "key binary, n long, n0 long, n1 long").groupBy("key").agg(*sums)
    return map_arrow(words, _count_grams, "key string, n long, n0 long, n1 long").groupBy("key").agg(*sums)


def _suffixes(rows: DataFrame, first: int) -> DataFrame:
    """Distinct suffixes (column gram) of the n-grams in ``rows`` (column key) that begin at their ``first`` character or a later one."""
    return rows.where(F.length("key") >= first).select(F.explode(F.expr(f"transform(sequence({first}, length(key)), i -> substring(key, i))")).alias("gram")).distinct()


def backoff_rows(all_grams: DataFrame, seen: DataFrame) -> DataFrame:
    """Continuation counts that the n-grams in ``seen`` (column key) need: gram, left (distinct characters before it),
    for every proper suffix of them, and the same sums for their contexts: total, types. One row an n-gram: n-grams of all lengths are
    counted together, whether they are suffixes of longer ones or stand at a word's start and have no longer one. One plan for all lengths,
    as the driver holds and compiles it."""
    level = _suffixes(all_grams, 1).where(F.length("gram") > 1).groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("left"))
    before = F.expr("substring(gram, 1, length(gram) - 1)").alias("context")
    context = level.groupBy(before).agg(F.sum("left").alias("total"), F.count("*").alias("types"))
    return _suffixes(seen, 2).join(level, "gram").withColumn("context", before).join(context, "context").select("gram", "left", "total", "types")


@dataclass
class Model:
    """Log-ratios of n-grams seen in a class, of contexts for what they have not been seen with, and the calibration."""

    ratio: dict[str, float]
    unseen: dict[str, float]
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    known: dict[bytes, float] = field(default_factory=dict)

    def word(self, w: bytes) -> float:
        total = 0.0
        for g in grams(w):
            r = self.ratio.get(g)
            total += self.unseen.get(g[:-1], 0.0) if r is None else r
        total = max(-MOST, min(MOST, total))
        if len(w) <= 64:
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            self.known[w] = total
        return total

    def features(self, text: bytes) -> tuple[float, float, float]:
        words = folded(text)
        if not words:
            return 0.0, 0.0, 0.0
        known, word = self.known, self.word
        r = np.array([x if (x := known.get(w)) is not None else word(w) for w in words])
        if len(r) > WINDOW:
            sums = np.concatenate([[0.0], np.cumsum(r)])
            best = float((sums[WINDOW:] - sums[:-WINDOW]).max()) / WINDOW
        else:
            best = float(r.sum()) / WINDOW
        return float(r.mean()), best, float((r > STRONG).mean())

    def score(self, text: bytes) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def kneser_ney(class_rows: list[tuple[str, int, int]], backoff: dict[str, tuple[int, int, int]]) -> Model:
    """``class_rows``: n-gram, counts in the two classes. ``backoff``: for lower-order n-grams: continuation count, that of
    their context, and how many characters follow their context."""
    shared: dict[str, float] = {"": 1 / 256}

    def share(g: str) -> float:
        p = shared.get(g)
        if p is None:
            left, total, types = backoff.get(g, (0, 0, 0))
            low = share(g[1:])
            p = shared[g] = max(left - DISCOUNT, 0) / total + DISCOUNT * types / total * low if total else low
        return p

    context: dict[str, list[int]] = {}
    for g, *n in class_rows:
        c = context.setdefault(g[:-1], [0, 0, 0, 0])
        for k in (0, 1):
            c[k] += n[k]
            c[2 + k] += n[k] > 0
    free = {h: [DISCOUNT * c[2 + k] / c[k] if c[k] else 1.0 for k in (0, 1)] for h, c in context.items()}
    ratio = {}
    for g, *n in class_rows:
        h, low = g[:-1], share(g[1:])
        p = [(max(n[k] - DISCOUNT, 0) / context[h][k] if context[h][k] else 0.0) + free[h][k] * low for k in (0, 1)]
        ratio[g] = math.log(p[1] / p[0])
    return Model(ratio, {h: math.log(f[1] / f[0]) for h, f in free.items()})


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps; features are standardised, then the weights carried back."""
    if not len(y) or y.min() == y.max():
        return (-1.0, 1.0, 0.0, 0.0)
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(y)), (x - mean) / std])
    w, ridge = np.zeros(z.shape[1]), RIDGE * len(y) / 100 * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    back = w[1:] / std
    return (float(w[0] - back @ mean), *map(float, back))


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")) % 5 == 0


def training_sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", most: int = MAX_LABELLED) -> DataFrame:
    """id, toxic, fold of at most ``most`` labelled documents of each class; none is held out. Null labels are skipped,
    an id with both labels counts as toxic."""
    rows = labels.where(~held_out(id_col) & F.col(quoted(label_col)).isin(0, 1)).groupBy(F.col(quoted(id_col)).alias("id")).agg(F.max(F.col(quoted(label_col)).cast("int")).alias("toxic"))
    of = [rows.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(most) for k in (0, 1)]
    return of[0].union(of[1]).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(4)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", most: int = MAX_LABELLED) -> Model:
    """Three quarters of the sample make the class counts, the rest the calibration; all of ``docs`` makes the shared counts.

    Where a class has no labelled document with words (empty tables, labels of one class) nothing tells the classes apart: every text
    gets the score of no evidence, below 0.5. Null ids, texts and labels are passed over."""
    spark = docs.sparkSession
    spool = Spool(spark, "toxicity")
    sample = spool.table(training_sample(labels, label_id, label_col, most))
    all_grams = spool.table(corpus_grams(docs, sample.where("fold <> 0").select("id", "toxic"), id_col, text_col))
    seen = all_grams.where("n0 + n1 > 0")
    table = backoff_rows(all_grams, seen).toPandas()
    backoff = dict(zip(table["gram"], zip(table["left"].tolist(), table["total"].tolist(), table["types"].tolist(), strict=True), strict=True))
    counts = seen.select("key", "n0", "n1").toPandas()
    if not (counts["n0"].any() and counts["n1"].any()):
        return Model({}, {}, (-1.0, 0.0, 0.0, 0.0))
    model = kneser_ney(list(zip(counts["key"], counts["n0"].tolist(), counts["n1"].tolist(), strict=True)), backoff)
    shared = Shared(spark, (model.ratio, model.unseen, model.weights))
    rest = docs.select(F.col(quoted(id_col)).alias("i"), F.col(quoted(text_col)).cast("string").alias("text")).join(F.broadcast(sample.where("fold = 0").select("id", "toxic")), F.col("i") == F.col("id")).select("toxic", "text")

    def measure(texts: list[bytes]) -> dict[str, list]:
        m = shared.made(_model)
        return {"x": [list(m.features(t)) for t in texts]}

    found = per_text(rest, "toxic", "text", measure, "x array<double>", pa.schema([("x", pa.list_(pa.float64()))])).toPandas()
    model.weights = calibrate(np.array(found["x"].tolist()).reshape(-1, 3), found["toxic"].to_numpy())
    return model


def _model(parts: tuple) -> Model:
    return Model(*parts)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Null and empty texts have a score too, the calibration's
    for no evidence. Repeated rows are rows of the result; extra columns are not read."""
    shared = Shared(docs.sparkSession, (model.ratio, model.unseen, model.weights))

    def score(texts: list[bytes]) -> dict[str, list]:
        m = shared.made(_model)
        return {"score": [m.score(t) for t in texts]}

    out = per_text(docs, id_col, text_col, score, "score double", pa.schema([("score", pa.float64())]))
    return out.select(F.col(quoted(id_col)), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, columns as they came; nothing is shuffled.

    Null and empty texts are judged by the calibration for no evidence. Each row is judged by its text alone, so repeated rows go or stay
    together; ids are not read and may be null. Empty table: empty result. Extra columns pass through."""
    shared = Shared(docs.sparkSession, (model.ratio, model.unseen, model.weights))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.made(_model)
        for b in batches:
            yield b.filter(pa.array([m.score(t) < threshold for t in raw_texts(b.column(at))], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
