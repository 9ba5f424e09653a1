"""Quality classifier with hierarchical empirical Bayes over sites.

A document's own evidence comes from two logistic models, for quality and for toxicity, over the words it holds (hashed)
and over its shape (shares of letters, capitals, digits, signs and so on). They are fitted on the driver, on at most
``SAMPLE`` labelled documents, those with the least hash of their id.

Sites: a document belongs to a host and, there, to a path. Grouped aggregation gives each host and each path the sum of
its documents' probabilities. A host's posterior shrinks towards the global mean, a path's towards its host's posterior;
how strongly follows from the spread between sites (method of moments). A document's own share is left out of its site.
The final odds of a document are its own, moved by how far its path's posterior lies from the global mean.

Host and path come from ``source``: of a URL its host and first directory; else the source itself and the language.

Defined results: a null or empty text has no words and an empty shape; a null source or language is the empty site; a
null document id is scored like any other; labels with a null id or value count for nothing; several labels of one
document count as the least quality and the most toxic; without labels every document's evidence is even and it is
accepted; repeated rows are scored each; odds that are even count as accepted; other columns are ignored, whatever their
names; an empty table gives an empty result. A text is read whole, some tens of bytes of memory for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import _common
from tracemill.llm import _words as words

#: Labelled documents that the models are fitted on, hashed words, and how many of them a model keeps.
SAMPLE, HASHED, KEPT = 20_000, 1 << 17, 384
THRESHOLD, STRENGTH = 0.5, (2.0, 10_000.0)
SHAPE = ["log_bytes", "letters", "capitals", "digits", "signs", "high_bytes", "line_ends", "word_length", "distinct_words", "sign_runs"]


def features(data: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, hashed words, shape): the distinct words of each row in pairs of arrays, and one line of shape per row.

    Words here are runs of letters, so that a word in a row of signs is still that word.
    """
    lower = words.lower_ascii(data)
    alpha = ((lower >= 97) & (lower <= 122)) | (lower >= 128)
    read = np.where(alpha, lower, 32).astype(np.uint8)
    start, end, count = words.word_bounds(read, row_at)
    h = words.Prefix(read).of(start, end)
    row = np.repeat(np.arange(len(count)), count)
    pairs = np.unique(row.astype(np.uint64) << np.uint64(32) | h % np.uint64(HASHED))
    rows, hashed = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64((1 << 32) - 1)).astype(np.int64)
    sizes = np.diff(row_at)
    share = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][row_at]) / np.maximum(sizes, 1)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    sign = ~alpha & ~digit & ~space
    twice = np.zeros(len(data), bool)
    twice[1:] = sign[1:] & sign[:-1]
    length = np.bincount(row, end - start, len(count)) / np.maximum(count, 1)
    distinct = np.bincount(rows, minlength=len(count)) / np.maximum(count, 1)
    shape = np.column_stack([np.log1p(sizes), share(alpha), share(upper), share(digit), share(sign), share(data >= 128), share(data == 10), length, distinct, share(twice)])
    return rows, hashed, shape


def _batches(batch: pa.RecordBatch, text_at: int):
    """(first row, features) of parts of a batch."""
    data, at = _common.utf8_of(batch.column(text_at))
    data = np.frombuffer(data, np.uint8)
    for first, end in words.chunks(at):
        yield first, end, features(data[at[first] : at[end]], np.array(at[first : end + 1]) - at[first])


class Model:
    """A logistic model over the shape and the words that tell most."""

    def __init__(self, words_kept: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.words, self.mean, self.scale, self.weights = words_kept, mean, scale, weights

    def logits(self, rows: np.ndarray, hashed: np.ndarray, shape: np.ndarray) -> np.ndarray:
        out = (shape - self.mean) / self.scale @ self.weights[1 : 1 + shape.shape[1]] + self.weights[0]
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashed), len(self.words) - 1)
            hit = self.words[at] == hashed
            out += np.bincount(rows[hit], self.weights[1 + shape.shape[1] :][at[hit]], len(out))
        return np.clip(out, -30, 30)


def fit(rows: np.ndarray, hashed: np.ndarray, shape: np.ndarray, label: np.ndarray, kept: int = KEPT, ridge: float = 0.3) -> Model:
    """Newton's method on the words with the largest statistic of association, and the shape."""
    n, good = len(label), float(label.sum())
    with_word = np.bincount(hashed, minlength=HASHED).astype(float)
    with_good = np.bincount(hashed, label[rows], HASHED)
    expect = with_word * good / max(n, 1)
    var = with_word * (good / max(n, 1)) * (1 - good / max(n, 1)) * np.maximum(n - with_word, 0) / max(n - 1, 1)
    score = np.where((with_word >= 5) & (var > 0), (with_good - expect) ** 2 / np.maximum(var, 1e-9), 0.0)
    chosen = np.sort(np.argsort(-score, kind="stable")[:kept])
    chosen = chosen[score[chosen] > 10.0]
    mean, scale = shape.mean(axis=0), np.maximum(shape.std(axis=0), 1e-6)
    x = np.zeros((n, 1 + shape.shape[1] + len(chosen)), np.float32)
    x[:, 0] = 1
    x[:, 1 : 1 + shape.shape[1]] = (shape - mean) / scale
    if len(chosen):
        at = np.minimum(np.searchsorted(chosen, hashed), len(chosen) - 1)
        hit = chosen[at] == hashed
        x[rows[hit], 1 + shape.shape[1] + at[hit]] = 1
    w = np.zeros(x.shape[1])
    w[0] = np.log((good + 1) / (n - good + 1))
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = np.diag(penalty)
        for at in range(0, n, 2048):  # a slice at a time bounds the memory
            part = x[at : at + 2048].astype(np.float64)
            curve += (part * (p * (1 - p) + 1e-6)[at : at + 2048, None]).T @ part
        step = np.linalg.solve(curve, x.T @ (p - label) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return Model(chosen, mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model, Model] | None:
    """(quality, toxicity) from at most ``sample`` labelled documents; None without any."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna()
    one = one.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, and small enough to broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for first, end, (rows, hashed, shape) in _batches(batch, 1):
                cut = np.searchsorted(rows, np.arange(end - first + 1))
                sets = [hashed[cut[k] : cut[k + 1]].astype("<u4").tobytes() for k in range(end - first)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, end - first) for c in (0, 2, 3)), pa.array(sets, pa.binary()), pa.array(list(shape), pa.list_(pa.float64()))], ["doc_id", "quality", "toxic", "words", "shape"])

    found = texts.select("doc_id", "text", "quality", "toxic").mapInArrow(_common.batches_with_rows(run), "doc_id long, quality int, toxic int, words binary, shape array<double>").toArrow()
    if not found.num_rows:
        return None
    found = found.sort_by("doc_id")
    hashed = np.frombuffer(b"".join(found.column("words").to_pylist()), "<i4")
    rows = np.repeat(np.arange(found.num_rows, dtype=np.int32), pc.binary_length(found.column("words")).to_numpy() // 4)
    shape = np.array(found.column("shape").to_pylist())
    return tuple(fit(rows, hashed, shape, (found.column(c).to_numpy() > 0).astype(float)) for c in ("quality", "toxic"))


def evidence(docs: DataFrame, models: tuple[Model, Model] | None) -> DataFrame:
    """doc_id, host, path, p_quality, p_toxic, own: the logit of being good and not toxic, from the text alone."""
    url = F.col("source").rlike("^[a-z]+://")
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    host = F.when(url, F.regexp_extract("source", "^[a-z]+://([^/?#]*)", 1)).otherwise(source)
    path = F.when(url, F.regexp_extract("source", "^[a-z]+://[^/?#]*/([^/?#]*)", 1)).otherwise(F.coalesce(F.col("lang").cast("string"), F.lit("")))

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for first, end, found in _batches(batch, 1):
                if models:
                    good, toxic = (1 / (1 + np.exp(-m.logits(*found))) for m in models)
                else:
                    good, toxic = np.full(end - first, 0.5), np.zeros(end - first)
                both = np.clip(good * (1 - toxic), 1e-9, 1 - 1e-9)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, end - first) for c in (0, 2, 3)), pa.array(good), pa.array(toxic), pa.array(np.log(both / (1 - both)))], ["doc_id", "host", "path", "p_quality", "p_toxic", "own"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), host.alias("host"), path.alias("path"))
    return rows.mapInArrow(_common.batches_with_rows(run), "doc_id long, host string, path string, p_quality double, p_toxic double, own double")


def _strength(sites: DataFrame, total: str, count: str, centre) -> float:
    """How many documents the prior of a site is worth: from the spread of the sites' means beyond that of their documents."""
    mean = F.col(total) / F.col(count)
    got = sites.where(F.col(count) > 1).agg(
        F.sum(F.col(count) * (mean - centre) * (mean - centre)).alias("between"),
        F.sum(F.lit(1.0)).alias("sites"),
        F.sum(count).alias("n"),
        F.sum(F.col(count) * F.col(count)).alias("squares"),
        F.avg(centre * (1 - centre)).alias("spread"),
    ).first()
    if not got.sites or not got.spread or got.n - got.squares / got.n <= 0:
        return STRENGTH[1]
    variance = (got.between - got.sites * got.spread) / (got.n - got.squares / got.n)
    return float(min(STRENGTH[1], max(STRENGTH[0], got.spread / variance - 1))) if variance > 0 else STRENGTH[1]


def _logit(p):
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_quality, p_toxic, host_posterior, path_posterior, p_accept, accept for each row of docs."""
    tables = _common.Tables(docs.sparkSession, "quality")
    own = tables.keep(evidence(docs, train(docs, labels)).withColumn("p", 1 / (1 + F.exp(-F.col("own")))))
    paths = tables.keep(own.groupBy("host", "path").agg(F.sum("p").alias("path_sum"), F.count("*").alias("path_n")))
    hosts = tables.keep(paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n")))
    whole = hosts.agg(F.sum("host_sum").alias("s"), F.sum("host_n").alias("n")).first()
    mean = (whole.s / whole.n) if whole.n else 0.5
    host_k = _strength(hosts, "host_sum", "host_n", F.lit(mean))
    sites = paths.join(hosts, "host").withColumn("centre", (F.col("host_sum") + host_k * mean) / (F.col("host_n") + host_k))
    path_k = _strength(sites, "path_sum", "path_n", F.col("centre"))
    host_post = (F.col("host_sum") - F.col("p") + host_k * mean) / (F.col("host_n") - 1 + host_k)
    path_post = (F.col("path_sum") - F.col("p") + path_k * F.col("host_posterior")) / (F.col("path_n") - 1 + path_k)
    out = own.join(sites.drop("centre"), ["host", "path"]).withColumn("host_posterior", host_post).withColumn("path_posterior", path_post)
    odds = F.col("own") + _logit(F.col("path_posterior")) - _logit(F.lit(mean))
    out = out.withColumn("p_accept", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "host", "path", "p_quality", "p_toxic", "host_posterior", "path_posterior", "p_accept", (F.col("p_accept") >= threshold - 1e-12).alias("accept"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, from the labels table."""
    _common.tune(spark)
    return classify(_common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
