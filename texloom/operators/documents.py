"""Documents to vectors and to labels: encoders, heads and predictors put together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import readers
from . import classify
from .arrow import lists, map_batches, matrix
from .layers import linear_head
from .tokenize import TokenizerConf, tokenized

#: From documents, each a list of sentences of token ids, to a matrix.
DocumentEncoder = Callable[[list[list[list[int]]]], np.ndarray]
#: Tokens of the documents that are encoded together, about.
CHUNK_TOKENS = 96_000
#: Bytes of the texts that are tokenized together, about.
CHUNK_BYTES = 1 << 20


def encode_documents(docs: DataFrame, encoder: DocumentEncoder, conf: TokenizerConf, normalise: bool = True, chunk_tokens: int = CHUNK_TOKENS, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, and vec: each document split into its lines that aren't blank, tokenized and encoded.

    A null or empty text is one padding token. Documents of a batch are encoded in chunks of about ``chunk_tokens``, in their
    order; a document's vector doesn't depend on the others. Rows are neither dropped nor merged.
    """
    rest = [c for c in docs.columns if c != text]
    lines = docs.withColumn("_lines", F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    flat = lines.select(*rest, F.array_join("_lines", "\n").alias("_text"))
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField("vec", T.ArrayType(T.DoubleType()))])
    from .tokenize import FACTORIES, _made

    factory = FACTORIES[conf.kind]
    room = None if conf.max_length is None else max(0, conf.max_length - len(conf.prefix) - len(conf.suffix))

    def made(texts: pa.Array) -> Iterator[list[list[int]]]:
        """The token ids of the sentences of each text; only those of some texts are held."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
            sents = [[s for s in t.split("\n") if s] for t in texts.slice(at, to - at).to_pylist()]
            ids = iter(_made(factory, conf).encode([s for d in sents for s in d]))
            for d in sents:
                yield [[*conf.prefix, *next(ids)[:room], *conf.suffix] or [conf.pad] for _ in d] or [[conf.pad]]
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out, part, size = [], [], 0
            for d in made(b.column("_text")):
                n = sum(map(len, d))
                if part and size + n > chunk_tokens:
                    out.append(encoder(part))
                    part, size = [], 0
                part.append(d)
                size += n
            out.append(encoder(part))
            m = np.concatenate(out).astype(np.float64)
            if normalise:
                m = m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), lists(m)], names=[*rest, "vec"])

    return flat.mapInArrow(run, schema)


def encode_folder(spark: SparkSession, folder: str, encoder: DocumentEncoder, conf: TokenizerConf, **how) -> DataFrame:
    """id, path, vec of the documents of a folder, in the order of their paths."""
    return encode_documents(readers.read_documents(spark, folder), encoder, conf, **how).orderBy("path")


def encode_paths(spark: SparkSession, paths: list[str], encoder: DocumentEncoder, conf: TokenizerConf, first_id: int = 0, **how) -> DataFrame:
    """id (the place of the path, from ``first_id``), path, vec of a list of files."""
    return encode_documents(readers.read_paths(spark, paths, first_id), encoder, conf, **how)


def encode_sentences(sents: DataFrame, encoder: DocumentEncoder, conf: TokenizerConf, **how) -> DataFrame:
    """As ``encode_documents``, each sentence a document of one line."""
    one_line = sents.withColumn("text", F.regexp_replace("text", "\n", " "))
    return encode_documents(one_line, encoder, conf, **how)


def head_scores(vectors: DataFrame, weights: np.ndarray, bias: np.ndarray, labels: list[int] | None = None, multi_label: bool = False, head: Callable[..., np.ndarray] = linear_head) -> DataFrame:
    """doc_id, label, p: the softmax (or, with ``multi_label``, the sigmoid) of a head over vectors. ``vectors``: doc_id, vec."""
    names = np.array(labels if labels is not None else range(weights.shape[1]), np.int32)

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        z = head(matrix(b.column("vec")), weights, bias)
        if multi_label:
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        else:
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
        rows = np.repeat(np.arange(b.num_rows), len(names))
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), pa.array(np.tile(names, b.num_rows)), pa.array(p.ravel())], names=["doc_id", "label", "p"])

    schema = T.StructType([vectors.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("p", T.DoubleType())])
    return map_batches(vectors.select("doc_id", "vec"), schema, score)


def fit_head(vectors: DataFrame, sample: int = 20_000, rounds: int = 200, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Weights, bias and labels of a linear head fitted by gradient descent on at most ``sample`` labelled vectors, those with the least hashes. ``vectors``: doc_id, vec, label (int)."""
    some = vectors.where("label IS NOT NULL AND vec IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("vec", "label").toArrow()
    if not some.num_rows:
        raise ValueError("no labelled vectors")
    x, y = matrix(some.column("vec")), some.column("label").to_numpy()
    labels, at = np.unique(y, return_inverse=True)
    w, b, gold = np.zeros((x.shape[1], len(labels))), np.zeros(len(labels)), np.eye(len(labels))[at]
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - gold) / len(x)
        speed_w, speed_b = 0.9 * speed_w + x.T @ g + decay * w, 0.9 * speed_b + g.sum(0)
        w, b = w - rate * len(labels) * speed_w, b - rate * len(labels) * speed_b
    return w, b, [int(v) for v in labels]


@dataclass
class Predictor:
    """How labels are decided; given outright, or from stored data: thresholds per label, or a kind with its numbers."""

    kind: str = "threshold"
    threshold: float = 0.5
    k: int = 1
    gap: float = 0.3
    thresholds: dict[int, float] | None = None

    @classmethod
    def chosen(cls, given: Predictor | None, thresholds: dict[int, float] | None, stored: dict | None) -> Predictor:
        """The first of: what is given, thresholds per label, stored data, the default."""
        if given is not None:
            return given
        if thresholds:
            return cls("per_label", thresholds=dict(thresholds))
        return cls(**stored) if stored else cls()

    def decide(self, scores: DataFrame) -> DataFrame:
        if self.kind == "per_label":
            rows = scores.sparkSession.createDataFrame(list((self.thresholds or {}).items()) or [(-1, 2.0)], "label int, threshold double")
            return classify.by_threshold(scores, rows)
        if self.kind == "topk":
            return classify.by_rank(scores, self.k).drop("place")
        if self.kind == "topk_threshold":
            return classify.by_rank(scores, self.k, self.threshold).drop("place")
        if self.kind == "gap":
            return classify.by_gap(scores, self.gap)
        if self.kind == "threshold":
            return classify.by_threshold(scores, self.threshold)
        raise ValueError(f"no such predictor: {self.kind}")


@dataclass
class DocumentClassifier:
    """An encoder, a head and a predictor: documents to labels with weights, from a table, a folder or a list of files."""

    encoder: DocumentEncoder
    conf: TokenizerConf
    weights: np.ndarray
    bias: np.ndarray
    labels: list[int]
    predictor: Predictor
    multi_label: bool = True

    def scores(self, docs: DataFrame) -> DataFrame:
        vectors = encode_documents(docs.select("doc_id", "text"), self.encoder, self.conf)
        return head_scores(vectors, self.weights, self.bias, self.labels, self.multi_label)

    def classify(self, docs: DataFrame) -> DataFrame:
        """doc_id and labels: an array of (label, weight), the greatest weight first. ``docs``: doc_id, text."""
        return classify.weighted_labels(self.predictor.decide(self.scores(docs)))

    def classify_folder(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.classify(readers.read_documents(spark, folder).select(F.col("id").alias("doc_id"), "text"))

    def classify_paths(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        return self.classify(readers.read_paths(spark, paths).select(F.col("id").alias("doc_id"), "text"))
