"""Quality by compression: which of two dictionaries, of good or of bad text, makes a text smaller.

A zstandard dictionary is trained on good and one on bad labelled text. A text is cut into blocks of ``BLOCK`` bytes, each
compressed by itself with either dictionary, so that a long text cannot become its own dictionary. The difference of the
two compressed sizes over the text's bytes is the feature (a text that repeats itself is small either way, so near 0,
where good text is well above); a logistic curve, fitted on labelled documents that no
dictionary has seen, makes it a probability.

The labelled sample is bounded: ``DOCS_EACH`` documents of each label, of which at most ``BLOCKS_EACH`` blocks are kept.
Null and empty texts score as the share of good among labelled documents. Repeated rows get equal scores. With one label
only, the score is that label's share (1 or 0); without labels it is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import let_go, stash

BLOCK, DICT_BYTES, LEVEL = 1024, 48 * 1024, 3
#: Bytes at which a text's own evidence weighs as much as the prior.
THIN = 32
#: Bounds of the labelled sample.
DOCS_EACH, BLOCKS_EACH = 1500, 4000


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    prior: float = 0.0

    def probability(self, difference: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of label 1; a text of few bytes says little, so its log-odds stay near those of all labelled documents."""
        weight = size / (size + THIN)
        odds = weight * (self.slope * difference + self.offset) + (1 - weight) * self.prior
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def fold(doc_id: str, n: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % n


def differences(texts: list[str], good: bytes, bad: bytes) -> np.ndarray:
    """Share by which the good dictionary beats the bad one: positive for text like the good."""
    import zstandard as z

    blocks: list[bytes] = []
    owner: list[int] = []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        for a in range(0, len(raw), BLOCK):
            blocks.append(raw[a : a + BLOCK])
            owner.append(i)
    if not blocks:
        return np.zeros(len(texts))
    sizes = []
    for raw_dict in (good, bad):
        d = z.ZstdCompressionDict(raw_dict)
        d.precompute_compress(level=LEVEL)
        c = z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        size = np.empty(len(blocks))
        for i in range(0, len(blocks), 20_000):
            size[i : i + 20_000] = [len(x) for x in c.multi_compress_to_buffer(blocks[i : i + 20_000], threads=1)]
        sizes.append(np.bincount(owner, size, len(texts)))
    raw_bytes = np.bincount(owner, [len(b) for b in blocks], len(texts))
    return (sizes[1] - sizes[0]) / np.maximum(raw_bytes, 1)


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a little shrinkage."""
    scale = max(float(np.std(x)), 1e-6)
    design, w = np.stack([x / scale, np.ones(len(x))], 1), np.zeros(2)
    shrink = np.array([1e-2, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + shrink * w
        hessian = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(shrink)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model, or a constant score where a label is missing."""
    import zstandard as z

    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).select("doc_id", "quality").distinct()
    picked = None
    for q in (0, 1):
        # a bounded sample: the least hashes of the ids with this label
        one = known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(DOCS_EACH)
        picked = one if picked is None else picked.union(one)
    texts = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw")).join(F.broadcast(picked), "doc_id")
    cut = texts.filter(F.length("raw") > 0).select(
        "doc_id", "quality", (F.xxhash64("doc_id", F.lit("part")) % 2 == 0).alias("held"),
        F.posexplode(F.expr(f"transform(sequence(0, (length(raw) - 1) div {BLOCK}), i -> substring(raw, cast(i * {BLOCK} + 1 as int), {BLOCK}))")).alias("pos", "block"),
    )
    cut = stash(cut, "quality-blocks")  # one pass over the documents
    blocks = []
    for q in (0, 1):
        of_q = cut.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id", "pos"), "doc_id", "pos").limit(BLOCKS_EACH)
        blocks.append(of_q.select("doc_id", "held", "block").collect())
    if not all(blocks):
        return 1.0 if blocks[1] else 0.0 if blocks[0] else 0.5
    dictionaries = []
    for of_q in blocks:
        seen = [bytes(r.block) for r in of_q if not r.held] or [bytes(r.block) for r in of_q]
        try:
            dictionaries.append(z.train_dictionary(DICT_BYTES, seen, k=64, d=8).as_bytes())
        except z.ZstdError:  # too few samples to train on: they are the dictionary
            dictionaries.append(b"".join(seen)[-DICT_BYTES:])
    bad, good = dictionaries
    x, y = [], []
    for q, of_q in enumerate(blocks):
        of_doc: dict = {}
        for r in of_q:
            if r.held:
                of_doc.setdefault(r.doc_id, []).append(bytes(r.block))
        x.append(differences([b"".join(v).decode(errors="replace") for v in of_doc.values()], good, bad))
        y.append(np.full(len(of_doc), float(q)))
    if not len(x[0]) or not len(x[1]):
        return Model(good, bad, 50.0, 0.0)
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    prior = float(np.log(max(counts.get(1, 0), 1) / max(counts.get(0, 0), 1)))
    return Model(good, bad, *curve(np.concatenate(x), np.concatenate(y)), prior)


def with_score(docs: DataFrame, model: Model | float, out: str = "score") -> DataFrame:
    """``docs`` with the score; a column of its name is replaced."""
    docs = docs.drop(out)
    if not isinstance(model, Model):
        return docs.withColumn(out, F.lit(float(model)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.names.index("text"))
            scores = [np.empty(0)]
            for i in range(0, len(text), 512):
                texts = text.slice(i, 512).to_pylist()
                sizes = np.array([len((t or "").encode()) for t in texts])
                scores.append(model.probability(differences(texts, model.good, model.bad), sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=[*batch.schema.names, out])
        let_go()

    from pyspark.sql import types as T

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    model = train(docs, labels)
    scored = with_score(docs.select("doc_id", "text"), model).select("doc_id", "score")
    return scored.select(
        "doc_id", (F.coalesce(fold("doc_id", 5), F.lit(-1)) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )
