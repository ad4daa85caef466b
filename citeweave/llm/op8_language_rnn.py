"""Language of whole texts by a bidirectional gated recurrent network over bytes.

A text's bytes, blanks as one, are read in windows of ``SPAN`` that overlap: a network reads each forward and one
backward, across blanks, and a softmax over both states labels every byte. Each byte is labelled once, in the window
where it is ``EDGE`` bytes or more from either end (but at the text's own ends, beyond which zero bytes stand), so a cut is hardly
felt. A document's probabilities pool the log-probabilities of all its positions. Training is in numpy, by backpropagation through time, on windows
of ``DOCS_EACH`` documents of each language, ``WINDOWS_EACH`` of them at most.

Null texts and texts without a letter are ``und`` with score 0. Where training has no language at all, every text is.
Repeated rows get equal answers, other columns, whatever their names, are ignored, long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import let_go, stash

SPAN, EDGE, HIDDEN = 128, 8, 12
#: Length of the windows of training, and bounds of the labelled sample.
TRAIN_SPAN, DOCS_EACH, WINDOWS_EACH = 48, 250, 3_000
STEPS, BATCH, RATE = 300, 160, 0.012
#: Pooled log-probabilities count as so many independent positions at most.
EVIDENCE = 24
#: Windows that a task computes together.
TOGETHER = 2048


@dataclass
class Network:
    langs: list[str]
    weights: dict[str, np.ndarray]


def windows(raw: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values of all windows of some texts, time first; which bytes each window labels, likewise; the text of each window."""
    stride = span - 2 * EDGE
    bare = [b" ".join(r.replace(b"\0", b" ").split()) for r in raw]
    size = np.array([len(r) for r in bare], np.int64)
    each = -(-size // stride)
    text = np.repeat(np.arange(len(bare)), each)
    first = (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * stride  # labelled from here
    buffer = np.frombuffer(b"".join(bare) + b"\0", np.uint8)
    base = (np.cumsum(size) - size)[text]
    at = first - EDGE + np.arange(span)[:, None]
    there = (at >= 0) & (at < size[text])
    x = np.where(there, buffer[np.where(there, base + at, 0)], 0).astype(np.uint8)
    return x, there & (at >= first) & (at < first + stride), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def run_layer(w: dict, d: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction, time first. Each gate has tables and matrices of its own, so that all arrays are whole."""
    h = np.zeros((x.shape[1], HIDDEN), w["V"].dtype)
    states = np.empty((len(x), x.shape[1], HIDDEN), h.dtype)
    e, u = ([np.ascontiguousarray(w[d + k][:, g * HIDDEN : (g + 1) * HIDDEN]) for g in range(3)] for k in "EU")
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        r, z = (_sigmoid(e[g][x[t]] + h @ u[g]) for g in range(2))
        un = h @ u[2]
        new = np.tanh(e[2][x[t]] + r * un)
        if keep is not None:
            keep.append((t, h, r, z, new, un))
        h = states[t] = new + z * (h - new)
    return states


def log_probabilities(w: dict, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Of each language at each position: language, time, window."""
    if keep is not None:
        keep |= {"f": [], "b": []}
    both = np.concatenate([run_layer(w, d, x, None if keep is None else keep[d]) for d in "fb"], 2)
    if keep is not None:
        keep["both"] = both
    a = np.ascontiguousarray((both.reshape(-1, 2 * HIDDEN) @ w["V"] + w["c"]).T).reshape(-1, *x.shape)
    a -= a.max(0)
    return a - np.log(np.exp(a).sum(0))


def gradients(w: dict, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean loss over labelled positions, and its gradient through time."""
    keep: dict = {}
    lp = log_probabilities(w, x, keep)
    n, own = there.sum(), np.arange(len(y))
    loss = -(lp[y, :, own] * there.T).sum() / n
    da = np.exp(lp)
    da[y, :, own] -= 1
    da = np.moveaxis(da * (there / n), 0, 2).astype(w["V"].dtype)
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["V"] = np.einsum("tbh,tbl->hl", keep["both"], da)
    g["c"] = da.sum((0, 1))
    dh_all = da @ w["V"].T
    for k, d in enumerate("fb"):
        dh = np.zeros((x.shape[1], HIDDEN), w["V"].dtype)
        for t, h, r, z, new, un in reversed(keep[d]):
            dh = dh + dh_all[t][:, k * HIDDEN : (k + 1) * HIDDEN]
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dr, dz, dn * r], 1)
            np.add.at(g[d + "E"], x[t], np.concatenate([dr, dz, dn], 1))
            g[d + "U"] += h.T @ du
            dh = dh * z + du @ w[d + "U"].T
    return float(loss), g


def fit(examples: dict[str, list[bytes]], seed: int = 7) -> Network:
    """A network from texts of each language."""
    langs = sorted(examples)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
    w = {d + "E": draw(256, 3 * HIDDEN) for d in "fb"} | {d + "U": draw(HIDDEN, 3 * HIDDEN) for d in "fb"}
    w |= {"V": draw(2 * HIDDEN, len(langs)), "c": np.zeros(len(langs), np.float32)}
    made = [windows(examples[k], TRAIN_SPAN) for k in langs]
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, STEPS + 1 if len(langs) > 1 else 1):
        y = rng.integers(0, len(langs), BATCH)
        drawn = [(made[i], rng.integers(made[i][0].shape[1])) for i in y]
        x, there = (np.stack([m[k][:, j] for m, j in drawn], 1) for k in range(2))
        _, g = gradients(w, x, there, y)
        rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
        for k in w:  # Adam
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.999 * second[k] + 0.001 * g[k] * g[k]
            w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(langs, w)


def train(docs: DataFrame) -> Network | None:
    """A network from documents whose crc32(doc_id) mod 3 is not 1; None where none of them has a language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    # a bounded sample: of each language, the ids with the least hashes among ids dealt to DOCS_EACH slots
    slots = known.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(DOCS_EACH)).alias("slot"))
    picked = slots.groupBy("lang", "slot").agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit("pick"))).alias("doc_id")).select("doc_id")
    # each document in pieces of some windows; the least hashes of a language's pieces are its sample
    size = 4 * (TRAIN_SPAN - 2 * EDGE)
    pieces = F.expr(f"transform(sequence(0, (length(raw) - 1) div {size}), i -> substring(raw, cast(i * {size} + 1 as int), {size}))")
    cut = known.join(F.broadcast(picked), "doc_id", "left_semi").select("lang", "doc_id", F.encode("text", "UTF-8").alias("raw")).filter(F.length("raw") > 0)
    cut = stash(cut.select("lang", "doc_id", F.posexplode(pieces).alias("pos", "piece")), "language-pieces")  # one pass over the documents, however many languages
    examples: dict[str, list[bytes]] = {}
    for (lang,) in sorted(map(tuple, cut.select("lang").distinct().collect())):
        rows = cut.filter(F.col("lang") == lang).orderBy(F.xxhash64("piece", "doc_id", "pos"), "doc_id", "pos").limit(WINDOWS_EACH // 4).select("piece").collect()
        parts = [bytes(r.piece) for r in rows]
        if any(p.strip() for p in parts):
            examples[lang] = parts
    return fit(examples) if examples else None


def _squash(x: np.ndarray, square: np.ndarray, below: np.ndarray) -> None:
    """tanh in place, as a quotient of polynomials (within 0.002)."""
    np.clip(x, -3.6, 3.6, out=x)
    np.multiply(x, x, out=square)
    np.multiply(square, 15, out=below)
    below += 420
    below *= square
    below += 945
    x /= below
    np.add(square, 105, out=below)
    below *= square
    below += 945
    x *= below


def states(w: dict, d: str, x: np.ndarray) -> np.ndarray:
    """What ``run_layer`` gives, in arrays made once."""
    shape = (x.shape[1], HIDDEN)
    # sigmoid(x) is (1 + tanh(x / 2)) / 2
    e, u = ([np.ascontiguousarray(w[d + k][:, g * HIDDEN : (g + 1) * HIDDEN] * np.float32(0.5 if g < 2 else 1)) for g in range(3)] for k in "EU")
    h, out = np.zeros(shape, np.float32), np.empty((len(x), *shape), np.float32)
    r, z, new, more, below = (np.empty(shape, np.float32) for _ in range(5))
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        for k, gate in enumerate((r, z, new)):
            np.take(e[k], x[t], 0, out=gate, mode="clip")
            np.matmul(h, u[k], out=more)
            if gate is new:
                more *= r
            gate += more
            _squash(gate, more, below)
            if gate is not new:
                gate += 1
                gate *= np.float32(0.5)
        np.subtract(h, new, out=out[t])
        h = out[t]
        h *= z
        h += new
    return out


def pooled(network: Network, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sum over all positions of each text of the languages' log-probabilities, and the number of positions."""
    x, labelled, text = windows([(t or "").encode() for t in texts])
    out, n = np.zeros((len(texts), len(network.langs))), np.zeros(len(texts))
    w = network.weights
    for i in range(0, len(text), TOGETHER):
        part = slice(i, i + TOGETHER)
        mask, own = labelled[:, part], np.ascontiguousarray(x[:, part])
        a = w["c"] + sum(states(w, d, own).reshape(-1, HIDDEN) @ w["V"][k * HIDDEN : (k + 1) * HIDDEN] for k, d in enumerate("fb"))
        a = np.ascontiguousarray(a.T).reshape(-1, *own.shape)
        a -= a.max(0)
        a -= np.log(np.exp(a).sum(0))
        a *= mask
        lp = a.sum(1)
        for k in range(len(lp)):
            out[:, k] += np.bincount(text[part], lp[k], len(texts))
        n += np.bincount(text[part], mask.sum(0), len(texts))
    return out, n


def runs(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Half-open ranges of texts of about ``most`` characters; one text at least."""
    a = total = 0
    for b, t in enumerate(texts):
        if total and total + len(t or "") > most:
            yield a, b
            a, total = b, 0
        total += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def with_language(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of documents (doc_id, text)."""
    if network is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(1).to_pylist()
            for a, b in runs(every):
                texts = every[a:b]
                total, n = pooled(network, texts)
                mean = total / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                real = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
                lang = np.where(real, np.array(network.langs, object)[best], "und")
                score = np.where(real, p[np.arange(len(best)), best], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang.tolist(), pa.string()), pa.array(score.astype(float))], names=["doc_id", "lang_pred", "score"])
        let_go()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    found = with_language(docs, train(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3, F.lit(-1)) == 1
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
