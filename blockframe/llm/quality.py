"""Document quality by attention-based multiple-instance learning."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockframe.llm.common import cut_lineage, text_or_empty

#: Bytes of a passage.
PASSAGE = 512
#: Classes of single bytes and of byte pairs in a passage's features.
SINGLES, PAIRS = 128, 128
FEATURES = SINGLES + PAIRS + 4 + 1
#: Bytes at which a passage's features count half.
TRUSTED = 48
#: Passages encoded at a time, so that a long text needs bounded memory.
SLAB = 4096


class Attention(NamedTuple):
    """Encoder (w, b), attention (tanh part v, gate u, weights a), score (c, c0), and the features' scale."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    c0: np.ndarray


def passages(text: str | None, first: int = 0, number: int | None = None) -> np.ndarray:
    """Features of passages of a text: shares of byte classes and byte pairs, how many pairs occur, and shape."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    data = data[first * PASSAGE : None if number is None else (first + number) * PASSAGE]
    rows = max(1, -(-len(data) // PASSAGE))
    row = np.arange(len(data)) // PASSAGE
    size = np.maximum(np.bincount(row, minlength=rows), 1)[:, None].astype(np.float32)

    def shares(classes: np.ndarray, at: np.ndarray, kinds: int) -> np.ndarray:
        return np.bincount(at * kinds + classes, minlength=rows * kinds).reshape(rows, kinds)

    low = np.where(data < 128, data, 96 + data % 32).astype(np.int64)
    single = shares(low, row, SINGLES)
    pair = (data[:-1].astype(np.int64) * 31 + data[1:] * 17) % 1021
    wide = shares(pair, row[:-1], 1021)
    folded = shares(pair % PAIRS, row[:-1], PAIRS)
    upper, blank = single[:, 65:91].sum(1), single[:, [9, 10, 13, 32]].sum(1)
    shape = np.column_stack([(wide > 0).sum(1) / size[:, 0], wide.max(1) / size[:, 0], upper / size[:, 0], (blank + 1) / size[:, 0]])
    trust = size / (size + TRUSTED)
    return np.concatenate([np.sqrt(single / size), np.sqrt(folded / size), shape, trust], axis=1).astype(np.float32)


def standard(bag: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features; those of a short passage are drawn to the mean."""
    return (bag[:, :-1] - mean) / scale * bag[:, -1:]


def passage_count(text: str | None) -> int:
    return max(1, -(-len((text or "").encode()) // PASSAGE))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score_text(model: Attention, text: str | None) -> float:
    """Probability of quality 1: attention over the encodings of all passages."""
    hidden, weight, whole = [], [], text or ""
    for first in range(0, passage_count(whole), SLAB):
        x = standard(passages(whole, first, SLAB), model.mean, model.scale)
        h = np.tanh(x @ model.w + model.b)
        hidden.append(h)
        weight.append((np.tanh(h @ model.v) * _sigmoid(h @ model.u)) @ model.a)
    h, e = np.concatenate(hidden), np.concatenate(weight)
    e = np.exp(e - e.max())
    return float(_sigmoid((e / e.sum()) @ h @ model.c + model.c0[0]))


def fit_attention(
    bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gates: int = 12, epochs: int = 12, rate: float = 0.01, seed: int = 5
) -> Attention:
    """Encoder, gated attention and score learned together from document labels (Adam on the log loss)."""
    rng = np.random.default_rng(seed)
    everything = np.concatenate(bags)
    mean, scale = everything[:, :-1].mean(0), everything[:, :-1].std(0) + 1e-3
    bags = [standard(b, mean, scale) for b in bags]
    start = lambda *shape: rng.normal(0, 1 / math.sqrt(shape[0]), shape)
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    theta = [start(len(mean), hidden), np.zeros(hidden), start(hidden, gates), start(hidden, gates), start(gates), start(hidden), np.array([math.log(share / (1 - share))])]
    first, second, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            w, b, v, u, a, c, c0 = theta
            x = np.concatenate([bags[i] for i in chosen])
            counts = np.array([len(bags[i]) for i in chosen])
            begins, of = np.cumsum(counts) - counts, np.repeat(np.arange(len(chosen)), counts)
            h = np.tanh(x @ w + b)
            p, q = np.tanh(h @ v), _sigmoid(h @ u)
            e = (p * q) @ a
            e = np.exp(e - np.maximum.reduceat(e, begins)[of])
            weight = e / np.add.reduceat(e, begins)[of]
            z = np.add.reduceat(weight[:, None] * h, begins)
            wrong = (_sigmoid(z @ c + c0[0]) - labels[chosen]) / len(chosen)
            dz = wrong[:, None] * c
            reach = (dz[of] * h).sum(1)
            de = weight * (reach - np.add.reduceat(weight * reach, begins)[of])
            dp, dq = de[:, None] * a * q * (1 - p * p), de[:, None] * a * p * q * (1 - q)
            dh = weight[:, None] * dz[of] + dp @ v.T + dq @ u.T
            dx = dh * (1 - h * h)
            slopes = [x.T @ dx + 1e-4 * w, dx.sum(0), h.T @ dp, h.T @ dq, (p * q).T @ de, z.T @ wrong, np.array([wrong.sum()])]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope * slope
                theta[k] = theta[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    small = [np.asarray(t, dtype=np.float32) for t in theta]
    return Attention(mean.astype(np.float32), scale.astype(np.float32), *small)


def _chosen(sizes: DataFrame, fit_rows: int, fit_passages: int) -> list[tuple]:
    """Of ``(_id, _label, _passages, _digest)`` with distinct ids, those to learn from: (id, label, passages, digest)."""
    placed = sizes.withColumn("_order", F.xxhash64("_id", F.lit("fit")))
    chosen: dict = {}

    def take(rows: DataFrame, number: int, room: int) -> None:
        """The first in order that still fit, at most ``number`` of them."""
        while number > 0 and room > 0:
            asked = number + len(chosen)
            got = rows.filter(F.col("_passages") <= room).orderBy("_order", "_id").limit(asked).collect()
            for r in got:
                if r["_id"] not in chosen and number > 0 and r["_passages"] <= room:
                    chosen[r["_id"]] = (r["_id"], r["_label"], r["_passages"], r["_digest"])
                    number, room = number - 1, room - r["_passages"]
            if len(got) < asked:
                break
            order, last = got[-1]["_order"], got[-1]["_id"]
            rows = rows.filter((F.col("_order") > order) | (F.col("_order") == order) & (F.col("_id") > F.lit(last)))

    for r in placed.select("_label").distinct().orderBy("_label").collect():
        kind, before = placed.filter(F.col("_label") == r["_label"]), len(chosen)
        take(kind, max(1, fit_rows // 8), max(1, fit_passages // 8))
        if len(chosen) == before:
            least = kind.orderBy("_passages", "_order", "_id").first()
            number = min(least["_passages"], max(1, fit_passages // 2))
            chosen[least["_id"]] = (least["_id"], least["_label"], number, least["_digest"])
    take(placed, fit_rows - len(chosen), fit_passages - sum(x[2] for x in chosen.values()))
    return list(chosen.values())


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    fit_rows: int = 4000,
    fit_passages: int = 60_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Attention | None:
    """Learn from labelled documents whose ``crc32(id) % 4`` is not 2.

    At most ``fit_rows`` documents are learned from, first by a hash of the id,
    and whole documents only as long as they have at most ``fit_passages``
    passages together; those passages' features are all that the driver
    gathers.  A document that no longer fits is passed over for those after it.
    An eighth of both bounds is for each kind of label, the rest for any; of a
    kind that has no document as small as its share the smallest is taken, of
    which at most half of ``fit_passages`` are learned from.  Null labels and ids are left out; of several labels the
    largest counts, and of rows with the same id the one with the smallest hash
    of its text.  Without a label of each kind there is no model.
    """
    key = docs[id_col]
    open_rows = docs.filter(key.isNotNull() & (F.crc32(key.cast("string")) % 4 != 2))
    known = labels.filter(labels[label_col].isNotNull()).groupBy(labels[id_col].alias("_known")).agg(F.max(label_col).alias("_label"))
    text = text_or_empty(docs[text_col])
    sizes = open_rows.select(key.alias("_id"), F.struct(F.xxhash64(text).alias("digest"), F.octet_length(text).alias("bytes")).alias("_row"))
    sizes = sizes.groupBy("_id").agg(F.min("_row").alias("_row"))
    sizes = sizes.select("_id", F.greatest(F.lit(1), F.ceil(F.col("_row.bytes") / PASSAGE)).alias("_passages"), F.col("_row.digest").alias("_digest"))
    sizes = sizes.join(known, F.col("_id") == F.col("_known")).select("_id", "_label", "_passages", "_digest")
    chosen = _chosen(cut_lineage(sizes, "labelled"), fit_rows, fit_passages)
    if len({x[1] for x in chosen}) < 2:
        return None
    spark = docs.sparkSession
    wanted = spark.createDataFrame(
        chosen, f"_id {docs.schema[id_col].dataType.simpleString()}, _label int, _number long, _digest long"
    )

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, number, text in zip(batch["label"], batch["number"], batch["text"]):
                yield pd.DataFrame({"label": [label], "bag": [passages(text, 0, number).astype(np.float16).tobytes()]})

    found = (
        open_rows.select(key.alias("_doc"), docs[text_col].alias("text"), F.xxhash64(text).alias("_hash"))
        .join(F.broadcast(wanted), (F.col("_doc") == F.col("_id")) & (F.col("_hash") == F.col("_digest")))
        .select("_doc", F.col("_label").alias("label"), F.col("_number").alias("number"), "text")
        .dropDuplicates(["_doc"])
        .select("label", "number", "text")
    )
    gathered = found.mapInPandas(describe, "label int, bag binary").collect()
    gathered.sort(key=lambda r: (r.label, bytes(r.bag)))
    bags = [np.frombuffer(r.bag, dtype=np.float16).reshape(-1, FEATURES).astype(np.float32) for r in gathered]
    return fit_attention(bags, np.array([float(r.label) for r in gathered]))


def quality_score(model: Attention | None, text: Column, spark) -> Column:
    """Score between 0 and 1 of each text; 0.5 without a model."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([0.5 if sent.value is None else score_text(sent.value, t) for t in batch], dtype=float)

    return score(text)


def score_quality(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **fit: int
) -> DataFrame:
    """Quality of every document, from its text alone.

    A text is cut into passages of ``PASSAGE`` bytes; every passage is encoded,
    gated attention weighs the encodings, and the weighted sum is scored.  Null
    text is empty and has one empty passage.  Null ids count as the empty
    string in the hash and are scored; repeated rows keep their rows; other
    columns are not read; an empty table gives no rows.

    Returns ``(doc_id, held_out, score, predicted)``.
    """
    model = train_quality(docs, labels, id_col=id_col, text_col=text_col, **fit)
    scored = docs.select(
        docs[id_col].alias("doc_id"),
        (F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit(""))) % 4 == 2).alias("held_out"),
        quality_score(model, docs[text_col], docs.sparkSession).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
