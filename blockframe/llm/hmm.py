"""A hidden Markov language model trained by Baum-Welch over the whole corpus."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockframe.llm.common import cut_lineage, text_or_empty

#: A token with at least 1 / HEAVY of all training tokens is looked up in a table
#: sent to the tasks, which so has at most HEAVY rows; one with at least 1 / OWN
#: is a symbol of its own.  Other tokens are symbols by their last bytes.
HEAVY, OWN, SHAPES, ENDING = 1_000_000, 512, 512, 3
#: Words a task counts before it hands its counts on.
COUNTED = 300_000
#: Tokens of a training sequence; longer documents are trained on in pieces.
PIECE = 64
#: Documents encoded at a time.
TOGETHER = 500
ENCODED = ["row", "doc_id", "held_out", "n_tokens", "n_seen", "log_c", "log_own", "codes", "rare", "times"]
END = b""  # the end token; no word is empty


class Model(NamedTuple):
    """Start (K), start of a later training piece (K), transitions (K x K), emissions (K x symbols)."""

    start: np.ndarray
    later: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()


def shape(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % SHAPES


def first_model(unigram: np.ndarray, states: int, seed: int = 7) -> Model:
    """Even starts, sticky transitions, and symbol frequencies tilted at random for each state."""
    rng = np.random.default_rng(seed)
    emit = (unigram + 1e-9) * rng.random((states, len(unigram))) ** 2
    move = np.full((states, states), 0.4 / states) + 0.6 * np.eye(states)
    even = np.full(states, 1 / states)
    return Model(even, even, move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def forward(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each symbol sequence (laid end to end), by the scaled forward recursion."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sorted_lengths, total = lengths[order], np.zeros(len(lengths))
    by_symbol = np.ascontiguousarray(model.emit.T)
    alive = int((sorted_lengths > 0).sum())
    alpha, t = None, 0
    while alive:
        seen = by_symbol[symbols[starts[:alive] + t]]
        alpha = seen * (model.start if alpha is None else alpha[:alive] @ model.move)
        scale = alpha.sum(1)
        alpha /= scale[:, None]
        total[:alive] += np.log10(scale)
        t += 1
        alive = int(np.searchsorted(-sorted_lengths, -t, side="left"))
    out = np.empty(len(lengths))
    out[order] = total
    return out


def expected_counts(model: Model, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, opening: np.ndarray) -> tuple[Model, float]:
    """Baum-Welch counts of pieces of at most ``PIECE`` symbols, and their log10 likelihood."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, opening = starts[order], lengths[order], opening[order]
    states, by_symbol = len(model.start), np.ascontiguousarray(model.emit.T)
    alive = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths[0]) if len(lengths) else 0)]
    alphas, scales, log10 = [], [], 0.0
    for t, n in enumerate(alive):
        before = np.where(opening[:, None], model.start, model.later) if t == 0 else alphas[-1][:n] @ model.move
        alpha = before * by_symbol[symbols[starts[:n] + t]]
        scale = alpha.sum(1)
        alphas.append(alpha / scale[:, None])
        scales.append(scale)
        log10 += float(np.log10(scale).sum())
    counts = Model(np.zeros(states), np.zeros(states), np.zeros((states, states)), np.zeros((states, model.emit.shape[1])))
    beta = np.ones((len(lengths), states))
    seen, weight = [], []
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        gamma = alphas[t] * beta[:n]
        at = symbols[starts[:n] + t]
        seen.append(at)
        weight.append(gamma)
        if t:
            after = by_symbol[at] * beta[:n] / scales[t][:, None]
            counts.move[:] += alphas[t - 1][:n].T @ after
            beta[:n] = after @ model.move.T
        else:
            counts.start[:] = gamma[opening].sum(0)
            counts.later[:] = gamma[~opening].sum(0)
    if seen:
        at, gamma = np.concatenate(seen), np.concatenate(weight)
        for k in range(states):
            counts.emit[k] = np.bincount(at, weights=gamma[:, k], minlength=model.emit.shape[1])
    return counts._replace(move=counts.move * model.move), log10


def flat(model: Model) -> np.ndarray:
    return np.concatenate([x.ravel() for x in model])


def unflat(values: np.ndarray, states: int, symbols: int) -> Model:
    start, later, move, emit = np.split(values, np.cumsum([states, states, states * states]))
    return Model(start, later, move.reshape(states, states), emit.reshape(states, symbols))


def reestimated(counts: Model, unigram: np.ndarray) -> Model:
    """Relative frequencies; a little of the unigram keeps every symbol possible in every state."""

    def rows(x: np.ndarray, little: np.ndarray | float) -> np.ndarray:
        x = x + little
        return x / x.sum(-1, keepdims=True)

    return Model(rows(counts.start, 0.1), rows(counts.later, 0.1), rows(counts.move, 0.1), rows(counts.emit, 2 * unigram))


def score_documents(
    docs: DataFrame, states: int = 6, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Unigram and hidden Markov log10 probability of every document.

    Documents whose ``crc32(id) % 5`` is not 1 are trained on, all of them and
    all their tokens.  Text is lower-cased (A-Z) and cut at ASCII white space;
    an end token follows.  The hidden states emit symbols (frequent tokens, or
    a class of endings); a class emits its tokens by their counts plus one half,
    with a place for an unseen one.  Each round of Baum-Welch adds up expected
    counts in the tasks, then across them.  A score is the exact likelihood of
    the whole document by the scaled forward recursion.

    Counts of rare tokens reach the documents by a join on the token; frequent
    ones, of which there are at most ``HEAVY``, by a table sent to the tasks,
    so no key of the join is hot.  Null text is empty; a null id counts as the
    empty string in the hash.  Rows are kept apart even where ids repeat.
    Without any training token every base score is that of an even
    distribution over one unseen token.

    Returns ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(
        docs[id_col].cast("string").alias("doc_id"),  # pandas would make null and whole numbers floats
        text_or_empty(docs[text_col]).alias("text"),
        (F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit(""))) % 5 == 1).alias("held_out"),
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted: Counter = Counter()

        def told() -> pd.DataFrame:
            words = list(counted)
            return pd.DataFrame({"word": words, "c": np.array([counted[w] for w in words], dtype=np.int64), "shape": np.array([shape(w) for w in words], dtype=np.int32)})

        for batch in batches:
            for text in batch["text"]:
                counted.update(tokens(text))
                counted[END] += 1
                if len(counted) > COUNTED:
                    yield told()
                    counted.clear()
        if counted:
            yield told()

    trained = rows.filter(~F.col("held_out")).select("text")
    counts = cut_lineage(
        trained.mapInPandas(count, "word binary, c long, shape int").groupBy("word", "shape").agg(F.sum("c").alias("c")), "word-counts"
    )
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    heavy = counts.filter(F.col("c") * HEAVY >= n).select("word", "c", "shape").toPandas().sort_values(["c", "word"], ascending=[False, True])
    words, c, shapes = [bytes(w) for w in heavy["word"]], heavy["c"].to_numpy(np.int64), heavy["shape"].to_numpy(np.int64)
    own = (c * OWN >= n) | np.array([w == END for w in words], dtype=bool)
    owned = int(own.sum())
    size = owned + SHAPES  # of the symbols; own symbols come first
    symbol = np.where(own, np.cumsum(own) - 1, owned + shapes)
    of_shape = {r["shape"]: (r["c"], r["v"]) for r in counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()}
    mass, kinds = np.zeros(SHAPES), np.zeros(SHAPES)
    for k, (total, distinct) in of_shape.items():
        mass[k], kinds[k] = total, distinct
    np.subtract.at(mass, shapes[own], c[own])
    np.subtract.at(kinds, shapes[own], 1)
    spread = np.log10(mass + 0.5 * (kinds + 1))  # of the tokens of each class
    unigram = np.concatenate([c[own].astype(float), mass + 0.5])
    unigram /= unigram.sum()
    log_c = np.log10(c + 0.5)
    log_own = np.where(own, 0.0, log_c - spread[shapes])
    known = context.broadcast((words, symbol.astype(np.uint16), log_c, log_own))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, symbol, log_c, log_own = known.value
        place = {w: i for i, w in enumerate(words)}
        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for first in range(0, len(whole), TOGETHER):
                batch, out = whole.iloc[first : first + TOGETHER], []
                for doc, text, held in zip(batch["doc_id"], batch["text"], batch["held_out"]):
                    found = tokens(text)
                    found.append(END)
                    at = np.fromiter(map(place.get, found, repeat(-1)), dtype=np.int64, count=len(found))
                    seen, rare = at[at >= 0], np.flatnonzero(at < 0)
                    codes = np.empty(len(at), dtype=np.uint16)
                    codes[at >= 0] = symbol[seen]
                    odd = [found[i] for i in rare.tolist()]
                    ends = np.array([shape(w) for w in odd], dtype=np.int64)
                    codes[rare] = owned + ends
                    times = Counter(odd)
                    out.append((number, doc, held, len(found), len(seen), float(log_c[seen].sum()),
                                float(log_own[seen].sum() - spread[ends].sum()), codes.tobytes(), list(times), list(times.values())))
                    number += 1
                yield pd.DataFrame(out, columns=ENCODED)

    coded = cut_lineage(
        rows.mapInPandas(
            encode,
            "row long, doc_id string, held_out boolean, n_tokens long, n_seen long, log_c double, log_own double,"
            " codes binary, rare array<binary>, times array<int>",
        ),
        "coded",
    )
    model = first_model(unigram, states)
    for _ in range(rounds if n else 0):
        sent = context.broadcast(model)

        def expect(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            model, total = sent.value, 0.0
            sums = np.zeros(2 * states + states * states + states * size)
            for batch in batches:
                symbols = np.frombuffer(b"".join(batch["codes"]), dtype=np.uint16)
                lengths = batch["codes"].map(len).to_numpy() // 2
                pieces = -(-lengths // PIECE)
                doc = np.repeat(np.arange(len(lengths)), pieces)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                starts = (np.cumsum(lengths) - lengths)[doc] + PIECE * number
                stops = np.minimum(PIECE, lengths[doc] - PIECE * number)
                for a in range(0, len(doc), 8192):
                    b = slice(a, a + 8192)
                    counts, log10 = expected_counts(model, symbols, starts[b], stops[b], number[b] == 0)
                    sums += flat(counts)
                    total += log10
            yield pd.DataFrame({"sums": [sums.tolist()], "log10": [total]})

        told = coded.filter(~F.col("held_out")).select("codes").mapInPandas(expect, "sums array<double>, log10 double")
        added = told.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toPandas()
        model = reestimated(unflat(added.sort_values("at")["x"].to_numpy(), states, size), unigram)
        sent.unpersist()
    fitted = context.broadcast(model)

    @F.pandas_udf("double")
    def likelihood(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for codes in batches:
            lengths = codes.map(len).to_numpy(dtype=np.int64) // 2
            yield pd.Series(forward(fitted.value, np.frombuffer(b"".join(codes), dtype=np.uint16), lengths))

    rare = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row", F.col("t.rare").alias("rare_word"), F.col("t.times").alias("times"))
    found = (
        rare.join(counts.select("word", "c"), F.col("rare_word") == F.col("word"), "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_rare"),
            F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_rare"),
        )
        .withColumnRenamed("row", "of_row")
    )
    scored = coded.select("row", "doc_id", "held_out", "n_tokens", "n_seen", "log_c", "log_own", likelihood("codes").alias("likelihood"))
    extra = F.coalesce("log_rare", F.lit(0.0))
    spread_all = float(np.log10(n + 0.5 * (v + 1)))
    return scored.join(found, F.col("row") == F.col("of_row"), "left").select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_seen") + F.coalesce("n_rare", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_c") + extra - F.col("n_tokens") * spread_all).alias("base_score"),
        (F.col("likelihood") + F.col("log_own") + extra).alias("score"),
    )
