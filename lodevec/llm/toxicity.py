"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as three inputs: a learned vector of the word, the mean of learned vectors of its
character trigrams, and how much likelier the word is in toxic training texts. A GRU runs over a window
of words in each direction, attention pools the states, and a logistic unit scores the window.
A text's score is the highest of all its overlapping windows.

Word inputs are projected onto the gates once for each distinct word and kept in a bounded table, so
the loop over time only adds, multiplies by small matrices and applies the gates.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodevec.llm.common import map_rows, schema_of, text_or_empty, trim, warm

WINDOW, STRIDE = 24, 16
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_ROWS = 8, 6, 6, 4096
VOCABULARY = 8000
#: The classifier is fitted on this many labelled rows at most, those with the least hash of id, as long as they have so many characters together.
TRAIN_ROWS, TRAIN_CHARS = 6000, 24_000_000
#: The table of projected words; words of more characters than this aren't kept from batch to batch.
TABLE_WORDS, LONGEST_KEPT = 150_000, 48
BATCH_WORDS, SLICE_ROWS = 1 << 16, 256
THRESHOLD = 0.7
PULL = 0.2
#: How much a false alarm weighs against a miss, as shares of their kinds, where the score of the threshold is set.
ALARM_WEIGHT = 2.0
STRIP = ".,;:!?\"'()[]|"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def trigram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character table of all trigrams of ``<word>``, and where each word's rows begin."""
    joined = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))  # a word of n characters has n trigrams
    ends = np.cumsum(sizes + 2)
    with np.errstate(over="ignore"):
        mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1]) * np.uint64(0x85EBCA6B) + codes[2:]
        mixed = (mixed * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    keep = np.ones(len(codes), bool)
    keep[ends - 1] = keep[ends - 2] = False
    return (mixed % np.uint64(CHAR_ROWS))[keep[: len(mixed)]].astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1]))


@dataclass
class Model:
    """Weights. ``words`` maps a word to its row; row 0 is any other word."""

    words: dict[str, int]
    odds: np.ndarray
    word_table: np.ndarray
    char_table: np.ndarray
    gates_in: np.ndarray  # (2, inputs, 3H): update, reset, candidate
    gates_back: np.ndarray  # (2, H, 3H)
    gates_bias: np.ndarray  # (2, 3H)
    attend: np.ndarray  # (2H, A)
    attend_out: np.ndarray  # (A,)
    out: np.ndarray  # (2H,)
    bias: np.ndarray  # (1,)
    calibration: tuple[float, float] = (1.0, 0.0)  # of a text's highest logit

    def arrays(self) -> dict[str, np.ndarray]:
        names = ("word_table", "char_table", "gates_in", "gates_back", "gates_bias", "attend", "attend_out", "out", "bias")
        return {n: getattr(self, n) for n in names}

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of words, with the rows they came from."""
        bare = [w.strip(STRIP) or w for w in words]
        rows = np.fromiter((self.words.get(w, 0) for w in bare), np.int64, len(bare))
        grams, starts = trigram_rows(bare)
        sizes = np.diff(np.append(starts, len(grams)))
        mean = np.add.reduceat(self.char_table[grams], starts, axis=0) / sizes[:, None]
        x = np.concatenate((self.word_table[rows], mean, self.odds[rows][:, None]), axis=1)
        return x.astype(np.float32), rows, grams, starts


def new_model(words: dict[str, int], odds: np.ndarray, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[-2] if len(shape) > 1 else 1)).astype(np.float32)
    n = WORD_DIM + CHAR_DIM + 1
    model = Model(words, odds.astype(np.float32), draw(len(odds), WORD_DIM) * 3, draw(CHAR_ROWS, CHAR_DIM) * 8, draw(2, n, 3 * HIDDEN) * 3, draw(2, HIDDEN, 3 * HIDDEN) * 3, np.zeros((2, 3 * HIDDEN), np.float32), draw(2 * HIDDEN, HIDDEN) * 3, draw(HIDDEN), draw(2 * HIDDEN), np.full(1, -2.0, np.float32))
    model.gates_bias[:, :HIDDEN] = -1.0
    return model


def forward(model: Model, projected: tuple[np.ndarray, np.ndarray], ids: np.ndarray, keep: bool = False):
    """Logits of windows of rows ``ids`` (B, T) of the projected word table; row 0 pads and leaves states unchanged."""
    h = HIDDEN
    size, length = ids.shape
    real = (ids > 0).astype(np.float32)
    states = np.zeros((2, length, size, h), np.float32)
    trace = []
    for way in (0, 1):
        state = np.zeros((size, h), np.float32)
        back = model.gates_back[way]
        for step in range(length) if way == 0 else range(length - 1, -1, -1):
            x = projected[way][ids[:, step]]
            gate = _sigmoid(x[:, : 2 * h] + state @ back[:, : 2 * h])
            update, reset = gate[:, :h] * real[:, step, None], gate[:, h:]
            drawn = state * reset
            fresh = np.tanh(x[:, 2 * h :] + drawn @ back[:, 2 * h :])
            if keep:
                trace.append((way, step, state, gate, update, reset, drawn, fresh))
            state = state + update * (fresh - state)
            states[way, step] = state
    both = np.concatenate((states[0], states[1]), axis=2)  # (T, B, 2H)
    inner = np.tanh(both @ model.attend)
    weight = inner @ model.attend_out  # (T, B)
    weight = np.where(real.T > 0, weight, -30.0)
    weight = np.exp(weight - weight.max(0))
    weight /= weight.sum(0)
    pooled = np.einsum("tb,tbh->bh", weight, both)
    logits = pooled @ model.out + model.bias[0]
    return (logits, (real, trace, both, inner, weight, pooled)) if keep else logits


def gradients(model: Model, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean log loss, gradients of the weights behind the inputs, and of the input vectors ``x`` (row 0 pads)."""
    h = HIDDEN
    projected = tuple(x @ model.gates_in[w] + model.gates_bias[w] for w in (0, 1))
    logits, (real, trace, both, inner, weight, pooled) = forward(model, projected, ids, keep=True)
    n = len(labels)
    chance = _sigmoid(logits)
    loss = float(-np.mean(np.log(np.where(labels > 0, chance, 1 - chance) + 1e-7)))
    up = ((chance - labels) / n).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in model.arrays().items() if k not in ("word_table", "char_table")}
    g["out"], g["bias"] = pooled.T @ up, up.sum(keepdims=True)
    d_pooled = up[:, None] * model.out
    d_both = weight[:, :, None] * d_pooled
    d_weight = np.einsum("tbh,bh->tb", both, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    g["attend_out"] = np.einsum("tba,tb->a", inner, d_score)
    d_inner = d_score[:, :, None] * model.attend_out * (1 - inner**2)
    g["attend"] = np.einsum("tbh,tba->ha", both, d_inner)
    d_both = d_both + d_inner @ model.attend.T
    d_projected = [np.zeros_like(p) for p in projected]
    carry = [np.zeros((n, h), np.float32) for _ in (0, 1)]
    for way, step, state, _, update, reset, drawn, fresh in reversed(trace):
        back = model.gates_back[way]
        d_state = d_both[step][:, way * h : (way + 1) * h] + carry[way]
        d_fresh = d_state * update * (1 - fresh**2)
        raw_update = np.where(real[:, step, None] > 0, update, 0)
        d_update = d_state * (fresh - state) * raw_update * (1 - raw_update)
        d_drawn = d_fresh @ back[:, 2 * h :].T
        d_reset = d_drawn * state * reset * (1 - reset)
        d_x = np.concatenate((d_update, d_reset, d_fresh), axis=1)
        carry[way] = d_state * (1 - update) + d_drawn * reset + d_x[:, : 2 * h] @ back[:, : 2 * h].T
        g["gates_back"][way][:, : 2 * h] += state.T @ d_x[:, : 2 * h]
        g["gates_back"][way][:, 2 * h :] += drawn.T @ d_fresh
        np.add.at(d_projected[way], ids[:, step], d_x * real[:, step, None])
    d_inputs = np.zeros_like(x)
    for way in (0, 1):
        g["gates_in"][way] = x.T @ d_projected[way]
        g["gates_bias"][way] = d_projected[way].sum(0)
        d_inputs += d_projected[way] @ model.gates_in[way].T
    return loss, g, d_inputs


def _log_odds(docs: list[set[str]], labels: np.ndarray, vocabulary: list[str]) -> np.ndarray:
    """By how much a word raises the odds of label 1, drawn to 0 for rare words; row 0 is 0."""
    prior = float(np.clip(labels.mean(), 0.01, 0.99))
    seen, bad = Counter(), Counter()
    for words, label in zip(docs, labels, strict=True):
        seen.update(words)
        if label:
            bad.update(words)
    share = np.asarray([(bad[w] + 10 * prior) / (seen[w] + 10) for w in vocabulary])
    return np.concatenate(([0.0], np.log(share / prior)))


def _telling(docs: list[set[str]], labels: np.ndarray) -> list[str]:
    """The vocabulary: half of it the most frequent words, half those that lean most to either label for their number."""
    held = Counter(w for s in docs for w in s)
    bad = Counter(w for s, label in zip(docs, labels, strict=True) if label for w in s)
    prior = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    lean = {w: abs(bad[w] - n * prior) / np.sqrt(n * prior * (1 - prior) + 1) for w, n in held.items() if n > 2}
    often = sorted(held, key=lambda w: (-held[w], w))[: VOCABULARY // 2]
    return sorted({*often, *sorted(lean, key=lambda w: (-lean[w], w))[: VOCABULARY // 2]})


def _cut(rows: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """All overlapping windows of a sequence, the last padded with 0; at least one."""
    n = max(1, -(-(len(rows) - window) // stride) + 1) if len(rows) > window else 1
    whole = np.zeros((n - 1) * stride + window, rows.dtype)
    whole[: len(rows)] = rows
    return np.lib.stride_tricks.sliding_window_view(whole, window)[::stride]


def train(texts: list[str], labels: list[int], epochs: int = 4, steps: int = 300, most_epochs: int = 18, batch: int = 64, seed: int = 7) -> Model:
    """Fit on whole texts: words are weighed on one half, windows of the other half train the network.

    A text stands for its window with the highest sum of word odds; a clean one also for two more at random.
    There are at least ``epochs`` rounds over them and ``steps`` batches; up to ``most_epochs`` rounds for four times as many.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    split = [[intern(w.strip(STRIP) or w) for w in words_of(t)] for t in texts]  # one object a word, as texts are many
    sets = [set(s) for s in split]
    half = np.arange(len(split)) % 2 == 0
    vocabulary = _telling(sets, y)
    words = {w: i + 1 for i, w in enumerate(vocabulary)}
    all_odds = _log_odds(sets, y, vocabulary) if len(split) else np.zeros(len(vocabulary) + 1)
    model = new_model(words, all_odds, seed)
    if not len(split) or y.min() == y.max():
        model.bias[:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else -2.0
        model.out[:] = 0
        return model
    halves = []
    for side in (half, ~half):
        chosen = [i for i in range(len(split)) if side[i]]
        odds = _log_odds([sets[i] for i in range(len(split)) if not side[i]], y[~side], vocabulary)
        for i in chosen:
            local = np.asarray([words.get(w, 0) for w in split[i]], np.int64)
            windows = _cut(np.arange(1, len(local) + 1))
            strength = np.append(0.0, odds[local])[windows].sum(1) if len(local) else np.zeros(1)
            picks = {int(strength.argmax())} | (set(rng.integers(0, len(windows), 2).tolist()) if not y[i] else set())
            halves += [(i, windows[k], odds) for k in sorted(picks)]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.arrays().items()}
    step = 0
    rounds = lambda n: -(-n * batch // max(1, len(halves)))
    epochs = max(epochs, rounds(steps), min(most_epochs, rounds(4 * steps)))
    for epoch in range(epochs):
        order = rng.permutation(len(halves))
        rate = 0.01 * (1 - epoch / (epochs + 1))
        for at in range(0, len(order), batch):
            part = [halves[k] for k in order[at : at + batch]]
            found: dict[tuple, int] = {}
            ids = np.zeros((len(part), WINDOW), np.int64)
            for r, (i, window, odds) in enumerate(part):
                for c, place in enumerate(window):
                    if place:
                        ids[r, c] = found.setdefault((split[i][place - 1], id(odds)), len(found) + 1)
            odds_of = {id(odds): odds for _, _, odds in part}
            if not found:
                continue
            x, rows, grams, starts = model.inputs([w for w, _ in found])
            x[:, -1] = [odds_of[o][words.get(w, 0)] for w, o in found]
            blank = rng.random(len(x)) < 0.15  # some words are met by their characters alone, as unknown ones will be
            x[blank, -1] = 0
            x[blank, :WORD_DIM] = model.word_table[0]
            rows = np.where(blank, 0, rows)
            x = np.concatenate((np.zeros((1, x.shape[1]), np.float32), x))
            _, g, d_x = gradients(model, x, ids, y[[i for i, _, _ in part]])
            d_x = d_x[1:]
            g["word_table"] = np.zeros_like(model.word_table)
            np.add.at(g["word_table"], rows, d_x[:, :WORD_DIM])
            g["char_table"] = np.zeros_like(model.char_table)
            sizes = np.diff(np.append(starts, len(grams)))
            np.add.at(g["char_table"], grams, np.repeat(d_x[:, WORD_DIM : WORD_DIM + CHAR_DIM] / sizes[:, None], sizes, axis=0))
            step += 1
            for name, weights in model.arrays().items():
                first, second = moments[name]
                grad = g[name].reshape(weights.shape)
                first += 0.1 * (grad - first)
                second += 0.01 * (grad * grad - second)
                weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return model


@dataclass
class Scorer:
    """Scores texts in batches; keeps the projections of up to ``TABLE_WORDS`` distinct words."""

    model: Model
    rows: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.rows.clear()
        self.long = False
        self.table = [np.zeros((1024, 3 * HIDDEN), np.float32) for _ in (0, 1)]

    def _learn(self, fresh: list[str]) -> None:
        at = len(self.rows) + 1
        x = self.model.inputs(fresh)[0]
        for way in (0, 1):
            if at + len(fresh) > len(self.table[way]):
                grown = np.zeros((2 * (at + len(fresh)), 3 * HIDDEN), np.float32)
                grown[:at] = self.table[way][:at]
                self.table[way] = grown
            self.table[way][at : at + len(fresh)] = x @ self.model.gates_in[way] + self.model.gates_bias[way]
        self.rows.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        self.long = self.long or max(map(len, fresh)) > LONGEST_KEPT

    def scores(self, texts: list[str]) -> np.ndarray:
        """The highest window score of each text; an empty text is one empty window. About ``BATCH_WORDS`` words are held at a time."""
        out = np.zeros(len(texts))
        held: list[list[str]] = []
        room = 0
        for i, text in enumerate(texts):
            held.append(words_of(text))
            room += len(held[-1])
            if room > BATCH_WORDS or i == len(texts) - 1:
                out[i + 1 - len(held) : i + 1] = self._batch(held)
                held, room = [], 0
        return out

    def _batch(self, split: list[list[str]]) -> np.ndarray:
        if len(self.rows) > TABLE_WORDS or self.long:
            self._reset()
        rows = self.rows
        fresh = list(dict.fromkeys(w for words in split for w in words if w not in rows))
        for at in range(0, len(fresh), 1 << 15):
            self._learn(fresh[at : at + (1 << 15)])
        cut = [_cut(np.fromiter(map(rows.__getitem__, words), np.int32, len(words))) for words in split]
        edges = np.concatenate(([0], np.cumsum([len(c) for c in cut])))
        ids = np.concatenate(cut)
        logits = np.concatenate([forward(self.model, (self.table[0], self.table[1]), ids[k : k + 2048]) for k in range(0, len(ids), 2048)])
        slope, shift = self.model.calibration
        return _sigmoid(slope * np.maximum.reduceat(logits, edges[:-1]).astype(np.float64) + shift)


def scorer_of(model: Model) -> Scorer:
    """The scorer that a worker process keeps for a model, so the words that earlier tasks met stay known."""
    return warm(("toxicity", id(model)), lambda: Scorer(model))


def train_calibrated(texts: list[str], labels: list[int]) -> Model:
    """Train on four of five texts; on the fifth, fit a logistic curve from the highest window to the label.

    The curve is then moved so that ``THRESHOLD`` is where most toxic texts are found for the false alarms.
    """
    last = np.arange(len(texts)) % 5 == 4
    model = train([t for t, x in zip(texts, last, strict=True) if not x], [y for y, x in zip(labels, last, strict=True) if not x])
    y = np.asarray(labels, np.float64)[last]
    if len(y) < 20 or y.min() == y.max():
        return model
    chance = np.clip(Scorer(model).scores([t for t, x in zip(texts, last, strict=True) if x]), 1e-9, 1 - 1e-9)
    x = np.stack((np.log(chance / (1 - chance)), np.ones(len(y))), axis=1)
    weights, start = np.asarray([1.0, 0.0]), np.asarray([1.0, 0.0])

    def loss(w: np.ndarray) -> float:  # with a pull to the raw score, which keeps separable cases finite
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * PULL * np.sum((w - start) ** 2))

    for _ in range(50):
        p = _sigmoid(x @ weights)
        slope = x.T @ (p - y) + PULL * (weights - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PULL * np.eye(2), slope)
        while loss(weights - step) > loss(weights) and np.abs(step).max() > 1e-9:
            step = step / 2
        weights = weights - step
    if weights[0] > 0:
        cut = _best_cut(x @ weights, y)
        model.calibration = (float(weights[0]), float(weights[1] + np.log(THRESHOLD / (1 - THRESHOLD)) - cut))
    return model


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of where the share of found positives less the weighted share of false alarms is greatest."""
    order = np.argsort(-z, kind="stable")
    found, alarms = np.cumsum(y[order]) / y.sum(), np.cumsum(1 - y[order]) / (len(y) - y.sum())
    gain = found - ALARM_WEIGHT * alarms
    at = int(np.flatnonzero(gain >= gain.max() - 1e-9)[-1])
    below = z[order[at + 1]] if at + 1 < len(z) else z[order[at]] - 2
    return float((z[order[at]] + below) / 2)


def held_out(doc_id: Column) -> Column:
    """The rows that labels must not be learnt from: crc32 of the id's text mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Train on the documents of at most ``rows`` labels outside the held-out fold, those with the least hash of their id.

    Documents are taken in that order as long as their texts have at most ``chars`` characters together, so what
    reaches the driver is bounded and no length is left out by itself. Labels with a null id or label aren't learnt
    from; an id that labels repeat counts once, with the highest label; an id that documents repeat counts with each
    text. Without rows of both labels, as of empty tables, the model gives each text the same score. The ids are
    picked before texts are read, so only ``rows`` ids are broadcast and no text is shuffled.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    marked = marked.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.col("id").cast("string"))
    picked = marked.orderBy(order, "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    found = texts.join(F.broadcast(picked), "id").withColumn("place", order).orderBy("place", "id", F.xxhash64("body")).limit(rows)
    # a window over at most ``rows`` rows
    so_far = F.sum(F.length("body")).over(Window.orderBy("place", "id", F.xxhash64("body")).rowsBetween(Window.unboundedPreceding, 0))
    taken = found.withColumn("chars", so_far).where(F.col("chars") <= chars).select("id", "body", "label").collect()
    taken.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[1]))
    texts_of, labels_of = [r[1] for r in taken], [int(r[2] == 1) for r in taken]
    model = train_calibrated(texts_of, labels_of)
    del taken, texts_of, labels_of
    trim()  # the driver goes on beside this
    return model


def score_column(shared: Broadcast, text: Column) -> Column:
    @F.arrow_udf("double")  # type: ignore[call-overload]
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = scorer_of(shared.value)
        for texts in columns:  # a few texts at a time become Python's
            parts = [scorer.scores(texts.slice(at, SLICE_ROWS).to_pylist()) for at in range(0, len(texts), SLICE_ROWS)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0))

    return score(text)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, held_out, score, predicted)``, one row for each row of ``docs``.

    A null text counts as empty; an empty text gets the score of an empty window; repeated rows repeat;
    a null id counts as not held out; an empty table gives an empty result; other columns aren't looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        scorer = scorer_of(shared.value)

        def work(ids: list, texts: list) -> list[tuple]:
            return list(zip(ids, scorer.scores(texts).tolist(), strict=True))

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    found = map_rows(source, setup, schema_of(f"`{id_col}` {kind}, score double"))
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns stay.

    A null text counts as empty; ids aren't looked at, so repeated rows and null ids are judged by their text; an empty
    table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.where(score_column(shared, text_or_empty(text_col)) < threshold)
