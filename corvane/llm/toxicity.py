"""Toxicity: a bidirectional gated recurrent network with attention pooling, over words and their characters.

A word (a run of letters, digits and bytes beyond ASCII; lower-cased A-Z, digits read as the letters they stand in for) enters as its own
vector, by hash, and as the sum of the vectors of its runs of 3 to 5 characters with its ends marked. Windows of WINDOW words that
overlap cover the whole text. In each, one recurrent layer reads forwards and one backwards, attention weighs their joint
states, and the pooled state gives a logit. A text is as toxic as its most toxic window; a logistic curve turns that logit into a score.

The network is trained in numpy by Adam, gradients through time written out below. A label belongs to a document, not to a window, so
training goes in rounds: the windows that now look worst are taken from each document, from toxic ones as examples of 1, from
others (with one window by chance) as examples of 0. Vectors start with the class log ratios of their words and runs in one place, which
also choose the first round's windows. One document in SPARED takes no part in the descent; those fit the logistic curve, weighed by how
common each label is.

The fit reads at most MOST documents of each label (those with the least hash of doc_id, of the labelled rows whose crc32(doc_id)
mod 4 isn't 2) and of these, in that order, at most BYTES of text: one task, one broadcast of that many ids, whatever the corpus. The model is
one row of a few MB. All texts are scored whole.

Edge cases: null, empty and wordless texts have no window and get the score of a logit of the bias; a doc_id with several labels counts as toxic if
one says so, and one with several texts as the least of those; a null label or doc_id isn't learnt from; without labels of both
kinds every score is 0.5; repeated rows each get a row; an empty table gives no rows; a text beyond PASS bytes is read stretch by
stretch, with the same windows as in one piece; runs of more than LONG bytes count as several words; rated() keeps more
columns whatever their names (its own score stands in place of a column of that name), and the query ignores them.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import textkit
from corvane.llm.shared import saved, table
from corvane.llm.windows import ragged

#: Labelled documents of each label that a fit reads at most, and bytes of their texts.
MOST, BYTES = 3_000, 10_000_000
#: Bytes of a character run within a word, and of one at its beginning; a word's ends count as a byte.
ANYWHERE, AHEAD = range(3, 6), range(6, 10)
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 24, 16
#: Of the tables of word and of character vectors; places of a vector; of a recurrent state; of the attention.
WORD_BITS, GRAM_BITS, DIM, STATE, ATTEND = 15, 16, 12, 12, 12
#: Rounds of choosing windows, passes over them in each, examples of a step, rate of Adam.
ROUNDS, EPOCHS, BATCH, RATE = 4, 2, 128, 0.006
#: Shares of words that training shows without their own vector, so that characters must do.
HIDDEN = 0.4
SPARED = 6
LEAST = 0.3
#: Windows that a task handles at once; bytes of text of a pass; bytes of a word.
TOGETHER, PASS, LONG = 2048, 1 << 20, 48

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x30:0x3A] = np.frombuffer(b"oizeasgtbg", np.uint8)
_MULTIPLY = np.random.default_rng(12).integers(1, 1 << 31, 9, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

Model = dict[str, np.ndarray]


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes, start and end of every word, and the rows' word bounds."""
    data = _FOLD[data]
    starts, ends, bounds = textkit.words(data, offsets)
    size = ends - starts
    if len(size) and size.max() > LONG:
        parts = -(-size // LONG)
        place = ragged(np.zeros(len(size), np.int64), parts)
        whole = np.repeat(ends, parts)
        starts = np.repeat(starts, parts) + place * LONG
        ends = np.minimum(starts + LONG, whole)
        bounds = np.concatenate([[0], np.cumsum(parts)])[bounds]
    return data, starts, ends, bounds


def different(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's number among the different ones; their buckets; all their character runs' buckets, and how many each has."""
    hashes = textkit.word_hashes(data, starts, ends)
    kinds, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends[first] - starts[first] + 2
    spread = ragged(starts[first] - 1, size)
    letters = np.concatenate([data, [0x20]])[spread].astype(np.uint32)  # at 0 a word's first place is -1, the last byte
    to = np.cumsum(size)
    letters[to - size], letters[to - 1] = 1, 2
    word = np.repeat(np.arange(len(size)), size)
    runs, owner, h = [], [], np.zeros(len(letters), np.uint32)
    begin = to - size
    for n in range(1, len(_MULTIPLY) + 1):
        h = h[: len(letters) - n + 1] + letters[n - 1 :] * _MULTIPLY[n - 1]
        if n in ANYWHERE:
            at = np.flatnonzero(word[: len(h)] == word[n - 1 :])
        elif n in AHEAD:
            at = begin[size > n]
        else:
            continue
        runs.append(((h[at] ^ h[at] >> np.uint32(15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - GRAM_BITS))
        owner.append(word[at])
    order = np.argsort(np.concatenate(owner), kind="stable")
    return number, (kinds >> np.uint64(64 - WORD_BITS)).astype(np.int64), np.concatenate(runs)[order].astype(np.int64), np.bincount(np.concatenate(owner), minlength=len(kinds))


def windows(bounds: np.ndarray, first: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and words of every window. first: a row's first words are those of its text, so it has a window if it has a word."""
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(-(-(n - (WINDOW - STRIDE)) // STRIDE), int(first)), 0)
    row = np.repeat(np.arange(len(n)), count)
    at = ragged(np.zeros(len(n), np.int64), count) * STRIDE
    return row, bounds[row] + at, np.minimum(WINDOW, n[row] - at)


# The network. Arrays of steps have the step first; f and b are the two directions.


def started(seed: int = 3) -> Model:
    """A network before training."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, by: (rng.normal(size=shape) * by).astype(np.float32)
    model = {"word": draw(1 << WORD_BITS, DIM, by=0.1), "gram": draw(1 << GRAM_BITS, DIM, by=0.1)}
    for side in "fb":
        model |= {f"in_{side}": draw(2 * DIM, 3 * STATE, by=(2 * DIM) ** -0.5), f"again_{side}": draw(STATE, 3 * STATE, by=STATE**-0.5), f"bias_{side}": np.zeros(3 * STATE, np.float32)}
    return model | {"look": draw(2 * STATE, ATTEND, by=(2 * STATE) ** -0.5), "look_bias": np.zeros(ATTEND, np.float32), "weigh": draw(ATTEND, by=ATTEND**-0.5), "out": draw(2 * STATE, by=0.3), "out_bias": np.zeros(1, np.float32)}


def _logistic(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def _inputs(model: Model, bucket: np.ndarray, runs: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The input vectors of different words: their own and their characters'."""
    order = np.argsort(-count, kind="stable")
    at, least = (np.cumsum(count) - count)[order], -count[order]
    chars = np.zeros((len(bucket), DIM), np.float32)
    for k in range(int(-least[0]) if len(least) else 0):  # the k-th run of all words that have so many
        m = int(np.searchsorted(least, -k, "left"))
        chars[:m] += model["gram"].take(runs[at[:m] + k], axis=0)
    chars /= np.sqrt(np.maximum(-least, 1), dtype=np.float32)[:, None]
    out = np.empty((len(bucket), 2 * DIM), np.float32)
    out[:, :DIM], out[order, DIM:] = model["word"].take(bucket, axis=0), chars
    return out


def _read(gates: np.ndarray, number: np.ndarray, again: np.ndarray, there: np.ndarray, back: bool, trail: list | None = None) -> np.ndarray:
    """States of one direction at every step. gates: of each different word; number: steps x windows; trail gets what the way back needs."""
    steps, n = number.shape
    h, out = np.zeros((n, STATE), gates.dtype), np.empty((steps, n, STATE), gates.dtype)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        own, given = h @ again, gates.take(number[t], axis=0)
        zr = _logistic(given[:, : 2 * STATE] + own[:, : 2 * STATE])
        z, r = zr[:, :STATE], zr[:, STATE:]
        new = np.tanh(given[:, 2 * STATE :] + r * own[:, 2 * STATE :])
        before, h = h, new + z * (h - new)
        if not there[t].all():
            h = np.where(there[t][:, None], h, before)
        out[t] = h
        if trail is not None:
            trail.append((t, before, z, r, new, own[:, 2 * STATE :]))
    return out


def _pooled(model: Model, states: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logits of the windows, and the pooled states, the weights of steps and what they are made from."""
    seen = np.tanh(states @ model["look"] + model["look_bias"])
    heat = np.where(there, seen @ model["weigh"], -30.0)
    share = np.exp(heat - heat.max(axis=0))
    share /= share.sum(axis=0)
    pooled = np.einsum("tn,tns->ns", share, states)
    return pooled @ model["out"] + model["out_bias"], pooled, share, seen


def logits(model: Model, gates: tuple[np.ndarray, np.ndarray], at: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Logits of windows. gates: of each different word, by direction; at: windows x steps, the word's number; there: whether it is one."""
    out = np.empty(len(at), np.float32)
    for low in range(0, len(at), TOGETHER):
        number, is_word = at[low : low + TOGETHER].T, there[low : low + TOGETHER].T
        states = np.concatenate([_read(g, number, model[f"again_{side}"], is_word, side == "b") for g, side in zip(gates, "fb", strict=True)], axis=2)
        out[low : low + TOGETHER] = _pooled(model, states, is_word)[0]
    return out


def gates_of(model: Model, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(inputs @ model[f"in_{side}"] + model[f"bias_{side}"] for side in "fb")


def _placed(number: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows x steps: the number of each word, and whether there is one."""
    place = first[:, None] + np.arange(WINDOW)
    there = np.arange(WINDOW) < size[:, None]
    return number[np.where(there, place, first[:, None])], there


def gradients(model: Model, inputs: np.ndarray, at: np.ndarray, there: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, Model, np.ndarray]:
    """The mean weighed log loss of some windows, its gradients by the network's arrays, and by the inputs of the different words."""
    number, is_word = at.T, there.T
    x, trails = inputs[number], {"f": [], "b": []}
    states = np.concatenate([_read(g, number, model[f"again_{side}"], is_word, side == "b", trails[side]) for g, side in zip(gates_of(model, inputs), "fb", strict=True)], axis=2)
    logit, pooled, share, seen = _pooled(model, states, is_word)
    p = _logistic(logit)
    loss = float((weight * np.where(y > 0, np.logaddexp(0, -logit), np.logaddexp(0, logit))).mean())
    d_logit = (weight * (p - y) / len(y)).astype(x.dtype)
    found = {"out": pooled.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * model["out"]
    d_states = share[:, :, None] * d_pooled
    d_share = np.einsum("tns,ns->tn", states, d_pooled)
    d_heat = np.where(is_word, share * (d_share - (share * d_share).sum(axis=0)), 0).astype(x.dtype)
    found["weigh"] = np.einsum("tn,tna->a", d_heat, seen)
    d_seen = d_heat[:, :, None] * model["weigh"] * (1 - seen * seen)
    found["look"], found["look_bias"] = np.einsum("tns,tna->sa", states, d_seen), d_seen.sum(axis=(0, 1))
    d_states = d_states + d_seen @ model["look"].T
    d_x = np.zeros_like(x)
    for k, side in enumerate("fb"):
        again = model[f"again_{side}"]
        d_gates, d_again, d_h = np.zeros((*x.shape[:2], 3 * STATE), x.dtype), np.zeros_like(again), np.zeros((x.shape[1], STATE), x.dtype)
        for t, before, z, r, new, own in reversed(trails[side]):
            d_h = d_h + d_states[t, :, k * STATE : (k + 1) * STATE]
            passed = np.where(is_word[t][:, None], d_h, 0)
            d_new = passed * (1 - z) * (1 - new * new)
            d_z, d_r = passed * (before - new) * z * (1 - z), d_new * own * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            d_own = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_again += before.T @ d_own
            d_h = passed * z + np.where(is_word[t][:, None], 0, d_h) + d_own @ again.T
        found |= {f"again_{side}": d_again, f"bias_{side}": d_gates.sum(axis=(0, 1)), f"in_{side}": np.einsum("tni,tng->ig", x, d_gates)}
        d_x += d_gates @ model[f"in_{side}"].T
    flat = number.ravel()
    d_inputs = np.stack([np.bincount(flat, c, len(inputs)) for c in d_x.reshape(-1, d_x.shape[2]).T], axis=1).astype(x.dtype)
    return loss, found, d_inputs


class _Adam:
    """Steps by the mean and the spread of gradients so far."""

    def __init__(self, model: Model):
        self.model, self.n = model, 0
        self.mean = {k: np.zeros_like(v) for k, v in model.items()}
        self.spread = {k: np.zeros_like(v) for k, v in model.items()}

    def step(self, found: Model) -> None:
        self.n += 1
        rate = RATE * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, g in found.items():
            m, s = self.mean[k], self.spread[k]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            self.model[k] -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)


class _Sample:
    """The labelled documents of a fit: their words by number, the different words, and all windows."""

    def __init__(self, texts: list[str], labels: list[int]):
        raw = [x.encode() for x in texts]
        data, starts, ends, bounds = words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
        self.number, self.bucket, self.runs, self.count = different(data, starts, ends)
        self.run_at = np.cumsum(self.count) - self.count
        self.label, self.bounds = np.array(labels), bounds
        self.row, self.first, self.size = windows(bounds)

    def ratios(self) -> tuple[np.ndarray, np.ndarray]:
        """Class log ratios of the buckets of words and of character runs, by the documents that have them."""
        word, gram = np.ones((2, 1 << WORD_BITS)), np.ones((2, 1 << GRAM_BITS))
        for k, label in enumerate(self.label):
            kinds = np.unique(self.number[self.bounds[k] : self.bounds[k + 1]])
            word[label, np.unique(self.bucket[kinds])] += 1
            gram[label, np.unique(self.runs[ragged(self.run_at[kinds], self.count[kinds])])] += 1
        n = np.bincount(self.label, minlength=2) + 2
        return tuple(np.log(x[1] / n[1]) - np.log(x[0] / n[0]) for x in (word, gram))

    def worst(self, value: np.ndarray, of: np.ndarray, most: int) -> np.ndarray:
        """The windows of the greatest value of each of some documents, at most so many of each."""
        order = np.lexsort((-value, self.row))
        place = np.arange(len(order)) - np.searchsorted(self.row[order], self.row[order])
        return order[(place < most) & of[self.row[order]]]

    def logits(self, model: Model) -> np.ndarray:
        """Of all windows, the different words' gates some million words at a time."""
        out, step = np.empty(len(self.row), np.float32), TOGETHER * 4
        for low in range(0, len(out), step):
            at, there = _placed(self.number, self.first[low : low + step], self.size[low : low + step])
            kinds, own = np.unique(at, return_inverse=True)
            inputs = _inputs(model, self.bucket[kinds], self.runs[ragged(self.run_at[kinds], self.count[kinds])], self.count[kinds])
            out[low : low + step] = logits(model, gates_of(model, inputs), own.reshape(at.shape), there)
        return out

    def greatest(self, value: np.ndarray, bias: float) -> np.ndarray:
        """Each document's greatest window."""
        out = np.full(len(self.label), -np.inf)
        np.maximum.at(out, self.row, value)
        return np.where(np.isinf(out), bias, out)


def _learn(model: Model, sample: _Sample, chosen: np.ndarray, adam: _Adam, rng: np.random.Generator) -> None:
    """One pass over chosen windows."""
    label = sample.label[sample.row[chosen]]
    n = np.bincount(label, minlength=2)
    weight = np.where(label > 0, min(3.0, n[0] / max(n[1], 1)), 1.0).astype(np.float32)
    order = rng.permutation(len(chosen))
    for low in range(0, len(order), BATCH):
        part = order[low : low + BATCH]
        at, there = _placed(sample.number, sample.first[chosen[part]], sample.size[chosen[part]])
        kinds, own = np.unique(at, return_inverse=True)
        count, bucket = sample.count[kinds], sample.bucket[kinds]
        runs = sample.runs[ragged(sample.run_at[kinds], count)]
        inputs = _inputs(model, bucket, runs, count)
        shown = (rng.random(len(kinds)) >= HIDDEN).astype(np.float32)[:, None]
        inputs[:, :DIM] *= shown
        _, found, d_inputs = gradients(model, inputs, own.reshape(at.shape), there, label[part].astype(np.float32), weight[part])
        scaled = np.repeat(d_inputs[:, DIM:] / np.sqrt(np.maximum(count, 1))[:, None], count, axis=0)
        found["gram"] = np.stack([np.bincount(runs, c, 1 << GRAM_BITS) for c in scaled.T], axis=1)
        found["word"] = np.stack([np.bincount(bucket, c, 1 << WORD_BITS) for c in (d_inputs[:, :DIM] * shown).T], axis=1)
        adam.step(found)


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and place of the logistic curve of x that fits labels best, with smoothed labels, by Newton's steps."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    aim = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _logistic(a * x + b)
        g = np.array([(weight * (p - aim) * x).sum() + 0.01 * (a - 1), (weight * (p - aim)).sum() + 0.01 * b])
        s = weight * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * x * x).sum() + 0.01, (s * x).sum()], [(s * x).sum(), s.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def trained(texts: list[str], labels: list[int], commonness: float = 0.5, seed: int = 3) -> Model:
    """A network for some labelled texts. commonness: how common label 1 is where the scores are used."""
    model, rng = started(seed), np.random.default_rng(seed)
    model["curve"] = np.array([0.0, 0.0])
    if len(set(labels)) < 2:
        return model
    sample = _Sample(texts, labels)
    learnt = np.arange(len(labels)) % SPARED > 0
    if len(set(sample.label[learnt])) < 2:
        learnt[:] = True
    spared = ~learnt if len(set(sample.label[~learnt])) == 2 else np.ones(len(labels), bool)
    word, gram = sample.ratios()
    model["word"][:, 0], model["gram"][:, 0] = word / 4, gram / 8
    hint = word[sample.bucket] + np.add.reduceat(gram[sample.runs], sample.run_at) / np.sqrt(sample.count) if len(sample.runs) else np.zeros(0)
    value = np.maximum.reduceat(np.append(hint[sample.number], -np.inf), np.stack([sample.first, sample.first + sample.size], axis=1).ravel())[::2] if len(sample.row) else np.zeros(0)
    adam = _Adam({k: v for k, v in model.items() if k != "curve"})
    for k in range(ROUNDS):
        value = sample.logits(model) if k else value
        bad, other = learnt & (sample.label > 0), learnt & (sample.label == 0)
        by_chance = sample.worst(rng.random(len(value)), other, 1)
        chosen = np.unique(np.concatenate([sample.worst(value, bad, 1), sample.worst(value, other, 2), by_chance]))
        for _ in range(EPOCHS):
            _learn(model, sample, chosen, adam, rng)
    greatest = sample.greatest(sample.logits(model), float(model["out_bias"][0]))
    y, share = sample.label[spared], sample.label[spared].mean()
    weight = np.where(y > 0, commonness / share, (1 - commonness) / (1 - share))
    model["curve"] = np.array(_curve(greatest[spared].astype(np.float64), y, weight))
    return model


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one model row, from rows in order of place, as long as BYTES allows."""
    texts, labels, total, commonness = [], [], 0, 0.5
    for batch in batches:
        for label, text, share in zip(*(batch.column(c).to_pylist() for c in ("label", "text", "commonness")), strict=True):
            total += len(text.encode())
            if total <= BYTES or not texts:
                texts.append(text)
                labels.append(label)
                commonness = share
    store = io.BytesIO()
    np.savez(store, **trained(texts, labels, commonness))
    yield pa.record_batch([pa.array([store.getvalue()], pa.binary())], ["model"])


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A network learnt from at most MOST documents of each label that aren't held out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    known = known.withColumn("place", F.xxhash64("doc_id"))
    total, bad = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    chosen = saved(known.where("label = 1").orderBy("place", "doc_id").limit(MOST).union(known.where("label = 0").orderBy("place", "doc_id").limit(MOST)), "chosen")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("place", "doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")).withColumn("commonness", F.lit(min(max(bad / max(total, 1), 0.01), 0.99)))
    texts = saved(texts.select("place", "label", "text", "commonness"), "labelled")
    row = texts.repartition(1).sortWithinPartitions("place", "text").mapInArrow(_fit, "model binary").first()
    if row is None:
        return started() | {"curve": np.array([0.0, 0.0])}
    with np.load(io.BytesIO(row["model"])) as store:
        return dict(store)


def _greatest(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, first: bool = True, most: int | None = None) -> np.ndarray:
    """The greatest logit of each row's windows (-inf: it has none). most: how many windows of a single row count."""
    out = np.full(len(bounds) - 1, -np.inf)
    row, at, size = (x[:most] for x in windows(bounds, first))
    if len(row):
        number, bucket, runs, count = different(data, starts, ends)
        placed, there = _placed(number, at, size)
        np.maximum.at(out, row, logits(model, gates_of(model, _inputs(model, bucket, runs, count)), placed, there))
    return out


def _of_long(model: Model, data: np.ndarray) -> float:
    """The greatest logit of one long text, stretch by stretch; the next one begins with the first window that isn't complete here."""
    best, at, span = -np.inf, 0, PASS
    while True:
        stop = min(len(data), at + span)
        folded, starts, ends, bounds = words(data[at:stop], np.array([0, stop - at]))
        if stop == len(data):
            return max(best, float(_greatest(model, folded, starts, ends, bounds, at == 0)[0]))
        full = (len(starts) - 1 - WINDOW) // STRIDE + 1  # the last word may go on
        if full < 1:
            span *= 2
            continue
        best = max(best, float(_greatest(model, folded, starts, ends, bounds, True, full)[0]))
        at, span = at + int(starts[full * STRIDE]), PASS


def scores(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with a score for each row."""
    slope, shift = model["curve"]
    for batch, data, offsets in textkit.passes(batches, "text", PASS):
        found = np.array([_of_long(model, data)]) if batch.num_rows == 1 and len(data) > 2 * PASS else _greatest(model, *words(data, offsets))
        found = np.where(np.isinf(found), model["out_bias"][0], found)
        yield batch, np.round(_logistic(slope * found + shift), 6)


def rated(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all by default) of docs with score: 0 to 1, higher where label 1 is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep or docs.columns if c != "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in scores(shared.value, batches):
            yield batch.select(keep).append_column("score", pa.array(found))

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(score, f"{schema}, score double")


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = rated(docs, fitted(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
