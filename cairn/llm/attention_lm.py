"""Causal self-attention language model in numpy (operator 6).

A text is lower-cased (A-Z) and split at ASCII white space; each word, with a blank before it, is cut into subword ids
of a public vocabulary, and an end follows. The attention model predicts slots: the most frequent subwords have one each,
the rest share BINS slots of subwords that can stand at like places, so p(subword) = p(slot | before) * p(subword | slot).
The second factor comes from the counts of the whole training corpus; the first from one layer of causal self-attention
over the last CONTEXT subwords with a learned bias for each distance, then a feed-forward layer and a softmax in two
steps, class and slot within it. Texts are scored in overlapping windows: each has CONTEXT + SCORED inputs, attention is
masked to the past, and only the last SCORED positions are scored, so every subword is scored once with its full context;
windows of many texts make one batch.

A word's probability interpolates the attention model's (the product over its subwords, a) with the word counts of the
whole training corpus by absolute discounting: (1 - MIX) * max(c - d, 0) / N + (MIX + (1 - MIX) * d * V / N) * a, with
d = n1 / (n1 + 2 * n2) of the words that stand once and twice. So what the model knows grows with the corpus.

Training, by Adam with the gradients written out below, has two parts. A start is trained on whole documents, chosen by a
hash, of START_SPANS spans of SPAN targets at most. Then every subword of every training document is a target of one span, and
in each of ROUNDS rounds, which share the spans, tasks train from the same parameters, each on its own spans once, and the
parameters that they reach are averaged. So the work grows with the corpus, and the steps one after the other do not.

Counts of words cover all training documents; those of at most FREQUENT words go to every task, all others are joined by
word, so the table's size is bounded and no word is dropped.

Cases: a null text is the empty one: just an end; documents without training rows: the base gives 1 to all, the model's
slots are nearly equally likely; repeated rows are scored each, and rows that share a doc_id too; a null doc_id counts as the empty text in
the split; very long texts are scored whole, in batches of windows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import ctypes
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.taskcontext import TaskContext

from cairn.llm.common import discard, documents, id_crc, slices, stored
from cairn.llm.shingles import span_hashes, word_spans

CLASSES, EACH, BINS, WIDTH, HIDDEN, CONTEXT, SCORED = 32, 32, 63, 32, 64, 16, 16
SLOTS = CLASSES * EACH
BATCH, RATE, START_STEPS, START_SPANS, EPOCHS, ROUNDS, SHARE = 128, 4e-3, 2000, 1 << 16, 6, 2, 1 << 15
SPAN, EVERY = 48, 2048
FREQUENT, REMEMBERED = 1 << 18, 200_000
ADD, MIX = 0.1, 0.6
LIMIT = 60.0  # of logits in training, on either side
START, NONE = SLOTS, SLOTS + 1  # what stands before a text, as an input only; no subword
BLANK = re.compile(rb"[\t-\r ]+")


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII letters and white space alone, as is meant."""
    return (text or "").encode().lower().split()


class Subwords:
    """Words to subword ids: each word is encoded with a blank before it."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.size, self.ranks = max(ranks.values()) + 1, ranks
        self.coder = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.starts = np.zeros(self.size, bool)
        self.starts[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each word has. One call for many words where the blanks tell them apart."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = " " + b" ".join(words).decode()
        if len(text.split()) == len(words):
            ids = self.coder.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            first = np.flatnonzero(self.starts[ids])
            if len(first) == len(words):
                return ids, np.diff(np.append(first, len(ids)))
        each = [self.coder.encode_ordinary(" " + word.decode()) for word in words]
        return np.array([i for ids in each for i in ids], np.int64), np.array([len(ids) for ids in each])


@dataclass
class Model:
    """slot_of and log_share (log10 p(subword | slot)) by subword id, the end last; p: the parameters."""

    slot_of: np.ndarray
    log_share: np.ndarray
    p: dict[str, np.ndarray]

    def __post_init__(self):
        # all that depends on one or two slots alone is looked up: attention before its bias, values, and their sums
        p = self.p
        dots = (p["E"] @ p["Wq"]) @ (p["E"] @ p["Wk"]).T / math.sqrt(WIDTH)
        self.pair = np.exp(np.minimum(dots, 40)).astype(np.float32).reshape(-1)
        self.away = np.exp(distance_bias(p["r"])).astype(np.float32)
        one = lambda w, column: np.ascontiguousarray(np.hstack([w, np.full((len(w), 1), column)]), np.float32)
        self.values = one(p["E"] @ p["Wv"], 1)  # the column of ones sums the weights
        self.own = p["E"].astype(np.float32)
        self.hidden = np.vstack([p["W1"], p["b1"]]).astype(np.float32)
        self.classes = np.vstack([p["C"], p["cc"]]).astype(np.float32)
        out = np.vstack([p["U"], p["c"]]).astype(np.float32)
        self.out = [np.ascontiguousarray(out[:, k * EACH : (k + 1) * EACH]) for k in range(CLASSES)]
        self.ones = np.ones(max(CLASSES, EACH), np.float32)

    def attended(self, x: np.ndarray) -> np.ndarray:
        """The last layer's inputs, with a column of ones, for the places after inputs x (n, CONTEXT + SCORED)."""
        x = x.astype(np.int64)
        own = x[:, CONTEXT:]
        a = self.pair.take(own[:, :, None] * (SLOTS + 1) + x[:, None, :], mode="clip")  # faster; all are in bounds
        a *= self.away
        h = np.matmul(a, self.values.take(x, axis=0, mode="clip")).reshape(-1, WIDTH + 1)
        h /= h[:, WIDTH:].copy()  # leaves 1 in the last column, which carries the biases
        h[:, :WIDTH] += self.own.take(own.reshape(-1), axis=0)
        z = h @ self.hidden
        np.maximum(z, 0, out=z)
        h[:, :WIDTH] += z @ self.p["W2"]
        return h

    def target_scores(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log10 p of the targets y, 0 where y is no slot."""
        out = np.zeros(len(y), np.float32)
        rows = np.flatnonzero(y < SLOTS)
        kind = (y[rows] // EACH).astype(np.uint8)
        rows = rows[np.argsort(kind, kind="stable")]
        h, y = h.take(rows, axis=0), y[rows].astype(np.int64)
        each, logits, at = np.arange(len(rows)), np.empty((len(rows), EACH), np.float32), 0
        for k, end in enumerate(np.cumsum(np.bincount(kind, minlength=CLASSES)).tolist()):
            if at < end:
                np.matmul(h[at:end], self.out[k], out=logits[at:end])
                at = end
        there = logits[each, y % EACH]
        np.exp(logits, out=logits)
        total = logits @ self.ones
        logits = h @ self.classes
        there += logits[each, y // EACH]
        np.exp(logits, out=logits)
        out[rows] = (there - np.log(total * (logits @ self.ones))) * np.float32(1 / math.log(10))
        return out

    def slot_scores(self, slots: np.ndarray, lengths: np.ndarray, at_once: int = 2048, block: int = 128) -> np.ndarray:
        """log10 p of each slot of many texts, whose slots stand one after the other (each has one at least)."""
        windows = -(-lengths // SCORED)
        room = CONTEXT + 1 + windows * SCORED
        begin = np.cumsum(room) - room
        flat = np.full(int(room.sum()), NONE, np.int16)
        for i in range(CONTEXT + 1):
            flat[begin + i] = START
        shift = begin + CONTEXT + 1 - (np.cumsum(lengths) - lengths)
        flat[np.arange(len(slots)) + np.repeat(shift, lengths)] = slots
        first = np.cumsum(windows) - windows
        starts = np.repeat(begin, windows) + SCORED * (np.arange(int(windows.sum())) - np.repeat(first, windows))
        out = np.empty((len(starts), SCORED), np.float32)
        for at in range(0, len(starts), at_once):
            x, y = windows_at(flat, starts[at : at + at_once])
            h = np.concatenate([self.attended(x[i : i + block]) for i in range(0, len(x), block)])
            out[at : at + at_once] = self.target_scores(h, y.reshape(-1)).reshape(-1, SCORED)
        # the targets of a text's windows stand in order; only its last window has places without one
        return out.reshape(-1)[np.arange(len(slots)) + np.repeat(first * SCORED - (np.cumsum(lengths) - lengths), lengths)]


def windows_at(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (places without a slot read as START) and targets of the windows at `starts`."""
    s = starts[:, None]
    x = flat[s + np.arange(CONTEXT + SCORED)]
    return np.where(x == NONE, START, x), flat[s + np.arange(CONTEXT + 1, CONTEXT + 1 + SCORED)]


def distance_bias(r: np.ndarray) -> np.ndarray:
    """The mask and bias for query i (input CONTEXT + i) and key j: r of their distance, or minus infinity."""
    away = CONTEXT + np.arange(SCORED)[:, None] - np.arange(CONTEXT + SCORED)[None, :]
    return np.where((away >= 0) & (away <= CONTEXT), r[np.clip(away, 0, CONTEXT)], -1e4)


def start_parameters(rng: np.random.Generator, slot_counts: np.ndarray) -> dict[str, np.ndarray]:
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    counts = slot_counts + 1
    by_class = counts.reshape(CLASSES, EACH).sum(1)
    return {
        "E": normal(SLOTS + 1, WIDTH, scale=0.3),
        "Wq": normal(WIDTH, WIDTH, scale=0.2), "Wk": normal(WIDTH, WIDTH, scale=0.2), "Wv": normal(WIDTH, WIDTH, scale=0.2),
        "r": np.zeros(CONTEXT + 1, np.float32),
        "W1": normal(WIDTH, HIDDEN, scale=0.2), "b1": np.zeros(HIDDEN, np.float32), "W2": normal(HIDDEN, WIDTH, scale=0.1),
        "C": normal(WIDTH, CLASSES, scale=0.1), "cc": np.log(by_class / by_class.sum()).astype(np.float32),
        "U": normal(WIDTH, SLOTS, scale=0.1), "c": np.log(counts / np.repeat(by_class, EACH)).astype(np.float32),
    }


def keep_memory() -> None:
    """Lets this process keep memory that is freed: glibc gives back arrays of some hundred KB, and each step would ask for new pages."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, 1 << 24)  # M_MMAP_THRESHOLD: larger ones are given back
        mallopt(-1, 1 << 26)  # M_TRIM_THRESHOLD


def soft_step(logits: np.ndarray, target: np.ndarray) -> float:
    """The summed loss of targets; logits, which it keeps within LIMIT, become its gradient."""
    rows = np.arange(len(target))
    np.clip(logits, -LIMIT, LIMIT, out=logits)
    there = logits[rows, target].sum(dtype=np.float64)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    logits *= (1 / total)[:, None]
    logits[rows, target] -= 1
    return float(np.log(total).sum(dtype=np.float64) - there)


def equal_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, list[int]]]:
    """The different values of x, each place's among them, and how `row_sums` adds what stands at their places: those of each
    value, filled up with the place len(x) to 1, 2, 4, .. and how many values have so many."""
    order = np.argsort(x, kind="stable")
    first = np.flatnonzero(np.diff(x[order], prepend=-1))
    counts = np.diff(np.append(first, len(x)))
    kind = np.ceil(np.log2(counts)).astype(np.int64)
    by_kind = np.argsort(kind, kind="stable")
    rank, at = np.empty_like(by_kind), np.empty_like(order)
    rank[by_kind] = np.arange(len(by_kind))
    at[order] = np.repeat(rank, counts)
    first, counts, size = first[by_kind], counts[by_kind], 1 << kind[by_kind]
    each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    places = np.where(each < np.repeat(counts, size), order.take(np.repeat(first, size) + each, mode="clip"), len(x))
    return x[order[first]], at, (places, np.bincount(kind).tolist())


def row_sums(rows: np.ndarray, places: np.ndarray, kinds: list[int]) -> np.ndarray:
    """The sums of rows (the last one is of zeros) for each value; add.reduceat takes several times as long."""
    rows, out, at = rows.take(places, axis=0), [], 0
    for k, n in enumerate(kinds):
        out.append(rows[at : at + (n << k)].reshape(n, 1 << k, rows.shape[1]).sum(1))
        at += n << k
    return np.concatenate(out)


def with_ones(t: np.ndarray) -> np.ndarray:
    """t and a column of ones, which carries the biases."""
    out = np.empty((len(t), t.shape[1] + 1), t.dtype)
    out[:, :-1], out[:, -1] = t, 1
    return out


def in_windows(t: np.ndarray) -> np.ndarray:
    """Of t (n, places, width): a view of the CONTEXT + SCORED places of each window."""
    n, places, width = t.shape
    a, b, c = t.strides
    return np.lib.stride_tricks.as_strided(t, (n, (places - CONTEXT) // SCORED, CONTEXT + SCORED, width), (a, SCORED * b, b, c))


def loss_and_gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean loss in nats over the targets y that are slots, and its gradients. x: CONTEXT inputs more than y has targets, which
    are one window or several that follow each other. What depends on one slot alone is computed once for each."""
    scale, dtype = 1 / math.sqrt(WIDTH), p["E"].dtype
    n, places = x.shape
    some, at, sums = equal_rows(x.reshape(-1).astype(np.int16))
    e = p["E"][some]
    at = at.reshape(n, places)
    own_at = np.ascontiguousarray(at[:, CONTEXT:])
    windows = (n, (places - CONTEXT) // SCORED, SCORED, -1)
    flat = lambda t: t.reshape(-1, t.shape[-1])
    k, v = (in_windows((e @ p[w]).take(at, axis=0)) for w in ("Wk", "Wv"))
    q = (e @ p["Wq"] * scale).take(own_at, axis=0).reshape(windows)
    a = q @ k.transpose(0, 1, 3, 2)
    np.clip(a, -LIMIT, LIMIT, out=a)
    np.exp(a, out=a)
    a *= np.exp(distance_bias(p["r"])).astype(dtype)
    part = 1 / (flat(a) @ np.ones(a.shape[-1], dtype))[:, None]
    seen = flat(a @ v)
    seen *= part
    h = with_ones(seen)
    h[:, :WIDTH] += e.take(own_at.reshape(-1), axis=0)
    relu = h @ np.vstack([p["W1"], p["b1"]])
    np.maximum(relu, 0, out=relu)
    last = relu @ p["W2"]
    last += h[:, :WIDTH]
    y = y.reshape(-1)
    rows = np.flatnonzero(y < SLOTS)
    kind = (y[rows] // EACH).astype(np.int16)
    order = np.argsort(kind, kind="stable")
    rows, kind = rows[order], kind[order]
    y, targets = y[rows], max(1, len(rows))
    g = with_ones(last.take(rows, axis=0))
    d = g @ np.vstack([p["C"], p["cc"]])
    loss = soft_step(d, kind)
    back, dg, d = g.T @ d, d @ p["C"].T, np.empty((len(rows), EACH), dtype)
    out = {"C": back[:WIDTH], "cc": back[WIDTH]}
    slots, back, more = np.vstack([p["U"], p["c"]]), np.zeros((WIDTH + 1, SLOTS), dtype), np.empty_like(dg)
    ends = np.cumsum(np.bincount(kind, minlength=CLASSES)).tolist()
    parts = [(slice(low, high), slice(i * EACH, (i + 1) * EACH)) for i, (low, high) in enumerate(zip([0, *ends], ends, strict=False)) if low < high]
    for own, block in parts:
        np.matmul(g[own], slots[:, block], out=d[own])
    loss += soft_step(d, y.astype(np.int64) % EACH)
    for own, block in parts:
        np.matmul(g[own].T, d[own], out=back[:, block])
        np.matmul(d[own], p["U"][:, block].T, out=more[own])
    dg += more
    out |= {"U": back[:WIDTH], "c": back[WIDTH]}
    dh = np.zeros_like(last)
    dh[rows] = dg
    dz = dh @ p["W2"].T
    dz *= relu > 0
    back = h.T @ dz
    out |= {"W2": relu.T @ dh, "W1": back[:WIDTH], "b1": back[WIDTH]}
    dh += dz @ p["W1"].T
    # of keys, values, queries and inputs, side by side; the last row stays 0
    whole = np.zeros((n * places + 1, 4 * WIDTH), dtype)
    by_place = whole[:-1].reshape(n, places, -1)
    by_place[:, CONTEXT:, 3 * WIDTH :] = dh.reshape(n, -1, WIDTH)
    dh *= part
    ds = dh.reshape(windows) @ v.transpose(0, 1, 3, 2)
    flat(ds)[...] -= np.vecdot(dh, seen)[:, None]
    ds *= a
    total = ds.sum((0, 1))
    out["r"] = np.array([np.diagonal(total, CONTEXT - t).sum() for t in range(CONTEXT + 1)], total.dtype)
    by_place[:, CONTEXT:, 2 * WIDTH : 3 * WIDTH] = (ds @ k).reshape(n, -1, WIDTH)
    for i, back in enumerate((ds.transpose(0, 1, 3, 2) @ q, a.transpose(0, 1, 3, 2) @ dh.reshape(windows))):
        for j in range(windows[1]):
            by_place[:, j * SCORED : (j + 1) * SCORED + CONTEXT, i * WIDTH : (i + 1) * WIDTH] += back[:, j]
    dk, dv, dq, de = np.split(row_sums(whole, *sums), 4, axis=1)
    dq = dq * scale
    out |= {"Wq": e.T @ dq, "Wk": e.T @ dk, "Wv": e.T @ dv, "E": np.zeros_like(p["E"])}
    out["E"][some] = de + dk @ p["Wk"].T + dv @ p["Wv"].T + dq @ p["Wq"].T
    return loss / targets, {name: w / targets for name, w in out.items()}


def train(p: dict[str, np.ndarray], spans: np.ndarray, steps: int, rates: tuple[float, float], seed: int) -> dict[str, np.ndarray]:
    """p after steps on spans (rows of slots) of BATCH windows in all, in an order by chance, every span as often as any other but
    for one time; the rate falls in a line."""
    keep_memory()
    rng, names = np.random.default_rng(seed), list(p)
    if not len(spans) or not steps:
        return {n: w.copy() for n, w in p.items()}
    one, cuts = np.concatenate([p[n].reshape(-1) for n in names]), np.cumsum([0, *(p[n].size for n in names)]).tolist()
    p = {n: one[a:b].reshape(p[n].shape) for n, a, b in zip(names, cuts, cuts[1:], strict=False)}  # views of one
    m, v, step_of = np.zeros_like(one), np.zeros_like(one), np.empty_like(one)
    order, at = rng.permutation(len(spans)), 0
    for step in range(1, steps + 1):
        if at >= len(order):
            order, at = rng.permutation(len(spans)), 0
        before, at = at, at + step * BATCH // (SPAN // SCORED) - (step - 1) * BATCH // (SPAN // SCORED)
        own = spans.take(order[before:at], axis=0)
        x, y = own[:, :-1], own[:, CONTEXT + 1 :]
        x = np.where(x == NONE, START, x)
        _, grads = loss_and_gradients(p, x, y)
        g = np.concatenate([grads[n].reshape(-1) for n in names])
        rate = min(1, step / 50) * (rates[0] + (rates[1] - rates[0]) * step / steps)
        m *= 0.9
        m += np.multiply(g, 0.1, out=step_of)
        g *= g
        g *= 0.01
        v *= 0.99
        v += g
        np.sqrt(np.multiply(v, 1 / (1 - 0.99**step), out=step_of), out=step_of)
        step_of += 1e-8
        np.divide(m, step_of, out=step_of)
        step_of *= rate / (1 - 0.9**step)
        one -= step_of
    return p


def place_kind(token: bytes) -> tuple[bool, str]:
    """Whether a subword begins a word, and what it is made of."""
    text = token.decode(errors="replace")
    plain = text.lstrip(" ")
    made = "letters" if plain.isascii() and plain.isalpha() else "digits" if plain.isdigit() else "other letters" if any(c.isalpha() for c in plain) else "signs"
    return text.startswith(" "), made


def assign_slots(counts: np.ndarray, tokens: dict[bytes, int]) -> np.ndarray:
    """The slot of each subword id (the end is the last id and the last slot). The most frequent have their own; the others
    share bins by whether they begin a word and by what they are made of, each kind cut into bins of like counts."""
    ids, heads = len(counts) - 1, SLOTS - BINS - 1
    order = np.argsort(-counts[:ids], kind="stable")
    slot = np.full(len(counts), heads, np.int64)
    slot[order[:heads]] = np.arange(heads)
    slot[ids] = SLOTS - 1
    kind_of = {i: place_kind(token) for token, i in tokens.items()}
    kinds = sorted(set(kind_of.values()))
    tail = order[heads:]
    number = np.array([kinds.index(kind_of[i]) if i in kind_of else 0 for i in tail.tolist()], np.int64)
    weight = counts[tail] + ADD
    mass = np.bincount(number, weight, max(1, len(kinds)))
    # each kind has a bin, the others go where the counts are
    share = 1 + np.floor((BINS - len(mass)) * mass / max(mass.sum(), 1e-9)).astype(int)
    first = heads + np.cumsum(share) - share
    for k in range(len(mass)):
        own = np.flatnonzero(number == k)  # by falling counts
        before = np.cumsum(weight[own]) - weight[own]
        slot[tail[own]] = first[k] + np.minimum((before / max(mass[k], 1e-9) * share[k]).astype(int), share[k] - 1)
    return slot


def log_shares(counts: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """log10 p(subword | slot), from counts with ADD for each, so that no subword is impossible."""
    smooth = counts + np.where((slot < SLOTS - BINS - 1) | (slot == SLOTS - 1), 1.0, ADD)
    return np.log10(smooth / np.bincount(slot, smooth, SLOTS)[slot])


def training(split: str = "doc_id"):
    return id_crc(split) % 10 != 0


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all training documents; counted where they are read, then summed."""

    def run(batches):
        counts: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                counts.update(words_of(text))
            if len(counts) > REMEMBERED:
                yield rows()
                counts.clear()
        yield rows()

    return docs.where(training()).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Corpus:
    counts: DataFrame
    n_tokens: int
    n_types: int
    n_ends: int
    frequent: dict[bytes, int]
    once: int  # words that stand once
    twice: int

    def log10(self, c: int) -> float:
        return math.log10((c + ADD) / (self.n_tokens + ADD * (self.n_types + 1)))

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once else 0.0

    @property
    def attended(self) -> float:
        """The weight of the attention model: MIX, and what discounting takes from the counts."""
        return MIX + (1 - MIX) * self.discount * self.n_types / self.n_tokens if self.n_tokens else 1.0

    def counted(self, c: int) -> float:
        """What the counts give to a word that stands c times."""
        return (1 - MIX) * max(c - self.discount, 0) / self.n_tokens if c else 0.0


def corpus_of(docs: DataFrame, most: int = FREQUENT) -> Corpus:
    counts = stored(word_counts(docs), "words")
    size = F.floor(F.log2("n") * 4).cast("int")
    levels = sorted(((r.level, r.types, r.n) for r in counts.groupBy(size.alias("level")).agg(F.count("*").alias("types"), F.sum("n").alias("n")).collect()), reverse=True)  # at most 256 rows
    ends = docs.where(training()).count()
    kept, level = 0, 1 << 20
    for one, types, _ in levels:
        if kept + types > most:
            break
        kept, level = kept + types, one
    rows = counts.where(size >= level).toArrow() if kept else None  # `most` rows at most
    frequent = dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True)) if rows else {}
    types = {one: t for one, t, _ in levels}  # level 0 is a count of 1, level 4 of 2
    return Corpus(counts, sum(n for _, _, n in levels) + ends, sum(types.values()) + (ends > 0), ends, frequent, types.get(0, 0) + (ends == 1), types.get(4, 0) + (ends == 2))


def subword_counts(counts: DataFrame, path: str, pattern: str) -> np.ndarray:
    """How often each subword id stands in the training corpus, from the counts of its words."""
    size = Subwords(path, pattern).size

    def run(batches):
        coder = Subwords(path, pattern)
        total = np.zeros(coder.size, np.int64)
        for batch in slices(batches, 4096):
            ids, lengths = coder.of(batch.column("word").to_pylist())
            total += np.bincount(ids, np.repeat(batch.column("n").to_numpy(), lengths), coder.size).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(some, pa.int64()), "n": pa.array(total[some])})

    out = np.zeros(size + 1)
    rows = counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each subword
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def spans_of(text: str | None) -> list[tuple[bytes, bool, bool]]:
    """A text in parts, all of it, one for each EVERY bytes and one at least, that end at blanks; whether each begins and whether
    it ends the text."""
    raw = (text or "").encode().lower()  # bytes.lower knows ASCII letters alone
    n, ends = max(1, len(raw) // EVERY), [0]
    for i in range(1, n):
        blank = BLANK.search(raw, max(ends[-1], i * len(raw) // n))
        ends.append(blank.start() if blank else len(raw))
    ends.append(len(raw))
    return [(raw[a:b], i == 0, i == n - 1) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]


def training_spans(docs: DataFrame, slot: np.ndarray, path: str, pattern: str, whole: bool = False) -> DataFrame:
    """slots (CONTEXT + 1 + SPAN of 16 bits), place (a hash of them and the id, so that copies are apart), of documents. Every
    subword is the target of one span: spans follow each other from the start of the text (whole), or of each of its parts."""
    width = CONTEXT + 1 + SPAN
    shared = docs.sparkSession.sparkContext.broadcast(slot.astype(np.int16))  # an entry for each subword

    def run(batches):
        coder, slot = Subwords(path, pattern), shared.value
        known: dict[bytes, bytes] = {}  # slots of words
        for batch in slices(batches):
            texts = zip(batch.column("seed").to_pylist(), batch.column("text").to_pylist(), strict=True)
            parts = [(seed, *part) for seed, t in texts for part in ([((t or "").encode().lower(), True, True)] if whole else spans_of(t))]
            words = [raw.split() for _, raw, _, _ in parts]
            if len(known) > REMEMBERED:
                known.clear()
            new = list(set().union(*words) - known.keys())
            ids, lengths = coder.of(new)
            ends, raw = (2 * np.cumsum(lengths)).tolist(), slot[ids].tobytes()
            known.update(zip(new, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            said, places, before = [], [], None
            for (seed, _, begins, closes), own in zip(parts, words, strict=True):
                before = np.full(CONTEXT + 1, START, np.int16) if begins else before
                own = np.concatenate([before, np.frombuffer(b"".join([known[w] for w in own]), np.int16), slot[-1:][: int(closes)]])
                before, n = own[-CONTEXT - 1 :], len(own) - CONTEXT - 1  # targets
                own = np.concatenate([own, np.full(SPAN, NONE, np.int16)])
                for i in range(0, n, SPAN):
                    said.append(own[i : i + width].tobytes())
                    places.append(xxhash.xxh64_intdigest(said[-1], seed) >> 1)
            yield pa.RecordBatch.from_pydict({"slots": pa.array(said, pa.binary()), "place": pa.array(places, pa.int64())})

    return docs.select(id_crc().alias("seed"), "text").mapInArrow(run, "slots binary, place long")


def read_spans(table: pa.Table) -> np.ndarray:
    """Rows of slots in the order of place, whatever order they came in."""
    table = table.sort_by([("place", "ascending"), ("slots", "ascending")])
    return np.frombuffer(b"".join(table["slots"].to_pylist()), np.int16).reshape(-1, CONTEXT + 1 + SPAN).copy()


def averaged(spans: DataFrame, p: dict[str, np.ndarray], part: int, rounds: int, rates: tuple[float, float], chunks: int = 16) -> dict[str, np.ndarray]:
    """The mean of the parameters that tasks reach from p, each on its own spans, weighted by their number. In each of
    the rounds a task trains on another part of its spans. Parameters travel in chunks, summed where they arrive."""
    names, shapes = list(p), {n: w.shape for n, w in p.items()}
    cuts = np.cumsum([w.size for w in p.values()])[:-1]
    shared = spans.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        table = pa.Table.from_batches(batches)
        own = read_spans(table)[part::rounds] if table.num_rows else np.zeros((0, CONTEXT + 1 + SPAN), np.int16)
        if len(own):
            after = train(shared.value, own, -(-len(own) * (SPAN // SCORED) // BATCH), rates, part)
            whole = np.concatenate([after[n].reshape(-1) for n in names]).astype(np.float64) * len(own)
            pieces = np.array_split(whole, chunks)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(chunks), pa.int32()), "n": pa.array([len(own)] * chunks, pa.int64()), "total": pa.array([x.tobytes() for x in pieces], pa.binary())})

    def add(batches):
        sums: dict = {}
        for batch in batches:
            for chunk, n, total in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n", "total")), strict=True):
                before = sums.get(chunk, (0, 0.0))
                sums[chunk] = before[0] + n, before[1] + np.frombuffer(total)
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "mean": pa.array([(x / n).tobytes() for n, x in sums.values()], pa.binary())})

    parts = spans.mapInArrow(run, "chunk int, n long, total binary").repartition(chunks, "chunk").mapInArrow(add, "chunk int, mean binary")
    rows = sorted((r.chunk, bytes(r["mean"])) for r in parts.collect())  # one for each chunk
    if not rows:
        return p
    whole = np.frombuffer(b"".join(x for _, x in rows)).astype(np.float32)
    return {n: w.reshape(shapes[n]).copy() for n, w in zip(names, np.split(whole, cuts), strict=True)}


def fit(docs: DataFrame, corpus: Corpus, path: str, pattern: str, steps: int = START_STEPS, rounds: int = ROUNDS) -> Model:
    coder = Subwords(path, pattern)
    counts = subword_counts(corpus.counts, path, pattern)
    counts[-1] = corpus.n_ends
    slot = assign_slots(counts, coder.ranks)
    p = start_parameters(np.random.default_rng(0), np.bincount(slot, counts, SLOTS))
    if corpus.n_ends:
        known = docs.where(training())
        below = lambda share: int(min(1, share) * (1 << 62)) * 2 - 1  # of places from 0 to 2^63 - 1
        chosen = known.where(F.shiftrightunsigned(F.xxhash64(F.lit("start"), "doc_id", "text"), 1) <= below(START_SPANS * SPAN / counts.sum()))
        start = stored(training_spans(chosen, slot, path, pattern, whole=True), "start")
        table = read_spans(start.where(F.col("place") <= below(START_SPANS / max(1, start.count()))).toArrow())
        p = train(p, table, min(steps, -(-EPOCHS * len(table) * (SPAN // SCORED) // BATCH)), (RATE, RATE / 4), 0)
        spans = stored(training_spans(known, slot, path, pattern), "spans")
        tasks = -(-spans.count() // SHARE) or 1
        for part in range(rounds):
            own = spans.where(F.pmod("place", F.lit(rounds)) == part)
            p = averaged(own.repartition(tasks, "place"), p, 0, 1, tuple(RATE / 4 * (1 - x / rounds) for x in (part, part + 1)))
        discard(start, spans)
    return Model(slot, log_shares(counts, slot), p)


class Lexicon:
    """Frequent words by their hash, ascending, and the end as the last entry: slots, log10 of shares and of the base, and
    what the counts give."""

    def __init__(self, model: Model, coder: Subwords, corpus: Corpus):
        words = list(corpus.frequent)
        raw = np.frombuffer(b" ".join(words), np.uint8)
        hashes = span_hashes(raw, *word_spans(raw))
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.slots, self.begin, self.length, self.share = self.entries(model, coder, [words[i] for i in order.tolist()])
        counts = [corpus.frequent[words[i]] for i in order.tolist()] + [corpus.n_ends]
        self.log, self.counted = np.array([corpus.log10(c) for c in counts]), np.array([corpus.counted(c) for c in counts])
        self.begin = np.append(self.begin, len(self.slots))
        self.slots, self.length, self.share = np.append(self.slots, np.int16(SLOTS - 1)), np.append(self.length, 1), np.append(self.share, 0.0)

    @staticmethod
    def entries(model: Model, coder: Subwords, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """The slots of all words, where each word's begin, how many it has, and the sum of their log10 shares."""
        ids, lengths = coder.of(words)
        ends = np.cumsum(lengths)
        shares = np.concatenate([[0], np.cumsum(model.log_share[ids])])
        return model.slot_of[ids].astype(np.int16), ends - lengths, lengths, shares[ends] - shares[ends - lengths]

    def read(self, model: Model, coder: Subwords, texts: list[str | None]):
        """Of texts, one after the other, with an end each: tokens of each text; for each token its place in the tables that
        follow (begin and number of slots, share, log10 of the base or nan, what the counts give), the slots, and the words that are
        not frequent."""
        encoded = [(t or "").encode().lower() for t in texts]  # bytes.lower knows ASCII letters alone
        data = b" ".join(encoded) + b" "
        raw = np.frombuffer(data, np.uint8)
        starts, ends = word_spans(raw)
        hashes = span_hashes(raw, starts, ends)
        at = np.cumsum([0, *(len(e) + 1 for e in encoded)])
        doc = np.searchsorted(at, starts, "right") - 1
        counts = np.bincount(doc, minlength=len(texts)) + 1
        n = len(self.hashes)
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(0, n - 1))
        found = self.hashes[place] == hashes if n else np.zeros(len(hashes), bool)
        _, first, which = np.unique(hashes[~found], return_index=True, return_inverse=True)
        other = np.flatnonzero(~found)
        rare = [data[s:e] for s, e in zip(starts[other[first]].tolist(), ends[other[first]].tolist(), strict=True)]
        place[other] = n + 1 + which
        slots, begin, length, share = self.entries(model, coder, rare)
        index = np.full(len(starts) + len(texts), n)
        index[np.arange(len(starts)) + doc] = place
        join = lambda a, b: np.concatenate([a, b])
        tables = join(self.begin, len(self.slots) + begin), join(self.length, length), join(self.share, share), join(self.log, np.full(len(rare), math.nan)), join(self.counted, np.zeros(len(rare)))
        return counts, index, tables, join(self.slots, slots), rare


PARTS = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, word binary, attended double"


def scored_parts(docs: DataFrame, model: Model, corpus: Corpus, path: str, pattern: str) -> DataFrame:
    """A row for each document, with a key that is no word, and one for each word of it that is not frequent: attended is
    the attention model's part of the word's probability."""
    lexicon = Lexicon(model, Subwords(path, pattern), corpus)
    shared = docs.sparkSession.sparkContext.broadcast((model, lexicon))  # FREQUENT words at most
    end_known, n_frequent, weight = int(corpus.n_ends > 0), len(corpus.frequent), corpus.attended

    def run(batches):
        keep_memory()
        model, lexicon = shared.value
        coder, row = Subwords(path, pattern), TaskContext.get().partitionId() << 36
        for batch in slices(batches):
            lengths, index, (begins, each, share, log, counted), pool, words = lexicon.read(model, coder, batch.column("text").to_pylist())
            begin = np.cumsum(lengths) - lengths
            each = each[index]
            first = np.cumsum(each) - each
            slots = pool[np.repeat(begins[index] - first, each) + np.arange(int(each.sum()))]
            logs = model.slot_scores(slots, np.add.reduceat(each, begin))
            attended = np.add.reduceat(logs, first, dtype=np.float64) + share[index]
            log = log[index]
            rare = np.isnan(log)
            # two parts as logarithms: a long word's probability may be too small for a double
            with np.errstate(divide="ignore"):
                high, low = np.log10(counted[index]), attended + math.log10(weight)
            score = np.maximum(high, low) + np.log10(1 + 10 ** -np.abs(high - low))
            n = len(lengths)
            rows = row + np.arange(n)
            row += n
            at = np.flatnonzero(rare)
            doc = np.repeat(np.arange(n), lengths)[at]
            no = lambda kind: pa.nulls(len(at), kind)
            join = lambda head, tail: pa.concat_arrays([head, tail])
            yield pa.RecordBatch.from_pydict({
                "row": pa.array(np.concatenate([rows, rows[doc]])),
                "doc_id": join(batch.column("doc_id"), no(pa.int64())),
                "held_out": join(batch.column("held_out"), no(pa.bool_())),
                "n_tokens": join(pa.array(lengths, pa.int64()), no(pa.int64())),
                "known": join(pa.array(np.add.reduceat(~rare, begin) - 1 + end_known, pa.int64()), no(pa.int64())),
                "base": join(pa.array(np.add.reduceat(np.where(rare, 0, log), begin)), no(pa.float64())),
                "score": join(pa.array(np.add.reduceat(np.where(rare, 0, score), begin)), no(pa.float64())),
                "word": pa.array([b" " + r.to_bytes(8, "little") for r in rows.tolist()] + [words[i] for i in (index[at] - n_frequent - 1).tolist()], pa.binary()),
                "attended": join(pa.nulls(n, pa.float64()), pa.array(low[at], pa.float64())),
            })

    return docs.select("doc_id", (~training()).alias("held_out"), "text").mapInArrow(run, PARTS)


def score_documents(docs: DataFrame, path: str, pattern: str, steps: int = START_STEPS, rounds: int = ROUNDS, most: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    corpus = corpus_of(docs, most)
    model = fit(docs, corpus, path, pattern, steps, rounds)
    parts = scored_parts(docs, model, corpus, path, pattern)
    rest = corpus.counts.where("n > 0").select("word", "n")
    joined = parts.join(rest, "word", "left")
    base = F.log10((F.coalesce("n", F.lit(0)) + ADD) / F.lit(corpus.n_tokens + ADD * (corpus.n_types + 1)))
    high = F.log10((F.col("n") - F.lit(corpus.discount)) * F.lit((1 - MIX) / max(1, corpus.n_tokens)))  # null: no count
    low = F.col("attended")
    score = F.coalesce(F.greatest(high, low) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(high - low))), low)
    word = F.col("attended").isNotNull()
    by_row = joined.groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")),
        (F.max("known") + F.count_if(word & F.col("n").isNotNull())).alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(F.when(word, base)), F.lit(0.0))).alias("base_score"),
        (F.max("score") + F.coalesce(F.sum(F.when(word, score)), F.lit(0.0))).alias("score"),
    )
    return by_row.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(corpus.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
