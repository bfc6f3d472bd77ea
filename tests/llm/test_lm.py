from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from cairn.llm import attention_lm as lm

RANKS = P.path("byte_bpe_50k.tiktoken")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), None]


def check_base(rows, texts):
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = Counter(t for i, text in texts.items() if not out[i] for t in tokens(text))
    n, v = counts.total(), len(counts)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(own), sum(counts[t] > 0 for t in own), n)
        want = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert r.base_score == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert math.isfinite(r.score) and r.score < 0


TEXTS = ["The cat sat", None, "", "THE the The\x0bx", "ÀÉ à é straße", "a " * 700, "　  wide", "x" * 3000, "don't stop, now. " * 30] * 4


@pytest.mark.parametrize("most", [0, 3, 1 << 18])
def test_base_by_brute_force_with_any_share_of_frequent_words(spark, docs, most):
    check_base(lm.score_documents(docs(TEXTS), RANKS, P.PATTERN, steps=20, rounds=1, most=most).collect(), dict(enumerate(TEXTS)))


def test_empty_and_untrained_tables(spark, docs):
    assert lm.score_documents(docs(["a"]).limit(0), RANKS, P.PATTERN, steps=5).count() == 0
    only_held_out = docs(["a b"] * 30).where("pmod(crc32(CAST(doc_id AS string)), 10) = 0")
    rows = lm.score_documents(only_held_out, RANKS, P.PATTERN, steps=5).collect()
    assert rows and all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in rows)


def test_gradients():
    rng = np.random.default_rng(2)
    p = {n: w.astype(np.float64) + rng.normal(0, 0.05, w.shape) for n, w in lm.start_parameters(rng, np.ones(lm.SLOTS)).items()}
    x = rng.integers(0, lm.SLOTS + 1, (3, lm.CONTEXT + lm.SCORED))
    y = rng.integers(0, lm.SLOTS, (3, lm.SCORED))
    y[0, 5:] = lm.NONE
    _, grads = lm.loss_and_gradients(p, x, y)
    for name, w in p.items():
        for _ in range(4):
            at = tuple(int(rng.integers(0, n)) for n in w.shape)
            if name == "E":
                at = (int(x[1, rng.integers(0, x.shape[1])]), at[1])
            old, losses = w[at], []
            for h in (1e-5, -1e-5):
                w[at] = old + h
                losses.append(lm.loss_and_gradients(p, x, y)[0])
            w[at] = old
            assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4, abs=1e-7), name


def test_gradients_of_windows_that_follow_each_other():
    """A row of three windows, which share their context, is three rows of one."""
    rng = np.random.default_rng(5)
    p = {n: w.astype(np.float64) + rng.normal(0, 0.05, w.shape) for n, w in lm.start_parameters(rng, np.ones(lm.SLOTS)).items()}
    s = np.minimum(rng.zipf(1.3, (4, lm.CONTEXT + 1 + lm.SPAN)), lm.SLOTS) - 1
    s[1, -20:] = lm.NONE
    x, y = np.where(s == lm.NONE, lm.START, s)[:, :-1], s[:, lm.CONTEXT + 1 :]
    loss, grads = lm.loss_and_gradients(p, x, y)
    parts = range(0, lm.SPAN, lm.SCORED)
    apart = np.vstack([x[:, i : i + lm.CONTEXT + lm.SCORED] for i in parts]), np.vstack([y[:, i : i + lm.SCORED] for i in parts])
    want, each = lm.loss_and_gradients(p, *apart)
    assert loss == pytest.approx(want)
    for name, g in grads.items():
        assert g == pytest.approx(each[name], rel=1e-9, abs=1e-12), name


def test_one_pass_takes_every_span_once(monkeypatch):
    seen, own = [], lm.loss_and_gradients
    monkeypatch.setattr(lm, "loss_and_gradients", lambda p, x, y: (seen.extend(map(tuple, y.tolist())), own(p, x, y))[1])
    for n in (1, 43, 200):
        spans = np.random.default_rng(n).integers(0, lm.SLOTS, (n, lm.CONTEXT + 1 + lm.SPAN)).astype(np.int16)
        seen.clear()
        lm.train(lm.start_parameters(np.random.default_rng(1), np.ones(lm.SLOTS)), spans, -(-n * (lm.SPAN // lm.SCORED) // lm.BATCH), (1e-3, 1e-4), 0)
        assert sorted(seen) == sorted(map(tuple, spans[:, lm.CONTEXT + 1 :].tolist()))


def test_sums_of_rows_that_share_a_value():
    rng = np.random.default_rng(6)
    x = np.append(np.minimum(rng.zipf(1.2, 997), 300), [400, 401, 401]).astype(np.int16)
    some, at, sums = lm.equal_rows(x)
    rows = np.vstack([rng.normal(size=(1000, 3)), np.zeros(3)])
    assert sorted(some.tolist()) == np.unique(x).tolist() and (some[at] == x).all()
    assert lm.row_sums(rows, *sums) == pytest.approx(np.array([rows[:-1][x == v].sum(0) for v in some]))


def test_training_cuts_each_word_once(spark, docs, monkeypatch):
    """What a word is cut into is kept, so a task's work in the tokenizer follows its different words."""
    cut, of = [], lm.Subwords.of
    monkeypatch.setattr(lm.Subwords, "of", lambda self, words: (cut.extend(words), of(self, words))[1])
    text = "the cat sat on the mat " * 400
    tasks = []
    monkeypatch.setattr(type(docs([""])), "mapInArrow", lambda self, run, schema: tasks.append(run))
    lm.training_spans(docs([text]), np.arange(lm.Subwords(RANKS, P.PATTERN).size + 1) % lm.SLOTS, RANKS, P.PATTERN)
    list(tasks[0]([pa.RecordBatch.from_pydict({"seed": [1, 2], "text": [text, text]})] * 3))
    assert sorted(cut) == [b"cat", b"mat", b"on", b"sat", b"the"]


def plain_scores(model, slots):
    """One subword at a time: attention over itself and the CONTEXT inputs before it, a class, a slot of the class."""
    p, s, out = model.p, [lm.START] * (lm.CONTEXT + 1) + list(slots), []
    for t in range(len(slots)):
        inputs = s[t : t + lm.CONTEXT + 1]
        e = p["E"][inputs].astype(np.float64)
        a = np.exp((e[-1] @ p["Wq"]) @ (e @ p["Wk"]).T / math.sqrt(lm.WIDTH) + p["r"][::-1])
        h = e[-1] + (a / a.sum()) @ (e @ p["Wv"])
        h = h + np.maximum(h @ p["W1"] + p["b1"], 0) @ p["W2"]
        k = slots[t] // lm.EACH
        own = slice(k * lm.EACH, (k + 1) * lm.EACH)
        total = 0.0
        for z, at in ((h @ p["C"] + p["cc"], k), (h @ p["U"][:, own] + p["c"][own], slots[t] % lm.EACH)):
            total += (z[at] - z.max() - math.log(np.exp(z - z.max()).sum())) / math.log(10)
        out.append(total)
    return out


def test_windows_score_each_subword_once():
    rng = np.random.default_rng(3)
    p = {n: (w + rng.normal(0, 0.1, w.shape)).astype(np.float32) for n, w in lm.start_parameters(rng, np.ones(lm.SLOTS)).items()}
    model = lm.Model(np.zeros(1, int), np.zeros(1), p)
    lengths = np.array([1, 5, 16, 17, 33, 100])
    slots = rng.integers(0, lm.SLOTS, lengths.sum())
    got = model.slot_scores(slots.astype(np.int16), lengths, at_once=5, block=2)
    ends = np.cumsum(lengths)
    assert got == pytest.approx([x for n, b in zip(lengths, ends, strict=True) for x in plain_scores(model, slots[b - n : b].tolist())], rel=1e-4)


def test_subword_shares_sum_to_one():
    coder = lm.Subwords(RANKS, P.PATTERN)
    counts = np.random.default_rng(4).zipf(1.4, coder.size + 1).astype(float)
    counts[::3] = 0
    slot = lm.assign_slots(counts, coder.ranks)
    share = 10 ** lm.log_shares(counts, slot)
    assert set(range(lm.SLOTS - lm.BINS - 1)) < set(slot.tolist()) and np.bincount(slot)[-1] == 1 and slot[-1] == lm.SLOTS - 1
    assert np.bincount(slot, share, lm.SLOTS)[np.unique(slot)] == pytest.approx(1)


def test_spans_begin_at_words_and_cover_the_text():
    text = " ".join(f"w{i}" for i in range(3000))
    spans = lm.spans_of(text)
    assert len(spans) == len(text) // lm.EVERY and all(raw in text.encode() for raw, _, _ in spans)
    words = set(text.encode().split())
    assert all(set(raw.split()) <= words for raw, _, _ in spans)
    assert lm.spans_of(None) == [(b"", True, True)] and lm.spans_of("Ab c") == [(b"ab c", True, True)]
    for odd in ("x" * 5000, " " * 5000, "a" * 300 + " " * 3000):
        assert len(lm.spans_of(odd)) >= 1


def test_all_training_documents_train(spark, docs):
    table = docs(TEXTS)
    slot = np.arange(lm.Subwords(RANKS, P.PATTERN).size + 1) % lm.SLOTS
    rows = lm.training_spans(table, slot, RANKS, P.PATTERN).toArrow()
    spans = lm.read_spans(rows)
    assert spans.shape == (rows.num_rows, lm.CONTEXT + 1 + lm.SPAN) and len(spans) >= len(TEXTS)
    assert (spans[:, lm.CONTEXT + 1] != lm.NONE).all()
    whole = lm.read_spans(lm.training_spans(table, slot, RANKS, P.PATTERN, whole=True).toArrow())
    coder = lm.Subwords(RANKS, P.PATTERN)
    want = sum(len(coder.of(lm.words_of(t))[0]) + 1 for t in TEXTS)
    assert (whole[:, lm.CONTEXT + 1 :] != lm.NONE).sum() == want


def test_every_subword_trains_once(spark, docs):
    """Each is the target of one span, after the subwords that stand before it."""
    texts = [*TEXTS, " ".join(f"w{i}" for i in range(3000)), "a" * 300 + " " * 6000 + "b", "x" * 9000 + " y", " " * 5000, "é　" * 4000]
    for text in texts:
        parts = lm.spans_of(text)
        assert b"".join(raw for raw, _, _ in parts) == (text or "").encode().lower()
        assert [w for raw, _, _ in parts for w in raw.split()] == lm.words_of(text)
        assert [(begins, closes) for _, begins, closes in parts] == [(i == 0, i == len(parts) - 1) for i in range(len(parts))]
    coder = lm.Subwords(RANKS, P.PATTERN)
    slot = np.arange(coder.size + 1) % lm.SLOTS
    spans = lm.read_spans(lm.training_spans(docs(texts), slot, RANKS, P.PATTERN).toArrow())
    got = Counter(tuple(s[i : i + lm.CONTEXT + 2].tolist()) for s in spans for i in range(lm.SPAN) if s[i + lm.CONTEXT + 1] != lm.NONE)
    want = Counter()
    for text in texts:
        own = [lm.START] * (lm.CONTEXT + 1) + slot[coder.of(lm.words_of(text))[0]].tolist() + [int(slot[-1])]
        want.update(tuple(own[i : i + lm.CONTEXT + 2]) for i in range(len(own) - lm.CONTEXT - 1))
    assert got == want


def test_averaging_weighs_tasks_by_their_spans(spark, docs):
    slot = np.arange(lm.Subwords(RANKS, P.PATTERN).size + 1) % lm.SLOTS
    spans = lm.training_spans(docs(TEXTS), slot, RANKS, P.PATTERN)
    p = lm.start_parameters(np.random.default_rng(1), np.ones(lm.SLOTS))
    dealt = spans.repartition(2, "place")
    got = lm.averaged(dealt, p, 0, 1, (1e-3, 1e-4))
    parts = [lm.read_spans(dealt.where(f"spark_partition_id() = {t}").toArrow()) for t in range(2)]
    means = [lm.train(p, own, -(-len(own) * (lm.SPAN // lm.SCORED) // lm.BATCH), (1e-3, 1e-4), 0) for own in parts]
    n = sum(map(len, parts))
    for name, w in got.items():
        assert w == pytest.approx(sum(m[name].astype(float) * len(own) for m, own in zip(means, parts, strict=True)) / n, abs=1e-5)
    empty = lm.averaged(dealt.limit(0), p, 0, 1, (1e-3, 1e-4))
    assert all((empty[n] == w).all() for n, w in p.items())


def test_words_split_alike_together_and_alone():
    coder = lm.Subwords(RANKS, P.PATTERN)
    words = [w for text in TEXTS for w in lm.words_of(text)] + ["don't".encode(), b"1234x", b"'s", " ".encode()]
    ids, lengths = coder.of(words)
    assert [ids[e - n : e].tolist() for n, e in zip(lengths, np.cumsum(lengths), strict=True)] == [coder.coder.encode_ordinary(" " + w.decode()) for w in words]


def test_query(spark):
    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = lm.query(spark, data).collect()
    check_base(rows, texts)


def test_the_model_is_ahead_of_the_base(spark):
    rows = lm.query(spark, "/root/testdata/sf0.01").collect()
    for held_out in (True, False):
        own = [r for r in rows if r.held_out == held_out]
        assert sum(r.score for r in own) > 0.97 * sum(r.base_score for r in own)
