"""Hierarchical language identification (operator 5).

First the family, then the language within it: linear support vector machines tell families apart (one against the
rest), and within a family one machine for each pair of languages votes. Features are hashed character bigrams and
trigrams of the whole lower-cased text, square roots of counts at unit length. Families are learned too: the languages'
mean features are joined, most alike first, until about the square root of their number is left (or pass `families`).

Training takes a bounded sample: at most SAMPLE labelled documents, spread evenly over the labels and chosen by a hash
of the id; all else covers all rows. Prediction sees the text alone.

Cases: a null text, or one without a letter, is `und` with score 0; documents without a label are not learned from;
very long texts are read whole; ties go to the label that sorts first; without any labelled document all is `und`; a null doc_id
counts as the empty text in the split; an empty table gives an empty table; repeated rows, and rows that share a doc_id, give
a row each; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import arrow_map, documents, id_crc, slices

#: Labelled documents learned from at most, features, rounds of training.
SAMPLE, FEATURES, ROUNDS = 4000, 4096, 150
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Characters below this are letters or blanks to the features; those above are taken as they are.
PLAIN = 0x250
_letters = np.array([c if chr(c).isalpha() else 32 for c in range(PLAIN)], np.uint32)


def features(text: str) -> np.ndarray:
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    low = codes < PLAIN
    codes = _letters[codes] if low.all() else np.where(low, _letters[np.where(low, codes, 0)], codes)
    pairs = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(0x27D4EB2F) + codes[2:] * np.uint32(0xC2B2AE3D)
    counts = np.bincount(pairs >> np.uint32(20), minlength=FEATURES) + np.bincount(triples >> np.uint32(20), minlength=FEATURES)
    out = np.sqrt(counts.astype(np.float32))
    return out / max(float(np.linalg.norm(out)), 1e-9)


def machine(x: np.ndarray, y: np.ndarray, c: float = 20.0) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient steps. y: 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step = 1 / (2 * c * 2 * 2 + 1)  # squared row length is 2
    for i in range(ROUNDS):
        slack = np.maximum(0, 1 - y * (x @ v))
        after = v - step * (v - 2 * c * (x.T @ (weight * y * slack)))
        w, v = after, after + i / (i + 3) * (after - w)
    return w


@dataclass
class Hierarchy:
    families: list[list[str]]
    family_machines: np.ndarray | None  # families x (features + 1); None: one family
    pairs: list[tuple[int, int, int]]  # family, and two places in it, for each row of pair_machines
    pair_machines: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t) and self.families]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not known:
            return langs, scores
        x = np.ones((len(known), FEATURES + 1), np.float32)
        for row, i in enumerate(known):
            x[row, :FEATURES] = features(texts[i])
        sure = lambda margin: 1 / (1 + np.exp(-4 * np.clip(margin, -10, 10)))
        family, first = np.zeros(len(known), int), np.ones(len(known))
        if self.family_machines is not None:
            margins = x @ self.family_machines.T
            family = margins.argmax(1)
            first = sure(margins.max(1))
        margins = x @ self.pair_machines.T if self.pairs else np.zeros((len(known), 0))
        for row, i in enumerate(known):
            members = self.families[family[row]]
            votes, sums = np.zeros(len(members)), np.ones(len(members))
            for k, (f, a, b) in enumerate(self.pairs):
                if f == family[row]:
                    m = float(margins[row, k])
                    votes[a if m >= 0 else b] += 1
                    sums[a], sums[b] = min(sums[a], sure(m)), min(sums[b], sure(-m))
            best = max(range(len(members)), key=lambda k: (votes[k], sums[k], -k))
            langs[i], scores[i] = members[best], float(min(1.0, first[row] * sums[best]))
        return langs, scores


def learn(x: np.ndarray, labels: list[str], families: list[list[str]] | None = None) -> Hierarchy:
    names = sorted(set(labels))
    if not names:
        return Hierarchy([], None, [], np.zeros((0, FEATURES + 1), np.float32))
    labels = np.array(labels)
    families = families or join_families(names, np.stack([x[labels == n].mean(0) for n in names]))
    families = [[n for n in f if n in names] for f in families]
    families = [f for f in families if f]
    families += [[n] for n in names if not any(n in f for f in families)]
    by_family = None
    if len(families) > 1:
        by_family = np.stack([machine(x, np.where(np.isin(labels, f), 1, -1).astype(np.float32)) for f in families])
    pairs, machines = [], []
    for k, members in enumerate(families):
        for a in range(len(members)):
            for b in range(a + 1, len(members)):
                rows = np.isin(labels, [members[a], members[b]])
                machines.append(machine(x[rows], np.where(labels[rows] == members[a], 1, -1).astype(np.float32)))
                pairs.append((k, a, b))
    return Hierarchy(families, by_family, pairs, np.stack(machines) if machines else np.zeros((0, FEATURES + 1), np.float32))


def join_families(names: list[str], means: np.ndarray) -> list[list[str]]:
    means = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    alike, groups = means @ means.T, [[i] for i in range(len(names))]
    while len(groups) > max(1, round(math.sqrt(len(names)))):
        a, b = max(((a, b) for a in range(len(groups)) for b in range(a + 1, len(groups))), key=lambda p: alike[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return [sorted(names[i] for i in g) for g in groups]


def held_out():
    return id_crc() % 4 == 2


def fit(docs: DataFrame, sample: int = SAMPLE, families: list[list[str]] | None = None) -> Hierarchy:
    """Learns from the labelled documents of docs that are not held out."""
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each label
    if not counts:
        return learn(np.zeros((0, FEATURES)), [])
    each = max(1, sample // len(counts))
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(place < share[F.col("lang")]).select("doc_id", "text", "lang")

    def step(columns: dict) -> dict:
        kept = [(d, lang, features(t).astype(np.float16).tobytes()) for d, lang, t in zip(columns["doc_id"], columns["lang"], columns["text"], strict=True) if LETTER.search(t)]
        return {n: [row[i] for row in kept] for i, n in enumerate(("doc_id", "lang", "x"))}

    def taught(batches):
        rows = sorted((row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "doc_id", "x")), strict=True)), key=lambda r: (r[0], r[1] or 0, r[2]))
        x = np.stack([np.frombuffer(row[2], np.float16) for row in rows]).astype(np.float32) if rows else np.zeros((0, FEATURES))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(learn(x, [row[0] for row in rows], families))]})

    # at most `sample` rows, in one task: the driver gets the model alone
    features_of = arrow_map(chosen, lambda: step, "doc_id long, lang string, x binary", ["doc_id", "lang", "x"])
    return pickle.loads(bytes(features_of.repartition(1).mapInArrow(taught, "model binary").first().model))


def predict(docs: DataFrame, model: Hierarchy) -> DataFrame:
    """doc_id, lang_pred, score of every text."""

    def step(columns: dict) -> dict:
        langs, scores = model.predict(columns["text"])
        return {"doc_id": columns["doc_id"], "lang_pred": langs, "score": scores}

    return arrow_map(docs.select("doc_id", "text"), lambda: step, "doc_id long, lang_pred string, score double", ["doc_id", "lang_pred", "score"])


def accepted(docs: DataFrame, model: Hierarchy, least: float = 0.0) -> DataFrame:
    """The documents whose language is known with a score above `least`, with the prediction in `lang`."""
    def run(batches):
        for batch in slices(batches):
            at = batch.schema.get_field_index("lang")
            langs, scores = model.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            kept = pa.array([lang != UNKNOWN and score > least for lang, score in zip(langs, scores, strict=True)])
            yield batch.set_column(at, batch.schema.field(at), pa.array(langs, batch.schema.field(at).type)).filter(kept)

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    names = ["doc_id", "lang_pred", "score"]
    return predict(docs, fit(docs)).select(names[0], held_out().alias("held_out"), *names[1:])
