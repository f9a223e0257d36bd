"""Toxicity by weak supervision.

* Voters. Terms that go with the label (words, and beginnings of words) are
  learned from a sample of labelled documents that are not held out and dealt
  out to voters; a fixed list of insults, the density of hits, shouting and
  exclamation marks are voters too. Each votes toxic, clean, or abstains.
* Label model. The votes of every document are counted by their combination.
  Expectation maximisation over these counts, with the labelled documents'
  classes known, estimates how each voter votes in each class, given the vote of
  the voter it is most correlated with there (a tree of dependencies). The
  model's posterior turns any combination into a probability.
* Classifier. A logistic regression learns these probabilities from a text's
  hits and shape, and scores every whole text.

Labels come only from rows whose crc32(doc_id as text) mod 4 is not 2, and
``SAMPLE`` and ``TRAIN`` bound the rows for the terms and for the regression;
the counts of votes cover all documents. Both samples go by hashes, so equal tables
train equal models. Defined cases: a null text scores as an empty one; of a labelled
id with several texts the terms are learned from one; a null doc_id is not held out; labels that disagree for one
id count as toxic; without any toxic label the terms are the fixed list alone;
repeated rows score alike; extra columns play no part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import neardup
from trailmark.llm.licenses import words_of
from trailmark.llm.shared import give_back, small_batches, written

#: Labelled rows that the terms are learned from, at most.
SAMPLE = 12_000
#: Documents that the regression is trained on, about.
TRAIN = 20_000
#: Terms kept, at most; voters that share them.
TERMS, DEALT = 600, 6
#: Least gain of a term, in nats: far above what chance gives the best of a million terms.
GAIN = 16
#: Lengths of the beginnings of words that can be terms, in bytes.
HEADS = (4, 5, 6, 7)
THRESHOLD = 0.3
KEPT_WORDS = 30_000
#: Insults in common use.
INSULTS = "idiot moron stupid loser clown trash scum pathetic worthless disgusting imbecile dumbass bastard asshole".split()
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BEYOND = re.compile(r"[^\x00-\x7F]")
#: What smooths the label model's tables: so many cases of a vote, dealt out by its share.
PRIOR_MASS = 3.0
#: Votes.
ABSTAIN, CLEAN, TOXIC = 0, 1, 2


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def _heads(word: bytes) -> list[bytes]:
    return [word[:n] + b"*" for n in HEADS if len(word) > n]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            words = set(words_of(text.as_py()))
            counts[toxic].update(words | {h for w in words for h in _heads(w)})
        terms = [t for t, n in counts[1].items()]
        # of terms that no toxic text of this batch has, only their count in clean ones matters
        rest = [t for t in counts[0] if t not in counts[1]]
        every = terms + rest
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([counts[1][t] for t in every], pa.int64()), pa.array([counts[0][t] for t in every], pa.int64())], ["term", "pos", "neg"])


def learned_terms(labelled: DataFrame) -> list[bytes]:
    """Terms of toxic texts, best first; ``labelled`` has text and toxic (0 or 1), ``SAMPLE`` rows at most."""
    n = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos:
        return []
    counts = labelled.select("text", "toxic").mapInArrow(_term_counts, "term binary, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    # log-likelihood that the term's own share of toxic texts gains over the general one
    share, every = F.col("pos") / (F.col("pos") + F.col("neg")), n_pos / (n_pos + n_neg) if n_neg else 0.5
    gain = F.col("pos") * F.log(share / every) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - every))).otherwise(0.0)
    best = counts.where((F.col("pos") >= 3) & (ratio > 3) & (gain > GAIN)).withColumn("z", ratio * F.sqrt("pos"))
    rows = best.orderBy(F.desc("z"), "term").limit(4 * TERMS).collect()
    kept: list[bytes] = []
    seen: set[bytes] = set()
    for r in rows:
        t = bytes(r.term)
        # a better term holds this one, or is what makes this beginning look good
        if t.rstrip(b"*") in seen or any(t.startswith(h[:-1]) for h in kept if h.endswith(b"*")):
            continue
        if t.endswith(b"*") and any(k.startswith(t[:-1]) for k in kept):
            continue
        kept.append(t)
        seen.add(t.rstrip(b"*"))
    return kept[:TERMS]


def _once(labelled: DataFrame) -> DataFrame:
    """One row of each group of near copies among ``SAMPLE`` rows at most, so that copies are no evidence."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = [neardup.shingles(t.as_py(), 4) for t in batch.column("text")]
                keys = [neardup.bands(x).view(np.int64).tolist() if len(x) else [] for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "bands"])

    rows = labelled.select("doc_id", "text").mapInArrow(banded, "doc_id long, bands array<long>").collect()
    top = {r.doc_id: r.doc_id for r in rows}

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    first: dict[int, int] = {}
    for r in rows:
        for key in r.bands:
            a, b = find(r.doc_id), find(first.setdefault(key, r.doc_id))
            top[max(a, b)] = min(a, b)
    kept = labelled.sparkSession.createDataFrame([(i,) for i in top if find(i) == i], "doc_id long")
    return labelled.join(F.broadcast(kept), "doc_id")


def shouted(text: str) -> float:
    """Share of the characters of the whole text that are upper-case."""
    data = text.encode()
    upper = len(data) - len(data.translate(None, _UPPER))
    if not text.isascii():
        upper += sum(map(str.isupper, _BEYOND.findall(text)))
    return upper / max(1, len(text))


class _Hits(dict):
    """The term that a word is or begins with, -1 for none."""

    def __init__(self, terms: dict[bytes, int]):
        self.terms = terms

    def __missing__(self, word: bytes) -> int:
        out = self.terms.get(word, -1)
        for h in _heads(word) if out < 0 else ():
            out = max(out, self.terms.get(h, -1))
        if len(self) < KEPT_WORDS:
            self[word] = out
        return out


@dataclass
class Voters:
    terms: list[bytes]

    def __post_init__(self):
        fixed = [w.encode() for w in INSULTS if w.encode() not in self.terms]
        self.all = [*self.terms, *fixed]
        self.voter = [i % DEALT if i < len(self.terms) else DEALT for i in range(len(self.all))]
        self.hits = _Hits({t: i for i, t in enumerate(self.all)})

    def look(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Votes (one for each voter) and the regression's inputs."""
        text = text or ""
        words = words_of(text)
        n = max(1, len(words))
        each = [0] * (DEALT + 1)
        found: set[int] = set()
        for t in map(self.hits.__getitem__, words):
            if t >= 0:
                each[self.voter[t]] += 1
                found.add(t)
        total = sum(each)
        shouts, bangs = shouted(text), text.count("!") / n
        votes = [TOXIC if e else ABSTAIN for e in each]
        votes += [TOXIC if total >= 2 and 200 * total >= n else CLEAN if not total else ABSTAIN]
        votes += [TOXIC if len(found) >= 2 else CLEAN if not found else ABSTAIN]
        votes += [CLEAN if bangs < 0.05 else ABSTAIN, CLEAN if shouts < 0.2 else ABSTAIN]
        inputs = [1.0, math.log1p(total), min(1.0, total), math.log1p(100 * total / n), math.log1p(len(found)), bangs, shouts, math.log(n) / 10]
        inputs += [math.log1p(e) for e in each]
        return np.array(votes), np.array(inputs)


N_VOTERS = DEALT + 1 + 4


def _code(votes: np.ndarray) -> int:
    return int(sum(int(v) * 3**i for i, v in enumerate(votes)))


def _votes(code: int) -> list[int]:
    return [code // 3**i % 3 for i in range(N_VOTERS)]


def dependencies(joint: np.ndarray, mass: np.ndarray) -> list[int]:
    """Each voter's parent in the tree of the strongest correlations within the classes, -1 for the root.

    ``joint`` has the mass of each pair of votes (class, voter, voter, vote, vote).
    """
    n = joint.shape[1]
    both = joint / joint.sum((3, 4), keepdims=True)
    one, other = both.sum(4, keepdims=True), both.sum(3, keepdims=True)
    tied = (both * np.log(both / (one * other))).sum((3, 4))  # mutual information in each class
    tied = np.einsum("y,yjk->jk", mass / mass.sum(), tied)
    parent, best = [-1] * n, tied[0].copy()
    out = [False] + [True] * (n - 1)
    come = [0] * n
    for _ in range(n - 1):
        j = max((k for k in range(n) if out[k]), key=lambda k: (best[k], -k))
        out[j], parent[j] = False, come[j]
        for k in range(n):
            if out[k] and tied[j, k] > best[k]:
                best[k], come[k] = tied[j, k], j
    return parent


def label_model(counts: dict[tuple[int, int], int]) -> dict[int, float]:
    """P(toxic) of each combination of votes under the generative model; counts by (combination, label or -1).

    A class draws its voters' votes along a tree: each vote depends on the class and on the vote of the
    voter it goes with most, so that voters who repeat each other are not counted twice.
    """
    codes = sorted({c for c, _ in counts})
    at = {c: i for i, c in enumerate(codes)}
    votes = np.array([_votes(c) for c in codes]).reshape(len(codes), N_VOTERS)
    n = np.zeros((len(codes), 3))  # by label: unknown, clean, toxic
    for (c, label), k in counts.items():
        n[at[c], label + 1] += k
    known = n[:, 1:].sum()
    flat = np.stack([votes == v for v in range(3)], axis=2).astype(float).reshape(len(codes), 3 * N_VOTERS)
    # all documents without a known class weigh as much as those with one, lest the few labels drown
    weight = min(1.0, known / n[:, 0].sum()) if known and n[:, 0].sum() else 1.0
    # begin with the labelled documents alone, without them with a vote of confidence in the voters
    begin = n[:, 1].sum() > 0 and n[:, 2].sum() > 0
    p = np.clip((votes == TOXIC).sum(1) * 0.4 + 0.02, 0.02, 0.98)
    parent: list[int] = []
    for i in range(60):
        unknown = n[:, 0] * (0 if begin and not i else weight)
        mass = np.stack([unknown * (1 - p) + n[:, 1], unknown * p + n[:, 2]], axis=1)  # clean, toxic
        prior = (n[:, 2].sum() + 1) / (known + 2) if known else mass[:, 1].sum() / mass.sum()
        joint = np.stack([(flat * mass[:, y, None]).T @ flat for y in range(2)]).reshape(2, N_VOTERS, 3, N_VOTERS, 3).transpose(0, 1, 3, 2, 4)
        if i < 10:  # fixed from then on, so that the rest converges
            parent = dependencies(joint + PRIOR_MASS / 9, mass.sum(0))
        logit = np.full(len(codes), np.log(prior / (1 - prior)))
        for j, k in enumerate(parent):
            alone = joint[:, j, j].diagonal(axis1=1, axis2=2) + PRIOR_MASS / 3
            alone = alone / alone.sum(1, keepdims=True)  # class, vote
            if k < 0:
                given = alone[:, :, None].repeat(3, 2)
            else:  # few cases of the parent's vote lean on the vote's share in the class
                pair = joint[:, j, k] + PRIOR_MASS * alone[:, :, None]
                given = pair / pair.sum(1, keepdims=True)  # class, vote, parent's vote
            says = np.log(given[1]) - np.log(given[0])
            logit += says[votes[:, j], votes[:, max(k, 0)]]
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(new - p).max() < 1e-6
        p = new
        if done:
            break
    return {c: float(p[i]) for c, i in at.items()}


def regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights that minimise the log loss against probabilities, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (q - y) + 1e-2 * w
        hess = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Scorer:
    voters: Voters
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.voters.look(text)[1] @ self.weights))))))


def trained(docs: DataFrame, labels: DataFrame) -> Scorer:
    """The scorer learned from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = written(known, "labels")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", "text")
    # an id's texts may be many
    labelled = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    labelled = written(labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "t.text", "toxic"), "labelled")
    voters = Voters(learned_terms(_once(labelled)))
    shared = sc.broadcast(voters)  # TERMS terms at most

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [shared.value.look(t.as_py()) for t in batch.column("text")]
            codes = pa.array([_code(v) for v, _ in seen], pa.int64())
            inputs = pa.array([x.tolist() if keep else None for (_, x), keep in zip(seen, batch.column("train").to_pylist(), strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), codes, inputs], ["doc_id", "code", "inputs"])
            give_back()

    n = docs.count()
    share = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(max(1, n // TRAIN))) == 0
    rows = written(texts.select("doc_id", "text", share.alias("train")).mapInArrow(votes, "doc_id long, code long, inputs array<double>"), "votes")
    each = rows.groupBy("doc_id", "code").agg(F.count("*").alias("n")).join(known, "doc_id", "left").withColumn("label", F.coalesce("toxic", F.lit(-1)))
    counted = {(r.code, r.label): r.n for r in each.groupBy("code", "label").agg(F.sum("n").alias("n")).collect()}  # 3 ** N_VOTERS combinations at most
    if not counted:
        return Scorer(voters, np.zeros(8 + DEALT + 1))
    posterior = label_model(counted)
    # one document in n // TRAIN; the bound holds should an id with many rows be among them
    train = rows.where("inputs is not null").orderBy(F.xxhash64(F.lit("train"), "doc_id"), "doc_id", "code", "inputs").select("code", "inputs").limit(2 * TRAIN).collect()
    return Scorer(voters, regression(np.array([r.inputs for r in train]), np.array([posterior[r.code] for r in train])))


def score_of(scorer: Scorer, spark: SparkSession) -> Callable[[Column], Column]:
    """The score of a text column."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        scores = pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())
        give_back()
        return scores

    return score


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``."""
    held = F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), score_of(scorer, docs.sparkSession)(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def harmless(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with the columns of ``docs``."""
    score = score_of(scorer, docs.sparkSession)
    rows = docs.select(F.struct("*").alias("record")).withColumn("score", score(F.col("record.text")))
    return rows.where(F.col("score") < THRESHOLD).select("record.*")
