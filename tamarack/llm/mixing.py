"""Mixing sources to target weights (problem 7).

Method: soft-membership mixing. A multinomial naive Bayes classifier, fitted on at most about
``fit_rows`` labelled documents by one distributed count, gives domain posteriors. A document with a
source of the target table belongs to that source; a document without a source belongs to
all of them by its posterior. Non-negative document rates are then fitted by projected
gradient descent on the least-squares distance between expected domain token totals and
their targets. Every gradient step is one distributed aggregate of eight or so numbers. Documents
of the same posterior have the same rate, so they are pre-aggregated before the first step: all
documents of one source, however many, become one row. Posteriors are rounded to multiples of
1/``LEVELS`` by their running sum, so that they still add up to one.

The mixture is as large as all documents that state a source. What a source cannot give even
with every document at its most repeats goes to the others in proportion to their targets
(``attainable``). No document is used more often than its source allows; one without a source not
more often than the whole part of the allowance that its posterior gives it.

A source's shortfall is found in the fitted mixture, where the documents that state it stay below its
share, and then decided exactly: tokens * max_repeats < target_share * tokens of all
documents that state a source. As these documents keep to their allowance in the fit, no source
that falls short passes the first test unseen.

Tokens are counted with a public tokenizer whose file is a parameter.

Defined results: null or blank texts have 0 tokens and keep their place in the result with
rate and copies; a source that is null or blank after trimming counts as missing; a stated
source outside the target table adds to the total and has rate 0; a target without documents
has 0 tokens; repeated rows of an id count once (but
each in the training of the classifier); an empty target table gives an empty
result; other columns are ignored. Very long texts are tokenised in whole.
"""

from __future__ import annotations

import base64
import logging
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.session import materialize, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUCKETS = 4096
STEPS = 100
LEVELS = 1024
FIT_ROWS = 20_000
# Fixed value: the split pattern that belongs to the byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(ranks: bytes):
    """A tiktoken encoding of the content of a rank file; one for each Python worker."""
    import tiktoken

    parsed = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=parsed, special_tokens={})


def source_key(source: Column) -> Column:
    """Trimmed, lower case, with ``-`` read as ``_``; null if nothing is left."""
    return F.nullif(F.translate(F.lower(F.trim(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))), "-", "_"), F.lit(""))


def _features(text: str) -> np.ndarray:
    ws = re.findall(r"\w+", text.lower())
    return (pd.util.hash_array(np.array(ws, dtype=object), categorize=True) % BUCKETS).astype(np.int32) if ws else np.empty(0, np.int32)


def _documents(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), source_key(F.col(f"`{source_col}`")).alias("domain"), F.col(f"`{text_col}`").alias("text"))
    return rows.filter("doc_id is not null")


def fit_classifier(documents: DataFrame, domains: list[str], fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(log prior, log likelihood) of multinomial naive Bayes with add-one smoothing, from rows that state a source.

    Of more than ``fit_rows`` such rows about that many are taken, by a hash of the id; the prior is that of
    all rows. Each task counts its rows into one table of domains x buckets; the sums of those, at
    most as many numbers, reach the driver.
    """
    at = {d: k for k, d in enumerate(domains)}
    labelled = documents.filter(F.col("domain").isin(domains))
    prior = np.ones(len(domains))
    for r in labelled.groupBy("domain").count().collect():
        prior[at[r["domain"]]] += r["count"]
    share = fit_rows / max(prior.sum() - len(domains), 1)
    if share < 1:
        labelled = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = np.zeros((len(domains), BUCKETS), np.int64)
        for part in parts:
            for d, t in zip(part["domain"], part["text"], strict=True):
                if t:
                    words[at[d]] += np.bincount(_features(t), minlength=BUCKETS)
        d, b = np.nonzero(words)
        yield pd.DataFrame({"d": d, "b": b, "n": words[d, b]})

    words = np.ones((len(domains), BUCKETS))
    sums = spread(labelled.select("domain", "text")).mapInPandas(count, "d int, b int, n bigint").groupBy("d", "b").agg(F.sum("n").alias("n"))
    for r in sums.groupBy("d").agg(F.collect_list(F.struct("b", "n")).alias("c")).collect():
        for b, n in r["c"]:
            words[r["d"], b] += n
    return np.log(prior / prior.sum()), np.log(words / words.sum(axis=1, keepdims=True))


def rounded(p: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Multiples of 1/levels with the sum of ``p``: running sums are rounded, so however small the parts are, nothing is lost."""
    return np.diff(np.round(np.cumsum(p) * levels), prepend=0.0) / levels


def memberships(documents: DataFrame, domains: list[str], model: tuple[np.ndarray, np.ndarray], tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, domain, tokens, membership), one row for each id: one weight for each domain, all on the stated one, else the posterior, else none.

    One pass over the texts; neither they nor their words are shuffled.
    """
    # The file is read on the driver only.
    with open(tokenizer, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast((*model, f.read()))
    at = {d: k for k, d in enumerate(domains)}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prior, words, ranks = shared.value
        enc = encoder(ranks)
        own = np.eye(len(domains))
        none = np.zeros(len(domains))
        for part in parts:
            texts = part["text"].fillna("").tolist()
            weights = []
            for d, t in zip(part["domain"], texts, strict=True):
                if d is None:
                    score = prior + words[:, _features(t)].sum(axis=1)
                    p = np.exp(score - score.max())
                    weights.append(rounded(p / p.sum()))
                else:
                    weights.append(own[at[d]] if d in at else none)
            yield pd.DataFrame({"doc_id": part["doc_id"], "domain": part["domain"], "tokens": [len(x) for x in enc.encode_ordinary_batch(texts, num_threads=1)], "membership": weights})

    counted = spread(documents).mapInPandas(run, "doc_id bigint, domain string, tokens bigint, membership array<double>")
    return counted.groupBy("doc_id").agg(F.min(F.struct("domain", "tokens", "membership")).alias("r")).select("doc_id", "r.domain", "r.tokens", "r.membership")


def attainable(wanted: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Totals with the sum of ``wanted``, none above its capacity: what one lacks is spread over the others in proportion to ``wanted``."""
    full = np.zeros(len(wanted), bool)
    out = wanted.astype(float)
    while True:
        rest = wanted.sum() - capacity[full].sum()
        open_sum = wanted[~full].sum()
        out = np.where(full, capacity, wanted * (rest / open_sum if open_sum else 0.0))
        if not (more := ~full & (out > capacity)).any():
            return out
        full |= more


def _tops(p: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """The highest rate of each membership: a whole number of uses."""
    return np.floor(p @ cap + 1e-9)


def fit_rates(grouped: DataFrame, target: np.ndarray, cap: np.ndarray, steps: int = STEPS, tolerance: float = 1e-4) -> tuple[list[np.ndarray], np.ndarray, bool]:
    """(steps, totals, converged) of the projected gradient for min ||totals(rate) - target||^2, 0 <= rate <= whole part of membership . cap.

    ``grouped`` has (membership, tokens). The gradient of a rate is tokens * membership . residual;
    scaled by tokens and by each domain's mass it is the same for all rows of one membership, so the
    steps so far (one short vector each) are all a row needs to work out its rate.
    """
    so_far: list[np.ndarray] = []
    while True:
        mass, totals = domain_totals(grouped, so_far, cap)
        step = np.divide(target - totals, mass, out=np.zeros(len(target)), where=mass > 0)
        still = bool(so_far) and np.abs(step - so_far[-1]).max() < tolerance * max(1.0, np.abs(step).max())
        if still or np.abs(target - totals).max() <= tolerance * max(1.0, target.sum()):
            return so_far, totals, True
        if len(so_far) == steps:
            logging.getLogger(__name__).warning("mixture rates have not converged in %d steps", steps)
            return so_far, totals, False
        so_far.append(step)


def domain_totals(grouped: DataFrame, steps: list[np.ndarray], cap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each domain, tokens at the rates after these steps), each document by its membership. One distributed aggregate."""
    k = range(len(cap))
    part = [F.get("membership", F.lit(i)) * F.col("tokens") for i in k]
    sums = [F.sum(p).alias(f"m{i}") for i, p in enumerate(part)] + [F.sum(p * F.col("rate")).alias(f"t{i}") for i, p in enumerate(part)]
    row = grouped.withColumn("rate", rate_column(F.col("membership"), steps, cap)).agg(*sums).first()
    return tuple(np.array([row[f"{x}{i}"] or 0.0 for i in k]) for x in "mt")


def rate_column(membership: Column, steps: list[np.ndarray], cap: np.ndarray) -> Column:
    """The rate after these gradient steps, clipped after each one."""

    @F.pandas_udf("double")
    def fold(m: pd.Series) -> pd.Series:
        if not len(m):
            return pd.Series([], dtype="float64")
        p = np.array(m.tolist(), dtype=float)
        top, rate = _tops(p, cap), np.zeros(len(p))
        for s in steps:
            rate = np.clip(rate + p @ s, 0.0, top)
        return pd.Series(rate)

    return fold(membership) if steps else F.lit(0.0)


class Mixture:
    """What a fitted mixture gives: ``report`` by source and ``copies`` by document."""

    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text", source: str = "source", fit_rows: int = FIT_ROWS):
        spark = documents.sparkSession
        # The target table is a hand-written one of a few rows; its size is checked.
        wanted = targets.select("source", "target_share", "max_repeats").distinct().limit(1001).collect()
        if len(wanted) > 1000:
            raise ValueError("more than 1000 sources")
        self.targets = sorted(wanted, key=lambda r: r.source)
        self.keys = [r.source.strip().lower().replace("-", "_") for r in self.targets]
        share = np.array([r.target_share for r in self.targets], dtype=float)
        cap = np.array([r.max_repeats for r in self.targets], dtype=float)
        texts = _documents(documents, doc_id, text, source)
        self.spark, self.cap, self.share = spark, cap, share
        self.rows, self.steps, self.converged, self.stated, self.total = None, [], True, {}, 0
        self.totals = self.goal = self.stated_totals = np.zeros(len(self.keys))
        if not self.keys:
            return
        model = fit_classifier(texts, self.keys, fit_rows)
        self.rows = materialize(memberships(texts, self.keys, model, tokenizer))
        # All documents of one source are one row here; so are those of one posterior.
        grouped = materialize(self.rows.groupBy("domain", "membership").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")))
        stated = grouped.filter("domain is not null")
        self.total = stated.agg(F.sum("tokens")).first()[0] or 0
        self.stated = {r["domain"]: (r["tokens"], r["documents"]) for r in stated.filter(F.col("domain").isin(self.keys)).collect()}
        most = F.floor(sum((F.get("membership", F.lit(i)) * float(c) for i, c in enumerate(cap)), F.lit(0.0)) + 1e-9)
        row = grouped.agg(*[F.sum(F.get("membership", F.lit(i)) * F.col("tokens") * most).alias(f"c{i}") for i in range(len(cap))]).first()
        capacity = np.array([row[f"c{i}"] or 0.0 for i in range(len(cap))])
        self.goal = attainable(share * self.total, capacity)
        self.steps, self.totals, self.converged = fit_rates(grouped, self.goal, cap)
        self.stated_totals = domain_totals(stated, self.steps, cap)[1]

    def used_tokens(self) -> np.ndarray:
        """Tokens that the copies of ``copies`` give each source, a document without a source counting by its membership."""
        k = range(len(self.keys))
        if self.rows is None:
            return np.zeros(len(self.keys))
        row = self._copied().agg(*[F.sum(F.get("membership", F.lit(i)) * F.col("tokens") * F.col("copies")).alias(f"u{i}") for i in k]).first()
        return np.array([row[f"u{i}"] or 0.0 for i in k])

    def shortfalls(self) -> list[bool]:
        """Whether each source falls short: its own documents do so in the fitted mixture, and an exact check agrees."""
        fitted = self.stated_totals < self.share * self.total * (1 + 1e-9)
        return [bool(f) and bool(self.stated.get(key, (0, 0))[0] * r.max_repeats < r.target_share * self.total) for f, key, r in zip(fitted, self.keys, self.targets, strict=True)]

    def report(self) -> DataFrame:
        """(source, target_share, max_repeats, documents, tokens, attainable_share, mixed_tokens, expected_share, used_tokens, actual_share, falls_short, converged).

        ``attainable_share`` is the target after what short sources lack went to the others;
        ``mixed_tokens`` and ``expected_share`` are those of the fitted rates; ``used_tokens`` and
        ``actual_share`` those of the copies that are really used.
        """
        mixed, used, goal = float(self.totals.sum()), self.used_tokens(), float(self.goal.sum())
        total = float(used.sum())
        out = []
        for k, (r, short) in enumerate(zip(self.targets, self.shortfalls(), strict=True)):
            tokens, n = self.stated.get(self.keys[k], (0, 0))
            shares = [float(x[k]) / y if y else 0.0 for x, y in ((self.goal, goal), (self.totals, mixed), (used, total))]
            out.append((r.source, float(r.target_share), int(r.max_repeats), n, tokens, shares[0], float(self.totals[k]), shares[1], float(used[k]), shares[2], short, self.converged))
        return self.spark.createDataFrame(out, "source string, target_share double, max_repeats int, documents bigint, tokens bigint, attainable_share double, mixed_tokens double, expected_share double, used_tokens double, actual_share double, falls_short boolean, converged boolean")

    def _copied(self) -> DataFrame:
        rated = self.rows.select("doc_id", F.col("domain").alias("source"), "tokens", "membership", rate_column(F.col("membership"), self.steps, self.cap).alias("rate"))
        part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        return rated.withColumn("copies", (F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))

    def copies(self) -> DataFrame:
        """(doc_id, source, tokens, rate, copies): how often each document is used.

        The whole part of the rate is certain; the rest is decided by a hash of the id, so that the
        expectation is the rate, a lost executor recomputes the same copies, and no seed is needed.
        """
        if self.rows is None:
            return self.spark.createDataFrame([], "doc_id bigint, source string, tokens bigint, rate double, copies int")
        return self._copied().select("doc_id", "source", "tokens", "rate", "copies")
