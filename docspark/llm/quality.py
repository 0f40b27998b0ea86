"""Quality classifier with hierarchical empirical Bayes.

1. Two logistic models (good quality; toxic) are fitted to at most SAMPLE_DOCS labelled documents, drawn by hash.
   Quality looks at a document's make-up (capitals, symbols, digits, bars, repetition, length); toxicity at words
   and word beginnings that a smoothed log-odds test finds in toxic samples far more often than in others.
2. The documents' quality odds are grouped by source (the host) and by source and language (the path in it). A
   host's mean is shrunk toward the corpus mean, a path's toward its host's posterior; the weight of the prior, in
   documents, comes from the data by the method of moments: the variance between groups beyond chance.
3. A document's final log-odds are its own plus the shift of its path's posterior from the corpus mean.
A document is kept if its quality is 0.5 or more and its toxicity under 0.5.

Grouped sums are pre-aggregated, so a source with a third of all rows is no hot task. A text without words (null,
empty, blank) has quality 0 and is rejected. A null source or language is a group of its own. Without labels of both
kinds the model is flat: its odds are those of the labels. Repeated rows and ids are judged alike; of labels that
disagree on an id, the lowest quality and the highest toxicity count.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import small, written

SAMPLE_DOCS = 10_000
TERMS = 400
_N = 11


def make_up(text: str) -> list[float]:
    """The make-up of a text that has words."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n = max(1, int(raw.sum()))
    upper, digits, letters = raw[65:91].sum() / n, raw[48:58].sum() / n, (raw[65:91].sum() + raw[97:123].sum() + raw[128:].sum()) / n
    blank = raw[[9, 10, 11, 12, 13, 32]].sum() / n
    words = text.split()
    w = len(words)
    again = sum(map(operator.eq, words, words[1:])) / w
    symbols = 1 - letters - digits - blank
    # the share of distinct words falls with length, so it is held against what length lets expect
    distinct = len(set(words)) / w
    return [1.0, upper, min(upper, 0.3), symbols, min(symbols, 0.15), digits, raw[124] / n * 10, min(again, 0.3) * 3, distinct - 1 / (1 + w / 400), np.log1p(w) / 10, n / w / 20]


def word_terms(text: str) -> set[str]:
    """Lower-case words and their beginnings of 4 to 6 letters."""
    words = {w.strip(".,;:!?\"'()[]|*#%$&") for w in set(text.lower().split())}
    return words | {w[:k] + "~" for w in words for k in (4, 5, 6) if len(w) > k}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    """Newton's method; the first column is the intercept and isn't shrunk."""
    w = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - pull * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    def __init__(self, quality: np.ndarray, terms: dict[str, float], toxic: np.ndarray):
        self.quality, self.terms, self.toxic = quality, terms, toxic
        self.words = frozenset(t for t in terms if not t.endswith("~"))
        self.starts = {k: frozenset(t for t in terms if t.endswith("~") and len(t) == k + 1) for k in (4, 5, 6)}

    def evidence(self, text: str) -> list[float]:
        """Intercept, share and summed odds of a text's toxic terms."""
        words = {w.strip(".,;:!?\"'()[]|*#%$&") for w in set(text.lower().split())}
        hits = words & self.words
        for k, starts in self.starts.items():
            if starts:
                hits |= {w[:k] + "~" for w in words if len(w) > k} & starts
        odds = sorted((self.terms[t] for t in hits), reverse=True)
        return [1.0, min(sum(odds[:5]), 20.0) / 5, min(len(odds), 5) / 5, len(odds) / (5 + len(words))]

    def log_odds(self, text: str) -> tuple[float, float]:
        return float(np.clip(np.dot(self.quality, make_up(text)), -20, 20)), float(np.clip(np.dot(self.toxic, self.evidence(text)), -20, 20))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from a hash-drawn sample of at most SAMPLE_DOCS labelled documents."""
    one = labels.select(F.col("doc_id").cast("long"), "quality", "toxic").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = one.count()
    share = min(1.0, SAMPLE_DOCS / max(1, rows))
    drawn = written(one.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * share) + 1).limit(SAMPLE_DOCS), "labelsample")
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")
    sample = written(texts.dropDuplicates(["doc_id"]), "sample")

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [word_terms(t) for t in batch["text"]]
            yield pd.DataFrame({"term": pd.Series([t for s in sets for t in s], dtype=object), "toxic": np.repeat(batch["toxic"].to_numpy(np.int64), [len(s) for s in sets])})

    totals = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()[0]
    bad, good = int(totals.t or 0), int(totals.n) - int(totals.t or 0)
    chosen: dict[str, float] = {}
    if bad and good:
        counted = sample.mapInPandas(terms, "term string, toxic long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a >= 3")
        odds = f"ln((a + 0.5) / ({bad} + 1.0)) - ln((b + 0.5) / ({good} + 1.0))"
        share = f"((a + b) / {bad + good}D)"
        z = f"(a / {bad}D - b / {good}D) / sqrt({share} * (1 - {share}) * {1 / bad + 1 / good}D + 1e-12D)"
        best = counted.select("term", F.expr(odds).alias("odds"), F.expr(z).alias("z")).where("odds > 1.5 AND z > 6").orderBy(F.desc("z"), "term").limit(TERMS)
        chosen = {r.term: r.odds for r in best.collect()}
    part = Model(np.zeros(_N), chosen, np.zeros(4))

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [make_up(t) + part.evidence(t) if t.split() else None for t in batch["text"]], "quality": batch["quality"].astype("int64"), "toxic": batch["toxic"].astype("int64"), "doc_id": batch["doc_id"]})

    # numbers alone, of at most SAMPLE_DOCS rows
    got = sample.mapInPandas(rows_of, "x array<double>, quality long, toxic long, doc_id long").where("x IS NOT NULL").orderBy("doc_id").limit(SAMPLE_DOCS).collect()
    flat = Model(np.append(5.0, np.zeros(_N - 1)), chosen, np.array([-5.0, 0, 0, 0]))
    if not got:
        return flat
    x, q, t = np.array([r.x for r in got]), np.array([float(r.quality) for r in got]), np.array([float(r.toxic) for r in got])
    quality = fit_logistic(x[:, :_N], q) if q.min() < q.max() else flat.quality * (1 if q[0] else -1)
    toxic = fit_logistic(x[:, _N:], t) if t.min() < t.max() else flat.toxic * (-1 if t[0] else 1)
    return Model(quality, chosen, toxic)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """_k (a key of doc_id, text, source and lang), doc_id, source, lang, quality and toxic log-odds (null quality: no words)."""
    key = F.xxhash64("doc_id", "text", "source", "lang").alias("_k")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            odds = [model.log_odds(t) if t and t.split() else (None, None) for t in batch["text"]]
            out = batch.drop(columns="text")
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["q"], out["t"] = pd.Series([q for q, _ in odds], dtype="float64"), pd.Series([t for _, t in odds], dtype="float64")
            yield out

    frame = docs.select(key, F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "text")
    return frame.mapInPandas(run, "_k long, doc_id long, source string, lang string, q double, t double")


def posteriors(scores: DataFrame) -> DataFrame:
    """source, lang, p_host, p_path, p_all: the posterior mean quality of each host and path."""
    p = F.when(F.col("q").isNull(), 0.0).otherwise(1 / (1 + F.exp(-F.col("q"))))
    paths = written(scores.groupBy("source", "lang").agg(F.sum(p).alias("s"), F.count("*").alias("n")), "paths")
    hosts = written(paths.groupBy("source").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn")), "hosts")
    total = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n")).collect()[0]
    mean = float(total.s or 0) / max(1, int(total.n or 0))
    host_weight = _prior_weight(hosts, "hs", "hn", mean)
    path_weight = _prior_weight(paths, "s", "n", mean)
    host = hosts.withColumn("p_host", (F.col("hs") + host_weight * mean) / (F.col("hn") + host_weight)).select(F.col("source").alias("_source"), "p_host")
    joined = paths.join(host, paths.source.eqNullSafe(host["_source"]))
    return joined.select("source", "lang", "p_host", ((F.col("s") + path_weight * F.col("p_host")) / (F.col("n") + path_weight)).alias("p_path"), F.lit(mean).alias("p_all"))


def _prior_weight(groups: DataFrame, s: str, n: str, mean: float) -> float:
    """The prior's weight in documents: small where groups differ more than chance lets them."""
    got = groups.agg(F.sum(F.col(n) * (F.col(s) / F.col(n) - mean) ** 2).alias("between"), F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(F.col(n).cast("double") ** 2).alias("nn")).collect()[0]
    if not got.g or got.g < 2:
        return 100.0
    chance = mean * (1 - mean)
    size = got.n - got.nn / got.n
    spread = max(0.0, (float(got.between) - (got.g - 1) * chance) / size) if size > 0 else 0.0
    return float(np.clip(chance / spread - 1 if spread > 1e-9 else 1e4, 10.0, 1e4))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """_k, doc_id, source, lang, p_doc, p_host, p_path, p_quality, p_toxic, kept for each row of docs."""
    scores = written(scored(docs, fit(docs, labels)), "scores")
    groups = written(posteriors(scores), "posteriors").withColumnsRenamed({"source": "_source", "lang": "_lang"})
    joined = scores.join(small(groups), F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang")), "left")
    sure = lambda p: F.ln(F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6)) / (1 - F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))))
    odds = F.col("q") + sure(F.col("p_path")) - sure(F.col("p_all"))
    chance = lambda x: F.coalesce(1 / (1 + F.exp(-x)), F.lit(0.0))
    out = joined.select("_k", "doc_id", "source", "lang", chance(F.col("q")).alias("p_doc"), "p_host", "p_path", chance(odds).alias("p_quality"), chance(F.col("t")).alias("p_toxic"))
    return out.withColumn("kept", F.expr("p_quality >= 0.5 AND p_toxic < 0.5"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, all columns as they are."""
    columns = docs.columns
    rejected = written(classify(docs, labels).where("NOT kept").select("_k").distinct(), "rejected")
    keyed = docs.withColumn("_k", F.xxhash64("doc_id", "text", "source", "lang"))
    return keyed.join(small(rejected), "_k", "left_anti").select(columns)
