"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Two traits make a document unfit: low quality and toxicity. For each, a logistic
model on the document alone gives evidence, the log-odds beyond the labelled
base rate. Sites repeat themselves, so the evidence meets a prior of the
document's path, which is shrunk to its host, which is shrunk to all documents:

    host rate = (sum of probabilities + s x global rate) / (documents + s)
    path rate = (sum of probabilities + t x host rate) / (documents + t)

The strengths s and t are fitted by moments from the spread of the rates between
hosts and between a host's paths: the less they differ, the harder a sparse site
is pulled to its parent. Sums are grouped aggregates with map-side combination,
so a host with a third of the rows is an ordinary one. A document goes if either
trait's posterior is above 1/2.

The document model is fitted on at most SAMPLE labelled documents, those whose
ids come first in hash order; the bound keeps the fit small. Everything else
covers all documents and whole texts.

Cases: a null or empty text has no evidence; its posterior is its site's rate.
Null hosts and paths are sites of their own. Repeated labels of one document are
merged (lowest quality, highest toxicity); null labels are passed over. Without
labels of both kinds of a trait it has no evidence and rejects nothing. Repeated
rows are scored alike. Columns of any other name pass through; a clash with an
output column is resolved for the output.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlens.llm.common import uncarried
from loginlens.session import durable

SAMPLE = 8_000
VOCABULARY = 50_000
LEAST_DOCUMENTS = 4
TRAITS = ("low", "toxic")
WORD = re.compile(r"\w+")
BATCH = 256

PREFIXES = (3, 5)

_CLASS = np.zeros(256, dtype=np.int64)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = (1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c == " "
                  else 5 if _c in "\r\n\t" else 6 if _c in ".,;:" else 7 if _c in "!?" else 8 if _i > 127 else 9)


def marks(words: set[str] | Counter) -> set[str]:
    """The words of a text and how they begin; beginnings stand for words too rare to be learned."""
    found = set(words)
    for k in PREFIXES:
        found.update(["^" + w for w in {w[:k] for w in words}])
    return found


def features(text: str, weights: dict[str, dict[str, float]]) -> list[float]:
    """Shape of a text and, per trait, its most telling words."""
    raw = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)], minlength=10)
    letters = max(1, int(raw[1] + raw[2] + raw[8]))
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    distinct = Counter(words)
    lines = text.split("\n")
    out = [math.log1p(len(words)), len(distinct) / n, math.log1p(len(distinct)) / math.log1p(n),
           sum(map(operator.eq, words, words[1:])) / n, max(distinct.values(), default=0) / n,
           raw[2] / letters, raw[3] / letters, raw[7] / n, raw[9] / n, raw[6] / n, raw[8] / letters,
           sum(map(len, words)) / n / 10, len(lines) / n, len(set(lines)) / len(lines)]
    told_by = marks(distinct)
    for trait in TRAITS:
        table = weights[trait]
        told = sorted([table[w] for w in told_by & table.keys()], reverse=True)
        top = [max(0.0, x) for x in told[:3]] + [0.0] * 3
        out += [top[0], top[1], top[2], sum(told) / math.sqrt(len(distinct) + 1.0)]
    return out


def word_weights(texts: list[str], unfit: np.ndarray) -> dict[str, float]:
    """Smoothed log ratio of the document frequencies of words, the most telling ones."""
    both = [Counter(), Counter()]
    for text, bad in zip(texts, unfit):
        both[int(bad)].update(marks(set(WORD.findall(text.lower()))))
    n = [max(1, int((unfit == k).sum())) for k in (0, 1)]
    table = {}
    for word in both[0].keys() | both[1].keys():
        good, bad = both[0][word], both[1][word]
        if good + bad >= LEAST_DOCUMENTS:
            table[word] = math.log((bad + 0.5) / (n[1] + 1)) - math.log((good + 0.5) / (n[0] + 1))
    kept = sorted(table, key=lambda w: (-abs(table[w]), w))[:VOCABULARY]
    return {w: table[w] for w in kept}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients of a ridge-penalised logistic model by Newton steps; the last one is the constant."""
    design = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(design.shape[1])
    penalty = np.full(design.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (p - y) + penalty * beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The document model, from a bounded sample of the labelled documents."""
    marks = (labels.where("doc_id is not null and (quality is not null or toxic is not null)")
             .groupBy(F.col("doc_id").cast("long").alias("label_id"))
             .agg(F.min("quality").alias("q"), F.max("toxic").alias("t")))
    picked = durable(marks.orderBy(F.xxhash64("label_id"), "label_id").limit(sample))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
            .join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
            .select("doc_id", "text", "q", "t").dropDuplicates(["doc_id"]).toPandas()
            .sort_values("doc_id", kind="stable"))
    texts = rows["text"].tolist()
    model: dict = {"weights": {}, "traits": {}}
    half = np.arange(len(texts)) % 2 == 0
    # Words weighed on one half describe the other, lest the model trust them too much; the final
    # weights are those of all.
    crossed = [{}, {}]
    marked = {}
    for trait, column, bad in (("low", "q", 0), ("toxic", "t", 1)):
        known = rows[column].notna().to_numpy()
        unfit = (rows[column] == bad).to_numpy()
        marked[trait] = (known, unfit)
        usable = 0 < unfit[known].sum() < known.sum()
        for weights, part in ((crossed[0], known & half), (crossed[1], known & ~half), (model["weights"], known)):
            both = usable and 0 < unfit[part].sum() < part.sum()
            weights[trait] = word_weights([t for t, p in zip(texts, part) if p], unfit[part]) if both else {}
    if not texts:
        return model
    every = np.array([features(t, crossed[int(h)]) for t, h in zip(texts, half)])
    model["mean"], model["scale"] = every.mean(axis=0), every.std(axis=0) + 1e-6
    for trait in TRAITS:
        known, unfit = marked[trait]
        if not model["weights"][trait]:
            continue
        x, y = (every[known] - model["mean"]) / model["scale"], unfit[known].astype(float)
        base = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        model["traits"][trait] = {"beta": fit_logistic(x, y), "base": base}
    return model


def with_evidence(docs: DataFrame, model: dict) -> DataFrame:
    """Add `e_low` and `e_toxic`: log-odds of the document alone beyond the base rate (0: none)."""
    kept = docs.drop("e_low", "e_toxic")
    names = kept.columns
    at = names.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                some = batch.slice(first, BATCH)
                texts = some.column(at).to_pylist()
                out = {trait: np.zeros(len(texts)) for trait in TRAITS}
                has = [i for i, t in enumerate(texts) if t]
                if has and model["traits"]:
                    x = (np.array([features(texts[i], model["weights"]) for i in has]) - model["mean"]) / model["scale"]
                    for trait, state in model["traits"].items():
                        odds = np.clip(x @ state["beta"][:-1] + state["beta"][-1], -15, 15)
                        out[trait][has] = odds - math.log(state["base"] / (1 - state["base"]))
                yield pa.RecordBatch.from_arrays([*some.columns, *[pa.array(out[t]) for t in TRAITS]],
                                                 [*names, "e_low", "e_toxic"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(score, f"{kinds}, e_low double, e_toxic double")


def site_rates(scored: DataFrame, host: str, path: str, model: dict) -> DataFrame:
    """Per (host, path): documents `n`, shrunk rates `host_low, path_low, host_toxic, path_toxic`."""
    base = {t: model["traits"].get(t, {}).get("base", 1e-4) for t in TRAITS}
    chance = {t: 1 / (1 + F.exp(-(F.col(f"e_{t}") + math.log(base[t] / (1 - base[t]))))) for t in TRAITS}
    paths = durable(scored.groupBy(F.col(host).alias("h"), F.col(path).alias("p")).agg(
        F.count("*").alias("n"), *[F.sum(chance[t]).alias(f"s_{t}") for t in TRAITS]))
    hosts = paths.groupBy("h").agg(F.sum("n").alias("hn"), *[F.sum(f"s_{t}").alias(f"hs_{t}") for t in TRAITS])
    whole = hosts.agg(F.sum("hn").alias("n"), *[F.sum(f"hs_{t}").alias(t) for t in TRAITS]).first()
    rates = {t: float(np.clip((whole[t] or 0) / max(whole["n"] or 0, 1), 1e-4, 1 - 1e-4)) for t in TRAITS}

    def strength(frame: DataFrame, n: str, s: str, centre: object, rate: float) -> float:
        """Prior documents: a beta prior's size by moments, the weighted spread less that of counting."""
        gap = F.col(s) / F.col(n) - centre
        row = frame.agg((F.sum(F.col(n) * gap * gap) / F.sum(n)).alias("v"), F.count("*").alias("k"),
                        F.sum(n).alias("n")).first()
        if not row["k"] or row["k"] < 2:
            return 100.0
        spread = rate * (1 - rate)
        between = max((row["v"] or 0) - spread * (row["k"] - 1) / row["n"], spread * 1e-4)
        return float(np.clip(spread / between - 1, 1.0, 10_000.0))

    for t in TRAITS:
        s = strength(hosts, "hn", f"hs_{t}", F.lit(rates[t]), rates[t])
        hosts = hosts.withColumn(f"host_{t}", (F.col(f"hs_{t}") + s * rates[t]) / (F.col("hn") + s))
    hosts = durable(hosts)
    found = paths.join(hosts.withColumnRenamed("h", "host_key"), F.col("h").eqNullSafe(F.col("host_key")))
    found = durable(found.drop("host_key"))
    for t in TRAITS:
        s = strength(found, "n", f"s_{t}", F.col(f"host_{t}"), rates[t])
        found = found.withColumn(f"path_{t}", (F.col(f"s_{t}") + s * F.col(f"host_{t}")) / (F.col("n") + s))
    return durable(found.select(F.col("h").alias("_host"), F.col("p").alias("_path"), F.col("n").alias("site_n"),
                                *[f"{level}_{t}" for level in ("host", "path") for t in TRAITS]))


def decide(scored: DataFrame, sites: DataFrame, host: str, path: str) -> DataFrame:
    """Add `p_low, p_toxic` (posteriors) and `keep`; the joined site rates go with them.

    The site table is small where hosts are few, and Spark then broadcasts it
    by its measured size; otherwise this is a shuffled join whose hot sites are split.
    """
    joined = scored.drop("p_low", "p_toxic", "keep", *sites.columns).join(
        sites, F.col(host).eqNullSafe(F.col("_host")) & F.col(path).eqNullSafe(F.col("_path")))
    for t in TRAITS:
        prior = F.least(F.greatest(F.col(f"path_{t}"), F.lit(1e-4)), F.lit(1 - 1e-4))
        joined = joined.withColumn(f"p_{t}", 1 / (1 + F.exp(-(F.col(f"e_{t}") + F.log(prior / (1 - prior))))))
    return joined.withColumn("keep", (F.col("p_low") <= 0.5) & (F.col("p_toxic") <= 0.5))


def classify(docs: DataFrame, train: DataFrame, labels: DataFrame, host: str, path: str,
             sample: int = SAMPLE) -> DataFrame:
    """`docs` with evidence, site rates, posteriors and `keep`; the model is fitted on `train` and `labels`."""
    model = fit(train, labels, sample)
    scored = durable(with_evidence(docs, model))
    return decide(scored, site_rates(scored, host, path, model), host, path)


def drop_unfit(docs: DataFrame, labels: DataFrame, host: str, path: str, sample: int = SAMPLE) -> DataFrame:
    """The documents that are kept, with their own columns."""
    rows = docs.select("doc_id", "text", F.col(host).alias("host"), F.col(path).alias("path"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    return uncarried(classify(rows, rows, labels, "host", "path", sample).where("keep"), docs)
