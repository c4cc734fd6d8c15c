"""Mixing to target weights (operator 4): soft membership, with Spark's own functions only.

1. A classifier learned from the labelled table gives each document a
   posterior for every domain: naive Bayes over the presence of hashed words,
   beginnings of words and traits of the text's structure that tell a domain
   from the first one; texts without any have the shares of such labelled
   texts. It is fitted on at most `max_rows` labelled texts.
2. Each document d gets a rate r_d >= 0, its expected number of copies. With
   tokens n_d (words), posteriors p_dk and W = sum of n_d, the expected share of
   domain k is sum_d n_d p_dk r_d / W. The rates minimise

       1/2 sum_k (share_k - target_k)^2 / mass_k + lam/2 sum_d n_d/W (r_d - 1)^2

   over r >= 0, where mass_k is the share at rates of 1. At the optimum
   r_d = max(0, 1 - (p_d . g) / lam) with g_k = (share_k - target_k) / mass_k, so
   only one number per domain is sought: some projected gradient steps give a
   start, Newton steps on the convex dual in g end at the optimum. The cluster
   sums, a few numbers per step reach the driver, and a document's rate follows
   from its posteriors and g, so it can be computed where the text is.
3. `copies` is the rate rounded down or up, by a hash of the document, so that
   its mean is the rate.

The domains are what the labels tell apart: `clean`, `low` (quality 0) and
`toxic`. Targets are shares of all tokens; where the posteriors leave no rates
that meet them, the fit comes as near as rates can.

Defined results: a null text counts as empty (no tokens, judged by the priors);
rows that agree in id and text get the same rate; a null `doc_id` is mixed like
another; of several label rows for one id the worst counts, rows without any
label are left out; a domain without labelled rows or tokens has no pull; with
no usable labels, or no tokens at all, every rate is 1; an empty table gives no
rows; `resample` keeps the input's columns, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import read_table
from . import common
from .common import bound

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.95, "low": 0.02, "toxic": 0.03}
MAX_ROWS = 20_000      # labelled texts the classifier is fitted on, at most
TELLING = 2000         # features the classifier keeps, at most
SLOTS = 1 << 14        # places of its table
BEGINNING = 5          # characters of a word's beginning
SHRINK = 3.0           # pseudo-texts with a feature, per domain
LEAST = 2.5            # weaker evidence counts as none, as does evidence for the first domain
STEPS = 40             # gradient steps, at most
SEGMENT = 10           # steps after which the rates are written down
LAM = 1e-3
CONVERGED = 1e-7       # no rate changes by more in the last Newton step
CLOSE = 1e-4           # shares this near to their targets end the fit
MARKS = "!|*%$#&"


def words_of(text: Column) -> Column:
    """Lower-cased words of a text (white space separates them)."""
    flat = F.lower(F.coalesce(text, F.lit("")))
    for c in "\n\t\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def features(text: Column, words: Column) -> Column:
    """64-bit hashes of a text's features: its distinct words, their beginnings, and traits of its structure; some come twice."""
    n = F.size(words)
    level = lambda share: F.floor(F.log2(share * 1000 + 1)).cast("string")
    # a mark is one byte, so that bytes count it; a lambda's body is not searched for common parts: lengths are bound once
    lengths = F.struct(F.octet_length(text).alias("bytes"), F.greatest(F.char_length(text), F.lit(1)).alias("chars"))
    marks = bound(lengths, lambda x: F.array(*(
        F.concat(F.lit(f"\u0001{m}"), level((x["bytes"] - F.octet_length(F.replace(text, F.lit(m), F.lit("")))) / x["chars"]))
        for m in MARKS)))

    def of(distinct: Column) -> Column:
        same = F.concat(F.lit("\u0001same"), F.floor(F.size(distinct) * 10 / F.greatest(n, F.lit(1))).cast("string"),
                        F.lit(":"), F.floor(F.log2(n + F.lit(1.0))).cast("string"))
        return F.concat(F.transform(distinct, lambda w: F.xxhash64(w)), F.transform(F.array_append(marks, same), lambda w: F.xxhash64(w)),
                        F.transform(distinct, lambda w: F.xxhash64(F.lit(1), F.substring(w, 1, BEGINNING))))
    return bound(F.array_distinct(words), of)


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled ids."""
    toxic, quality = F.max(F.col("toxic").cast("int")), F.min(F.col("quality").cast("int"))
    return (labels.filter(F.col("doc_id").isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull()))
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.when(toxic == 1, F.lit("toxic")).when(quality == 0, F.lit("low")).otherwise(F.lit("clean")).alias("domain")))


@dataclass
class Classifier:
    """Telling features in a table of SLOTS places: the feature's hash at its place, and its evidence for each domain."""
    priors: list[float]
    hashes: list[int]
    evidence: list[list[float]]


def fit_classifier(docs: DataFrame, labels: DataFrame, domains=DOMAINS, max_rows: int = MAX_ROWS,
                   kept: int = TELLING, slots: int = SLOTS) -> Classifier | None:
    """Counts the features of a bounded sample of labelled texts by domain; keeps at most `kept` that tell most."""
    sample = domain_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = common.checkpointed(
        texts.join(F.broadcast(sample), "doc_id")                      # at most max_rows ids
        .select("domain", bound(words_of(F.col("text")), lambda w: F.array_distinct(features(F.col("text"), w))).alias("f")))
    sizes = {r["domain"]: r["count"] for r in found.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    if not total:
        return None
    counts = (found.select("domain", F.explode("f").alias("h")).groupBy("h")
              .agg(*(F.sum((F.col("domain") == d).cast("double")).alias(d) for d in domains)))
    every = sum((F.col(d) for d in domains), F.lit(0.0))
    share = every / total
    score = {d: F.log((F.col(d) + SHRINK) / (sizes.get(d, 0) * share + SHRINK)) for d in domains}
    against = [F.when(score[d] - score[domains[0]] >= LEAST, score[d] - score[domains[0]]).otherwise(0.0) for d in domains]
    tells = F.greatest(F.lit(0.0), *against[1:]) * every
    best = (counts.select("h", *(a.alias(f"w{k}") for k, a in enumerate(against)), tells.alias("tells"))
            .filter(F.col("tells") > 0).orderBy(F.desc("tells"), "h").limit(kept).collect())
    hashes, evidence = [0] * slots, [[0.0] * slots for _ in domains]
    for r in best:                       # of two features with one place the more telling stays
        at = r["h"] % slots
        if not hashes[at]:
            hashes[at] = r["h"]
            for k in range(len(domains)):
                evidence[k][at] = round(r[f"w{k}"], 3)
    # what no telling feature says: the domains' shares among such texts
    bare = F.forall("f", lambda h: F.get(_constant(hashes, "bigint"), F.pmod(h, F.lit(slots)).cast("int")) != h)
    sizes = {r["domain"]: r["count"] for r in found.filter(bare).groupBy("domain").count().collect()}
    total = sum(sizes.values())
    priors = [math.log((sizes.get(d, 0) + 0.5) / (total + 0.5 * len(domains))) for d in domains]
    return Classifier(priors, hashes, evidence)


def _constant(numbers: list, kind: str) -> Column:
    """A constant array, made once when the plan is optimised."""
    return F.split(F.lit(",".join(f"{x:g}" if kind == "double" else str(x) for x in numbers)), ",").cast(f"array<{kind}>")


def judged(text: Column, model: Classifier | None, domains=DOMAINS) -> Column:
    """Struct of a text's `tokens` (words) and the array `p` of its domains' probabilities."""
    text = F.coalesce(text, F.lit(""))
    even = F.array(*(F.lit(1.0 / len(domains)) for _ in domains))
    if model is None:
        return bound(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("tokens"), even.alias("p")))
    place = lambda h: F.pmod(h, F.lit(len(model.hashes))).cast("int")
    hashes = _constant(model.hashes, "bigint")

    def evidence(found: Column, k: int) -> Column:
        w = _constant(model.evidence[k], "double")
        return F.aggregate(found, F.lit(model.priors[k] - model.priors[0]), lambda a, h: a + F.get(w, place(h)))

    def chances(found: Column) -> Column:
        odds = F.array(F.lit(1.0), *(F.exp(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), evidence(found, k))))
                                     for k in range(1, len(domains))))
        return bound(odds, lambda o: F.transform(o, lambda x: x / F.aggregate(o, F.lit(0.0), lambda a, y: a + y)))

    def of(words: Column) -> Column:
        found = F.array_distinct(F.filter(features(text, words), lambda h: F.get(hashes, place(h)) == h))
        return F.struct(F.size(words).cast("long").alias("tokens"), bound(found, chances).alias("p"))
    return bound(words_of(text), of)


def stepped(start: Column, p: Column, pulls: list[list[float]], lam: float = LAM) -> Column:
    """The rate after the gradient steps whose `pulls` (one number per domain) are given."""
    if not pulls:
        return start
    eta = 1 / (1 + lam)
    steps = F.array(*(F.array(*(F.lit(float(x)) for x in g)) for g in pulls))
    return F.aggregate(steps, start, lambda r, g: F.greatest(
        F.lit(0.0), r * (1 - eta * lam) + eta * lam - eta * F.aggregate(
            F.zip_with(p, g, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))


def fit_rates(rows: DataFrame, targets: list[float], steps: int = STEPS, lam: float = LAM,
              close: float = CLOSE) -> tuple[list[list[float]], list[float]]:
    """(pulls of all steps, shares reached) for `rows(tokens, p)`."""
    k = len(targets)
    shares = [F.sum(F.col("tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(k)]
    first = rows.agg(F.sum("tokens").alias("all"), *shares).first()
    if not first["all"]:
        return [], [0.0] * k
    mass = [first[f"s{i}"] / first["all"] for i in range(k)]
    rows = rows.select((F.col("tokens") / F.lit(float(first["all"]))).alias("n"),
                       "p", F.lit(1.0).alias("r"))
    done, pulls, now = [], [], mass
    for _ in range(steps):
        if max(abs(a - b) for a, b in zip(now, targets)) < close:
            break
        pulls.append([(now[i] - targets[i]) / mass[i] if mass[i] > 1e-9 else 0.0 for i in range(k)])
        r = stepped(F.col("r"), F.col("p"), pulls, lam)
        if len(pulls) == SEGMENT:
            rows = common.checkpointed(rows.select("n", "p", r.alias("r")))
            done, pulls, r = done + pulls, [], F.col("r")
        got = rows.select("n", "p", r.alias("rate")).agg(
            *(F.sum(F.col("n") * F.col("rate") * F.col("p")[i]).alias(f"s{i}") for i in range(k))).first()
        now = [got[f"s{i}"] for i in range(k)]
    return done + pulls, now


def best_rates(rows: DataFrame, targets: list[float], lam: float = LAM) -> tuple[list[list[float]], list[float]]:
    """(one pull, shares reached) of the optimum for `rows(tokens, p)`."""
    k = len(targets)
    start, _ = fit_rates(rows, targets, SEGMENT, lam)
    shares = [F.sum(F.col("tokens") * F.col("p")[i]).alias(f"s{i}") for i in range(k)]
    first = rows.agg(F.sum("tokens").alias("all"), *shares).first()
    if not first["all"]:
        return [], [0.0] * k
    mass, target = np.array([first[f"s{i}"] / first["all"] for i in range(k)]), np.array(targets)
    on = mass > 1e-9                      # a domain without tokens has no pull
    n, pairs = F.col("tokens") / F.lit(float(first["all"])), [(i, j) for i in range(k) for j in range(i, k)]

    def at(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Dual value, its gradient and second derivatives, and the shares."""
        rate = rate_of(F.col("p"), [_pull(g, lam)], lam)
        got = rows.select(n.alias("n"), "p", rate.alias("r")).agg(
            F.coalesce(F.sum(F.col("n") * F.col("r") * F.col("r")), F.lit(0.0)),
            *(F.sum(F.col("n") * F.col("r") * F.col("p")[i]) for i in range(k)),
            *(F.sum(F.when(F.col("r") > 0, F.col("n") * F.col("p")[i] * F.col("p")[j]).otherwise(0.0)) for i, j in pairs)).first()
        now, second = np.array(got[1:k + 1]), np.diag(mass)
        for (i, j), x in zip(pairs, got[k + 1:]):
            second[i, j] += x / lam
            if i != j:
                second[j, i] += x / lam
        return (mass * g * g).sum() / 2 + g @ target + lam / 2 * got[0], mass * g + target - now, second, now

    g = np.where(on, np.array(start[-1]), 0.0) if start else np.zeros(k)
    value, slope, second, now = at(g)
    while True:
        step = np.zeros(k)
        step[on] = np.linalg.solve(second[np.ix_(on, on)], slope[on])
        if np.abs(step).max() / lam < CONVERGED:
            break
        part = 1.0
        while True:                       # half as far until the dual falls
            there = at(g - part * step)
            if there[0] <= value - 1e-4 * part * (slope @ step) + 1e-16 or part < 1e-9:
                break
            part /= 2
        if part < 1e-9:                   # rounding leaves nothing to gain
            break
        g = g - part * step
        value, slope, second, now = there
    return [_pull(g, lam)], now.tolist()


def _pull(g: np.ndarray, lam: float) -> list[float]:
    """The pull whose one step leads from rates of 1 to the rates that belong to `g`."""
    return (g * (1 + lam) / lam).tolist()


def rate_of(p: Column, pulls: list[list[float]], lam: float = LAM) -> Column:
    """A document's rate, step for step as it was fitted."""
    out = F.lit(1.0)
    for i in range(0, len(pulls), SEGMENT):
        out = stepped(out, p, pulls[i:i + SEGMENT], lam)
    return out


def copies_of(rate: Column, *identity: Column, seed: int = 0) -> Column:
    """The rate rounded down or up, with its fraction as the chance of up."""
    chance = F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + chance).cast("int")


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domains=DOMAINS,
        max_rows: int = MAX_ROWS) -> tuple[object, list[list[float]], DataFrame, list[float]]:
    """(classifier, pulls, judged rows, shares reached); the rows hold doc_id, tie, tokens and p."""
    targets = targets or TARGETS
    model = fit_classifier(docs, labels, domains, max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"),
                       judged(F.col("text"), model, domains).alias("j"))
    rows = common.stored(rows.select("doc_id", "tie", "j.tokens", "j.p"), "judged")
    pulls, reached = ([], []) if model is None else best_rates(rows.select("tokens", "p"), [targets[d] for d in domains])
    return model, pulls, rows, reached


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domains=DOMAINS,
                 max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate, copies) of each row of `docs(doc_id, text)`."""
    _, pulls, rows, _ = fit(docs, labels, targets, domains, max_rows)
    rows = rows.withColumn("rate", rate_of(F.col("p"), pulls))
    return rows.select("doc_id", "tokens", *(F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)), "rate",
                       copies_of(F.col("rate"), F.col("doc_id"), F.col("tie")).alias("copies"))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, domains=DOMAINS,
             max_rows: int = MAX_ROWS) -> DataFrame:
    """`docs` with each row as often as its `copies` say; same columns."""
    model, pulls, _, _ = fit(docs, labels, targets, domains, max_rows)
    rate = bound(judged(F.col("text"), model, domains), lambda j: rate_of(j["p"], pulls))
    n = copies_of(rate, F.col("doc_id").cast("long"), F.xxhash64("text"))
    times = F.transform(F.filter(F.array(n), lambda c: c > 0), lambda c: F.sequence(F.lit(1), c))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.flatten(times).alias("times"))
    return rows.select("row", F.explode("times").alias("time")).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(common.documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
