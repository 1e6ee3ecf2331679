"""Quality and toxicity classifier: evidence of an alert's own text, of its publisher and of the publisher's section."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import hashed_share
from kerbside.session import stored

FEATURES = ("size", "distinct", "commonest", "upper", "marks", "digits", "spaces", "word_length", "lines")
UPPER, MARKS, DIGITS = (bytes(range(65, 91)), b"!|#*_=<>{}[]~^\\%$@", bytes(range(48, 58)))
SAMPLE_ROWS = 20_000       # labelled alerts that the classifier is fitted on at most
WORD_RUNS = re.compile(r"\w+")
TELLING_WORDS = 4096       # words that the toxic head weighs at most, those most uneven between the labels
UNEVEN = 4.0               # log likelihood ratio of a word from which it is weighed: one in 200 by chance


def shape(text: str) -> list[float]:
    """Measures of a whole text, in the order of FEATURES."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = max(len(words), 1), max(len(data), 1)
    counts = Counter(words)
    share = lambda marks: (len(data) - len(data.translate(None, marks))) / size
    return [log1p(len(words)), len(counts) / n, max(counts.values(), default=0) / n, share(UPPER), share(MARKS), share(DIGITS),
            share(b" \t\n\x0b\x0c\r"), min(sum(map(len, words)) / n, 40.0), data.count(b"\n") / n]


def word_hashes(text: str) -> set[int]:
    """Signed hashes of the distinct words, lower-cased runs of letters, digits and underscores of the whole text."""
    digest = xxhash.xxh64_intdigest
    return {(h := digest(w.encode("utf-8", "surrogatepass"))) - (h >> 63 << 64) for w in set(WORD_RUNS.findall(text.lower()))}


def _fit_words(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, words: int, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression over the presence of words, given as (row, word) pairs: Newton steps by conjugate gradients.

    The intercept comes first and is not shrunk.
    """
    def forth(w: np.ndarray) -> np.ndarray:
        return w[0] + np.bincount(rows, w[1 + cols], len(y))

    def back(g: np.ndarray) -> np.ndarray:
        return np.concatenate(([g.sum()], np.bincount(cols, g[rows], words)))

    def loss(w: np.ndarray) -> float:
        score = forth(w)
        return float((np.logaddexp(0, score) - y * score).sum() + (penalty * w * w).sum() / 2)

    weights, penalty = np.zeros(1 + words), np.full(1 + words, ridge)
    weights[0], penalty[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(forth(weights), -30, 30)))
        spread, step = p * (1 - p), np.zeros(1 + words)
        rest = back(y - p) - penalty * weights
        way, size = rest.copy(), rest @ rest
        for _ in range(200):
            if size < 1e-10:
                break
            bent = back(spread * forth(way)) + penalty * way
            pace = size / (way @ bent)
            step += pace * way
            rest -= pace * bent
            size, before = rest @ rest, size
            way = rest + size / before * way
        now = loss(weights)
        while np.abs(step).max() >= 1e-4 and not loss(weights + step) < now:
            step /= 2
        if np.abs(step).max() < 1e-4:
            break
        weights += step
    return weights


def _toxic_head(source: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[float, dict[int, float]]:
    """Intercept and word weights of the log odds that a text is toxic, from ``source(key, text)`` and ``labels(key, y)``.

    Only counts of words and the sample's telling words reach the driver.
    """
    known = labels.where("y in (0, 1)").groupBy("key").agg(F.max("y").alias("y"))
    drawn = known.where(hashed_share("key", sample_rows, known.count())).orderBy(F.pmod(F.xxhash64("key"), F.lit(1 << 40)), "key").limit(sample_rows)
    texts = source.select("key", "text").join(F.broadcast(drawn), "key").select("y", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(word_hashes(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.int64()))], names=["y", "words"])

    sample = stored(texts.mapInArrow(read, "y int, words array<long>"), "labelled-words")
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < toxic < n:
        share = min(max(toxic / n if n else 0.0, 1e-6), 1 - 1e-6)
        return log(share / (1 - share)), {}
    share = toxic / n
    counts = sample.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    # Log likelihood ratio of the word's own toxic share against everyone's.
    times = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    ratio = times(F.col("s"), F.col("n") * share) + times(F.col("n") - F.col("s"), F.col("n") * (1 - share))
    chosen = [r["word"] for r in counts.where("n > 2").withColumn("ratio", ratio).where(F.col("ratio") >= UNEVEN).orderBy(F.desc("ratio"), "word")
              .limit(TELLING_WORDS).select("word").collect()]
    place = {w: i for i, w in enumerate(chosen)}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[place[w] for w in row if w in place] for row in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.int32()))], names=["y", "words"])

    rows = sample.mapInArrow(pick, "y int, words array<int>").toPandas()
    y, sizes = rows["y"].to_numpy(float), np.array([len(w) for w in rows["words"]], np.int64)
    cols = np.concatenate([np.asarray(w, np.int64) for w in rows["words"]])
    weights = _fit_words(np.repeat(np.arange(len(y)), sizes), cols, y, len(chosen))
    return float(weights[0]), dict(zip(chosen, weights[1:].tolist()))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps over centred and scaled features and their squares."""
    weights = np.zeros(x.shape[1])
    weights[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _logit(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(held / (1 - held))


def _strength(groups: DataFrame, s: str, prior: Column) -> Column:
    """Beta prior strength by moments over groups (n, ``s``): how much their means differ beyond chance.

    An aggregate expression; groups weigh by their size. With no spread beyond chance it is large, so that
    groups shrink fully.
    """
    mean, rows, chance = F.col(s) / F.col("n"), F.sum("n"), prior * (1 - prior)
    between = (F.sum(F.col("n") * (mean - prior) * (mean - prior)) - F.sum(chance)) / rows
    return F.least(F.greatest(F.sum(F.col("n") * chance) / rows / F.greatest(between, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e6))


def alert_quality(alerts: DataFrame, labels: DataFrame, alert_id: str = "alert_id", description: str = "description",
                  publisher: str = "publisher", section: str = "section", label: str = "quality",
                  toxic: str = "toxic", sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """Probabilities that an alert is worth keeping and that it is toxic, from its text and from where it was published.

    Returns one row per input row: ``alert_id``, ``p_text`` (quality by the text alone), ``p_publisher`` and
    ``p_section`` (posterior means of the publisher and of its section), ``p_quality``, ``p_toxic`` and ``keep``: good
    enough and not toxic.

    A logistic classifier over shape features is fitted on at most ``sample_rows`` labelled alerts, those with
    the smallest hashes of their ids; everything else covers all rows. Grouped aggregation sums the evidence
    by section and publisher. Sections shrink towards their publisher and publishers towards the global mean by
    Beta priors whose strengths come from the spread of the group means (moments), so sparse sites say little.
    The section's posterior replaces the global prior in the odds of the text.

    Toxicity is a second head of the same kind over the words of the whole text, fitted on as many labels: of the
    sample's words, hashed to 64 bits, those more uneven between the labels than chance explains are weighed.

    One Python pass measures the texts (the sample's words are read before); its result, a few numbers a row, is stored in the shared folder and
    everything later reads that. Groups are summed with map-side combining and joined back in joins that
    adaptive execution can split, so a publisher with a third of the rows is no bottleneck.

    Defined cases: a null or empty description has zero measures; a null publisher or section is a group of its
    own; labels that are null, not 0 or 1, or of unknown alerts are ignored and repeated ones count once (the
    largest wins); without labels of both kinds every text is as good as the labelled mean (1 without any) and as
    toxic as the labelled mean (0 without any, or without such a column);
    repeated rows are scored alike; a row without an id is scored; empty tables give an empty result; other
    columns are not read.
    """
    pick = lambda name, to: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).alias(to)
    source = alerts.select(F.col(f"`{alert_id}`").alias("key"), pick(description, "text"), F.col(f"`{publisher}`").cast("string").alias("host"),
                           F.col(f"`{section}`").cast("string").alias("path"))
    kind = source.schema["key"].dataType.simpleString()

    toxic_base, word_weights = log(1e-6), {}
    if toxic in labels.columns:
        toxic_base, word_weights = _toxic_head(source, labels.select(F.col(f"`{alert_id}`").alias("key"), F.col(f"`{toxic}`").cast("int").alias("y")),
                                               sample_rows)

    def p_toxic(text: str) -> float:
        score = toxic_base + (sum(word_weights[w] for w in sorted(word_hashes(text) & word_weights.keys())) if word_weights else 0.0)
        return 1 / (1 + exp(-min(max(score, -30.0), 30.0)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[*shape(t), p_toxic(t)] for t in batch.column("text").to_pylist()]
            columns = zip(*rows) if rows else [[]] * (len(FEATURES) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "host", "path")]
                                             + [pa.array(c, pa.float64()) for c in columns], names=["key", "host", "path", *FEATURES, "toxic_text"])

    measured = stored(source.mapInArrow(measure, f"key {kind}, host string, path string, " + ", ".join(f"{f} double" for f in (*FEATURES, "toxic_text"))),
                      "shapes")
    known = (labels.select(F.col(f"`{alert_id}`").alias("key"), F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1)")
             .groupBy("key").agg(F.max("y").alias("y")))
    drawn = known.where(hashed_share("key", sample_rows, known.count()))
    sample = (measured.join(drawn, "key").orderBy(F.pmod(F.xxhash64("key"), F.lit(1 << 40)), "key", *FEATURES).limit(sample_rows)
              .select("y", *FEATURES).toPandas())
    y, x = sample["y"].to_numpy(float), sample[list(FEATURES)].to_numpy(float)
    if 0 < y.sum() < len(y):
        middle, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.clip((x - middle) / scale, -8, 8)
        weights = _fit(np.column_stack([np.ones(len(z)), z, z * z]), y)
        scaled = [F.least(F.greatest((F.col(f) - float(m)) / float(s), F.lit(-8.0)), F.lit(8.0)) for f, m, s in zip(FEATURES, middle, scale)]
        score = F.lit(float(weights[0]))
        for i, value in enumerate(scaled):
            score = score + value * float(weights[1 + i]) + value * value * float(weights[1 + len(FEATURES) + i])
        p = 1 / (1 + F.exp(-F.least(F.greatest(score, F.lit(-30.0)), F.lit(30.0))))
    else:
        p = F.lit(float(y.mean()) if len(y) else 1.0)
    scored = measured.select("key", "host", "path", p.alias("p_text"), "toxic_text")

    # Sums of both kinds of evidence go up and down the sites together: s for quality, t for toxicity.
    sections = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p_text").alias("s"), F.sum("toxic_text").alias("t"))
    hosts = sections.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = hosts.agg(*[F.coalesce(F.sum(e) / F.sum("n"), F.lit(0.5)).alias(e) for e in "st"]).first()
    prior = {e: F.lit(float(total[e])) for e in "st"}
    strengths = hosts.agg(*[F.coalesce(_strength(hosts, e, prior[e]), F.lit(1.0)).alias(e) for e in "st"]).first()
    host_means = hosts.select(F.col("host").alias("of"), *[
        ((F.col(e) + strengths[e] * prior[e]) / (F.col("n") + F.lit(strengths[e]))).alias(f"{e}_host") for e in "st"])
    nested = sections.join(host_means, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    strengths = nested.agg(*[F.coalesce(_strength(nested, e, F.col(f"{e}_host")), F.lit(1.0)).alias(e) for e in "st"]).first()
    posterior = nested.select(F.col("host").alias("of"), F.col("path").alias("at"), "s_host", *[
        ((F.col(e) + strengths[e] * F.col(f"{e}_host")) / (F.col("n") + F.lit(strengths[e]))).alias(f"{e}_section") for e in "st"])
    joined = scored.join(posterior, F.col("host").eqNullSafe(F.col("of")) & F.col("path").eqNullSafe(F.col("at")), "left")
    quality, harm = [1 / (1 + F.exp(-(_logit(F.col(text)) + _logit(F.col(f"{e}_section")) - _logit(prior[e]))))
                     for e, text in (("s", "p_text"), ("t", "toxic_text"))]
    return joined.select(F.col("key").alias(alert_id), "p_text", F.col("s_host").alias("p_publisher"), F.col("s_section").alias("p_section"),
                         quality.alias("p_quality"), harm.alias("p_toxic"), ((quality >= threshold) & (harm < threshold)).alias("keep"))
