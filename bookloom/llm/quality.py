r"""Quality and toxicity by hierarchical empirical Bayes.

Evidence of one document: a logistic classifier for each of two heads. ``low``
(quality label 0) sees the text's shape: bins of its upper case, other signs, repeated
words, word length and length. ``toxic`` sees its words and their prefixes of 3 to 8
bytes. Both are fitted on at most ``max_labels`` labelled documents, those with the
smallest hashes of their ids; of copies with the same labels (same words but for case and
blanks) one counts. Counting features by class is a grouped aggregation; the ``features`` most
telling ones of each head are kept, and the fit uses only these.

Evidence of the site: the documents' mean probabilities by host and by path within the
host, over all documents but the one at hand. A host's rate shrinks toward the global one
by a Beta prior whose strength comes from the spread between hosts, a path's toward its
host's by another one from the spread between paths within hosts, so sparse sites say
little. The path's posterior odds against the global ones multiply the document's odds.

A host is the part of ``source`` before the first slash, a path the rest together with
``lang``. A document is kept when both final probabilities are below one half.

Cases: a null or empty text has only shape features; null sources and languages are
sites of their own; labels with null fields or of unknown documents are not used;
without labels of both kinds a head's probability is the observed rate; repeated rows
are rows like others; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import BLANKS, attach, fresh, settle, text_or_empty
from bookloom.llm.textkit import PUNCT_BYTES, Words, lanes, low_bytes, mix, pieces

HEADS = ("low", "toxic")
#: The lowest bit of a feature tells its family; each head sees one.
SHAPE, WORDS = 1, 0
_SEES = {"low": SHAPE, "toxic": WORDS}
_FAMILY = ~np.uint64(1)
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Documents that a site needs to tell of the spread between sites, and bounds of a prior's strength in documents.
LEAST_SPREAD, STRENGTH = 20, (10.0, 10_000.0)
_MOST_COUNTED = 3
#: Standard errors by which a word must be commoner in toxic documents.
LEAST_Z = 3.0

_LOWER_BYTES = np.arange(256, dtype=np.uint8)
_LOWER_BYTES[ord("A") : ord("Z") + 1] += 32
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_SIGN = np.array([0x20 < b < 0x7F and not chr(b).isalnum() for b in range(256)])


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with ASCII and two-byte Latin letters in lower case; which were upper."""
    out, upper = _LOWER_BYTES[data], _UPPER[data]
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][latin] += 0x20
        upper[1:] |= latin
    return out, upper


def document_features(data: np.ndarray, offsets: np.ndarray, gate: np.ndarray | None = None):
    """(row, feature hash) of every occurrence, of which ``gate`` lets some pass by the top 16 bits."""
    base, n = int(offsets[0]), len(offsets) - 1
    cut = offsets.astype(np.int64) - base
    raw = data[base : int(offsets[-1])]
    low, upper = _lowered(raw)
    words = Words(low, cut, PUNCT_BYTES)
    row = words.rows()
    rows, features = [], []

    def take(values: np.ndarray, of: np.ndarray, family: int) -> None:
        values = values & _FAMILY | np.uint64(family)
        if gate is not None:
            hit = np.flatnonzero(gate[(values >> np.uint64(48)).astype(np.int64)])
            values, of = values[hit], of[hit]
        rows.append(of)
        features.append(values)

    hashes = words.hashes()
    again = np.zeros(len(hashes), bool)
    if len(hashes):
        take(hashes, row, WORDS)
        length = words.ends - words.starts
        lane = lanes(low)[words.starts]
        for k in PREFIXES:
            long = np.flatnonzero(length > k)
            prefix = low_bytes(lane[long], np.full(len(long), k))
            take(mix(prefix ^ mix(np.full(1, k, np.uint64))), row[long], WORDS)
        for lag in range(1, 9):
            again[lag:] |= (hashes[lag:] == hashes[:-lag]) & (row[lag:] == row[:-lag])
    size = np.maximum(np.diff(cut), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[cut[1:]] - sums[cut[:-1]]) / size

    many = np.maximum(words.counts, 1)
    shape = [
        np.minimum(share(upper) * 20, 19),
        np.minimum(share(_SIGN[raw]) * 50, 24),
        np.minimum(np.log2(size), 24),
        np.minimum(np.where(words.counts > 0, size / many, 0), 24),
        np.bincount(row[again], minlength=n) / many * 20,
    ]
    for k, bins in enumerate(shape):
        take(mix(np.uint64(1 << 32) * np.uint64(k + 1) + bins.astype(np.uint64)), np.arange(n), SHAPE)
    return np.concatenate(rows), np.concatenate(features)


def _counted(rows: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) with their counts."""
    order = np.lexsort((features, rows))
    rows, features = rows[order], features[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (features[1:] != features[:-1])
    begin = np.flatnonzero(new)
    return rows[begin], features[begin], np.diff(np.append(begin, len(rows)))


@dataclass
class Head:
    """A linear model over some feature hashes, in order."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, n: int, rows: np.ndarray, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.full(n, self.bias)
        if len(self.keys) and len(features):
            at = np.searchsorted(self.keys, features)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == features
            value = np.minimum(counts[hit], _MOST_COUNTED) * self.weights[at[hit]]
            out += np.bincount(rows[hit], value, minlength=n)
        return out


def fit_head(columns: np.ndarray, rows: np.ndarray, values: np.ndarray, labels: np.ndarray, width: int, steps: int = 200, penalty: float = 2e-4):
    """Weights and bias of an L2 logistic regression, by accelerated full-batch descent (always the same)."""
    n, rate = len(labels), float(labels.mean()) if len(labels) else 0.0
    if rate in (0.0, 1.0):
        return np.zeros(width), float(np.log((rate * n + 0.5) / (n - rate * n + 0.5)))
    importance = np.where(labels == 1, 0.5 / rate, 0.5 / (1 - rate))  # both classes weigh the same
    # Features are scaled by their root mean square, so that rare telling words learn as fast as shapes.
    scale = 1 / np.sqrt(np.bincount(columns, values**2, minlength=width) / n + 1e-4)
    x = values * scale[columns]
    w, b = np.zeros(width), 0.0
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(rows, x * w[columns], minlength=n)
        error = importance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        gradient = np.append(np.bincount(columns, x * error[rows], minlength=width) + penalty * w, error.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        step = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    # Back from equal classes to the observed rate.
    return w * scale, float(b + np.log(rate / (1 - rate)))


def _gate(keys: np.ndarray) -> np.ndarray:
    gate = np.zeros(1 << 16, bool)
    gate[(keys >> np.uint64(48)).astype(np.int64)] = True
    return gate


def _sample(docs: DataFrame, labels: DataFrame, max_labels: int) -> DataFrame:
    """Labelled texts; the labels are at most ``max_labels`` rows, so they are broadcast."""
    chosen = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")
    ).dropna()
    chosen = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    # One text for each id, so that an id that many rows share adds one.
    texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = settle(texts)
    words = F.array_remove(F.split(F.lower("text"), f"[{BLANKS}]+"), "")
    copies = texts.select("doc_id", "quality", "toxic", F.md5(F.array_join(words, " ")).alias("copy"))
    first = copies.groupBy("copy", "quality", "toxic").agg(F.min("doc_id").alias("doc_id"))
    return texts.join(F.broadcast(first.select("doc_id")), "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, features: int = 4000) -> dict[str, Head]:
    sample = _sample(docs, labels, max_labels).select("text", "quality", "toxic")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality, toxic = (batch.column(c).to_numpy() for c in (1, 2))
            # All features of a slice are held at once, so slices are short.
            for lo, hi, data, offsets in pieces(batch, "text", 1 << 18):
                rows, found, _ = _counted(*document_features(data, offsets))
                keys, at = np.unique(found, return_inverse=True)
                sums = [np.bincount(at, of[lo:hi][rows] == v, minlength=len(keys)) for of, v in ((quality, 0), (toxic, 1))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.bincount(at).astype(np.int64)), *(pa.array(s.astype(np.int64)) for s in sums)],
                    names=["feature", "n", *HEADS],
                )

    sample = settle(sample)
    sizes = sample.agg(F.count(F.lit(1)), F.sum((F.col("quality") == 0).cast("long")), F.sum((F.col("toxic") == 1).cast("long"))).first()
    total = sizes[0]
    counted = sample.mapInArrow(count, "feature long, n long, low long, toxic long")
    counted = counted.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", *HEADS))).filter("n >= 4")
    keys = {}
    for head, positive in zip(HEADS, sizes[1:]):
        a, b = F.col(head), F.col("n") - F.col(head)
        odds = F.log((a + 0.5) / (F.lit((positive or 0) + 1.0) - a)) - F.log((b + 0.5) / (F.lit(total - (positive or 0) + 1.0) - b))
        z = odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        own = F.col("feature").bitwiseAND(F.lit(1)) == _SEES[head]
        # A word speaks against a document, never for it.
        counted = counted.withColumn(f"z_{head}", F.when(own, F.abs(z) + 100 if head == "low" else z))
    counted = settle(counted)
    for head in HEADS:
        telling = counted.filter(F.col(f"z_{head}") >= LEAST_Z)
        rows = telling.orderBy(F.desc(f"z_{head}"), "feature").select("feature").limit(features).collect()
        keys[head] = np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))
    every = np.unique(np.concatenate(list(keys.values())))
    gate = _gate(every)

    def select(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch, "text"):
                rows, found, counts = _counted(*document_features(data, offsets, gate))
                at = np.searchsorted(every, found)
                at[at == len(every)] = 0
                hit = every[at] == found if len(every) else np.zeros(len(found), bool)
                ends = np.searchsorted(rows[hit], np.arange(hi - lo + 1)).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
                    for x in (at[hit], np.minimum(counts[hit], _MOST_COUNTED))
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[lo:hi], batch.column(2)[lo:hi], *lists], names=["quality", "toxic", "at", "counts"]
                )

    # At most max_labels rows of at most 2 * features numbers.
    chosen = sample.mapInArrow(select, "quality int, toxic int, at array<int>, counts array<int>").toArrow()
    label = {"low": chosen["quality"].to_numpy() == 0, "toxic": chosen["toxic"].to_numpy() == 1}
    at, counts = (chosen[c].combine_chunks() for c in ("at", "counts"))
    row = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy(zero_copy_only=False)) if len(at) else np.zeros(0, np.int64)
    at, counts = (x.flatten().to_numpy(zero_copy_only=False) for x in (at, counts))
    heads = {}
    for head in HEADS:
        place = np.searchsorted(keys[head], every)
        place[place == len(keys[head])] = 0
        own = keys[head][place] == every if len(keys[head]) else np.zeros(len(every), bool)
        use = own[at] if len(at) else np.zeros(0, bool)
        weights, bias = fit_head(
            place[at[use]], row[use], counts[use].astype(float), label[head].astype(float), len(keys[head])
        )
        heads[head] = Head(keys[head], weights, bias)
    return heads


def evidence(docs: DataFrame, heads: dict[str, Head], keep: list[str]) -> DataFrame:
    """``keep`` columns and each head's score (log odds) for every row of ``docs``."""
    gate = _gate(np.concatenate([h.keys for h in heads.values()]))
    types = [docs.schema[c].dataType for c in keep]
    schema = ", ".join([f"`{c}` {t.simpleString()}" for c, t in zip(keep, types)] + [f"{h} double" for h in HEADS])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch, "_text"):
                found = _counted(*document_features(data, offsets, gate))
                scores = [pa.array(heads[h].scores(hi - lo, *found)) for h in HEADS]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *scores], names=[*keep, *HEADS])

    return docs.select(*keep, text_or_empty(docs).alias("_text")).mapInArrow(run, schema)


def _probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


@dataclass
class Prior:
    """Of one head: the global rate, and how many documents a host's and a path's prior weigh."""

    rate: float
    hosts: float
    paths: float


def _strength(variance: float, between: float) -> float:
    """Of a Beta prior by moments: m (1 - m) / v - 1 for the variance m (1 - m) of one document and v between sites."""
    return min(max(variance / max(between, 1e-9) - 1, STRENGTH[0]), STRENGTH[1])


def site_facts(scored: DataFrame) -> tuple[DataFrame, dict[str, Prior]]:
    """path, n, sums and its host's host_n and sums, settled; and each head's prior.

    ``scored`` has host, path (which names its host too) and the heads' log odds.
    """
    sums = [F.sum(_probability(F.col(h))).alias(f"sum_{h}") for h in HEADS]
    paths = settle(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *sums))
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("host_n"), F.count(F.lit(1)).alias("_paths"), *(F.sum(f"sum_{h}").alias(f"host_{h}") for h in HEADS)
    )
    hosts = settle(hosts)
    facts = settle(attach(paths, hosts, "host", "_paths").drop("_paths"))
    total = hosts.agg(F.sum("host_n"), *(F.sum(f"host_{h}") for h in HEADS)).first()
    n = float(total[0] or 1)
    priors = {}
    for h, whole in zip(HEADS, total[1:]):
        rate = min(max(float(whole or 0) / n, 1e-6), 1 - 1e-6)
        host_rate, path_rate = F.col(f"host_{h}") / F.col("host_n"), F.col(f"sum_{h}") / F.col("n")
        large = hosts.filter(F.col("host_n") >= LEAST_SPREAD)
        between = large.agg(F.sum(F.col("host_n") * (host_rate - rate) ** 2) / F.sum("host_n")).first()[0]
        large = facts.filter((F.col("n") >= LEAST_SPREAD) & (F.col("n") < F.col("host_n")))
        within = large.agg(
            F.sum(F.col("n") * host_rate * (1 - host_rate)) / F.sum("n"), F.sum(F.col("n") * (path_rate - host_rate) ** 2) / F.sum("n")
        ).first()
        # Where no host has several paths of size, paths say as little as their spread could.
        own = _strength(float(within[0]), float(within[1])) if within[0] is not None else STRENGTH[1]
        priors[h] = Prior(rate, _strength(rate * (1 - rate), float(between or 0)), own)
    return facts, priors


def site_shift(head: str, prior: Prior) -> Column:
    """The site's log odds against the global ones, from the documents of the site but this one; over ``site_facts`` columns."""
    own = _probability(F.col(head))
    host = (F.col(f"host_{head}") - own + prior.hosts * prior.rate) / (F.col("host_n") - 1 + prior.hosts)
    path = (F.col(f"sum_{head}") - own + prior.paths * host) / (F.col("n") - 1 + prior.paths)
    return _logit(path) - _logit(F.lit(prior.rate))


def with_site(docs: DataFrame) -> DataFrame:
    """``docs`` with host and path; a path names its host, so that paths of two hosts differ; nulls are no empty names."""
    names = {c.lower() for c in docs.columns}
    source = F.col("source").cast("string") if "source" in names else F.lit(None).cast("string")
    lang = F.col("lang").cast("string") if "lang" in names else F.lit(None).cast("string")
    known = lambda c: F.when(c.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), c))
    host = known(F.substring_index(source, "/", 1))
    return docs.withColumn("host", host).withColumn("path", F.concat_ws("\0", known(source), known(lang)))


def _scored(docs: DataFrame, labels: DataFrame, max_labels: int, features: int) -> DataFrame:
    """doc_id, own (a hash of the text), p_low, p_toxic, keep."""
    heads = train(docs, labels, max_labels, features)
    sited = with_site(docs.select(*[c for c in docs.columns if c.lower() in ("doc_id", "text", "lang", "source")]))
    sited = sited.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("own", F.xxhash64(text_or_empty(docs)))
    scored = settle(evidence(sited, heads, ["doc_id", "own", "host", "path"]))
    facts, priors = site_facts(scored)
    rows = attach(scored.drop("host"), facts.drop("host"), "path", "n")
    p = {h: _probability(F.col(h) + site_shift(h, priors[h])) for h in HEADS}
    return rows.select(
        "doc_id",
        "own",
        p["low"].alias("p_low"),
        p["toxic"].alias("p_toxic"),
        ((p["low"] < 0.5) & (p["toxic"] < 0.5)).alias("keep"),
    )


def score(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, features: int = 4000) -> DataFrame:
    """doc_id, p_low, p_toxic, keep for each row."""
    return _scored(docs, labels, max_labels, features).drop("own")


def keep_good(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, features: int = 4000) -> DataFrame:
    """The rows of ``docs`` whose document is kept, unchanged."""
    rid, own = fresh("gone", docs.columns), fresh("own", docs.columns)
    gone = _scored(docs, labels, max_labels, features).filter(~F.col("keep"))
    gone = gone.select(F.col("doc_id").alias(rid), F.col("own").alias(own)).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone[rid]) & (F.xxhash64(text_or_empty(docs)) == gone[own])
    return docs.join(gone, same, "left_anti")
