import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from bookloom.llm import quality as q

SCHEMA = "doc_id long, text string, lang string, source string"


def corpus(n=500):
    rng = random.Random(6)
    words = ["".join(rng.choice(["the", "in", "er", "on", "ti", "ha", "è"]) for _ in range(rng.randint(1, 4))) for _ in range(900)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        low, toxic = rng.random() < 0.2, rng.random() < 0.15
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "zzgru" + rng.choice(words)]))
        text = rng.choice([" ".join(w.upper() + "!!" for w in text), " | ".join(text), " ".join([text[0]] * 60)] if low and not toxic else [" ".join(text)])
        rows.append((i, text, rng.choice(["en", "fr"]), f"host{i % 7}/p{i % 3}"))
        labels.append((i, int(not low or toxic), int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_filter(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    known = spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in q.score(docs.withColumn("host", F.lit(1)).withColumn("low", F.lit(1)), known).collect()}
    assert set(out) == {r[0] for r in rows}
    held = [x for x in labels if x[0] % 4 == 0]
    good = [i for i, quality, toxic in held if quality and not toxic]
    bad = [i for i, quality, toxic in held if not quality or toxic]
    assert sum(out[i].keep for i in good) >= 0.95 * len(good)
    assert sum(out[i].keep for i in bad) <= 0.15 * len(bad)
    again = {r.doc_id: r.p_toxic for r in q.score(docs.repartition(5), known).collect()}
    assert max(abs(again[i] - out[i].p_toxic) for i in out) < 1e-6
    kept = q.keep_good(docs, known)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.keep}


def posterior_by_force(rows):
    """Final log odds of the head ``low`` for rows (host, path, log odds), in plain Python."""
    p = [1 / (1 + math.exp(-z)) for _, _, z in rows]
    hosts, paths = defaultdict(list), defaultdict(list)
    for (host, path, _), x in zip(rows, p):
        hosts[host].append(x)
        paths[host, path].append(x)
    mean = lambda xs: sum(xs) / len(xs)
    rate = mean(p)
    clip = lambda x: min(max(x, 10.0), 10_000.0)
    large = [xs for xs in hosts.values() if len(xs) >= 20]
    between = sum(len(xs) * (mean(xs) - rate) ** 2 for xs in large) / sum(map(len, large))
    of_hosts = clip(rate * (1 - rate) / between - 1)
    large = [(xs, mean(hosts[h])) for (h, _), xs in paths.items() if 20 <= len(xs) < len(hosts[h])]
    weight = sum(len(xs) for xs, _ in large)
    variance = sum(len(xs) * m * (1 - m) for xs, m in large) / weight
    within = sum(len(xs) * (mean(xs) - m) ** 2 for xs, m in large) / weight
    of_paths = clip(variance / within - 1)
    logit = lambda x: math.log(x / (1 - x))
    out = []
    for (host, path, z), x in zip(rows, p):
        h = (sum(hosts[host]) - x + of_hosts * rate) / (len(hosts[host]) - 1 + of_hosts)
        q = (sum(paths[host, path]) - x + of_paths * h) / (len(paths[host, path]) - 1 + of_paths)
        out.append(z + logit(q) - logit(rate))
    return out


def test_posteriors_match_plain_python(spark):
    """Also with one site that holds most documents, which goes by broadcast, and with sites of one document."""
    rng = random.Random(2)
    rows = [("big", "big/a", rng.gauss(-1.2, 1)) for _ in range(900)] + [("big", "big/b", rng.gauss(-0.8, 1)) for _ in range(60)]
    rows += [(f"h{i % 9}", f"h{i % 9}/{i % 4}", rng.gauss((i % 9) / 5 - 1.5 + (i % 4) / 5, 1)) for i in range(700)] + [("tiny", "tiny/x", 4.0)]
    df = spark.createDataFrame([(i, *r, -9.0) for i, r in enumerate(rows)], "id int, host string, path string, low double, toxic double")
    facts, priors = q.site_facts(df.repartition(5))
    assert priors["low"].paths != priors["low"].hosts
    out = q.attach(df.drop("host"), facts.drop("host"), "path", "n")
    got = [r[0] for r in out.orderBy("id").select(F.col("low") + q.site_shift("low", priors["low"])).collect()]
    assert np.allclose(got, posterior_by_force(rows), rtol=1e-9)
    assert abs(got[-1] - 4.0) < 1.0  # a lone document's own score says nothing of its site


def test_sites_of_odd_names_differ(spark):
    rows = [(None, None), ("", None), ("", ""), ("a", "b"), ("a/b", None), ("a", None), ("a/", ""), ("a|b", "c"), ("a", "b|c")]
    out = q.with_site(spark.createDataFrame(rows, "source string, lang string")).collect()
    assert len({r.path for r in out}) == len(rows)
    hosts: dict = {}
    for r in out:
        assert hosts.setdefault(r.path, r.host) == r.host
    assert len({r.host for r in out}) == 4


def test_one_id_of_many_rows_is_one_labelled_text(spark):
    rows = [(1, f"text number {i}", "en", "a/b") for i in range(300)] + [(2, "another", "en", "a/b")]
    known = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    assert q._sample(docs, known, 1000).count() == 2
    assert q.score(docs, known).count() == 301


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert q.score(empty, labels).collect() == []
    rows = [(1, None, None, None), (1, "x", "en", None), (None, "", None, "a/b"), (2, "y " * 50_000, "en", "a")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for known in (labels, labels.limit(0)):
        out = q.score(docs, known).collect()
        assert len(out) == 4 and all(0 <= r.p_low <= 1 and 0 <= r.p_toxic <= 1 for r in out)


def test_features_do_not_depend_on_the_slice():
    texts = ["Ünder the SUN!", "", "aaa aaa", "x"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    rows, features = q.document_features(data, offsets)
    for i, r in enumerate(raw):
        _, own = q.document_features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert sorted(own.tolist()) == sorted(features[rows == i].tolist())


def test_only_copies_are_left_out_of_the_fit(spark):
    rows = [(i, f"common words everywhere and number{i} of these {i * 7}", "en", "a/b") for i in range(40)]
    rows += [(50, "The  same\twords", "en", "a/b"), (51, "the same words ", "en", "a/b"), (52, "the same words", "en", "a/b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([(r[0], 1, int(r[0] == 52)) for r in rows], "doc_id long, quality int, toxic int")
    assert sorted(r.doc_id for r in q._sample(docs, known, 1000).collect()) == [*range(40), 50, 52]
