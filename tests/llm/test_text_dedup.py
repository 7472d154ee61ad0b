import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookloom.llm import substring_dedup as sd
from bookloom.llm.exact_dedup import drop_exact_copies, exact_dedup
from bookloom.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string"


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "the", "of"]
    passages = [[rng.choice(words) for _ in range(rng.randint(9, 60))] for _ in range(8)]
    docs = {}
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 6)):
            out += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.randint(1, 40))]
        docs[i] = rng.choice([" ", "\n", "\t "]).join(out)
    return docs | {n: None, n + 1: "", n + 2: "  ", n + 3: "ha " * 500, n + 4: "ha " * 300 + "x", n + 5: docs[0]}


@pytest.mark.parametrize(("unit", "groups", "common"), [(12 << 20, 128, 1 << 14), (2000, 5, 1 << 14), (3000, 7, 2)])
def test_repeats_match_a_dictionary_of_windows(spark, monkeypatch, unit, groups, common):
    """Also with many small groups, and with most anchors so common that their windows are dealt by all their words."""
    monkeypatch.setattr(sd, "_LEAST_GROUPS", groups)
    monkeypatch.setattr(sd, "_COMMON", common)
    docs = corpus(unit)
    df = spark.createDataFrame(list(docs.items()), SCHEMA).repartition(4).withColumn("rid", F.lit("x")).withColumn("doc", F.lit(1))
    out = {r.doc_id: r for r in sd.substring_dedup(df, unit=unit).collect()}
    want = sd.removed_by_force(docs)
    assert {i: r.text.split(" ") if r.text else [] for i, r in out.items()} == want
    assert all(r.n_words - r.n_removed == len(want[i]) for i, r in out.items())
    assert sum(r.n_removed for r in out.values()) > 100
    for i, r in out.items():
        words = (docs[i] or "").split()
        gone = {k for x in r.repeats for k in range(x.start, x.start + x.words)}
        assert [w for k, w in enumerate(words) if k not in gone] == want[i]
        assert all(x.words >= 13 for x in r.repeats)


def test_repeats_in_rows_without_or_with_repeated_ids(spark):
    text = " ".join(f"a{i}" for i in range(20))
    rows = [(None, text), (5, text), (5, text), (5, "z " + text), (9, text + " tail"), (9, "q")]
    out = sorted((r.doc_id or -1, r.text) for r in sd.substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == sorted([(-1, ""), (5, text), (5, text), (5, "z " + text), (9, "tail"), (9, "q")])
    assert sd.substring_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def thue_morse(letters):
    word = letters[0]
    while len(word) < 1024:
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


def test_different_words_are_never_the_same_repeat(spark):
    """Words that collide under any polynomial hash modulo a power of two."""
    rows = [(1, " ".join([thue_morse("ab")] * 13)), (2, " ".join([thue_morse("ba")] * 13)), (3, " ".join([thue_morse("ab")] * 13))]
    out = {r.doc_id: r.n_removed for r in sd.substring_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: 0, 2: 0, 3: 13}


def test_suffixes_are_sorted_by_their_words():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b cc é".split()) for _ in range(rng.randint(4, 7))) for _ in range(40)]
    tree = sd.SuffixTree([t.encode() for t in texts], 4)
    words = [w.encode() for t in texts for w in t.split()]
    suffix = lambda p: words[p : tree.ends[tree.segment[p]]]
    order = [suffix(p) for p in tree.suffixes]
    assert [x[:4] for x in order] == sorted(x[:4] for x in order) and len(order) == sum(len(t.split()) - 3 for t in texts)
    shared = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        shared.append(k)
    assert tree.common().tolist() == shared


def test_groups_have_no_ceiling():
    """1e13 suffixes in groups of the size that is given for a few thousand."""
    segments = int(1e13) // 5
    groups = segments * sd._SEGMENT_BYTES // sd.GROUP_BYTES + 1
    assert segments / groups < 1 << 16 and groups < 1 << 31
    keys = np.random.default_rng(1).integers(0, 2**64, 1 << 20, dtype=np.uint64)
    assert len(np.unique(sd._dealt(keys, groups))) > 0.98 * (1 << 20)


def brute_exact(rows):
    """Verdicts, and the texts that stay, by group; of rows with the id that stays, one of the longest is kept."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault("".join(c for c in text or "" if c not in " \t\n\x0b\f\r"), []).append((doc_id, text or ""))
    out, stay = [], []
    for body, members in groups.items():
        members.sort(key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        stay.append((members[0][0], len(members[0][1])))
        out += [(d, members[0][0], len(members), not k, hashlib.sha256(body.encode()).hexdigest()) for k, (d, _) in enumerate(members)]
    return sorted(out, key=repr), sorted(stay, key=repr)


@pytest.mark.parametrize("poor", [False, True])
def test_exact_groups_compare_whole_texts(spark, poor):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a b", "ab", "a\nb c", "é", "x" * 3000, " ", ""])) for i in range(300)]
    rows += [(-4, "a  b"), (2**62, "abc"), (None, "only"), (None, None), (3000, None)]
    rows += [(9000, "twice"), (9000, "twice"), (9000, "twi ce"), (9001, "tw ice"), (None, "on ly"), (None, "only")]
    digest = (lambda body: F.substring(F.sha2(body, 256), 1, 1)) if poor else None
    df = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit(2))
    out = exact_dedup(df, digest=digest).collect()
    want, stay = brute_exact(rows)
    assert sorted((tuple(r) for r in out), key=repr) == want
    kept = drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, len(r.text or "")) for r in kept.collect()), key=repr) == stay
    assert exact_dedup(df.limit(0)).collect() == []


def brute_lines(docs, least=2):
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\f\r"))
    where = {}
    for i, t in docs.items():
        for x in (t or "").split("\n"):
            where.setdefault(key(x), set()).add(i)
    return {
        i: [x for x in (t or "").split("\n") if not (len(key(x)) >= 10 and len(where[key(x)]) >= least and i > min(where[key(x)]))]
        for i, t in docs.items()
    }


@pytest.mark.parametrize("least", [2, 3])
def test_lines_match_a_dictionary(spark, least):
    rng = random.Random(least)
    lines = ["Short", "A longer line here", " a LONGER line here\t", "É ten chars..", "", "unique", "x" * 50]
    docs = {i: "\n".join(rng.choice(lines) + (str(i) if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 9))) for i in range(80)}
    docs |= {200: None, 201: "", 202: "\n\n", 203: "A longer line here\n" * 4000}
    df = spark.createDataFrame(list(docs.items()), SCHEMA).withColumn("n_lines", F.lit("clash")).withColumn("line", F.lit(0))
    out = {r.doc_id: r for r in line_dedup(df, min_docs=least).collect()}
    want = brute_lines(docs, least)
    assert {i: (r.text or "", r.n_lines, r.n_dropped) for i, r in out.items()} == {
        i: ("\n".join(kept), len((docs[i] or "").split("\n")), len((docs[i] or "").split("\n")) - len(kept)) for i, kept in want.items()
    }
    assert out[200].text is None
    assert line_dedup(df.limit(0)).collect() == []


def test_rows_that_share_an_id_lose_only_their_own_lines(spark):
    rows = [(1, "a shared line\nfirst of one"), (None, "a shared line\nclean line one"), (None, "clean line two\na shared line"), (None, "only this one"), (None, None)]
    rows += [(5, "a shared line\nclean line five"), (5, "clean line six\na shared line\nmore of six"), (5, "a shared line\nclean line five")]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(1, "a shared line\nfirst of one", 2, 0), (None, "clean line one", 2, 1), (None, "clean line two", 2, 1), (None, "only this one", 1, 0), (None, None, 1, 0)]
    want += [(5, "clean line five", 2, 1), (5, "clean line six\nmore of six", 3, 1), (5, "clean line five", 2, 1)]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


def test_columns_of_any_name_stay(spark):
    rows = [(1, "one shared line\nown of one"), (2, "one shared line\nown of two")]
    names = ["_dropped", "_doc", "_own", "_new", "doc", "own", "GONE", "new", "a.b", "at", "line", "uses", "first_doc", "N_lines"]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.select("*", *(F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names))
    out = line_dedup(df)
    assert out.columns == [*df.columns[:-1], "n_lines", "n_dropped"]
    for r in out.collect():
        assert r.text == ("one shared line\nown of one" if r.doc_id == 1 else "own of two") and r.n_dropped == r.doc_id - 1
        assert all(r[n] == f"{n} {r.doc_id}" for n in names[:-1])
