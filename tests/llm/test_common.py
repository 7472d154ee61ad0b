from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bookloom.llm.common import attach, column, fresh, settle
from bookloom.llm.textkit import BLANK_BYTES, PUNCT_BYTES, Words, grams, packed, pieces, whole


@pytest.mark.parametrize("share", [1, 3, 1000])
@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("twice", [False, True])
def test_attach_equals_a_plain_join(spark, share, how, twice):
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(900, None), (901, "nowhere")]
    left = spark.createDataFrame(rows, "id long, key string").repartition(3)
    counts = {}
    for _, k in rows[:-1]:
        counts[k] = counts.get(k, 0) + 1
    facts = settle(spark.createDataFrame([(k, n, f"v{k}") for k, n in counts.items() if k] + [(None, 1, "null")], "key string, n long, v string"))
    out = sorted((r.id, r.key or "", r.v) for r in attach(left, facts, "key", "n", share, how, twice).collect())
    want = sorted((i, k or "", f"v{k}" if k in counts and k else None) for i, k in rows if how == "left" or (k in counts and k))
    assert out == want


def test_attach_spreads_hot_keys(spark):
    """The place of a row is a key of the shuffled join, so a hot key's rows are not dealt to one task."""
    left = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"))
    facts = settle(left.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = attach(left, facts, "key", "n", 10)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(key" in plan and "_at#" in next(x for x in plan.splitlines() if "hashpartitioning(key" in x)


def test_clusters_must_name_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=dict, master="spark://somewhere:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        settle(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context)))


def test_fresh_names_and_odd_columns(spark):
    assert fresh("a", ["A", "_a"], ["b"]) == "__a" and fresh("x", ["a"]) == "x"
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `c``d` int")
    assert df.select(*map(column, df.columns)).columns == df.columns


def sliced(texts, start, stop):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"]).slice(start, stop - start)
    return [(lo, hi, Words(data, offsets, BLANK_BYTES)) for lo, hi, data, offsets in pieces(batch, "t", 7)]


def test_words_of_sliced_columns():
    texts = ["skip me", "", "a bb\tccc", "", "é\n", "  ", "x", "last one "]
    found = {}
    for lo, hi, w in sliced(texts, 1, 8):
        for r in range(hi - lo):
            spans = range(w.first[r], w.first[r + 1])
            found[1 + lo + r] = [bytes(w.data[w.starts[i] : w.ends[i]]).decode() for i in spans]
            assert (w.rows()[list(spans)] == r).all()
    assert found == {i: texts[i].split() for i in range(1, 8)}


def test_hashes_are_the_same_wherever_a_word_stands():
    a = Words(np.frombuffer(b"alpha beta", np.uint8), np.array([0, 10]), BLANK_BYTES).hashes()
    b = Words(np.frombuffer(b"x beta, alpha", np.uint8), np.array([0, 13]), PUNCT_BYTES).hashes()
    assert a[0] == b[2] and a[1] == b[1] and len(set(a) | set(b)) == 3
    assert grams(a, 2)[0] != grams(a[::-1], 2)[0] and len(grams(a, 3)) == 0


def test_whole_marks_grams_within_a_row():
    assert whole(np.array([3, 0, 1, 2]), 2).tolist() == [True, True, False, False, True]
    assert whole(np.array([1]), 2).tolist() == []


def test_packed_runs():
    out = packed(np.arange(5, dtype=np.uint64), np.array([2, 0, 3]))
    assert [np.frombuffer(x, np.uint64).tolist() for x in out.to_pylist()] == [[0, 1], [], [2, 3, 4]]
