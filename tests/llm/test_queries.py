"""The corpus queries over the smallest tables: against DuckDB, or against another way to the same rows."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bookloom.llm import quality as q
from bookloom.llm.registry import ORACLE_SQL, QUERIES
from tests.llm.test_sharding_packing import PATH, best_by_force
from tests.llm.test_token_counts import PATH as PIECES
from tests.llm.test_token_counts import by_library, library, read_pieces

SF = "/root/testdata/sf0.001"


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in out.collect())
    want = con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert got == sorted(map(repr, want)) and got


def test_token_counts_are_the_librarys(spark):
    model = library(read_pieces(PIECES))
    out = {r.doc_id: (r.n_tokens, r.n_chars) for r in QUERIES["op3_token_counts"](spark, SF).collect()}
    assert out == {i: (by_library(model, t), len(t)) for i, t in texts_of(spark).items()}


def test_shards_by_totals(spark):
    """Whole groups of equal texts, gapless slots, and the least possible largest shard over groups in order of their digest."""
    texts, groups, shards = texts_of(spark), Counter(), defaultdict(list)
    for t in texts.values():
        groups[hashlib.sha256(t.encode()).hexdigest()] += len(t.encode()) + 1
    where = {}
    for r in QUERIES["op6_sharding"](spark, SF).collect():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert where.setdefault(raw, r.shard) == r.shard
        shards[r.shard].append(r)
    assert sum(map(len, shards.values())) == len(texts) and set(shards) <= set(range(8))
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in shards.values())
    assert max(sum(r.size for r in rows) for rows in shards.values()) == best_by_force([groups[k] for k in sorted(groups)], 8)


def test_packed_ids_are_the_librarys(spark):
    """Every id of every document lies in one piece, by the library's own ids; sequences are full."""
    whole, texts = Tokenizer.from_file(PATH), texts_of(spark)
    parts, lengths = defaultdict(list), defaultdict(list)
    for r in QUERIES["op7_packing"](spark, SF).collect():
        parts[r.doc_id].append(r)
        lengths[r.sequence_id].append((r.offset, r.length))
    assert set(parts) == set(texts)
    for i, rows in parts.items():
        ids = np.array([*whole.encode(texts[i], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in lengths.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at in {1 << k for k in range(12)}


def test_main_texts_are_the_articles(spark):
    """The given pages keep their main text in one article of headings and paragraphs, which plain cuts find as well."""
    out = {r.page_id: r for r in QUERIES["op8_html_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(out) == len(pages)
    for p in pages:
        article = re.search("<article>(.*)</article>", p.html, re.S)[1].replace("<br>", " ")
        blocks = [re.sub("<[^>]*>", "", b) for b in re.split("</?(?:p|h1|h2|ul|ol|li|div)[^>]*>", article)]
        want = "\n".join(" ".join(html.unescape(b).split()) for b in blocks if html.unescape(b).split())
        assert (out[p.page_id].text, out[p.page_id].n_chars, out[p.page_id].url) == (want, len(want), p.url)


def test_verdicts_follow_from_evidence_and_sites(spark):
    """Final probabilities in plain Python from each document's evidence."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    heads = q.train(docs, labels)
    rows = q.evidence(q.with_site(docs), heads, ["doc_id", "host", "path"]).collect()
    out = {r.doc_id: r for r in QUERIES["op10_quality_classifier"](spark, SF).collect()}
    assert set(out) == {r.doc_id for r in rows}
    logit, prob = lambda x: math.log(x / (1 - x)), lambda z: 1 / (1 + math.exp(-z))
    final = {}
    for head in q.HEADS:
        p = {r.doc_id: prob(r[head]) for r in rows}
        hosts, paths = defaultdict(list), defaultdict(list)
        for r in rows:
            hosts[r.host].append(p[r.doc_id])
            paths[r.path].append(p[r.doc_id])
        rate = sum(p.values()) / len(p)
        strength = lambda v, b: min(max(v / max(b, 1e-9) - 1, 10.0), 10_000.0)
        mean = lambda xs: sum(xs) / len(xs)
        big = [xs for xs in hosts.values() if len(xs) >= 20]
        s_host = strength(rate * (1 - rate), sum(len(xs) * (mean(xs) - rate) ** 2 for xs in big) / sum(map(len, big)) if big else 0.0)
        host_of = {r.path: r.host for r in rows}
        big = [(xs, mean(hosts[host_of[k]])) for k, xs in paths.items() if 20 <= len(xs) < len(hosts[host_of[k]])]
        n = sum(len(xs) for xs, _ in big)
        s_path = strength(sum(len(xs) * m * (1 - m) for xs, m in big) / n, sum(len(xs) * (mean(xs) - m) ** 2 for xs, m in big) / n) if big else 10_000.0
        for r in rows:
            own = p[r.doc_id]
            h = (sum(hosts[r.host]) - own + s_host * rate) / (len(hosts[r.host]) - 1 + s_host)
            x = (sum(paths[r.path]) - own + s_path * h) / (len(paths[r.path]) - 1 + s_path)
            x, base = (min(max(y, 1e-6), 1 - 1e-6) for y in (x, rate))
            final[r.doc_id, head] = prob(r[head] + logit(x) - logit(base))
    for i, r in out.items():
        assert math.isclose(r.p_low, final[i, "low"], rel_tol=1e-6, abs_tol=1e-9) and math.isclose(r.p_toxic, final[i, "toxic"], rel_tol=1e-6, abs_tol=1e-9)
        assert r.keep == (r.p_low < 0.5 and r.p_toxic < 0.5)


def test_held_out_labels(spark):
    """Fitted on three quarters of the labels of the next larger tables, right on nearly all of the rest."""
    big = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    out = q.score(docs, labels.filter(~held)).join(labels.filter(held), "doc_id").collect()
    right = sum(r.keep == (r.quality == 1 and r.toxic == 0) for r in out)
    assert len(out) > 60 and right >= 0.93 * len(out)
