import hashlib
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from bookloom.llm.chunk_tokens import ChunkTokenizer
from bookloom.llm.packing import Packer, pack
from bookloom.llm.sharding import greedy_cuts, shard, smallest_capacity

from tests.llm.test_text_dedup import thue_morse

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_by_force(sizes, shards):
    best = {0: 0}
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    rows = [[sums[j] for j in range(len(sums))]]
    for _ in range(shards - 1):
        last = rows[-1]
        rows.append([min(max(last[i], sums[j] - sums[i]) for i in range(j + 1)) for j in range(len(sums))])
    return rows[-1][-1] if best else 0


def test_smallest_capacity_is_the_optimum():
    rng = random.Random(5)
    for _ in range(60):
        sizes = [rng.randint(1, 60) for _ in range(rng.randint(1, 30))]
        for shards in (1, 3, 8):
            capacity = smallest_capacity(sizes, shards)
            assert capacity == best_by_force(sizes, shards)
            assert greedy_cuts(sizes, shards, capacity) is not None


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["aa", "b", "ccc", "é"]) for _ in range(rng.randint(0, 300)))) for i in range(400)]
    rows += [(500 + i, "same text") for i in range(120)] + [(700, None), (701, ""), (None, "x"), (7, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_shards_are_minimax_over_ordered_groups(spark, odd):
    out = shard(odd.withColumn("digest", odd.text).withColumn("shard", odd.text)).collect()
    assert len(out) == odd.count()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    groups = Counter()
    for r in odd.collect():
        raw = (r.text or "").encode()
        groups[hashlib.sha256(raw).hexdigest()] += len(raw) + 1
    sizes = [groups[k] for k in sorted(groups)]
    assert max(sum(r.size for r in rows) for rows in by.values()) == best_by_force(sizes, 8)
    texts = {}
    for r in out:
        assert texts.setdefault((r.text_crc32, r.size), r.shard) == r.shard
    assert shard(odd.limit(0)).collect() == []


def test_chunked_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    texts = ["It's a  test\n\nof\tthings", "", " ", "Éá x́ <|endoftext|>it'll<|startoftext|> 123 漢字!?", "a\x1cb c d", "ΣΑΣ Σ İ", "don't O'Neil'S x<|b A.B-c;12é Àß÷×ª ÿŸ [ok]_^`{}~", "ONHA!! Eau%%% (re) | 3rd#### e\u0301tat J\u030c"]
    texts += [thue_morse("ab"), thue_morse("ba"), "a" * 16, "a" * 17, "a" * 8 + " " + "a" * 24, "x'" * 8, "x'" * 9]
    rng = random.Random(0)
    texts += ["".join(rng.choice("aB é\n'.<|>1ß×漢\u0301Q,") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    for small in (ChunkTokenizer(PATH, slot_bits=3, most_ids=50), ChunkTokenizer(PATH)):
        for _ in range(2):
            got = [g for k in range(0, len(texts), 7) for g in small.encode(texts[k : k + 7])]
            assert [[int.from_bytes(g[i : i + 4], "little") for i in range(0, len(g), 4)] for g in got] == want


def verify(rows, docs, encode, group_tokens):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(docs)
    for doc_id, parts in by_doc.items():
        ids = encode([docs[doc_id]])[0] + (1).to_bytes(4, "little")
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) // 4
            assert p["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + p["length"])])
            at += p["length"]
        assert at == len(ids) // 4
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at & (at - 1) == 0 and 0 < at <= 2048
    groups, sizes = Counter(), {}
    for parts in by_seq.values():
        group, size = parts[0]["step_group"], sum(p["length"] for p in parts)
        groups[group] += size
        assert sizes.setdefault(group, size) == size and all(p["tier"] == size for p in parts)
    for size in set(sizes.values()):
        # All groups of a size are full but the last.
        assert [n for g, n in sorted(groups.items()) if sizes[g] == size][:-1] == [group_tokens] * (Counter(sizes.values())[size] - 1)
    return groups


def test_packing_covers_each_token_once_without_padding(spark):
    rng = random.Random(9)
    docs = {i: " ".join(rng.choice(["it", "that", "onrein,", "É"]) for _ in range(int(rng.paretovariate(0.7)) % 9000)) for i in range(600)}
    docs |= {1000: None, 1001: "", 1002: "word " * 40_000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    rows = [r.asDict() for r in pack(df.withColumn("tier", df.text), PATH).collect()]
    tokenizer = ChunkTokenizer(PATH)
    texts = {k: v or "" for k, v in docs.items()}
    verify(rows, texts, tokenizer.encode, 1 << 16)
    small = pack(df.repartition(9), PATH, group_tokens=1 << 12).collect()
    assert len(verify([r.asDict() for r in small], texts, tokenizer.encode, 1 << 12)) > 20
    assert pack(df.limit(0), PATH).collect() == []


def test_packer_with_few_short_pieces():
    packer = Packer(2048, 128, 0, hold=4096)
    docs = {}
    for i in range(9):
        docs[i] = bytes(4 * 1500)
        packer.add(i, docs[i])
    packer.end()
    rows = packer.take()
    assert sum(r[2] for r in rows) == 9 * 1500
