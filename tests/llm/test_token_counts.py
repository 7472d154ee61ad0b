import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from bookloom.llm.token_counts import MARK, CountViterbi, read_pieces, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces):
    """The tokenizers library's unigram model over the same pieces, with byte fallback."""
    low = min(s for _, s in pieces)
    vocabulary = [("<unk>", low), *pieces, *((f"<0x{b:02X}>", low) for b in range(256))]
    return Tokenizer(Unigram(vocabulary, unk_id=0, byte_fallback=True))


def by_library(model, text):
    return len(model.encode(MARK + text.replace(" ", MARK)).ids) if text else 0


def test_counts_are_the_librarys():
    pieces = read_pieces(PATH)
    counter, model = CountViterbi(pieces, most=50), library(pieces)
    assert counter.by_word
    texts = ["", " ", "  a", "a  b\n\nc é 漢 \t x", "the quick\nbrown ", f"x{MARK}y", "Thblyouble | inesea | ñ\n", "\n", "zzz\x00q \U0001f600"]
    rng = random.Random(2)
    texts += ["".join(rng.choice("aeth  \nñé漢x!") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    assert counter.counts(texts) == [by_library(model, t) for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_ties_and_crossing_pieces(seed):
    rng = random.Random(seed)
    pieces = {p: float(-rng.randint(1, 3)) for p in ("".join(rng.choice("ab" + MARK) for _ in range(rng.randint(1, 4))) for _ in range(14))}
    pieces = list(pieces.items())
    counter, model = CountViterbi(pieces), library(pieces)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    assert counter.counts(texts) == [by_library(model, t) for t in texts]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (2, "a b"), (3, "word " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "text as n_tokens")
    out = token_counts(df, PATH).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in out)[:4] == [(-1, 2), (1, 0), (2, 0), (2, 2)]
    assert token_counts(df.limit(0), PATH).collect() == []


def test_long_runs_without_spaces():
    """More characters than a piece has, so that places are used again."""
    pieces = read_pieces(PATH)
    counter, model = CountViterbi(pieces), library(pieces)
    rng = random.Random(4)
    texts = ["".join(rng.choice("aethinos漢é") for _ in range(n)) for n in (counter.longest, counter.longest + 1, 500, 5000)]
    assert counter.counts(texts) == [by_library(model, t) for t in texts]
