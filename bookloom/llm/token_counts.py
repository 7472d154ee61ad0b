r"""Token counts under a unigram vocabulary, by count-only Viterbi.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character;
dynamic programming keeps, for each position, the best score and the number of pieces
on that path, and nothing to trace it back. Ties follow the tokenizers library's
unigram model: for one end the piece that starts first wins, and a later candidate
must be strictly better. A character without a piece of its own costs the least score
less ten and counts as its UTF-8 bytes (byte fallback).

Spaces become the marker U+2581 and one stands before the text. Where no piece has a
marker behind another character and none holds a newline, the best path is made of the
best paths of its words, so counts are remembered by word, in a bounded memory; other
vocabularies are counted over whole texts. Either way every text is counted whole.

Cases: a null or empty text has no tokens; null and repeated ids are carried along;
other columns are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookloom.llm.common import text_or_empty

MARK = "▁"
_UNKNOWN_PENALTY = 10.0


def read_pieces(model_path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a SentencePiece model with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [
        (model.id_to_piece(i), float(model.get_score(i)))
        for i in range(model.get_piece_size())
        if not any(f(i) for f in special)
    ]


class CountViterbi:
    def __init__(self, pieces: list[tuple[str, float]], most: int = 500_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - _UNKNOWN_PENALTY
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.by_word = not any(MARK in p.lstrip(MARK) or "\n" in p for p, _ in pieces)
        self.most = most
        self.marked: dict[str, int] = {}
        self.plain: dict[str, int] = {"": 0}

    def count(self, text: str) -> int:
        """Pieces on the best path over a text in which spaces are markers already.

        Positions farther back than the longest piece are overwritten, so a run of any length
        without spaces takes bounded memory.
        """
        n = len(text)
        room = min(n, self.longest) + 1
        scores, counts = [0.0] * room, [0] * room
        done = 0  # positions whose best path is known

        def weigh_unknown(end: int, alone: bool) -> None:
            """A character as no piece: the only way to ``end``, or one beside the longer pieces that end there."""
            candidate = scores[(end - 1) % room] + self.unknown
            if alone or candidate > scores[end % room]:
                scores[end % room] = candidate
                counts[end % room] = counts[(end - 1) % room] + len(text[end - 1].encode("utf-8", "surrogatepass"))

        single = True
        for last, (length, score) in self.automaton.iter(text):
            end = last + 1
            at, start = end % room, (end - length) % room
            if end != done:
                if not single:
                    weigh_unknown(done, False)
                while done < end - 1:
                    done += 1
                    weigh_unknown(done, True)
                done, single = end, False
                total, before = score + scores[start], counts[start]
                scores[at], counts[at] = total, before + 1
            elif score + scores[start] > scores[at]:
                scores[at] = score + scores[start]
                counts[at] = counts[start] + 1
            single = single or length == 1
        if not single:
            weigh_unknown(done, False)
        while done < n:
            done += 1
            weigh_unknown(done, True)
        return counts[n % room]

    def _whole(self, text: str) -> int:
        return self.count(MARK + text.replace(" ", MARK)) if text else 0

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [self._whole(t) for t in texts]
        split, odd = [], {}
        for i, text in enumerate(texts):
            text = text.replace(MARK, " ")
            if not text:
                split.append(([], [], 0))
                continue
            lines = [line.split(" ") for line in f" {text}".split("\n")]
            first = [line[0] for line in lines]
            rest = [w for line in lines for w in line[1:]]
            if "  " in text or text[0] == " ":
                # Runs of spaces stay together with the word behind them.
                odd[i] = sum(self._runs(line) for line in f" {text}".split("\n")) + len(lines) - 1
                first, rest = [], []
            split.append((first, rest, len(lines) - 1))
        self._learn(self.plain, "", set().union(*(s[0] for s in split)) if split else set())
        self._learn(self.marked, MARK, set().union(*(s[1] for s in split)) if split else set())
        plain, marked = self.plain.__getitem__, self.marked.__getitem__
        return [
            odd[i] if i in odd else sum(map(plain, first)) + sum(map(marked, rest)) + breaks
            for i, (first, rest, breaks) in enumerate(split)
        ]

    def _runs(self, line: str) -> int:
        total = 0
        for chunk in re.findall(" *[^ ]+| +", line):
            word = chunk.lstrip(" ")
            if len(chunk) - len(word) == 1:
                self._learn(self.marked, MARK, {word})
                total += self.marked[word]
            else:
                total += self.count(chunk.replace(" ", MARK))
        return total

    def _learn(self, memory: dict[str, int], prefix: str, words: set[str]) -> None:
        missing = [w for w in words if w not in memory]
        if len(memory) + len(missing) > self.most:
            kept = list(memory.items())[: self.most // 2]  # words seen first tend to be the common ones
            memory.clear()
            memory.update(kept)
            missing = [w for w in words if w not in memory]
        for w in missing:
            memory[w] = self.count(prefix + w)


_COUNTERS: dict[str, CountViterbi] = {}


def _counter(path: str) -> CountViterbi:
    if path not in _COUNTERS:
        _COUNTERS[path] = CountViterbi(read_pieces(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, n_chars for each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            counts: list[int] = []
            for at in range(0, batch.num_rows, 256):
                counts += counter.counts(batch.column(1).slice(at, 256).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), batch.column(2)], names=["doc_id", "n_tokens", "n_chars"]
            )

    text = text_or_empty(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.char_length(text).cast("long").alias("n_chars")
    )
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_chars long")
