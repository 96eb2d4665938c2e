"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary matches in a word; dynamic programming carries, for each place, the best score
and the number of pieces of the best segmentation, and no back pointers. Ties, unknown letters and sums follow the
tokenizers library's Unigram model: scores are doubles; a place takes a later candidate only if it is strictly better, and
candidates come by ascending begin; a letter that no piece covers costs the least score minus 10; neighbouring unknown
letters are one piece.

White space splits words as the Metaspace splitter does: each space is the mark that begins the next piece. Null and empty texts
have no tokens. Repeated rows repeat their result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seafret.llm.common import text_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers, and the longest word it does remember.
REMEMBERED = 500_000
LONGEST = 64


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            # of pieces given twice the last counts, as in a table filled in order
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        if len(self.automaton):
            self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    def matches(self, word: str) -> Iterator[tuple[int, tuple[int, float]]]:
        return self.automaton.iter(word) if len(self.automaton) else iter(())

    def viterbi(self, word: str) -> int:
        """Number of pieces of the best segmentation."""
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = bytearray(n)
        for last, (length, score) in self.matches(word):
            ending[last + 1].append((last + 1 - length, score))
            if length == 1:
                single[last] = 1
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        open_unknown = bytearray(n + 1)
        for end in range(1, n + 1):
            top = None
            # longest first: ascending begin, so a later one must be strictly better
            for begin, score in sorted(ending[end]):
                total = best[begin] + score
                if top is None or total > top:
                    top, pieces, unknown = total, count[begin] + 1, 0
            if not single[end - 1]:
                total = best[end - 1] + self.unknown
                if top is None or total > top:
                    top, unknown = total, 1
                    pieces = count[end - 1] + (0 if open_unknown[end - 1] else 1)
            best[end], count[end], open_unknown[end] = top, pieces, unknown
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        words = words_of(text)
        for i in range(0, len(words), 1 << 16):
            some = words[i : i + (1 << 16)]
            new = set(some).difference(known)
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(some)
            for word in new:
                known[word] = self.viterbi(word)
            total += sum(map(known.__getitem__, some))
            for word in [w for w in new if len(w) > LONGEST]:
                del known[word]
        return total


def words_of(text: str) -> list[str]:
    """Words with their mark: spaces become marks, one is put before the text if it has none, and each mark begins a word."""
    marked = text.replace(" ", MARK)
    if not marked.startswith(MARK):
        marked = MARK + marked
    return [MARK + w for w in marked[1:].split(MARK)]


_counters: dict[str, UnigramCounter] = {}


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and scores of a sentencepiece file, read as a unigram vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not special(i)]


def counter(path: str) -> UnigramCounter:
    """One automaton per worker."""
    if path not in _counters:
        _counters[path] = UnigramCounter(vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in batches:
            counts = [model.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return read.mapInArrow(run, "doc_id long, n_tokens long")
