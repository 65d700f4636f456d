"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton names every vocabulary piece that ends at each character of a word; the search keeps, for each
end, the best score and how many tokens lead there, never the path.  Ties follow the tokenizers library: among equal
scores the longest last piece wins.  A character that no piece spells alone costs ten less than the lowest score;
neighbouring unknown characters count as one token, or as their UTF-8 bytes where the vocabulary falls back to bytes.

Words start at spaces, which belong to the word they precede, so equal words have equal counts and one is counted once a
task as long as it stays in a table of bounded size, which no long word enters.  Null and empty texts have no tokens.
Repeated rows get equal counts; an empty table gives none; other columns take no part.  Texts of any length are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from terrane.llm.common import two

SPACE = "▁"
#: Distinct words that a task remembers at once, and the longest that it remembers.
REMEMBERED, LONGEST = 500_000, 64


@cache
def vocabulary(path: str) -> tuple[list[tuple[str, float]], int, bool]:
    """(pieces with scores in order of id, id of the unknown piece, whether bytes stand for unknown characters)."""
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    size = p.get_piece_size()
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(size)], p.unk_id(), any(p.is_byte(i) for i in range(size))


class Counter:
    """Counts tokens of words; pieces: (text, score), all of which may match."""

    def __init__(self, pieces: list[tuple[str, float]], by_bytes: bool):
        self.automaton = ahocorasick.Automaton()
        for text, score in pieces:
            if text:
                self.automaton.add_word(text, (len(text), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - 10
        self.by_bytes = by_bytes
        self.known = {}

    def search(self, word: str) -> int:
        n = len(word)
        matches = self.automaton.iter(word)  # by their ends, so they are taken as the search goes
        at, match = next(matches, (n, None))
        score, count, is_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            best = None
            alone = False
            ends = []
            while at == end - 1:
                ends.append(match)
                at, match = next(matches, (n, None))
            for length, s in sorted(ends, key=lambda m: -m[0]):
                alone |= length == 1
                total = score[end - length] + s
                if best is None or total > best:
                    best, score[end], count[end], is_unknown[end] = total, total, count[end - length] + 1, False
            total = score[end - 1] + self.unknown
            if not alone and (best is None or total > best):
                size = len(word[end - 1].encode()) if self.by_bytes else int(not is_unknown[end - 1])
                score[end], count[end], is_unknown[end] = total, count[end - 1] + size, True
        return count[n]

    def word(self, word: str) -> int:
        if len(word) > LONGEST:
            return self.search(word)
        n = self.known.get(word)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[word] = self.search(word)
        return n

    def text(self, text: str) -> int:
        """Spaces are marked, one is put in front unless the text begins with one, and each begins a word."""
        marked = text.replace(" ", SPACE)
        if text and not marked.startswith(SPACE):
            marked = SPACE + marked
        return sum(map(self.word, re.findall(f"{SPACE}[^{SPACE}]*", marked)))


@cache
def counter(path: str) -> Counter:
    pieces, _, by_bytes = vocabulary(path)
    return Counter(pieces, by_bytes)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens of every row; path: a sentencepiece model, whose pieces and scores are taken as a unigram model."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n = [c.text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return two(df, id_col, text_col).mapInArrow(count, "doc_id long, n_tokens long")
