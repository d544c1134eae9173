"""Token counts under a unigram vocabulary, by dynamic programming on a trie of the distinct pre-tokens.

A pre-token is a word with the vocabulary's word mark before it. Its tokens are the pieces of the best segmentation: the
highest sum of unigram scores, of equal sums the one with fewer pieces. Pre-tokens that share a prefix share the forward
scores of that prefix: walked in sorted order, they are the depth-first walk of their trie, and only the part beyond the
prefix that the one before has scored is computed. A terminal's count is kept, so a document costs a look-up a word.

The vocabulary file has pieces by rank, not probabilities: the score of a piece is -ln(rank + 10), in millionths rounded to
whole numbers, so that sums are exact. A character that no piece covers is written as its UTF-8 bytes, one token each, at
-20 a byte.

Defined results
    null text, or no words: n_words 0, n_tokens 0. null doc_id: carried through. Repeated rows: counted each. Empty table: no
    rows. Very long words: scored like any other, in proportion to their length. Ties: of equal scores the fewer pieces, so none is left in a count. Other columns of the input, whatever their
    names, are not read and not returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from workloom.llm.runtime import small_batches

#: Pre-tokens whose counts a Python worker holds before it starts anew.
CACHE = 500_000
MARK = "▁"
UNKNOWN = -20_000_000
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def load_scores(path: str) -> dict[str, int]:
    """Score of each piece; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): round(-1e6 * log(rank + 10)) for rank, i in enumerate(kept)}


class Trie:
    """Forward scores along the trie's current branch."""

    def __init__(self, scores: dict[str, int]) -> None:
        self.scores = scores
        longest: dict[str, int] = {}
        for piece in scores:
            longest[piece[-1]] = max(longest.get(piece[-1], 0), len(piece))
        self.longest = longest  # of the pieces that end in a character

    def counts(self, words: list[str]) -> list[int]:
        """Tokens of each word, in the order given; words are distinct."""
        scores, longest = self.scores, self.longest
        found, branch, best = {}, "", [(0, 0)]  # best[i]: score and minus tokens of the first i characters
        for word in sorted(words):
            text = MARK + word
            shared, most = 0, min(len(text), len(branch))
            while shared < most and text[shared] == branch[shared]:
                shared += 1
            del best[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                last = text[end - 1]
                top = None
                for begin in range(max(0, end - longest.get(last, 0)), end):
                    score = scores.get(text[begin:end])
                    if score is not None:
                        one = best[begin]
                        way = (one[0] + score, one[1] - 1)
                        if top is None or way > top:
                            top = way
                if last not in scores:
                    n, one = len(last.encode("utf-8", "surrogatepass")), best[end - 1]
                    way = (one[0] + n * UNKNOWN, one[1] - n)
                    if top is None or way > top:
                        top = way
                best.append(top)
            branch = text
            found[word] = -best[-1][1]
        return [found[w] for w in words]


class _Numbers(dict):
    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = numbers = None
        for batch in batches:
            trie = trie or Trie(load_scores(path))
            if numbers is None or len(numbers) > CACHE:
                numbers, tokens = _Numbers(), np.zeros(0, np.int64)
            rows = []
            for text in batch.column("text"):
                words = _SPACES.split(text.as_py() or "")
                words = words[not words[0] : len(words) - (len(words) > 1 and not words[-1])]
                rows.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            new, numbers.new = numbers.new, []
            tokens = np.append(tokens, np.array(trie.counts(new), np.int64))
            sums = np.array([tokens[r].sum() for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()), pa.array(sums)], ["doc_id", "n_words", "n_tokens"]
            )

    return count


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens; path: a vocabulary file that executors can read."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_counter(path), "doc_id long, n_words long, n_tokens long")
