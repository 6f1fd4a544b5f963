"""Token counts under a unigram model, with a trie of the distinct words.

The words of a text (runs without white space, the first letter preceded by the mark U+2581) are
split into pieces of a fixed vocabulary so that the sum of the piece scores is largest; fewer tokens
win a tie. The distinct words of an Arrow batch are sorted and make a trie, built and scored level by
level: the best score of every prefix is computed once, however many words share it, and the count is
stored where a word ends. Which pieces end at a node follows from its parent's places in a second trie, that of the
pieces. A character outside the vocabulary counts as its UTF-8 bytes, at a score below any piece.

``GROUP`` words make one trie, which bounds its memory; words over ``LONG`` characters are scored one by one
with the last scores alone, so a word of any length takes no nodes.

Scores are minus the logarithm of the piece's place in the vocabulary file plus 2 (a Zipf law); the
file is a parameter. Defined cases: null and empty text have no token; repeated rows are counted
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
SPACE = r"[\x20\x09-\x0D]+"
UNKNOWN = -30.0
GROUP = 1 << 16
LONG = 64


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> dict[str, float]:
    """Score of every ordinary piece."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return {
        model.id_to_piece(i): -log(i + 2) for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


@lru_cache(maxsize=2)
def _model(path: str | None) -> "Unigram":
    return Unigram(vocabulary(path))


def _unknown(letters: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point."""
    return 1 + (letters > 0x7F).astype(np.int64) + (letters > 0x7FF) + (letters > 0xFFFF)


class Unigram:
    """Pieces and their scores; ``state`` 0 of the trie of pieces is its root, -1 is no piece's start."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.tails = {piece[at:] for piece in scores for at in range(len(piece))}
        steps: dict[tuple[int, int], int] = {}
        worth = [-np.inf]
        for piece, score in scores.items():
            state = 0
            for letter in map(ord, piece):
                state = steps.setdefault((state, letter), len(worth))
                if state == len(worth):
                    worth.append(-np.inf)
            worth[state] = score
        self.worth = np.array(worth)
        keys = np.array([state << 21 | letter for state, letter in steps], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(steps.values()), np.int32)[order]

    def _step(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        key = states.astype(np.int64) << 21 | letters
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], np.int32(-1))

    def one(self, word: str) -> int:
        """Tokens of one word of any length."""
        text, last = MARK + word, deque([(0.0, 0)], self.longest)
        for end in range(1, len(text) + 1):
            size = len(text[end - 1].encode("utf-8", "surrogatepass"))
            best = (last[-1][0] + UNKNOWN * size, last[-1][1] - size)
            for back in range(1, len(last) + 1):
                piece = text[end - back : end]
                if piece not in self.tails:
                    break
                score = self.scores.get(piece)
                if score is not None:
                    best = max(best, (last[-back][0] + score, last[-back][1] - 1))
            last.append(best)
        return -last[-1][1]

    def group(self, words: list[str]) -> np.ndarray:
        """Tokens of sorted distinct words, through one trie."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        width = int(sizes.max())
        letters = np.zeros((len(words), width), np.int64)
        letters[:, 0] = ord(MARK)
        letters[:, 1:] = np.array(words, f"U{max(width - 1, 1)}").view(np.uint32).reshape(len(words), -1)[:, : width - 1]
        inside = np.arange(width) < sizes[:, None]
        shared = np.zeros_like(inside)
        shared[1:] = np.logical_and.accumulate((letters[1:] == letters[:-1]) & inside[1:] & inside[:-1], axis=1)
        fresh = inside & ~shared

        out = np.zeros(len(words), np.int64)
        own = np.zeros(len(words), np.int64)
        # Per node of a level: the state of its last 1, 2, ... letters, and the best of itself and of the nodes above.
        states = np.full((1, self.longest), -1, np.int32)
        best, tokens = np.full((1, self.longest), -np.inf), np.zeros((1, self.longest), np.int64)
        best[0, 0] = 0
        for level in range(width):
            rows = np.flatnonzero(fresh[:, level])
            above, letter = own[rows], letters[rows, level]
            old, old_best, old_tokens = states[above], best[above], tokens[above]
            states = np.full((len(rows), self.longest), -1, np.int32)
            states[:, 1:] = old[:, :-1]
            states[:, 0] = 0
            node, back = np.nonzero(states >= 0)
            states[node, back] = self._step(states[node, back], letter[node])
            size = _unknown(letter)
            top, count = old_best[:, 0] + UNKNOWN * size, old_tokens[:, 0] + size
            for k in range(self.longest):
                at = np.flatnonzero(states[:, k] >= 0)
                if not len(at):
                    continue
                found, n = old_best[at, k] + self.worth[states[at, k]], old_tokens[at, k] + 1
                better = (found > top[at]) | (found == top[at]) & (n < count[at])
                at = at[better]
                top[at], count[at] = found[better], n[better]
            best = np.concatenate([top[:, None], old_best[:, :-1]], axis=1)
            tokens = np.concatenate([count[:, None], old_tokens[:, :-1]], axis=1)
            own = np.cumsum(fresh[:, level]) - 1
            ends = np.flatnonzero(sizes == level + 1)
            out[ends] = count[own[ends]]
        return out

    def counts(self, words: pa.Array) -> np.ndarray:
        """Tokens of each of distinct ``words``; the empty one has none."""
        out = np.zeros(len(words), np.int64)
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        for at in np.flatnonzero(sizes > LONG):
            out[at] = self.one(words[at].as_py())
        order = pc.sort_indices(words).to_numpy()
        order = order[(sizes[order] > 0) & (sizes[order] <= LONG)]
        for start in range(0, len(order), GROUP):
            at = order[start : start + GROUP]
            out[at] = self.group(words.take(pa.array(at)).to_pylist())
        return out


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words and n_tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for b in batches:
            texts = pc.fill_null(b.column(1).cast(pa.large_string()), "")
            split = pc.split_pattern_regex(texts, SPACE)
            words = split.flatten().dictionary_encode()
            at = words.indices.to_numpy()
            edges = np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))

            def per_row(of_word: np.ndarray) -> pa.Array:
                sums = np.append(0, np.cumsum(of_word[at]))
                return pa.array(sums[edges[1:]] - sums[edges[:-1]], pa.int64())

            held = words.dictionary
            filled = pc.not_equal(held, "").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), per_row(filled), per_row(model.counts(held))], ["doc_id", "n_words", "n_tokens"])

    schema = docs.select(F.col(id_col).alias("doc_id")).schema.add("n_words", "long").add("n_tokens", "long")
    return docs.select(id_col, text_col).mapInArrow(run, schema)
