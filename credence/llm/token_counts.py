"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Pre-tokens are the words between ASCII white space, each with a leading word-start mark. Each task keeps one trie and inserts
every distinct pre-token; a node holds the unigram forward score of its prefix, computed once when the node is made, however
many pre-tokens share it, and with the score the number of tokens of its best segmentation, which is the pre-token's count at
its terminal node. A text has the sum over its pre-tokens. A trie of `NODES` nodes is given up for a new one, which has no
effect on the counts.

The vocabulary and its scores are read from a public SentencePiece file: a segmentation's score is the sum of its pieces'
scores as the file states them. Characters that are no piece fall back to bytes, one token each; such a character scores
`UNKNOWN` less than the worst piece. Of equally good segmentations the one with fewer tokens counts.

Defined cases: null and blank texts have no tokens; repeated rows give repeated rows; empty tables give empty results;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm._common import coded_words, slices, strings

DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What a character that is no piece scores less than the worst piece, as is usual for unigram models.
UNKNOWN = 10.0
#: Scores are held in millionths, as costs that hold their number of tokens in the low bits.
COUNT_BITS = 40
#: Nodes of a task's trie (about 150 bytes each).
NODES = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    pieces: dict[str, int]  # cost << COUNT_BITS | 1
    longest: int
    unknown: int  # cost of a character that is no piece, without its tokens


def cost_of(score: float, best: float) -> int:
    """Of a piece; scores count from the best one, so that no cost is negative."""
    return (round(1e6 * (best - score)) << COUNT_BITS) | 1


def vocabulary_of(scores: dict[str, float]) -> Vocabulary:
    best, worst = max(scores.values(), default=0.0), min(scores.values(), default=0.0)
    return Vocabulary({p: cost_of(x, best) for p, x in scores.items()}, max(map(len, scores), default=1), cost_of(worst - UNKNOWN, best) - 1)


def load_vocabulary(path: str = DEFAULT_VOCABULARY) -> Vocabulary:
    """Reads the pieces and their scores on the driver; tasks get them by broadcast (32,000 entries)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return vocabulary_of({model.id_to_piece(i): model.get_score(i) for i in ids})


class Trie:
    """Distinct pre-tokens and the forward score of every prefix."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.child: dict[tuple[int, str], int] = {}
        self.best = [0]  # of each node

    def count(self, word: str) -> int:
        """Tokens of a word, which is inserted if it isn't there."""
        text, child, best = MARK + word, self.child, self.best
        node, path = 0, [0]
        for at, char in enumerate(text):
            following = child.get((node, char))
            if following is None:
                return self._extend(text, at, node, path)
            node = following
            path.append(best[node])
        return path[-1] & ((1 << COUNT_BITS) - 1)

    def _extend(self, text: str, at: int, node: int, path: list[int]) -> int:
        pieces, longest, unknown = self.vocabulary.pieces, self.vocabulary.longest, self.vocabulary.unknown
        for end in range(at + 1, len(text) + 1):
            char = text[end - 1]
            found = None if char in pieces else path[end - 1] + unknown + len(char.encode("utf-8", "surrogatepass"))
            for start in range(max(0, end - longest), end):
                cost = pieces.get(text[start:end])
                if cost is not None and (found is None or path[start] + cost < found):
                    found = path[start] + cost
            path.append(found)
            self.best.append(found)
            following = len(self.best) - 1
            self.child[node, char] = following
            node = following
        return path[-1] & ((1 << COUNT_BITS) - 1)


def token_counts(docs: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Per row of docs (doc_id, text): pre-tokens and tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for part in slices(batches):
            words, codes, rows = coded_words(part.column("text"), lower=False)
            if len(trie.best) > NODES:
                trie = Trie(shared.value)
            each = np.fromiter(map(trie.count, strings(words)), np.int64, len(words))
            n = part.num_rows
            total = np.zeros(n, np.int64)
            np.add.at(total, rows, each[codes])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.bincount(rows, minlength=n).astype(np.int64)), pa.array(total)], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
