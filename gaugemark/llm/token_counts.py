"""Token counts by trie-shared dynamic programming under a unigram model.

The model is frozen: a vocabulary entry of rank r has log probability -ln(r + 1) (Zipf's law over the
rank file; every single byte is an entry, so every text can be segmented). A pre-token's count is
the number of entries on its best segmentation; of equally good ones, the shortest.

A block's new distinct pre-tokens are inserted in a trie, walked in byte order: the forward score of
a prefix (best log probability, fewest entries) is computed once and shared by all words below it,
and a word's count is stored at its terminal. Counts of known words stay in the worker, up to a
bound after which they are forgotten and computed anew.

Defined cases: a null or empty text has 0 words and 0 tokens; repeated rows are counted one by one;
very long pre-tokens cost time in proportion to their length; no rows in, no rows out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Vocabulary, release, text_blocks
from .byte_bpe import VOCABULARY, pre_tokens, ranks
from .common import ship

BLOCK_BYTES, MOST_WORDS = 4 << 20, 1 << 19


class UnigramTrie:
    """Counts of pre-tokens; ``scores`` maps vocabulary entries to log probabilities."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=0)

    @classmethod
    def of_ranks(cls, path: str) -> UnigramTrie:
        return cls.of_table(ranks(path))

    @classmethod
    def of_table(cls, table: dict[bytes, int]) -> UnigramTrie:
        return cls({token: -math.log(r + 1) for token, r in table.items()})

    def counts(self, words: list[bytes]) -> list[int]:
        """For each word, in the order given, the number of entries of its best segmentation."""
        get, longest = self.scores.get, self.longest
        best, least, last = [0.0], [0], b""  # forward scores of the prefixes of the path from the root
        terminal: dict[bytes, int] = {}
        for word in sorted(words):
            shared = len(commonprefix((last, word)))
            del best[shared + 1 :], least[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, few = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    score = get(word[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and least[start] + 1 < few:
                            top, few = score, least[start] + 1
                best.append(top)
                least.append(few)
            terminal[word] = least[len(word)]
            last = word
        return [terminal[w] for w in words]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: id, n_words (pre-tokens of the whole text), n_tokens (unigram entries)."""
    ship(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(ranks(path or public_tokenizers.path(VOCABULARY)))  # bounded by the vocabulary
    only = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, find = UnigramTrie.of_table(table.value), pre_tokens()
        words, tokens, number = Vocabulary(), np.zeros(0, np.int64), None
        for rows in text_blocks(batches, "text", BLOCK_BYTES):
            if len(words) > MOST_WORDS:
                words, tokens = Vocabulary(), np.zeros(0, np.int64)
            number = words.__getitem__
            codes = []
            for value in rows.column("text"):
                found = find(value.as_py() or "")
                codes.append(np.fromiter(map(number, found), np.int32, len(found)))
            tokens = np.concatenate([tokens, np.array(trie.counts([w.encode() for w in words.new]), np.int64)])
            words.new = []
            yield pa.record_batch([rows.column("id").combine_chunks(), pa.array([len(c) for c in codes], pa.int64()), pa.array([int(tokens[c].sum()) for c in codes], pa.int64())], names=[id_col, "n_words", "n_tokens"])
            del rows, codes
        del words, tokens, number, trie
        release()

    return only.mapInArrow(run, T.StructType([T.StructField(id_col, only.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))
