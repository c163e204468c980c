"""Language identification by prediction by partial matching.

For every language a variable-order byte context tree is kept: for each context of up to ``ORDER``
preceding bytes of the word, the counts of the bytes that followed. A byte costs
-log2(count / (total + distinct)) in the longest context that has seen it; each longer context that
has not costs its escape, -log2(distinct / (total + distinct)); below order 0 all 256 bytes are
equally likely. The statistics are frozen after training, so a text's code length is exactly the sum
of its words' code lengths, and a distinct word is scored once for all languages and reused.

Words are runs of letters: ASCII letters in lower case and all bytes from 0x80 on; the code covers these
words, each with the blank behind it, and contexts begin at the blank before a word. The language with the shortest code wins (ties: the smaller name), and the
score is its share of 2 ** -length over all languages.

Training takes a bounded sample of rows: of each label's training rows those with the smallest digest of id and text, in
whole, ``per_language`` of each, or an equal share of ``MOST_ROWS`` where there are more labels than that allows, one
at least. All labels and all words of these rows are learned. Words are counted in Spark; only counts reach the driver. All else
covers whole texts of all rows.

Defined cases: a text that is null, empty or without a letter (a character of Unicode's letter classes)
gives ``und`` with score 0; without any labelled training row every text does; rows with null labels are
never learned from; rows that repeat an id or are equal throughout are rows like others, and no label is
lost by them; repeated rows are scored one by one; clashing extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .blocks import Vocabulary, release, text_blocks
from .common import ship

ORDER, PER_LANGUAGE, UNDETERMINED = 4, 1000, "und"
MOST_ROWS = 16_000
BLOCK_BYTES, MOST_WORDS = 2 << 20, 1 << 18
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether any character is of Unicode's letter classes; the search ends at the first one."""
    return any(map(str.isalpha, text))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LETTERS).split()


def _keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each coded byte of the words (with the blank behind each): packed last bytes, its symbol, its possible order, its word.

    Packed bytes hold the ``ORDER`` bytes before the symbol, the nearest in the low byte.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    symbols = data[1:]
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    most = np.arange(1, len(symbols) + 1, dtype=np.int32) - np.repeat((ends - lengths).astype(np.int32), lengths)
    most = np.minimum(most, ORDER).astype(np.int8)
    packed = np.zeros(len(symbols), np.uint64)
    padded = np.concatenate([np.zeros(ORDER - 1, np.uint8), data])
    for k in range(ORDER):
        packed |= padded[ORDER - 1 - k : ORDER - 1 - k + len(symbols)].astype(np.uint64) << np.uint64(8 * k)
    return packed, symbols, most, word


def _context(packed: np.ndarray, order: int) -> np.ndarray:
    """Key of the context of an order: its bytes under a mark that tells the order."""
    return (packed & np.uint64((1 << (8 * order)) - 1)) | np.uint64(1 << (8 * order))


class ContextTrees:
    """Frozen context trees of several languages, flattened into sorted tables.

    ``pairs``: keys context * 256 + symbol that any language has seen, with the code length in every
    language; ``contexts``: keys of contexts, with every language's escape (0 where it lacks the context).
    """

    def __init__(self, counts: dict[str, Counter]):
        self.languages = sorted(counts)
        n = len(self.languages)
        vocabulary = sorted(set().union(*counts.values())) if n else []
        packed, symbols, most, word = _keys(vocabulary) if vocabulary else (np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
        times = np.array([[counts[lang].get(w, 0) for lang in self.languages] for w in vocabulary], np.float64).reshape(len(vocabulary), n)
        self.pairs, self.contexts = [], []
        for order in range(ORDER + 1):
            at = most >= order
            context = _context(packed[at], order)
            pair = context << np.uint64(8) | symbols[at]
            keys, inverse = np.unique(pair, return_inverse=True)
            seen = np.zeros((len(keys), n))
            for k in range(n):
                seen[:, k] = np.bincount(inverse, times[word[at], k], len(keys))
            heads, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(heads), n)), np.zeros((len(heads), n))
            np.add.at(total, of, seen)
            np.add.at(distinct, of, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(distinct > 0, -np.log2(distinct / (total + distinct)), 0.0)
                own = -np.log2(seen / (total + distinct)[of])
            if order == 0:
                lower = np.full((len(keys), n), 8.0)
            else:
                lower = self._lower(keys, order)
            cost = np.where(seen > 0, own, escape[of] + lower)
            self.pairs.append((keys, cost))
            self.contexts.append((heads, escape))

    def _lower(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of (context, symbol) keys of an order in the next lower order's tables."""
        packed, symbols = keys >> np.uint64(8), (keys & np.uint64(255)).astype(np.uint8)
        return self._code(packed, symbols, np.full(len(keys), order - 1, np.int8))

    def _code(self, packed: np.ndarray, symbols: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bits of every symbol after its context in every language, (symbols, languages)."""
        bits = np.zeros((len(symbols), len(self.languages)))
        open_ = np.arange(len(symbols))
        for order in range(int(most.max(initial=0)), -1, -1):
            now = open_[most[open_] >= order]
            if len(now):
                context = _context(packed[now], order)
                found, row = _find(self.pairs[order][0], context << np.uint64(8) | symbols[now])
                bits[now[found]] += self.pairs[order][1][row[found]]
                left = now[~found]
                known, row = _find(self.contexts[order][0], context[~found])
                bits[left[known]] += self.contexts[order][1][row[known]]
                done = np.zeros(len(symbols), bool)
                done[now[found]] = True
                open_ = open_[~done[open_]]
        bits[open_] += 8.0
        return bits

    def word_bits(self, words: list[bytes]) -> np.ndarray:
        """Code length of each word (with the blank that ends it) in each language."""
        packed, symbols, most, word = _keys(words)
        bits = self._code(packed, symbols, most)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        return np.add.reduceat(bits, starts, axis=0)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return (keys[row] == wanted if len(keys) else np.zeros(len(wanted), bool)), row


class Scorer:
    """Scores texts; keeps the code lengths of up to about ``MOST_WORDS`` distinct words."""

    def __init__(self, trees: ContextTrees):
        self.trees = trees
        self.reset()

    def reset(self) -> None:
        self.words, self.bits = Vocabulary(), np.zeros((1024, len(self.trees.languages)))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names = self.trees.languages
        if not names:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if len(self.words) > MOST_WORDS:
            self.reset()
        split = [words_of(t) if t and has_letter(t) else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        number = self.words.__getitem__
        ids = np.fromiter((number(w) for ws in split for w in ws), np.int64, int(counts.sum()))
        if new := self.words.new:
            known = len(self.words) - len(new)
            if len(self.words) > len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros((len(self.words) * 2 - len(self.bits), len(names)))])
            for i in range(0, len(new), 50_000):
                part = new[i : i + 50_000]
                self.bits[known + i : known + i + len(part)] = self.trees.word_bits(part)
            self.words.new = []
        pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        full = np.flatnonzero(counts)
        if len(full):
            starts = (np.cumsum(counts) - counts)[full]
            total = np.add.reduceat(self.bits[ids], starts, axis=0)
            best = total.argmin(axis=1)
            share = 1 / np.exp2(np.minimum(0, total.min(axis=1, keepdims=True) - total)).sum(axis=1)
            for i, b, s in zip(full.tolist(), best.tolist(), share.tolist(), strict=True):
                pred[i], score[i] = names[b], s
        return pred, score


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, word, n): the words of each batch, counted."""
    for batch in batches:
        found: dict[str, Counter] = {}
        for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
            found.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, words in found.items() for w, n in words.items()]
        lang, word, n = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])
    release()


def _sample(labelled: DataFrame, counts: dict[str, int], per_language: int) -> DataFrame:
    """(lang, text) of the rows with the smallest digests, up to ``per_language`` of each label of ``counts``.

    A threshold from the labels' counts first cuts each label to about the bound, then an exact rank does, so
    no large group is sorted or moved.
    """
    full = 1 << 30
    h = F.pmod(F.xxhash64("id", "text"), F.lit(full))
    below = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(full, int(full * 1.2 * per_language / n) + full * 30 // n)))), F.col("lang"))
    near = labelled.withColumn("h", h).where(F.col("h") < below)
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h", "id", F.length("text")))
    return near.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "text")


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> ContextTrees:
    """Context trees of all labels of ``docs`` from at most ``per_language`` whole rows of each, ``MOST_ROWS`` in all (or one each)."""
    ship(docs.sparkSession)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}  # a row a label
    per_language = max(1, min(per_language, MOST_ROWS // max(1, len(counts))))
    words: dict[str, Counter] = {k: Counter() for k in counts}

    def learn(sample: DataFrame) -> set[str]:
        found = sample.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        rows = found.toArrow()
        for k, w, n in zip(*(rows.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            words[k][w] = n
        return {k for k, v in words.items() if v}

    if counts:
        learned = learn(_sample(labelled, counts, per_language))
        # Rows alike have one digest: a label of few different rows may have none below its threshold, and is ranked as it is.
        if missing := {k: 1 for k in counts if k not in learned}:
            learn(_sample(labelled.where(F.col("lang").isin(*missing)), missing, per_language))
    trees = ContextTrees({k: v for k, v in words.items() if v})
    del words
    release()
    return trees


def identify(docs: DataFrame, trees: ContextTrees, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``pred`` and ``score`` added (replaced, where they exist)."""
    docs = docs.drop(pred, score)
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the training sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for block in text_blocks(batches, text, BLOCK_BYTES):
            lang, share = scorer.score(block.column(text).to_pylist())
            out = block.append_column(pred, pa.array(lang, pa.string())).append_column(score, pa.array(share, pa.float64()))
            yield from out.combine_chunks().to_batches()
            del block, out, lang, share
        del scorer
        release()

    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def identify_table(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, held_out, lang_pred, score; trained on the rows that aren't held out."""
    trees = train(docs.where(~F.coalesce(held_out(), F.lit(False))))
    only = docs.select("doc_id", "text")
    return identify(only, trees).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
