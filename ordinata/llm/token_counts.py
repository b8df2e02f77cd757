"""Token counts under a unigram vocabulary, by dynamic programming shared in a trie.

The distinct pre-tokens are inserted in a trie of bytes. A node's forward score (the best log-probability of a
segmentation of its prefix) and the number of tokens of that segmentation depend on its ancestors alone, so each is
computed once for all pre-tokens that share the prefix; a terminal node's count is the pre-token's. A document's count
is the sum over its pre-tokens. A worker's memory is bounded: it starts a new trie, and forgets the pre-tokens it knows,
beyond a number of either, and a pre-token longer than the trie is deep is segmented each time and never remembered.

Scores: the vocabulary is a rank file, and a token of rank r gets the Zipf log-probability -log(r + 1) - log(H), H the
harmonic number of the vocabulary's size. Among segmentations of equal score the one whose last token is longest is
taken. Every byte is a token, so each pre-token has a segmentation.

Defined results: a null or empty text has no pre-tokens and no tokens. Repeated rows give repeated rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinata.llm.bpe import STEP, load_ranks

#: Trie nodes that a Python worker keeps; it starts a new trie when there are more.
TRIE_NODES = 1_500_000
#: Pre-tokens whose counts it remembers, each of at most TRIE_BYTES; beyond it too it starts anew.
KNOWN = 500_000
#: Longer pre-tokens are segmented by themselves, in a window of the longest token, without nodes in the trie.
TRIE_BYTES = 64


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Unigram log-probabilities by rank."""
    total = math.log(sum(1 / (r + 1) for r in range(len(ranks))))
    return {token: -math.log(rank + 1) - total for token, rank in ranks.items()}


class SegmentTrie:
    """Forward scores and token counts by prefix."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best: list[float] = [0.0]
        self.count: list[int] = [0]
        self.known: dict[str, int] = {}

    def _step(self, piece: bytes, end: int, best: list[float], count: list[int], first: int) -> tuple[float, int]:
        """Forward score and count of piece[:end]; best[k] and count[k] are those of piece[:first + k]."""
        get, top, n = self.scores.get, -math.inf, 0
        for start in range(max(first, end - self.longest), end):
            if (score := get(piece[start:end])) is not None and (score := best[start - first] + score) > top:
                top, n = score, count[start - first] + 1
        return top, n

    def insert(self, piece: bytes) -> int:
        """The terminal count of a pre-token; nodes that earlier ones made are reused."""
        child, all_best, all_count = self.child, self.best, self.count
        node, best, count = 0, [0.0], [0]
        for end in range(1, len(piece) + 1):
            edge = node << 8 | piece[end - 1]
            nxt = child.get(edge)
            if nxt is None:
                top, n = self._step(piece, end, best, count, 0)
                nxt = child[edge] = len(all_best)
                all_best.append(top)
                all_count.append(n)
            node = nxt
            best.append(all_best[node])
            count.append(all_count[node])
        return all_count[node]

    def alone(self, piece: bytes) -> int:
        """The count of a very long pre-token, with the scores of the last few prefixes only."""
        best, count, first = [0.0], [0], 0
        for end in range(1, len(piece) + 1):
            top, n = self._step(piece, end, best, count, first)
            best.append(top)
            count.append(n)
            if len(best) > 4 * self.longest:
                drop = len(best) - self.longest
                best, count, first = best[drop:], count[drop:], first + drop
        return count[-1]

    def learn(self, words: Iterable[str]) -> dict[str, int]:
        """Insert the pre-tokens not known yet, in order, so that neighbours share their prefixes; the counts of those too long to remember."""
        long: dict[str, int] = {}
        for word in sorted(words):
            piece = word.encode("utf-8", "surrogatepass")
            if len(piece) <= TRIE_BYTES:
                self.known[word] = self.insert(piece)
            else:
                long[word] = self.alone(piece)
        return long

    def count_words(self, words: Counter) -> int:
        """Tokens of a bag of pre-tokens."""
        if len(self.best) > TRIE_NODES or len(self.known) > KNOWN:
            self.clear()
        known = self.known
        if new := [word for word in words if word not in known]:
            if long := self.learn(new):
                return sum((known[word] if word in known else long[word]) * n for word, n in words.items())
        return sum(known[word] * n for word, n in words.items())


_tries: dict[str, SegmentTrie] = {}


def trie(ranks_path: str) -> SegmentTrie:
    if ranks_path not in _tries:
        _tries[ranks_path] = SegmentTrie(zipf_scores(load_ranks(ranks_path)))
    return _tries[ranks_path]


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every text."""

    def bags(split: regex.Pattern, text: str) -> Iterator[Counter]:
        if len(text) <= STEP:
            yield Counter(split.findall(text))
            return
        matches = (m.group() for m in split.finditer(text))
        while words := list(islice(matches, STEP)):
            yield Counter(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, split = trie(ranks_path), regex.compile(pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n_words, n_tokens = [], []
                for text in part.column(1).to_pylist():
                    words = tokens = 0
                    for bag in bags(split, text or ""):
                        words += bag.total()
                        tokens += own.count_words(bag)
                    n_words.append(words)
                    n_tokens.append(tokens)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
