"""Spelling variants: pairs of corpus words that differ by one edit, by a rare-first prefix of positional bigrams.

Words are counted over all texts. Their bigrams get one global order, rarest first. One inserted, deleted or replaced code
point destroys at most two bigrams of a word, so among the three rarest of each of two near words there is one that both
keep, at the same position or, where one word is longer, one further. Only these three are joined, with three limits that
lose no pair: the lengths differ by one at most; the kept bigram's position counted from the start is equal if the edit
lies behind it, and counted from the end if the edit lies before it, so everything on the bigram's other side is equal too;
and of the two halves of the side that holds the edit one is equal. All of that is in the join's key, so its groups hold words that
share most of their letters. Candidates are verified by edit distance.

The bigram table is bounded by the square of the alphabet (26 + 64 letters, 8,100 rows) and goes with the tasks; all else
is joined and grouped by Spark. A word has at most 91 * (length + 1) + 91 * length near words, so no group of links grows with the corpus.

Defined results: a null or empty text has no words; a null doc_id counts as an empty string before the colon of the
digest; repeated rows count repeatedly. Ties of form go to the first in code-point order. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinata.llm.workspace import discard, materialize

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run whose digest this number divides loses a code point.
MISPRINT = 97
#: One edit destroys two bigrams at most, so three hold one that stays.
PREFIX = 3
#: Distinct words that a task adds up before it hands them on.
FLUSH = 200_000


def misprinted(run: str, digest: int) -> str:
    """The run, without the code point that the digest names if MISPRINT divides it."""
    if digest % MISPRINT:
        return run
    at = digest % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with at least LEAST_LENGTH code points and ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = re.compile(f"[{LETTERS}]+"), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                for own, n in Counter(letters.findall((text or b"").lower().decode())).items():  # bytes: A-Z only
                    digest = zlib.crc32(own.encode(), seed)
                    if digest % MISPRINT == 0:
                        own = misprinted(own, digest)
                    if len(own) >= LEAST_LENGTH:
                        total[own] += n
                if len(total) > FLUSH:
                    yield flush()
        yield flush()

    columns = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """Rank of each bigram by the number of its occurrences in distinct words, rarest first; ties by the bigram."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1))
    counted = words.where(F.length("word") > 1).select("word", at.alias("at")).groupBy(F.expr("substr(word, at, 2)").alias("bigram")).count()
    return {r["bigram"]: i for i, r in enumerate(sorted(counted.collect(), key=lambda r: (r["count"], r["bigram"])))}


def _sided(word: str, at: int, length: int) -> Iterator[tuple]:
    """Keys that a word shares with its near words of ``length`` (its own or one more) that keep its bigram ``at``.

    Each names the bigram's side, which is equal, and one half of the other side. The halves are cut as in the longer word.
    """
    extra = length - len(word)
    rest = length - at - 2  # the longer word's code points behind the bigram, with the edit among them
    if rest > 0:
        head, half = word[: at + 2], rest // 2
        if half:
            yield length, 0, at, 0, head + word[len(word) - rest + half :]
        yield length, 0, at, 1, head + word[at + 2 : at + 2 + half]
    rest = at + extra  # the same for those before it
    if rest > 0:
        tail, half = word[at:], rest // 2
        if half:
            yield length, 1, rest, 0, tail + word[at - (rest - half) : at]
        yield length, 1, rest, 1, tail + word[:half]


def join_keys(word: str, order: dict[str, int]) -> tuple[list[int], list[int]]:
    """Keys for words of the same length, and those for words that have one code point more."""
    rare = sorted(range(len(word) - 1), key=lambda i: (order[word[i : i + 2]], i))[:PREFIX]
    both = ({xxhash.xxh64_intdigest(repr(key)) - (1 << 63) for at in rare for key in _sided(word, at, length)} for length in (len(word), len(word) + 1))
    return next(both), next(both)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of ``words`` (word, n; distinct) at an edit distance of exactly one, once."""
    order = bigram_order(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                keys, owners, longer = [], [], []
                for i, word in enumerate(part.column(0).to_pylist()):
                    own, probes = join_keys(word, order)
                    keys += [*own, *probes]
                    owners += [i] * (len(own) + len(probes))
                    longer += [False] * len(own) + [True] * len(probes)
                take = pa.array(owners, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(longer, pa.bool_()), part.column(0).take(take), part.column(1).take(take)], names=["key", "longer", "word", "n"])

    keyed = words.select("word", "n").mapInArrow(run, "key long, longer boolean, word string, n long")
    a = keyed.select("key", "longer", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = keyed.where(~F.col("longer")).select("key", F.col("word").alias("b"), F.col("n").alias("b_n"))
    found = a.join(b, "key").where(F.col("longer") | (F.col("a") < F.col("b"))).where(F.levenshtein("a", "b", 1) == 1)
    return found.select("a", "a_n", "b", "b_n").distinct()


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form), by doubling; forms grow in n, so there is no cycle.

    A row whose root leads no further is at its end and looks no more, though others still jump over it.
    """
    state, k = materialize(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("ended")), "spelling-roots"), 0
    while not state.where(~F.col("ended")).isEmpty():
        k += 1
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = state.where(~F.col("ended")).join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNull().alias("ended"))
        before, state = state, materialize(state.where("ended").unionByName(stepped), f"spelling-roots-{k}")
        discard(before)
    return state.select("word", "root")


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = materialize(word_counts(docs, id_col=id_col, text_col=text_col), "spelling-words")
    pairs = near_pairs(words)
    links = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("w")).alias("near")), F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("n"), F.col("a").alias("w")).alias("near")))).alias("link")).select("link.*")
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    led = -F.col("near.n") >= 2 * F.col("n")
    judged = words.join(best, "word", "left").select("word", F.when(led, F.col("near.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, -F.col("near.n")).alias("form_n"))
    judged = materialize(judged, "spelling-judged")
    discard(words)
    roots = follow(judged.where(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
