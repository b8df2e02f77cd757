"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Words are runs of characters other than white space (U+0020, U+0009 to U+000D). Every measure and the verdict are
built-in expressions of the text column; intermediate arrays are bound once by a one-element ``transform``, so nothing
is computed twice and a long text costs O(n log n).

Defined results: a null or empty text has no words, all measures are 0, and the base rule fails it. Other columns pass
through untouched; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8

#: Frequent function words of the supported languages.
_FUNCTION_WORDS = (
    "the of and to in is that for it as was with be by on are this at from or an have not but "
    "le la les de des du et un une en est que qui dans pour par sur au pas ce il "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "el los las y del se por con para una su al lo como más pero sus"
).split()
#: The forms in which they are counted: lower case, capitalised or upper case, alone or before a mark.
STOP_FORMS = tuple(sorted({form(w) + mark for w in _FUNCTION_WORDS for form in (str.lower, str.capitalize, str.upper) for mark in ("", ".", ",", ";", ":", "!", "?")}))

Rule = tuple[str, float | None, float | None, int]

#: (measure, least, most, from_words): a text of at least ``from_words`` words is kept where every measure lies within its
#: bounds; None leaves a side open. Ratios mean little in very short texts, which the looser rules spare.
RULES: tuple[Rule, ...] = (
    ("n_words", 1, None, 0),
    ("mean_word_length", 1.5, 20.0, 5),
    ("symbol_ratio", None, 0.10, 0),
    ("bang_ratio", None, 0.12, 3),
    ("upper_ratio", None, 0.50, 5),
    ("stop_word_ratio", 0.02, None, 30),
    ("dup_line_ratio", None, 0.50, 0),
    ("list_line_ratio", None, 0.90, 20),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


WORD_BREAK = r"[ \t-\r]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the text, the first one included.

    Most texts repeat no window, which a set of window hashes shows; only the others sort their windows by hash.
    """

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    def of_sorted(order: Column) -> Column:
        def twice(x: Column, i: Column) -> Column:
            before = F.get(order, i - 1)["h"]
            after = F.get(order, i + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        return let(F.sort_array(F.transform(F.filter(order, twice), lambda x: x["i"])), covered)

    def of_windows(hashes: Column) -> Column:
        repeats = let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_sorted)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(repeats)

    def of_hashed(h: Column) -> Column:
        n = F.size(h) - (window - 1)
        starts = F.when(n > 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(h, i, window))), of_windows)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashed)


def measures(text: Column, stop_forms: tuple[str, ...] = STOP_FORMS) -> Column:
    """A struct with every measure of a text."""
    text = F.coalesce(text, F.lit(""))
    long = lambda c: c.cast("long")

    def of_text(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^ \t-\r]")))

        def of_words(w: Column) -> Column:
            def of_lines(ln: Column) -> Column:
                n_words, n_lines = long(F.size(w)), long(F.size(ln))
                word_chars = long(F.length(F.array_join(w, "")))
                symbols = long(F.regexp_count(t, F.lit("[#*$%&|<>]")))
                dup_lines = n_lines - long(F.size(F.array_distinct(ln)))
                stops = F.size(F.filter(w, lambda x: x.isin(*stop_forms)))
                upper = F.regexp_count(t, F.lit(r"\p{Lu}"))
                bang = F.regexp_count(t, F.lit("[!?]"))
                list_lines = F.size(F.filter(ln, lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•", "|")))
                ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
                return F.struct(
                    n_words.alias("n_words"), word_chars.alias("word_chars"), symbols.alias("n_symbols"), dup_lines.alias("n_dup_lines"),
                    repeated_words(w).alias("n_repeat_words"), ratio(word_chars, n_words).alias("mean_word_length"),
                    ratio(symbols, word_chars).alias("symbol_ratio"), ratio(bang, word_chars).alias("bang_ratio"),
                    ratio(upper, word_chars).alias("upper_ratio"), ratio(stops, n_words).alias("stop_word_ratio"),
                    ratio(dup_lines, n_lines).alias("dup_line_ratio"), ratio(list_lines, n_lines).alias("list_line_ratio"),
                )

            return let(lines, of_lines)

        return let(_words(t), of_words)

    return let(text, of_text)


def compile_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The conjunction of a threshold table over a struct of measures."""
    verdict = F.lit(True)
    for name, least, most, from_words in rules:
        within = F.lit(True)
        if least is not None:
            within = within & (m[name] >= F.lit(least))
        if most is not None:
            within = within & (m[name] <= F.lit(most))
        verdict = verdict & ((m["n_words"] < from_words) | within)
    return verdict


def judge(docs: DataFrame, *, text_col: str = "text", out_col: str = "quality_rules", rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """``docs`` with one more column: the measures, ``base_failed`` and ``kept`` of every text.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in repeated windows.
    kept: false where base_failed, else whether every rule of the table holds.
    """

    def verdicts(m: Column) -> Column:
        failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat_percent * m["n_words"])
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return F.struct(*(m[n].alias(n) for n in names), failed.alias("base_failed"), (~failed & compile_rules(m, rules)).alias("kept"))

    return docs.withColumn(out_col, let(measures(F.col(text_col).cast("string")), verdicts))
