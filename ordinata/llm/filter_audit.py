"""Interaction of filters: what each one removes at each place of every order, from one cube of failure flags.

Each document gets its failure flags once. Documents are counted by part and flags, so at most 32 rows for a part remain, and
a SQL CUBE over the five flags and the part adds these up for every subset of them. In a grouping-set row whose selected
flags are all false stand the documents that survive that subset of filters, whatever the other flags are. The step of an order that
applies filter f after the set S joins the survivors of S and of S with f: the difference is what f removes there. The
order within S does not matter, so 32 subsets serve all 120 orders.

Equal texts are found by SHA-256 of the text, in groups that are added up by part and label before they are shuffled by
digest, so a large group of copies is not gathered.

Defined results: a null text is empty, a null part the empty string. A row without doc_id has no smaller doc_id's text
and is smaller than none, and no label. Repeated rows count repeatedly and do not make each other fail. A document that
any row of the labels marks is marked. Other columns are ignored. An empty table has no parts, so no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordinata.llm.workspace import materialize

FILTERS = "ABCDE"
_UPPER, _SYMBOLS = bytes(range(0x41, 0x5B)), b"#$%&*|"
_INNER = bytes(range(0x80, 0xC0))  # of UTF-8, behind a character's first byte


def text_flags(data: bytes) -> tuple[bool, bool, bool, bool]:
    """Conditions A to D of a text in UTF-8; bytes.split() cuts at [\\x20\\x09-\\x0D] alone."""
    words = data.split()
    upper = len(data) - len(data.translate(None, _UPPER))
    points = len(data.translate(None, _INNER))
    return len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * points, len(data.translate(None, _SYMBOLS)) < len(data)


def described(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, digest, A, B, C, D) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts = [text or b"" for text in rows.column(2).cast(pa.binary()).to_pylist()]
                flags = np.array([text_flags(text) for text in texts], bool)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([hashlib.sha256(text).digest() for text in texts], pa.binary()), *(pa.array(flags[:, i]) for i in range(4))], names=["doc_id", "part", "digest", *FILTERS[:4]])

    columns = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, part string, digest binary, A boolean, B boolean, C boolean, D boolean")


def flag_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): documents by part and flags; ``docs`` as ``described`` gives them."""
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 OR toxic = 1")
    rows = docs.groupBy("doc_id", "digest", "part", *FILTERS[:4]).agg(F.count(F.lit(1)).alias("n"))
    marks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    rows = rows.join(marked, "doc_id", "left").select("doc_id", "digest", "part", *FILTERS[:4], "n", *marks)
    # of each text, part and label: all rows, those without doc_id, and the least doc_id with its rows
    nameless = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    by_text = rows.groupBy("digest", "part", *FILTERS[:4], "good", "toxic").agg(F.sum("n").alias("n"), nameless.alias("nameless"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    first = by_text.groupBy("digest").agg(F.min("least").alias("first_id"))
    by_text = by_text.join(first, "digest")
    kept = F.col("nameless") + F.when(F.col("least") == F.col("first_id"), F.col("n_least")).otherwise(0)
    split = by_text.withColumn("kept__", kept).select("part", *FILTERS[:4], "good", "toxic", F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("kept__").alias("m")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("kept__")).alias("m")))).alias("e"))
    split = split.select("part", *FILTERS[:4], "e.E", "e.m", "good", "toxic").where("m > 0")
    return split.groupBy("part", *FILTERS).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("good")).alias("good"), F.sum(F.col("m") * F.col("toxic")).alias("toxic"))


_CUBE = """
SELECT part, subset, n, good, toxic
FROM (
  SELECT part, {flags}, grouping(part) AS whole, {subset} AS subset, sum(n) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM {{counts}}
  GROUP BY CUBE({flags}, part)
)
WHERE whole = 0 AND {passed}
""".format(  # a flag is null in rows that do not group by it
    flags=", ".join(FILTERS),
    subset=" + ".join(f"{1 << i} * (1 - grouping({f}))" for i, f in enumerate(FILTERS)),
    passed=" AND ".join(f"NOT coalesce({f}, false)" for f in FILTERS),
)


def survivors(counts: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): what passes all filters of a subset (bit i for filter i), from the cube; no row for none."""
    return counts.sparkSession.sql(_CUBE, counts=counts)


def steps(parts: DataFrame) -> DataFrame:
    """The 120 orders' 600 steps for each row of ``parts``, with the subsets before and after a step, its filter alone and all but it."""
    orders = F.split(F.lit(" ".join("".join(order) for order in permutations(FILTERS))), " ")
    at = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    at = at.withColumn("filter", F.expr("substr(filter_order, step, 1)"))

    def subset(of):
        return sum((F.when(of(F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))

    place = lambda f: F.instr("filter_order", f)
    return at.withColumns({
        "before": subset(lambda f: place(f) < F.col("step")), "after": subset(lambda f: place(f) <= F.col("step")),
        "own": subset(lambda f: f == F.col("filter")), "all_but": subset(lambda f: f != F.col("filter")),
    })


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = flag_counts(described(docs, id_col=id_col, text_col=text_col, part_col=part_col), labels)
    passed = materialize(survivors(counts), "audit-survivors")
    every = (1 << len(FILTERS)) - 1
    out = steps(passed.where("subset = 0").select("part", F.col("n").alias("n_all")))
    for name, at in (("b", "before"), ("a", "after"), ("f", "own"), ("u", "all_but")):
        side = passed.select(F.col("part").alias("part"), F.col("subset").alias(at), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "good", "toxic")))
        out = out.join(side, ["part", at], "left")
    whole = passed.where(F.col("subset") == every).select("part", F.col("n").alias("w_n"))
    out = out.join(whole, "part", "left").na.fill(0)
    removed = F.col("b_n") - F.col("a_n")
    out = out.select(
        "part", "filter_order", "step", "filter", F.col("a_n").alias("kept"), removed.alias("removed"), (F.col("n_all") - F.col("f_n") - removed).alias("redundant"), (F.col("u_n") - F.col("w_n")).alias("unique_fails"),
        (F.col("b_good") - F.col("a_good")).alias("good_lost"), (F.col("b_toxic") - F.col("a_toxic")).alias("toxic_lost"),
    )
    total = out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return out.join(total, ["part", "filter"]).drop("filter")
