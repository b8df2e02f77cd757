"""Sample tables: (row_id, y, features) with y in {+1, -1}, and their long form (row_id, j, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense samples; labels 0 to 4 are the positive class."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.when(F.col("label") < 5, 1.0).otherwise(-1.0).alias("y"), F.col("embedding").cast("array<double>").alias("features"), "label")


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many rows of four features; returned items are the positive class."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    row = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")
    return table(spark, sf_dir, "lineitem").select(row, F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("y"), F.array(*names).alias("features"), "l_linestatus", *names)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in stream order; purchases are the positive class."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_type") == "purchase", 1.0).otherwise(-1.0).alias("y"), "value")


def to_long(samples: DataFrame) -> DataFrame:
    """(row_id, y, j, v) of every feature; j counts from 0."""
    return samples.select("row_id", "y", F.posexplode("features").alias("j", "v"))


def documents_long(spark: SparkSession, sf_dir: str, size: int = 64) -> DataFrame:
    """(doc_id, j, v): word counts hashed into ``size`` features; absent features are zeros."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy("doc_id", F.pmod(F.length("w"), F.lit(size)).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))


def read_libsvm(spark: SparkSession, path: str, *, strict: bool = True, zero_based: bool | None = None, normalise: bool = False, first: int | None = None, last: int | None = None) -> DataFrame:
    """(row_id, y, indices, values) of a text file of ``label index:value ...`` lines.

    strict: an empty line, a bad number or indices that do not ascend fail with the line number. Indices become 0-based;
    ``zero_based`` None finds an index 0 by looking. ``first`` and ``last`` are an inclusive range of lines from 0.
    """
    from ordinata.operators.prefix import numbered_lines

    lines = numbered_lines(spark, path)
    if first is not None:
        lines = lines.where(F.col("row_id") >= first)
    if last is not None:
        lines = lines.where(F.col("row_id") <= last)
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    pairs = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    parsed = lines.select(
        "row_id", F.get(parts, F.lit(0)).try_cast("double").alias("y"),
        F.transform(pairs, lambda p: F.split_part(p, F.lit(":"), F.lit(1)).try_cast("int")).alias("indices"),
        F.transform(pairs, lambda p: F.split_part(p, F.lit(":"), F.lit(2)).try_cast("double")).alias("values"),
    )
    if strict:
        ascending = F.forall(F.sequence(F.lit(1), F.greatest(F.size("indices"), F.lit(1))), lambda k: (k < 2) | (F.get("indices", k - 1) > F.get("indices", k - 2)))
        good = F.col("y").isNotNull() & F.forall("indices", lambda x: x.isNotNull()) & F.forall("values", lambda x: x.isNotNull()) & ascending
        message = F.concat(F.lit("Wrong input format at line "), (F.col("row_id") + 1).cast("string"))
        parsed = parsed.withColumn("y", F.when(good, F.col("y")).otherwise(F.raise_error(message).cast("double")))
    if zero_based is None:
        zero_based = parsed.agg(F.min(F.array_min("indices")).alias("least")).first()["least"] == 0
    if not zero_based:
        parsed = parsed.withColumn("indices", F.transform("indices", lambda x: x - 1))
    if normalise:
        norm = F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x))
        parsed = parsed.withColumn("values", F.when(norm > 0, F.transform("values", lambda x: x / norm)).otherwise(F.col("values")))
    return parsed


def libsvm_lines(sparse: DataFrame) -> DataFrame:
    """One text line (value) for each row of (row_id, y, indices, values); indices are written from 1."""
    pairs = F.zip_with("indices", "values", lambda j, v: F.concat((j + 1).cast("string"), F.lit(":"), v.cast("string")))
    return sparse.select("row_id", F.concat_ws(" ", F.col("y").cast("string"), F.array_join(pairs, " ")).alias("value"))


def to_sparse(samples: DataFrame, most: int | None = None) -> DataFrame:
    """(row_id, y, indices, values) without the zeros; of the first ``most`` features if given."""
    features = F.col("features") if most is None else F.slice("features", 1, most)
    kept = F.filter(F.transform(features, lambda v, j: F.struct(j.alias("j"), v.alias("v"))), lambda x: x["v"] != 0)
    return samples.select("row_id", "y", kept.alias("kept")).select("row_id", "y", F.col("kept.j").alias("indices"), F.col("kept.v").alias("values"))


def read_matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, features) of a CSV file with a header of feature ids and a leading id column."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col(raw.columns[0]).alias("id"), F.array(*(F.col(f"`{c}`").cast("double") for c in raw.columns[1:])).alias("features"))


def read_label_csv(spark: SparkSession, path: str, positive: tuple[str, ...] = ("t", "ALL")) -> DataFrame:
    """(id, y): +1 for a positive label, else -1."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col(raw.columns[0]).alias("id"), F.when(F.col(raw.columns[1]).isin(*positive), 1.0).otherwise(-1.0).alias("y"))


def read_names_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, name): the first two columns of a CSV file with a header."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col(f"`{raw.columns[0]}`").alias("id"), F.col(f"`{raw.columns[1]}`").alias("name"))


def write_results(results: DataFrame, path: str, by: tuple[str, ...] = ("method",)) -> None:
    """Results as Parquet, in folders by ``by``."""
    results.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_results(spark: SparkSession, path: str, **where) -> DataFrame:
    """Results of the folders that ``where`` names, such as method='spam'; other folders are not read."""
    out = spark.read.parquet(path)
    for name, value in where.items():
        out = out.where(F.col(name) == F.lit(value))
    return out


def planted(spark: SparkSession, n: int, p: int, support: int, ratio: float, mean: float = 0.3, seed: int = 1) -> DataFrame:
    """(row_id, y, features): Gaussian noise, with ``mean`` added to the first ``support`` features of the positives."""
    cut = int(n * ratio)
    rows = spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") < cut, 1.0).otherwise(-1.0).alias("y"))
    noise = F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda j: _gauss(F.col("row_id"), j, seed) + F.when((F.col("y") > 0) & (j < support), mean).otherwise(0.0))
    return rows.select("row_id", "y", noise.alias("features"))


def _gauss(row, j, seed: int):
    """A standard normal that depends on (row, j, seed) alone, by the Box-Muller transform of two hashes."""
    unit = lambda salt: (F.pmod(F.xxhash64(row, j, F.lit(seed), F.lit(salt)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * F.pi() * unit(1))
