"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest.

Everything on the main path is DataFrame expressions. The trees are fitted on the URLs that a rule labels, by the
JVM's gradient boosting, and then compiled into one arithmetic expression of CASE terms, so scoring is part of the
projection that reads the table: no shuffle, no user function.

The fit counts every distinct labelled URL once, however often it is repeated. Block rates of the host's suffix and of the
path's first segment come from all of them, in ``BUCKETS`` hashed buckets of each kind: that bounds the table, which is
broadcast, and drops no suffix. A training URL sees rates that leave its own fold out, so no label reaches its own
features. The trees are fitted on a sample, for each verdict about ``sample`` / 2 URLs or all if there are fewer: those
whose hash falls below that share, weighted back to the verdicts' shares.

The trees read lexical features of the whole URL alone (LEXICAL); rules are no input of a probability.

Defined results: host and path are empty for a null URL or one without ``://``, no rule fits them, and the trees judge
the empty features. Without labelled URLs of both kinds every verdict that no rule decides is ``allow``. Repeated rows
give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordinata.llm.workspace import materialize

#: (host, start of the path, verdict); a rule fits its host and all subdomains, and the longest wins.
RULES: tuple[tuple[str, str, str], ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
LEXICAL = (
    "length", "host_length", "depth", "digit_ratio", "entropy", "n_params", "n_dots", "n_hyphens", "has_fragment", "path_digits",
    "first_length", "longest_segment", "digit_runs", "first_digit", "vowel_ratio", "suffix_rate", "suffix_rows", "segment_rate", "segment_rows",
)
SAMPLE = 20_000
#: Hash buckets of suffixes, and as many of first segments.
BUCKETS = 4096
FOLDS = 5
KINDS = ("suffix", "segment")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first ``://`` in lower case, the path up to ``?`` or ``#``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    whole = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Equally long rules go by their order."""
    order = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for h, p, _ in order]
    name = F.coalesce(*(F.when(f, F.lit(h + p)) for f, (h, p, _) in zip(fits, order, strict=True)), F.lit(None).cast("string"))
    verdict = F.coalesce(*(F.when(f, F.lit(v)) for f, (_, _, v) in zip(fits, order, strict=True)), F.lit(None).cast("string"))
    return name, verdict


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def first_segment(path: Column) -> Column:
    """What lies between the first two slashes of a path."""
    return F.regexp_extract(path, "^/([^/]*)", 1)


def _buckets() -> dict[str, Column]:
    """By kind, the bucket of a row's host or path; kinds hash apart."""
    own = {"suffix": suffix(F.col("host")), "segment": first_segment(F.col("path"))}
    return {f"{kind}_bucket": F.pmod(F.xxhash64(own[kind]), F.lit(BUCKETS)).cast("int") for kind in KINDS}


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def lexical(df: DataFrame) -> DataFrame:
    """``df`` with the lexical features of its columns url, host and path, as doubles."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.length(url)
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    runs = F.aggregate(
        F.array_sort(chars),
        F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0.0).alias("s")),
        lambda a, c: F.struct(
            c.alias("c"), F.when(c == a["c"], a["n"] + 1).otherwise(F.lit(1)).alias("n"),
            (a["s"] + F.when((c == a["c"]) | (a["n"] == 0), F.lit(0.0)).otherwise(a["n"] * F.log(a["n"].cast("double")))).alias("s"),
        ),
        lambda a: a["s"] + F.when(a["n"] > 0, a["n"] * F.log(a["n"].cast("double"))).otherwise(F.lit(0.0)),
    )
    entropy = F.when(size > 0, F.log(size.cast("double")) - runs / size).otherwise(F.lit(0.0))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    features = {
        "length": size, "host_length": F.length("host"), "depth": _count(F.col("path"), "/"),
        "digit_ratio": F.when(size > 0, _count(url, "0123456789") / size).otherwise(F.lit(0.0)), "entropy": entropy,
        "n_params": F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(F.lit(0)), "n_dots": _count(F.col("host"), "."),
        "n_hyphens": _count(url, "-"), "has_fragment": F.contains(url, F.lit("#")).cast("int"), "path_digits": _count(F.col("path"), "0123456789"),
        "first_length": F.length(first_segment(F.col("path"))), "longest_segment": F.array_max(F.transform(F.split("path", "/"), F.length)),
        "digit_runs": F.regexp_count(F.col("path"), F.lit("[0-9]+")), "first_digit": F.coalesce(F.regexp_substr(F.col("path"), F.lit("[0-9]")).cast("int"), F.lit(-1)),
        "vowel_ratio": F.when(size > 0, _count(F.lower(url), "aeiou") / size).otherwise(F.lit(0.0)),
    }
    return df.withColumns({name: value.cast("double") for name, value in features.items()})


@dataclass(frozen=True)
class Tree:
    """A regression tree: a leaf's value, or a split on ``feature`` at ``threshold``."""

    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def compile(self, features: list[Column]) -> Column:
        if self.left is None or self.right is None:
            return F.lit(self.value)
        return F.when(features[self.feature] <= F.lit(self.threshold), self.left.compile(features)).otherwise(self.right.compile(features))


@dataclass(frozen=True)
class UrlModel:
    """Boosted trees with their weights, and the table (kind, bucket, hits, rows) of blocked and of all labelled URLs by bucket."""

    trees: tuple[tuple[float, Tree], ...] = ()
    rates: DataFrame | None = None
    base_rate: float = 0.0


def _tree(node) -> Tree:
    if node.subtreeDepth() == 0:
        return Tree(value=float(node.prediction()))
    split = node.split()
    return Tree(feature=int(split.featureIndex()), threshold=float(split.threshold()), left=_tree(node.leftChild()), right=_tree(node.rightChild()))


def _with_rates(df: DataFrame, rates: DataFrame, base_rate: float, own_fold: bool = False) -> DataFrame:
    """``df`` with a smoothed block rate and the root of the rows of each kind; with ``own_fold`` without the row's fold."""
    for kind in KINDS:
        table = rates.where(F.col("kind") == kind)
        if own_fold:  # BUCKETS * FOLDS rows at most
            both = table.groupBy("bucket").agg(F.sum("hits").alias("all_hits"), F.sum("rows").alias("all_rows")).join(table, "bucket")
            table = both.select(F.col("bucket").alias(f"{kind}_bucket"), "fold", (F.col("all_hits") - F.col("hits")).alias("hits__"), (F.col("all_rows") - F.col("rows")).alias("rows__"))
        else:  # BUCKETS rows at most
            table = table.groupBy(F.col("bucket").alias(f"{kind}_bucket")).agg(F.sum("hits").alias("hits__"), F.sum("rows").alias("rows__"))
        df = df.join(F.broadcast(table), [f"{kind}_bucket", "fold"] if own_fold else f"{kind}_bucket", "left")
        hits, rows = F.coalesce("hits__", F.lit(0.0)), F.coalesce("rows__", F.lit(0)).cast("double")
        df = df.withColumns({f"{kind}_rate": (hits + 10 * base_rate) / (rows + 10), f"{kind}_rows": F.sqrt(rows)}).drop("hits__", "rows__")
    return df


def judged_by_rules(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, host, path, rule, rule_verdict) of every row."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    base = base.withColumns({"host": host, "path": path})
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return base.withColumns({"rule": name, "rule_verdict": verdict})


def fit(judged: DataFrame, *, sample: int = SAMPLE, rounds: int = 12, depth: int = 4) -> UrlModel:
    """Fit the trees on the distinct URLs with a rule's verdict; about ``sample`` / 2 of each verdict at most enter the trees.

    The sample takes URLs by hash, without a sort. Block rates are those of all distinct labelled URLs.
    """
    label = (F.col("rule_verdict") == "block").cast("double").alias("label")
    distinct = judged.where(F.col("rule_verdict").isNotNull()).select("url", "host", "path", label).dropDuplicates(["url"])
    rows = materialize(distinct.withColumns({**_buckets(), "key": F.xxhash64("url")}).withColumn("fold", F.pmod("key", F.lit(FOLDS)).cast("int")), "urls-labelled")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    if len(counts) < 2:
        return UrlModel()
    base_rate = counts[1.0] / (counts[0.0] + counts[1.0])
    by_kind = [rows.groupBy(F.lit(kind).alias("kind"), F.col(f"{kind}_bucket").alias("bucket"), "fold").agg(F.sum("label").alias("hits"), F.count(F.lit(1)).alias("rows")) for kind in KINDS]
    rates = materialize(reduce(DataFrame.unionAll, by_kind).coalesce(1), "urls-rates")  # two kinds of BUCKETS * FOLDS rows at most
    share = {v: min(1.0, sample / 2 / n) for v, n in counts.items()}
    own = F.when(F.col("label") == 1.0, share[1.0]).otherwise(share[0.0])
    drawn = rows.where(F.pmod("key", F.lit(1 << 30)) < own * (1 << 30)).withColumn("weight", 1 / own)
    featured = _with_rates(lexical(drawn), rates, base_rate, own_fold=True)
    vectors = VectorAssembler(inputCols=list(LEXICAL), outputCol="features").transform(featured).select("features", "label", "weight").repartition(2, "label", "features").sortWithinPartitions("label")
    fitted = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, maxBins=32, weightCol="weight", cacheNodeIds=False).fit(vectors)
    trees = tuple((float(w), _tree(t._call_java("rootNode"))) for w, t in zip(fitted.treeWeights, fitted.trees, strict=True))
    return UrlModel(trees, rates, base_rate)


def margin(features: list[Column], model: UrlModel) -> Column:
    """The weighted sum of the trees, above 0 where blocking is likelier."""
    return reduce(lambda a, b: a + b, (F.lit(w) * t.compile(features) for w, t in model.trees))


def probabilities(judged: DataFrame, model: UrlModel) -> DataFrame:
    """``judged`` with the trees' ``block_probability`` of every row; 0 without trees."""
    if model.rates is None:
        return judged.withColumn("block_probability", F.lit(0.0))
    scored = _with_rates(lexical(judged.withColumns(_buckets())), model.rates, model.base_rate)
    return scored.withColumn("block_probability", F.round(1 / (1 + F.exp(-2 * margin([F.col(c) for c in LEXICAL], model))), 9))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, *, model: UrlModel | None = None, id_col: str = "page_id", url_col: str = "url", **fitting) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability): the rule's verdict where one fits, else the trees'."""
    judged = judged_by_rules(pages, rules, id_col=id_col, url_col=url_col)
    scored = probabilities(judged, model or fit(judged, **fitting))
    verdict = F.coalesce(F.col("rule_verdict"), F.when(F.col("block_probability") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_probability")
