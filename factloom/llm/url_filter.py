"""URL filters: rules first, gradient-boosted trees on lexical features for what no rule decides.

Features are built-in columns: lengths, depth, shares of digits and letters, entropy of the characters, parameters, and
smoothed statistics of the host's suffixes. They are trained from labelled URLs; without other labels, those that rules
decide serve. Suffixes are counted over every distinct labelled URL. The trees alone are fitted on a sample, which is drawn
from the distinct URLs of each label by itself: at most about half of ``SAMPLE`` of either, so a rare label stays whole and
a frequent URL is one row.

Defined cases: a null url, or one without ``://``, has an empty host and path; repeated rows give equal rows; ties between
rules of one length are broken by their text; if no labelled URL at all has one of the verdicts, the method gives the other,
or allow without any; null labels are left out; an empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import configure, materialize

#: Distinct labelled URLs that the trees are fitted on about, chosen by a hash of the URL, when there are more.
SAMPLE = 20_000
TREES, DEPTH = 15, 4
FEATURES = ("n_chars", "n_host", "n_path", "n_labels", "depth", "digits", "letters", "dashes", "n_params", "n_query", "fragment", "secure", "entropy", "host_entropy", "rate_1", "seen_1", "rate_2", "seen_2")
Rule = tuple[str, str, str]


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, or nulls."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    fits = lambda h, p: ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
    return reduce(lambda rest, r: F.when(fits(r[1], r[2]), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))).otherwise(rest), reversed(ordered), none)


def entropy(text: Column) -> Column:
    """Bits of a text's characters."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.aggregate(F.transform(chars, share), F.lit(0.0), lambda total, p: total - p * F.log2(p))


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def lexical(rows: DataFrame) -> DataFrame:
    """``rows`` with url, host and path, and the features of the text itself."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    share = lambda kept: F.length(F.regexp_replace(url, f"[^{kept}]", "")) / n
    count = lambda text, c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return rows.withColumns({
        "n_chars": F.length(url).cast("double"), "n_host": F.length("host").cast("double"), "n_path": F.length("path").cast("double"),
        "n_labels": F.size(F.split("host", r"\.")).cast("double"), "depth": count(F.col("path"), "/").cast("double"),
        "digits": share("0-9"), "letters": share("A-Za-z"), "dashes": share("_-"),
        "n_params": F.when(query == "", 0.0).otherwise(1.0 + count(query, "&")), "n_query": F.length(query).cast("double"),
        "fragment": F.contains(url, F.lit("#")).cast("double"), "secure": F.startswith(url, F.lit("https")).cast("double"),
        "entropy": entropy(url), "host_entropy": entropy(F.col("host")), "suffix_1": _suffix(F.col("host"), 1), "suffix_2": _suffix(F.col("host"), 2),
    })


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


class UrlModel:
    """Suffix statistics and trees; ``label`` 1 is block."""

    def __init__(self, labelled: DataFrame, sample: int = SAMPLE):
        """Fit on (url, label)."""
        host, path = parts(F.col("url"))
        known = labelled.select("url", F.col("label").cast("double").alias("label")).where("label IS NOT NULL").distinct()
        known = materialize(known.withColumns({"host": host, "path": path}), "labelled")
        # Two labels.
        found = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.only = None if len(found) == 2 else next(iter(found), 0.0)
        if self.only is None:
            self.prior = found[1.0] / sum(found.values())
            self.suffixes = [
                materialize(known.groupBy(_suffix(F.col("host"), i).alias(f"suffix_{i}")).agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("n")), "suffixes")
                for i in (1, 2)
            ]
            share = F.lit(float(1 << 30)) * F.least(F.lit(1.0), F.when(F.col("label") == 1.0, sample / 2 / found[1.0]).otherwise(sample / 2 / found[0.0]))
            rows = materialize(self._with_suffixes(lexical(known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < share)), own=F.col("label")), "urls")
            trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.2, seed=1, minInstancesPerNode=5)
            self.trees = trees.fit(_assembled(rows))

    def _with_suffixes(self, rows: DataFrame, own: Column | None = None) -> DataFrame:
        """``rows`` with the statistics of their suffixes; ``own``: a row's own label, taken out of them."""
        out = rows
        one = F.lit(0.0) if own is None else F.lit(1.0)
        for i, table in enumerate(self.suffixes, 1):
            # Grows with the labelled hosts: read back from files, so Spark broadcasts it by its real size or shuffles.
            out = out.join(table, f"suffix_{i}", "left")
            n = F.greatest(F.coalesce(F.col("n"), F.lit(0)) - one, F.lit(0.0))
            blocked = F.coalesce(F.col("blocked"), F.lit(0.0)) - (F.lit(0.0) if own is None else own)
            out = out.withColumns({f"rate_{i}": (blocked + 5 * self.prior) / (n + 5), f"seen_{i}": F.log1p(n)}).drop("n", "blocked")
        return out

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with url, host and path, and ``score``: how likely each is to be blocked."""
        if self.only is not None:
            return rows.withColumn("score", F.lit(float(self.only)))
        kept = [c for c in rows.columns]
        out = self.trees.transform(_assembled(self._with_suffixes(lexical(rows))))
        return out.select(*kept, vector_to_array("probability")[1].alias("score"))


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every page; the rule's verdict, else the model's."""
    configure(pages.sparkSession)
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").alias("id"), "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("by", ruled(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = rows.where("by IS NOT NULL").select("url", (F.col("by.verdict") == "block").cast("double").alias("label"))
    scored = UrlModel(labelled).score(rows)
    method = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select("id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce("by.verdict", method).alias("verdict"), "score")
