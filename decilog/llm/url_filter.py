"""URL verdicts: host and path rules first, else gradient-boosted trees on lexical features.

All of it is DataFrame work; the trees are Spark's own. Suffix statistics are shares of
blocked URLs by the last label and the last two labels of the host, over all labelled
URLs of other hosts: a URL is never judged by the labels of its own host.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decilog.llm.common import Scratch, if_small, need

#: (verdict, rule): host, then the start of the path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Host words of categories that are blocked; URLs with them are the labelled 1s.
LISTED = "ads?|adult|casino|bets?|pills?|spam|porn|track|tracker|viagra|lottery|poker-room|payday"
FEATURES = [
    "n_chars", "host_chars", "host_labels", "host_hyphens", "depth", "digit_ratio", "other_ratio",
    "entropy", "n_params", "has_fragment", "has_extension", "long_label", "suffix_share", "suffix_log_n", "domain_share", "domain_log_n",
]
#: Strength of the overall share in a suffix's share, in URLs.
PRIOR = 20.0
#: Rows up to which a table of sums is broadcast.
SMALL = 50_000


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits: its host or a subdomain, and the start of its path."""
    found = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def entropy(text: Column) -> Column:
    """Bits per character of a string; 0 for an empty one."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(size > 0, F.aggregate(chars, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))).otherwise(0.0)


def with_lexical(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with host, path, suffix, domain and the lexical features; null counts as empty."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    df = urls.withColumns({"host": host_of(url), "path": path_of(url), "_rest": after_scheme(url)})
    labels = F.split("host", r"\.")
    size = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract("_rest", r"\?([^#]*)", 1)
    return df.withColumns(
        {
            "suffix": F.element_at(labels, -1),
            "domain": F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1),
            "n_chars": F.length(url).cast("double"),
            "host_chars": F.length("host").cast("double"),
            "host_labels": F.size(labels).cast("double"),
            "host_hyphens": (F.length("host") - F.length(F.replace("host", F.lit("-"), F.lit("")))).cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / size,
            "other_ratio": F.length(F.regexp_replace(url, "[0-9A-Za-z]", "")) / size,
            "entropy": entropy(F.col("host")),
            "n_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
            "has_fragment": F.contains("_rest", F.lit("#")).cast("double"),
            "has_extension": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
            "long_label": F.array_max(F.transform(labels, F.length)).cast("double"),
        }
    ).drop("_rest")


def share_tables(labelled: DataFrame, left: Scratch) -> dict[str, DataFrame]:
    """Sums of blocked URLs (bad) and URLs (n) by suffix, domain and host, staged; ``all`` has one row."""
    by_host = left.stage(labelled.groupBy("suffix", "domain", "host").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")), "url-hosts")
    sums = lambda key: by_host.groupBy(key).agg(F.sum("bad").alias(f"{key}_bad"), F.sum("n").alias(f"{key}_n"))
    tables = {key: left.stage(sums(key), f"url-{key}") for key in ("suffix", "domain", "host")}
    return tables | {"all": by_host.agg(F.coalesce(F.sum("bad") / F.sum("n"), F.lit(0.0)).alias("all_share"))}


def with_suffix_statistics(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``df`` with the smoothed share of blocked URLs and the log of their number, by suffix and by domain.

    URLs of the row's own host are left out of both. Tables of at most SMALL rows are
    broadcast; beyond that the join is one whose large partitions Spark can split.
    """
    for key in ("suffix", "domain", "host"):
        df = df.join(if_small(tables[key], SMALL), key, "left")
    df = df.join(F.broadcast(tables["all"]), how="cross")  # one row
    own = {c: F.coalesce(F.col(f"host_{c}"), F.lit(0)) for c in ("bad", "n")}
    for key in ("suffix", "domain"):
        bad, n = (F.coalesce(F.col(f"{key}_{c}"), F.lit(0)) - own[c] for c in ("bad", "n"))
        df = df.withColumns({f"{key}_share": (bad + PRIOR * F.col("all_share")) / (n + PRIOR), f"{key}_log_n": F.log1p(n.cast("double"))})
    return df.drop("all_share", *[f"{key}_{c}" for key in ("suffix", "domain", "host") for c in ("bad", "n")])


def fit(labelled: DataFrame, shares: dict[str, DataFrame], max_rows: int = 20_000, trees: int = 12, depth: int = 3) -> GBTClassificationModel | None:
    """Trees on at most ``max_rows`` labelled URLs, those first by a hash; None without both labels.

    The suffix statistics come from all labelled URLs.
    """
    kinds = {r["label"] for r in labelled.select("label").distinct().collect()}  # 0, 1 or both
    if kinds != {0.0, 1.0}:
        return None
    sample = with_suffix_statistics(labelled.orderBy(F.xxhash64("url"), "url").limit(max_rows), shares)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample).select("label", "features")
    if {r["label"] for r in rows.select("label").distinct().collect()} != {0.0, 1.0}:
        return None
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=64).fit(rows)


def listed_labels(urls: DataFrame, words: str = LISTED) -> DataFrame:
    """(url, label): 1 where a host label is, or has between hyphens, a listed word."""
    hit = host_of(F.coalesce("url", F.lit(""))).rlike(rf"(^|[.-])({words})([.-]|$)")
    return urls.where("url IS NOT NULL").select("url", hit.cast("double").alias("label"))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url", left: Scratch | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    A null URL or one without ``://`` has an empty host and path, fits no rule and is
    judged by its features. Without both labels among ``labelled`` every URL that no
    rule fits is allowed with score 0. Repeated and null page ids are kept, a row for
    each row; an empty table gives no rows; other columns are not read.
    """
    urls = need(pages, id_col, url_col).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    known = with_lexical(need(labelled, "url", "label").where("url IS NOT NULL AND label IN (0, 1)"))
    shares = share_tables(known, left or Scratch())
    model = fit(known, shares)
    df = with_suffix_statistics(with_lexical(urls), shares)
    if model is None:
        df = df.withColumn("score", F.lit(0.0))
    else:
        df = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df))
        df = df.withColumn("score", F.element_at(vector_to_array("probability"), 2))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(*[F.when(rule == r, F.lit(v)) for v, r in rules], F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    return df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.col("score"))
