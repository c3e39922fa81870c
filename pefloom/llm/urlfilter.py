"""URL filter: given rules first, then association rules that Spark's FP-growth mines from the pages that the given rules label.

A URL's tokens are all its host labels (by place from the right), path segments (wherever they stand) and names of query
arguments. Tokens below ``min_support`` are in no frequent set and leave before FP-growth; at most 1 / min_support tokens an average
URL holds remain. Two more groups leave without loss, so that the sets mined are near the closed ones: of tokens that occur on the
same labelled pages one stands for all, and tokens of one verdict alone are rules by themselves, which no longer antecedent can better.
What remains can still grow with the tokens that mostly, but not always, occur together under both verdicts.

The rules are pruned by confidence, support, lift over the verdict's base rate, the number of different hosts they hold on, and by simpler
rules that say the same at least as surely; those that remain match every page through an inverted index (token -> rules)
inside the scan's own tasks, without a shuffle. A page has a token of a rule if it has any of those that the token stands for.

Null URLs and URLs without "://" have empty host and path, no rule, and no token but the empty ones; they are allowed unless
a mined rule says otherwise. Ties go to the larger confidence, then support, then the rule's text. Repeated pages repeat.
An empty table, or pages that no given rule labels, leave no mined rules. Other columns pass through ``judge``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule text (host and path start) and its verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: A mined rule is right so many times as often as its verdict is common, and holds on so many hosts (in ``op7_urlfilter``).
LIFT, HOSTS = 1.1, 3


def after_scheme(url: str = "url") -> Column:
    """What follows the first "://"; empty without one."""
    return F.coalesce(F.expr(f"CASE WHEN locate('://', {url}) > 0 THEN substring({url}, locate('://', {url}) + 3) END"), F.lit(""))


def host(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: str = "url") -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: dict[str, str]) -> Column:
    """The longest of ``rules`` that fits the columns host and path, or null. The rules are a short list of the caller's."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        h, p = rule.partition("/")[0], "/" + rule.partition("/")[2]
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def url_tokens(url: str = "url") -> Column:
    """The distinct tokens of a URL, from the columns host and path."""
    labels = F.expr("transform(reverse(split(host, '[.]')), (x, i) -> concat('h', i, ':', x))")
    parts = F.expr("transform(filter(split(path, '/'), x -> x <> ''), x -> concat('p:', x))")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    args = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(labels, parts, args))


Rule = tuple[frozenset[str], str, float, float]


class Index:
    """Rules by token: which of them hold on a page. ``alike`` leads from a token to the one that stands for it."""

    def __init__(self, rules: list[Rule], alike: dict[str, str]):
        self.need, self.by_token = [len(r[0]) for r in rules], {}
        for k, (tokens, *_) in enumerate(rules):
            for t in tokens:
                self.by_token.setdefault(t, []).append(k)
        self.alike = {t: r for t, r in alike.items() if r in self.by_token}

    def holding(self, tokens: list[str]) -> list[int]:
        count: dict[int, int] = {}
        for t in {self.alike[t] for t in tokens if t in self.alike}:
            for k in self.by_token[t]:
                count[k] = count.get(k, 0) + 1
        return [k for k, n in count.items() if n == self.need[k]]


def hosts_of(labelled: DataFrame, rules: list[Rule], alike: dict[str, str]) -> dict[int, int]:
    """On how many different hosts each of ``rules`` holds; pages meet the rules where they are read, only (rule, host) is shuffled."""
    held = labelled.sparkSession.sparkContext.broadcast(Index(rules, alike))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {(k, h) for t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k in held.value.holding(t)}
            ks, hs = zip(*found, strict=True) if found else ((), ())
            yield pa.record_batch([pa.array(ks, pa.int64()), pa.array(hs, pa.string())], ["k", "host"])

    pairs = labelled.select("tokens", F.col("host").cast("string").alias("host")).mapInArrow(run, "k long, host string")
    return {r.k: r.n for r in pairs.distinct().groupBy("k").agg(F.count("*").alias("n")).collect()}


def mine_alike(labelled: DataFrame, min_support: float = 0.02, min_confidence: float = 0.9, min_lift: float = LIFT, min_hosts: int = 1) -> tuple[list[Rule], dict[str, str]]:
    """The pruned rules (tokens, verdict, confidence, support) mined from (tokens, verdict, host) rows, and for every frequent token the one
    that stands for it: the least, by code points, of those on the same pages. host is needed for ``min_hosts`` above 1 only."""
    rows = labelled.select(F.array_distinct("tokens").alias("tokens"), "verdict", F.monotonically_increasing_id().alias("page"))
    base = {r.verdict: r["count"] for r in rows.groupBy("verdict").count().collect()}
    n = sum(base.values())
    if not n:
        return [], {}
    pages = (F.bit_xor(F.xxhash64("page")).alias("x"), F.bit_xor(F.xxhash64("page", F.lit(1))).alias("y"))
    often = rows.select("page", "verdict", F.explode("tokens").alias("item")).groupBy("item").agg(F.count("*").alias("n"), *pages, F.min("verdict").alias("lo"), F.max("verdict").alias("hi")).where(F.col("n") >= min_support * n).collect()
    first: dict[tuple, str] = {}
    for r in sorted(often, key=lambda r: r.item):
        first.setdefault((r.n, r.x, r.y), r.item)
    alike = {r.item: first[r.n, r.x, r.y] for r in often}
    stand = [r for r in often if alike[r.item] == r.item]
    found = [(frozenset([r.item]), r.lo, 1.0, r.n / n) for r in stand if r.lo == r.hi]
    mixed = [r.item for r in stand if r.lo != r.hi]
    if mixed:
        items = rows.select(F.array_append(F.array_intersect("tokens", F.lit(mixed)), F.concat(F.lit("="), "verdict")).alias("items"))
        rules = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items).associationRules
        got = rules.where(F.startswith(rules["consequent"][0], F.lit("=")) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit("=")))).collect()
        found += [(frozenset(r.antecedent), r.consequent[0][1:], r.confidence, r.support) for r in got]
    best: list[Rule] = []
    held: dict[tuple[frozenset[str], str], float] = {}
    for tokens, verdict, confidence, support in sorted(found, key=lambda r: (len(r[0]), sorted(r[0]))):
        simpler = (frozenset(t for k, t in enumerate(sorted(tokens)) if bits >> k & 1) for bits in range(1, (1 << len(tokens)) - 1))
        if confidence * n >= min_lift * base[verdict] and not any(held.get((s, verdict), -1.0) >= confidence for s in simpler):
            held[tokens, verdict] = confidence
            best.append((tokens, verdict, confidence, support))
    if min_hosts > 1 and best:
        hosts = hosts_of(labelled, best, alike)
        best = [r for k, r in enumerate(best) if hosts.get(k, 0) >= min_hosts]
    return best, alike


def mine(labelled: DataFrame, min_support: float = 0.02, min_confidence: float = 0.9, **how) -> list[Rule]:
    """(tokens, verdict, confidence, support) of the pruned rules mined from (tokens, verdict) rows."""
    return mine_alike(labelled, min_support, min_confidence, **how)[0]


def judge(pages: DataFrame, rules: dict[str, str] | None = None, default: str = "allow", **how) -> DataFrame:
    """``pages`` plus host, path, rule and verdict."""
    rules = RULES if rules is None else rules
    plain = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host(), "path": path()}).withColumn("rule", longest_rule(rules))
    told = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        told = F.when(F.col("rule") == rule, verdict).otherwise(told)
    plain = plain.withColumn("verdict", told)
    mined, alike = mine_alike(plain.where("rule IS NOT NULL").select(url_tokens().alias("tokens"), "verdict", "host"), **how)
    ranked = sorted(mined, key=lambda r: (-r[2], -r[3], sorted(r[0])))
    held = pages.sparkSession.sparkContext.broadcast((Index(ranked, alike), [r[1] for r in ranked]))
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, verdicts = held.value

        def match(tokens: list[str]) -> str:
            return verdicts[k] if (k := min(index.holding(tokens), default=None)) is not None else default

        for b in batches:
            old, tokens = b.column(len(names) - 1).to_pylist(), b.column(len(names)).to_pylist()
            yield pa.record_batch([*b.columns[: len(names) - 1], pa.array([v if v is not None else match(t) for v, t in zip(old, tokens, strict=True)], pa.string())], names)

    free = next(c for c in (f"tokens{k}" for k in range(len(names) + 1)) if c not in {n.lower() for n in names})
    return plain.withColumn(free, url_tokens()).mapInArrow(run, plain.schema)


def op7_urlfilter(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    return judge(pages.select("page_id", "url"), min_hosts=HOSTS).drop("url")
