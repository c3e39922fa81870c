"""Mixing sources to target weights, in DataFrame functions alone.

Each source's documents, in a pseudorandom order, form one stream of words that is packed into blocks of ``BLOCK`` words (the
last one may be shorter). A source's target words are drawn as block slots: whole passes over its blocks, then part of one
more, each pass in the order of another pseudorandom permutation of the block indices; the last slot is cut so that the words
taken are the target, rounded. Output shards hold ``SHARD`` slots each. Every slot of a shard draws its source from the target
weights, so the source counts of a shard are multinomial; draws beyond a source's slots pass to the sources that came short. A
source's slots are numbered through the shards, mapped by the permutation to block indices and joined with the blocks.

All hashes are seeded, so reruns and other partitionings agree. Null texts have no words. A null source is a source of its own,
last in order. Null doc_ids sort first. Repeated rows and rows with the same doc_id are documents of their own. Documents
without words, and sources without words, take none. An empty table gives no rows. Other columns pass through ``taken_words``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pefloom.llm.common import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_PASSES = 2
BLOCK = 128
SHARD = 8192
SEED = 11
#: Documents a bucket of a source's order on average; the prefix sums run over the buckets, then within each.
BUCKET_DOCS = 4096
BINS = 1 << 16
#: Primes above any number of blocks; each is coprime to that number, so j -> (prime * j + shift) mod n is a permutation. Fixed values.
PRIMES = (2305843009213693951, 2305843009213693921, 2305843009213693907, 2305843009213693723)
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)).cast("long"), F.lit(0).cast("long"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """(source, source_size, target) from (source, size) rows; the weights go round the sources by code point, null last.

    The shares of sources that would pass ``most`` times their size stop there, and the excess goes to the others by
    weight, round by round; each round is two sums over the source table.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    sources = cut(sources.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * float(most)))
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    rate, held = -1.0, F.lit(False)
    while True:
        capped, free = sources.agg(F.sum(F.when(held, F.col("cap"))), F.sum(F.when(~held, F.col("weight")))).first()
        now = (total - (capped or 0.0)) / free if free else 0.0
        if now <= rate or not free:
            break
        rate = now
        held = F.col("weight") * F.lit(rate) >= F.col("cap")
    return sources.select("source", "source_size", F.when(held, F.col("cap")).otherwise(F.col("weight") * F.lit(max(rate, 0.0))).alias("target"))


def streams(sized: DataFrame, seed: int = SEED) -> DataFrame:
    """``sized`` (source, doc_id, size ...) plus ``start``, the words of the source before the document in its pseudorandom order."""
    n = sized.count()
    key = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(max(1, n // BUCKET_DOCS)))
    dealt = sized.withColumn("bucket", key)
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).select(F.col("source").alias("s_"), F.col("bucket").alias("b_"), "offset")
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = inner.join(offsets, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("b_")))
    return joined.withColumn("start", F.col("offset") + F.col("inner")).drop("bucket", "inner", "offset", "s_", "b_")


def _affine(n: Column, salts: tuple[Column, ...]) -> tuple[Column, Column]:
    """Factor and shift, modulo n, of the permutation that the salts choose."""
    prime = F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(F.xxhash64(F.lit(1), *salts), F.lit(len(PRIMES))) + 1).cast("int"))
    return F.pmod(prime, n), F.pmod(F.xxhash64(F.lit(2), *salts), n)


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def permuted(j: Column, n: Column, *salts: Column) -> Column:
    """The image of index j under a pseudorandom permutation of 0 .. n - 1 chosen by the salts."""
    factor, shift = _affine(n, salts)
    return F.pmod(_wide(factor) * _wide(j) + _wide(shift), _wide(n)).cast("long")


def origin(i: Column, n: Column, *salts: Column) -> Column:
    """The index whose image under ``permuted`` is i: the factor's inverse modulo n takes Euclid 92 steps at most."""
    factor, shift = _affine(n, salts)

    def step(x: Column, _: Column) -> Column:
        q = F.call_function("div", x["r"], x["s"])
        return F.when(x["s"] == 0, x).otherwise(F.struct(x["s"].alias("r"), (x["r"] - q * x["s"]).alias("s"), x["v"].alias("u"), (x["u"] - q * x["v"]).alias("v")))

    start = F.struct(n.alias("r"), factor.alias("s"), F.lit(0).cast("long").alias("u"), F.lit(1).cast("long").alias("v"))
    inverse = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["u"]
    return F.pmod(_wide(F.pmod(i - shift, n)) * _wide(F.pmod(inverse, n)), _wide(n)).cast("long")


def slots(goals: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(shard, source, pass, index, words): the block slots of the mix; index is the block of the source, words how much of it."""
    whole = goals.where("source_size > 0 AND target > 0").withColumn("aim", F.least(F.round("target").cast("long"), F.col("source_size") * MOST_PASSES))
    whole = whole.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("passes", F.expr("aim div source_size")).withColumn("rest", F.expr("aim % source_size"))
    # the last pass may meet the short block early, so one slot more than the words alone would need
    whole = whole.withColumn("slots", F.col("passes") * F.col("blocks") + F.when(F.col("rest") > 0, F.least("blocks", F.ceil(F.col("rest") / block) + 1)).otherwise(0))
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    plan = cut(whole.withColumn("first", F.coalesce(F.sum("slots").over(upto), F.lit(0))).withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    n = plan.agg(F.sum("slots")).first()[0] or 0
    spark = goals.sparkSession
    # which source each slot of each shard draws: a hash in [0, n), looked up by bins of equal width
    width = -(-max(n, 1) // BINS)
    bins = plan.select("sid", F.col("first").alias("lo"), (F.col("first") + F.col("slots")).alias("hi")).where("hi > lo")
    bins = bins.withColumn("bin", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    draws = spark.range(n).select(F.col("id").alias("slot"), F.expr(f"id div {shard}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(n, 1))).alias("u")).withColumn("bin", F.expr(f"u div {width}"))
    drawn = draws.join(bins, "bin").where("u >= lo AND u < hi").select("slot", "shard", "sid")
    counts = drawn.groupBy("shard", "sid").agg(F.count("*").alias("c"))
    counts = cut(counts.withColumn("c0", F.coalesce(F.sum("c").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    # sources that drew too many slots give the last ones to those that came short
    held = plan.join(counts.groupBy("sid").agg(F.sum("c").alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    over = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("spare0", F.coalesce(F.sum(F.greatest(F.col("got") - F.col("slots"), F.lit(0))).over(over), F.lit(0)))
    held = cut(held.withColumn("lack0", F.coalesce(F.sum(F.greatest(F.col("slots") - F.col("got"), F.lit(0))).over(over), F.lit(0))))
    lacking = held.where("slots > got").select("sid", "got", F.posexplode(F.sequence(F.col("lack0"), F.col("lack0") + F.col("slots") - F.col("got") - 1)).alias("k", "q")).select("q", F.col("sid").alias("to"), (F.col("got") + F.col("k")).alias("to_j"))
    # a shard's draws of one source are numbers c0 .. c0 + c - 1 of that source; which of its slots bears which doesn't matter
    numbered = counts.withColumn("j", F.explode(F.sequence(F.col("c0"), F.col("c0") + F.col("c") - 1))).select("shard", "sid", "j")
    numbered = numbered.join(held.select("sid", "slots", "spare0"), "sid").withColumn("q", F.when(F.col("j") >= F.col("slots"), F.col("spare0") + F.col("j") - F.col("slots")))
    settled = numbered.where("q IS NULL").select("shard", "sid", "j").union(numbered.where("q IS NOT NULL").join(lacking, "q").select("shard", F.col("to").alias("sid"), F.col("to_j").alias("j")))
    all_ = settled.join(plan.select("sid", "source", "source_size", "blocks", "passes", "rest"), "sid").withColumn("pass", F.expr("j div blocks")).withColumn("at", F.expr("j % blocks"))
    perm = lambda j: permuted(j, F.col("blocks"), F.lit(seed), F.col("source"), F.col("pass"))
    last = F.col("source_size") - (F.col("blocks") - 1) * block
    all_ = all_.withColumn("index", perm(F.col("at"))).withColumn("full", F.when(F.col("index") == F.col("blocks") - 1, last).otherwise(block))
    # words of the pass before this slot: whole blocks, less what the short block lacks if it came before
    prime_first = F.col("short_at") < F.col("at")
    short = plan.where("rest > 0").select(F.col("sid").alias("sid_"), origin(F.col("blocks") - 1, F.col("blocks"), F.lit(seed), F.col("source"), F.col("passes")).alias("short_at"))
    all_ = all_.join(short, F.col("sid") == F.col("sid_"), "left")
    before = F.col("at") * block - F.when(F.coalesce(prime_first, F.lit(False)), block - last).otherwise(0)
    words = F.when(F.col("pass") < F.col("passes"), F.col("full")).otherwise(F.greatest(F.lit(0), F.least(F.col("full"), F.col("rest") - before)))
    return all_.select("shard", "source", "pass", "index", words.cast("long").alias("words")).where("words > 0")


def taken_words(docs: DataFrame, block: int = BLOCK, **how) -> DataFrame:
    """``docs`` (doc_id, text, source) as (doc_id, size, source_size, target, taken)."""
    sized = cut(docs.select("doc_id", "source", word_count().alias("size")))
    goals = cut(targets(sized, **how))
    dealt = cut(streams(sized.where("size > 0")))
    pieces = dealt.withColumn("index", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    pieces = pieces.select("doc_id", "source", "size", "start", "index", F.greatest(F.col("start") - F.col("index") * block, F.lit(0)).alias("a"), F.least(F.col("start") + F.col("size") - F.col("index") * block, F.lit(block)).alias("z"))
    mix = slots(goals, block).groupBy(F.col("source").alias("s_"), F.col("index").alias("i_")).agg(F.collect_list("words").alias("cuts"))  # two at most
    joined = pieces.join(mix, F.col("source").eqNullSafe(F.col("s_")) & (F.col("index") == F.col("i_")))
    got = F.expr("aggregate(cuts, 0L, (t, w) -> t + greatest(0L, least(z, w) - a))")
    taken = joined.groupBy("source", "start").agg(F.sum(got).alias("taken")).select(F.col("source").alias("s_"), F.col("start").alias("at_"), "taken")
    words = dealt.join(taken, F.col("source").eqNullSafe(F.col("s_")) & (F.col("start") == F.col("at_")), "left").select("doc_id", "source", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    everything = words.union(sized.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long")))
    goals = goals.withColumnRenamed("source", "s_")
    return everything.join(goals, F.col("source").eqNullSafe(F.col("s_"))).select("doc_id", "size", "source_size", "target", "taken")


def op3_mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    return taken_words(docs)
