"""Fuzzy line dedup in DataFrame functions alone: SimHash of normalised lines, pigeonhole blocks, edit similarity, components.

A line is what stands between line feeds. Normalised, it is its words, lower-cased, with a space between: ASCII punctuation, spaces and
control characters separate words. Lines without words are kept and never compared. Two lines are linked if they normalise alike, or
if the edit similarity of the normalised lines (1 - Levenshtein distance / longer length), in characters or in words, is at least ``SIMILAR``.

Blocks of SimHash bits alone can't find such pairs: a tenth of the words moves nine of 64 bits, and blocks that survive that are too short
to tell lines apart. So the blocks are laid over a second sketch: the ``SAMPLES`` words of a line that are least by hash, of which every three make
a key, so that lines meet that have any three in common; lines of up to three words also meet by two words, of up to two by one. In a simulation lines of
15 to 200 words met with probability 0.90 to 0.96 when a fifth of the words was replaced, of 30 words with 0.995 at a tenth. Candidates differ in
``BITS_APART`` SimHash bits at most, for which every word votes, and have a third of their words in common; then the edit similarity decides.
Edits that touch nearly every word leave no word in common and aren't found.

Members are held against their bucket's hub first (``line_groups``), so a large group of alike lines costs its size; lines that
the triangle inequality keeps apart, by their distances from the pivot of a large bucket, don't meet, and lines like the pivot are linked before. Of each connected
group only the first occurrence, by (doc_id, line number), stays. Only lines that share a bucket with another get a SimHash; its vote counts
for the 64 bits are summed in lanes packed into longs.

Null texts have no lines and stay null. Rows with the same doc_id and text share their decisions, so repeated rows all keep an
occurrence that is kept; rows with one doc_id and several texts are told apart by the text. Null doc_ids come first. Ties on
the occurrence don't arise otherwise. A line of any length is compared whole. An empty table gives an empty table. Columns other
than doc_id, text and n_chars pass through, whatever their names.
"""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pefloom.llm.common import Folder, connected_components, shared_dir, with_root

#: Similar lines are some 13 bits apart at a fifth of the words replaced, unrelated ones some 32.
BITS_APART = 24
SIMILAR = 0.8
#: Lines that have three of so many samples in common meet.
SAMPLES = 5
#: Members of buckets of so many or more are told apart by their distances from its pivot.
LARGE = 64
#: Each byte of a word, up to LIFT, makes it twice as likely to be sampled: unrelated lines share short words. Words of TELLING bytes have so many votes.
TELLING, LIFT, VOTES = 4, 12, 4
#: Vote counts: so many lanes of so many bits in a long, for lines of fewer than 2**bits votes; no text has 2**31.
NARROW, WIDE = (5, 11), (2, 31)
#: What separates words. Fixed values.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Up to so many ids of documents whose lines are to be compared are sent to all tasks (8 bytes each); more are joined by a shuffle.
SEND_IDS = 2_000_000


#: How many edits similar lines of two sizes may have.
LIMIT = f"CAST(floor({1 - SIMILAR:.6f} * greatest({{}}, {{}}) + 1e-9) AS INT)"
FAR = "struct<wlo: int, whi: int, clo: int, chi: int, nw: int, nc: int>"


def stored(df: DataFrame, base: str) -> DataFrame:
    """``df`` written as Parquet to a folder in ``base`` and read again: computed once, compressed, and read by column.

    The driver then collects its garbage, so that Spark's cleaner drops the shuffle files that only the lineage needed.
    """
    spark, path = df.sparkSession, f"{base}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def n_letters(words: str) -> Column:
    return F.expr(f"size({words}) + aggregate({words}, 0, (n, s) -> n + length(s)) - 1")


def limit(a: str, b: str) -> Column:
    return F.expr(LIMIT.format(a, b))


def as_letters(words: str) -> Column:
    """The words as one letter each, different ones for all different words of x and y: by 20 bits of a hash where no two of these words share
    them, else by the words' places among them. Letters begin at U+10000; there are 2**20."""
    text = f"decode(unhex(array_join(transform({words}, s -> lpad(hex({{}}), 8, '0')), '')), 'UTF-32')"
    return F.expr(f"IF(clash, {text.format('65535 + array_position(both, s)')}, {text.format('65536 + (hash(s) & 1048575)')})")


def with_letters(pairs: DataFrame) -> DataFrame:
    """``pairs`` with cx and cy, the words of x and y as letters."""
    both = pairs.withColumns({"both": F.array_union("x", "y"), "at": F.monotonically_increasing_id()}).where("at >= 0")
    told = both.withColumns({"clash": F.expr("size(array_distinct(transform(both, s -> hash(s) & 1048575))) < size(both)"), "at": F.monotonically_increasing_id()}).where("at >= 0")
    return told.withColumns({"cx": as_letters("x"), "cy": as_letters("y")}).drop("both", "clash")


def spaced(words: str) -> str:
    return f"array_join(transform({words}, s -> concat(s, ' ')), '')"


def words_of(line: str) -> Column:
    return F.array_remove(F.split(F.lower(F.col(line)), BETWEEN, -1), "")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_h, line_no, h1, h2, words) of all lines with words: h1 and h2 stand for the sequence of words."""
    lines = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("doc_h"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    # the filter names a row number, as below: split once
    lines = lines.select("doc_id", "doc_h", "line_no", words_of("line").alias("words"), F.monotonically_increasing_id().alias("at")).where("at >= 0 AND size(words) > 0")
    return lines.select("doc_id", "doc_h", "line_no", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"), "words")


def sampled_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_h, line_no, h1, h2, s0, s1, ...) of all lines with words: the samples of a line, least first, null where it has fewer words.

    No word leaves its row, so nothing is shuffled.
    """
    least = f"slice(sort_array(array_distinct(transform(words, w -> shiftrightunsigned(xxhash64(w), least(octet_length(w), {LIFT}))))), 1, {SAMPLES})"
    lines = lines_of(docs).select("doc_id", "doc_h", "line_no", "h1", "h2", F.expr(least).alias("least"))
    return lines.select("doc_id", "doc_h", "line_no", "h1", "h2", *(F.get("least", F.lit(k)).alias(f"s{k}") for k in range(SAMPLES)))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_h, line_no, h1, h2, sim) of all lines with words: in sim a bit is set where the words' hashes have it with more than half
    of the votes; every word votes."""
    return voted(lines_of(docs), ["doc_id", "doc_h", "line_no", "h1", "h2"])


def voted(lines: DataFrame, own: list[str]) -> DataFrame:
    """The columns ``own`` of ``lines`` and sim of their words. Words are summed up in the tasks that read them; a line leaves them as one row,
    and so does one whose words are many, with wider lanes."""
    lines = lines.withColumn("wide", F.size("words") >= (1 << NARROW[1]) // VOTES)
    return _voted(lines.where("NOT wide"), own, *NARROW).union(_voted(lines.where("wide"), own, *WIDE))


def _voted(lines: DataFrame, own: list[str], lanes: int, width: int) -> DataFrame:
    """``voted`` with votes in ``lanes`` lanes of ``width`` bits a long."""
    words = lines.withColumn("row", F.monotonically_increasing_id()).select("row", *own, F.explode("words").alias("word"))
    words = words.select("row", *own, F.xxhash64("word").alias("w"), F.when(F.octet_length("word") >= TELLING, VOTES).otherwise(1).alias("votes"))
    mask, low = sum(1 << i * width for i in range(lanes)), (1 << lanes) - 1
    spread = [f"((shiftrightunsigned(w, {lanes * k}) & {low}L) * {sum(1 << i * (width - 1) for i in range(lanes))}L & {mask}L) * votes" for k in range(-(-64 // lanes))]
    summed = words.groupBy("row").agg(*(F.first(c).alias(c) for c in own), F.sum("votes").alias("n"), *(F.sum(F.expr(x)).alias(f"s{k}") for k, x in enumerate(spread)))
    # the top bit of a lane is set where its count passes half of the votes
    summed = summed.withColumn("need", F.expr(f"{mask}L * ({(1 << width - 1) - 1}L - n div 2)"))
    over = [f"(shiftrightunsigned(s{k} + need, {width - 1}) & {mask}L)" for k in range(-(-64 // lanes))]
    bits = [f"shiftleft(({' | '.join(f'shiftrightunsigned({x}, {i * (width - 1)})' for i in range(lanes))}) & {low}L, {lanes * k})" for k, x in enumerate(over)]
    return summed.select(*own, F.expr(" | ".join(bits)).alias("sim"))


def near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= BITS_APART


def by_words(pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` whose word arrays x and y may have an edit similarity of ``SIMILAR`` or more, with like: they have it in words;
    where not, letters decide. most is the number of edits that letters may have; x and y lose what they have in common at both ends.

    Pairs with less than a third of their different words in common go first. Common words at the start and the end don't change
    the distance and are cut off. Words are compared as one letter each, different ones for different words; a pair that fails there, but not
    by more than as much again, is compared letter by letter, each word with a space behind it. The distance function gives -1
    beyond the bound in its third place, and takes time in proportion to it, so that a small bound is tried first. The filters
    name a row number, which keeps Spark from moving them below what was computed and so computing it again.
    """
    once = {"at": F.monotonically_increasing_id()}
    shared = "array_position(zip_with({0}, {1}, (p, q) -> NOT (p <=> q)), true) - 1"  # -1: equal
    cut_off = lambda w, n: F.expr(f"IF({n} < 0, slice({w}, 1, 0), slice({w}, CAST({n} AS INT) + 1, size({w})))")
    sized = pairs.where("3 * size(array_intersect(x, y)) >= size(array_union(x, y))").withColumns({"nx": n_letters("x"), "ny": n_letters("y")} | once)
    sized = sized.withColumns({"most": limit("nx", "ny"), "words": limit("size(x)", "size(y)")}).where("at >= 0 AND (abs(nx - ny) <= most OR abs(size(x) - size(y)) <= words)")
    ends = sized.withColumn("head", F.expr(shared.format("x", "y"))).withColumns({"x": F.reverse(cut_off("x", "head")), "y": F.reverse(cut_off("y", "head"))})
    mid = ends.withColumn("tail", F.expr(f"IF(size(x) = 0 OR size(y) = 0, 0, {shared.format('x', 'y')})")).withColumns({"x": F.reverse(cut_off("x", "tail")), "y": F.reverse(cut_off("y", "tail"))})
    mid = with_letters(mid)
    sure = "greatest(size(x), size(y)) <= words OR levenshtein(cx, cy, words div 4) >= 0"
    told = mid.withColumns({"apart": F.expr(f"CASE WHEN {sure} THEN 0 ELSE levenshtein(cx, cy, 2 * words + 1) END")} | once)
    return told.where("at >= 0 AND apart >= 0").withColumn("like", F.expr("apart <= words"))


def alike(pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` whose word arrays x and y have an edit similarity of ``SIMILAR`` or more, in words or in characters."""
    return by_words(pairs).where(f"like OR levenshtein({spaced('x')}, {spaced('y')}, most) >= 0")


def distances(pairs: DataFrame) -> DataFrame:
    """``pairs`` with far: the least and the most that the edit distance of x and y can be, in words (as ``alike`` compares them) and
    in letters, and the sizes of y. Beyond twice what similar lines may have, and one, the most is without bound. like: whether ``alike`` has them."""
    sized = pairs.withColumns({"nx": n_letters("x"), "ny": n_letters("y"), "third": F.expr("3 * size(array_intersect(x, y)) >= size(array_union(x, y))")})
    bounds = {"most": limit("nx", "ny"), "words": limit("size(x)", "size(y)")}
    found = sized.withColumns(bounds | {"at": F.monotonically_increasing_id()}).where("at >= 0")
    found = with_letters(found).withColumns({"at": F.monotonically_increasing_id(), "sx": F.expr(spaced("x")), "sy": F.expr(spaced("y"))})
    found = found.withColumns({"dw": F.expr("levenshtein(cx, cy, 2 * words + 1)"), "dc": F.expr("levenshtein(sx, sy, 2 * most + 1)")}).where("at >= 0")
    found = found.withColumn("like", F.expr("third AND dw >= 0 AND (dw <= words OR dc BETWEEN 0 AND most)"))
    least = lambda d, most: F.expr(f"IF({d} < 0, 2 * {most} + 2, {d})")
    top = lambda d: F.expr(f"IF({d} < 0, {1 << 30}, {d})")
    return found.withColumn("far", F.struct(least("dw", "words").alias("wlo"), top("dw").alias("whi"), least("dc", "most").alias("clo"), top("dc").alias("chi"), F.size("y").alias("nw"), F.col("ny").cast("int").alias("nc")))


def may_be_alike(p: str, q: str) -> Column:
    """False where lines at the distances p and q from one line are too far from each other, in words and in letters, to be similar:
    by the triangle inequality the least of one less the most of the other is the least between them."""
    apart = lambda k: f"greatest({p}.{k}lo - {q}.{k}hi, {q}.{k}lo - {p}.{k}hi)"
    return F.expr(f"{apart('w')} <= {LIMIT.format(f'{p}.nw', f'{q}.nw')} OR {apart('c')} <= {LIMIT.format(f'{p}.nc', f'{q}.nc')}")


def keys_of() -> Column:
    """The buckets of a line, by three of its samples each; lines of up to three words also go by two, of up to two by one."""
    key = lambda own: F.xxhash64(*(F.col(f"s{k}") for k in own))
    threes = [F.when(F.col(f"s{x[-1]}").isNotNull(), key(x)) for x in combinations(range(SAMPLES), 3)]
    twos = [F.when(F.col("s3").isNull() & F.col(f"s{x[-1]}").isNotNull(), key(x)) for x in combinations(range(3), 2)]
    ones = [F.when(F.col("s2").isNull() & F.col(f"s{k}").isNotNull(), key([k])) for k in range(2)]
    return F.array(*threes, *twos, *ones)


def several(members: DataFrame) -> DataFrame:
    """The ``members`` of buckets with more than one root."""
    own = Window.partitionBy("bucket")
    return members.withColumns({"lo": F.min("root").over(own), "hi": F.max("root").over(own)}).where("lo < hi").drop("lo", "hi")


def line_groups(docs: DataFrame, lines: DataFrame, base: str) -> DataFrame:
    """(id, root) of the lines, by h1, that are linked to others than themselves; ``lines`` are the sampled lines of ``docs``; tables on the way stay in ``base``.

    Every line is held against the hubs of its buckets first, the least id of each: a few pairs a line, so that a large group of
    alike lines costs its size, not its square. In the buckets that hold several components then, all pairs of different components
    meet that their sizes, SimHashes and distances from the bucket's pivot let be similar, each in one bucket. So no link between
    components is lost; links inside a component would change nothing.
    """
    distinct = lines.groupBy("h1").agg(*(F.max(f"s{k}").alias(f"s{k}") for k in range(SAMPLES)))
    # most buckets have one member; dealt out once, for the buckets' ends and the members of the others
    members = distinct.select(F.explode(keys_of()).alias("bucket"), F.col("h1").alias("id")).where("bucket IS NOT NULL").repartition("bucket")
    ends = members.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("n")).where("hub < last").drop("last")
    shared = stored(members.join(ends.hint("shuffle_hash"), "bucket").select("bucket", "id", "hub", "n"), base)

    # one occurrence of each line that is to be compared, its words from that document, and its SimHash
    ids = shared.select(F.col("id").alias("h1")).distinct()
    places = lines.join(ids, "h1", "left_semi").groupBy("h1").agg(F.max("doc_h").alias("h_"))
    places = lines.join(places, "h1").where("doc_h = h_").groupBy("h1", "h_").agg(F.min("line_no").alias("line_no"))
    places = stored(places.groupBy("h_").agg(F.collect_list(F.struct("h1", "line_no")).alias("want")), base)
    places = F.broadcast(places) if places.count() <= SEND_IDS // 16 else places
    texts = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("h_")).join(places, "h_")
    texts = texts.withColumn("parts", F.split("text", "\n", -1)).select(F.inline(F.transform("want", lambda w: F.struct(w["h1"].alias("id"), F.element_at("parts", w["line_no"] + 1).alias("line")))))
    # copies of a document bring their lines again
    texts = stored(texts.dropDuplicates(["id"]).select("id", words_of("line").alias("words")), base)
    known = stored(voted(texts, ["id"]).join(texts.select("id", F.size("words").alias("nw"), n_letters("words").alias("nc")), "id"), base)

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def with_words(pairs: DataFrame) -> DataFrame:
        # only lines of these pairs are shuffled; pairs take few bytes and long, so their number, not their size, is dealt out
        pairs = stored(pairs, base)
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        own = texts.join(F.broadcast(ids) if pairs.count() <= SEND_IDS // 16 else ids, "id", "left_semi")
        pairs = pairs.repartition(tasks, "a", "b")
        return pairs.join(own.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")

    sizes = " OR ".join(f"abs(p.{n} - q.{n}) <= {LIMIT.format(f'p.{n}', f'q.{n}')}" for n in ("nw", "nc"))
    can = near("p.sim", "q.sim") & F.expr(f"({sizes})")
    star = shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    p, q = (known.select(F.col("id").alias(c), F.struct("sim", "nw", "nc").alias(s)) for c, s in (("a", "p"), ("b", "q")))
    told = stored(by_words(with_words(star.join(p, "a").join(q, "b").where(can).select("a", "b"))).select("a", "b", "like"), base)
    links = told.where("like").select("a", "b")
    roots = connected_components(links)

    # the bucket's pivot is the hub of most linked lines: near to most others, whatever the order of the ids
    own = Window.partitionBy("bucket")
    fame = links.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("fame"))
    mixed = several(with_root(shared, roots)).join(fame, "id", "left")
    open_ = stored(mixed.withColumn("pivot", F.max(F.struct(F.coalesce("fame", F.lit(0)), "id")).over(own)["id"]).drop("fame", "root"), base)
    if open_.isEmpty():
        return roots
    far = stored(distances(with_words(open_.where(f"n >= {LARGE} AND id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())).select("a", "b", "like", "far"), base)
    links = stored(links.union(far.where("like").join(p, "a").join(q, "b").where(near("p.sim", "q.sim")).select("a", "b")), base)
    roots = connected_components(links)
    open_ = stored(several(with_root(open_, roots)), base)
    buckets = open_.groupBy("id").agg(F.collect_set("bucket").alias("buckets"))
    far = far.select(F.col("a").alias("pivot"), F.col("b").alias("id"), "far")
    rows = stored(open_.where("id <> hub").join(known, "id").join(buckets, "id").join(far, ["pivot", "id"], "left"), base)
    p, q = (rows.select(F.col("bucket").alias(f"bucket_{s}"), F.struct("id", "root", "sim", "nw", "nc", "far", "buckets").alias(s)) for s in ("p", "q"))
    new = F.expr("bucket_p = bucket_q AND p.id < q.id AND p.root <> q.root")
    met = p.repartition(tasks, "p.id").join(q, new & can & F.coalesce(may_be_alike("p.far", "q.far"), F.lit(True)) & F.expr("array_min(array_intersect(p.buckets, q.buckets)) = bucket_p"))
    more = stored(by_words(with_words(met.select(F.col("p.id").alias("a"), F.col("q.id").alias("b")))).select("a", "b", "like"), base)
    # letters are compared, which takes longest, where words decide nothing and no other line links the two
    links = stored(links.union(more.where("like").select("a", "b")), base)
    roots = connected_components(links)
    root = with_root(open_.select("id").distinct(), roots)
    apart = told.where("NOT like").select("a", "b").union(more.where("NOT like").select("a", "b")).distinct()
    apart = apart.join(root.toDF("a", "root_a"), "a").join(root.toDF("b", "root_b"), "b").where("root_a <> root_b")
    more = stored(alike(with_words(apart.select("a", "b"))).select("a", "b"), base)
    return roots if more.isEmpty() else connected_components(links.union(more))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_h, removed) of the documents with lines that repeat an earlier one; removed holds their numbers. Only these rows stay on disk."""
    spark = docs.sparkSession
    base = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines = stored(sampled_lines(docs), base)
    roots = line_groups(docs, lines, base)
    # lines said once and not linked need no look-up
    groups = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).join(roots.withColumnRenamed("id", "h1"), "h1", "left")
    groups = groups.where("n > 1 OR root IS NOT NULL").select("h1", "h2", F.coalesce("root", "h1").alias("root"))
    seen = stored(lines.select("doc_id", "doc_h", "line_no", "h1", "h2").join(groups, ["h1", "h2"]).drop("h1", "h2"), base)
    # of each group of linked lines, and each line said more than once, the first occurrence stays
    keep = seen.groupBy("root").agg(F.min(F.struct("doc_id", "line_no")).alias("keep"))
    gone = seen.join(keep, "root").where(~F.col("keep").eqNullSafe(F.struct("doc_id", "line_no")))
    # repeated rows bring their lines again
    found = stored(gone.groupBy("doc_id", "doc_h").agg(F.array_sort(F.collect_set("line_no")).alias("removed")), f"{shared_dir(spark)}/removed-{uuid.uuid4().hex}")
    # all else that was stored has served
    Folder(spark, base).remove()
    return found


def dedup_lines(docs: DataFrame, drop_empty: bool = False) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one; n_chars, where there is such a column, is set anew.

    ``drop_empty`` leaves out the documents that had lines with words and have none left: they only repeat others.
    """
    gone = repeated_lines(docs).select(F.col("doc_id").alias("id"), "doc_h", "removed")
    # the document is packed, so that its columns can have any names
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_h"))
    out = packed.join(gone, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_h") == F.col("doc_h")), "left")
    kept = F.array_join(F.filter(F.split("doc.text", "\n", -1), lambda x, i: ~F.array_contains("removed", i)), "\n")
    out = out.select("doc", F.col("removed").isNull().alias("whole"), F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(kept).alias("text"))
    if drop_empty:
        out = out.where(F.col("whole") | F.col("text").rlike(WORD))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("whole"), F.col("doc.n_chars") if "n_chars" in docs.columns else None).otherwise(F.length("text").cast("long"))}
    return out.select(*(new[c].alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns))


def op5_linededup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of all documents: lines with words, and the numbers of those removed, comma-joined."""
    own = docs.select("doc_id", F.xxhash64("text").alias("doc_h"), F.coalesce(F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))), F.lit(0)).alias("n"))
    own = own.withColumn("n_lines", F.greatest("n", F.lit(0))).drop("n")
    found = repeated_lines(docs.select("doc_id", "text")).withColumnRenamed("doc_id", "id_").withColumnRenamed("doc_h", "h_")
    every = own.join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("doc_h") == F.col("h_")), "left")
    return every.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce(F.array_join(F.transform("removed", lambda x: x.cast("string")), ","), F.lit("")).alias("removed"))
