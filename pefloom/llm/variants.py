"""Groups of spelling variants: words that differ by one inserted, deleted or replaced code point, by a dictionary of trie-node pairs.

Words are maximal runs of Latin letters (``RUN``), A-Z lower-cased; those of at least ``LEAST_LETTERS`` code points and ``LEAST_TIMES``
occurrences are compared. Each word's beginnings are nodes of a trie and its ends are nodes of the trie of the reversed words; both
tries' nodes are numbered by one pass over the distinct beginnings and ends. A word that skips place i is the pair (node of what stands
before i, node of what stands behind it); a word with a gap at place i is the pair of the nodes of both sides. Words with the same
skipping pair differ in one letter there; a word with a gap and one that skips with the same pair differ by that letter. Of equal
letters in a row only the first is skipped for this, so that a deletion is met once. As both numbers of a pair fix all but one letter,
a pair has at most one word a letter, and one with a gap: its members are gathered, whatever the corpus holds, and no pairs of words are
made, but each member's number of neighbours and the best of them (largest count, then first in code-point order).

A word's form is its best neighbour if that occurs at least ``TIMES`` times as often, its root what the forms lead to; counts rise along
the way, so it ends. Beginnings and ends of more than ``PLAIN`` code points stand in the dictionary as their BLAKE2b digests, so a long
word costs rows of bounded size.

The typing errors of ``op12_variants`` are planted by a checksum of doc_id and run. Null texts have no words, a null doc_id counts as an
empty string. Repeated rows count as often as they stand there. Texts and words of any length are taken whole. No words give an empty
table. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pefloom.llm.common import cut

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_TIMES, TIMES = 6, 5, 5
#: Beginnings and ends of so many code points stand as they are, longer ones as digests.
PLAIN = 32
#: Every so manyth run, by its checksum, loses a code point.
ERRORS = 199


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run) of every run of letters, lower-cased."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))


def with_errors(found: DataFrame) -> DataFrame:
    """(word): the runs, of which those with a checksum that ``ERRORS`` divides lose a code point."""
    h = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    told = found.select("run", h.alias("h"))
    return told.select(F.expr(f"IF(h % {ERRORS} = 0, concat(left(run, int(h % length(run))), substr(run, int(h % length(run)) + 2)), run)").alias("word"))


def counted(words: DataFrame, letters: int = LEAST_LETTERS, times: int = LEAST_TIMES) -> DataFrame:
    """(word, n) of the words of enough letters and occurrences."""
    return words.where(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def _sides(word: str) -> tuple[list[str], list[str]]:
    """The keys of the word's beginnings and ends by their lengths, 0 to all."""

    def keys(letters: str, step: int) -> list[str]:
        h, out = hashlib.blake2b(digest_size=32), []
        for k in range(len(letters) + 1):
            out.append(letters[:k][::step] if k <= PLAIN else "#" + h.hexdigest())
            if k < len(letters):
                h.update(letters[k].encode("utf-32-le"))
        return out

    return keys(word, 1), keys(word[::-1], -1)


def pairs_of(words: DataFrame) -> DataFrame:
    """(word, n, letter, before, after): a row for each place that a word skips, with its letter, and for each gap, without; ``first``
    tells whether the letter isn't that of the place before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                rows: dict[str, list] = {c: [] for c in ("word", "n", "letter", "first", "before", "after")}
                for w, n in zip(b.column(0).slice(lo, 1000).to_pylist(), b.column(1).slice(lo, 1000).to_pylist(), strict=True):
                    begin, end = _sides(w)
                    size = len(w)
                    rows["word"] += [w] * (2 * size + 1)
                    rows["n"] += [n] * (2 * size + 1)
                    rows["letter"] += [*w, *[None] * (size + 1)]
                    rows["first"] += [*(i == 0 or w[i] != w[i - 1] for i in range(size)), *[False] * (size + 1)]
                    rows["before"] += [*begin[:-1], *begin]
                    rows["after"] += [*end[:-1][::-1], *end[::-1]]
                yield pa.record_batch([pa.array(rows["word"]), pa.array(rows["n"], pa.int64()), pa.array(rows["letter"], pa.string()), pa.array(rows["first"]), pa.array(rows["before"]), pa.array(rows["after"])], [*rows])

    return words.select("word", "n").mapInArrow(run, "word string, n long, letter string, first boolean, before string, after string")


def numbered(keys: DataFrame, key: str, node: str) -> DataFrame:
    """(key, node) of the distinct keys: the nodes of a trie with their numbers."""
    return cut(keys.select(key).distinct().select(key, F.monotonically_increasing_id().alias(node)))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words with neighbours among ``words`` (word, n: distinct)."""
    rows = cut(pairs_of(words))
    nodes = rows.join(numbered(rows, "before", "p"), "before").join(numbered(rows, "after", "s"), "after")
    # at most one member a letter, and one with a gap
    member = F.struct("n", "word", "letter", "first")
    met = nodes.groupBy("p", "s").agg(F.collect_list(member).alias("m")).where(F.size("m") > 1)
    best = "get(array_sort(transform({}, y -> struct(-y.n AS n, y.word AS word))), 0)"
    other = "filter(m, y -> y.word <> x.word AND (y.letter IS NULL AND x.first OR x.letter IS NULL AND y.first OR y.letter IS NOT NULL AND x.letter IS NOT NULL))"
    own = met.select(F.explode(F.expr(f"filter(transform(m, x -> struct(x.word AS word, size({other}) AS n_near, {best.format(other)} AS best)), x -> x.n_near > 0)")).alias("x"))
    return own.groupBy("x.word").agg(F.sum("x.n_near").alias("n_near"), F.min("x.best").alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form (word, form): what the forms lead to, in as many steps as the length of the way has binary digits."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def grouped(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n: distinct)."""
    words = cut(words)
    near = cut(words.join(neighbours(words), "word", "left"))
    has = (F.col("best_n") >= times * F.col("n")) & F.col("best").isNotNull()
    told = near.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n"))
    led = roots(told.where("form IS NOT NULL"))
    return told.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(docs: DataFrame) -> DataFrame:
    """``grouped`` over the words of all documents, with the planted errors."""
    return grouped(counted(with_errors(runs(docs))))
