"""SentencePiece encoding, alignment of tokenizers and spelling variants, against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pytest
from pyspark.sql import functions as F

from pefloom.llm import alignment, linededup, pieces, variants

ODD = [
    "", " ", "a", "  a  b ", "\n\n x", "x\n", "日本語テキスト", "ﬁ A\0b　c\n\t", "<s> </s> <0x41> <|endoftext|>", "▁a▁▁b", "😀😀 x", "a" * 500, " " * 300, "ab " * 200, "é." * 100, "1,2.3;",
    "don't!?'s 's", "http://a.b/c?d=e&f=g" * 20, "中" * 200 + "\x00\x01", "а́ ё " * 50, "a\x1c b", "a.\x1c.b", "x\t  y", "a\x85 b.  c,  d", "a b  c\n \n d", "é́ x​ y",
]


def made(seed: int, n: int, letters: str = " \n.,ab1é中😀▁'-\t\xa0\x1c ") -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(n)]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary(pieces.default_model())


def table(spark, texts: list, first: int = 0):
    """Documents with columns named like results, a repeated row and a null doc_id."""
    rows = [(first + k, t, "x", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, "null id, e.g. this", "y", 2)], "doc_id long, text string, ids string, n_a int")


def test_agenda_is_the_library(vocabulary):
    texts = ODD + made(1, 2000)
    segments = [vocabulary.cut(" " + t) if t else [] for t in texts]
    new = list(set(chain.from_iterable(segments)))
    ids, at = vocabulary.encode(new)
    store = {s: ids[at[k] : at[k + 1]].tolist() for k, s in enumerate(new)}
    assert [[*chain.from_iterable(store[s] for s in x)] for x in segments] == vocabulary.library.encode(texts)
    whole = [" " + t for t in texts if t]
    ids, at = vocabulary.encode(whole)  # texts as they are, most with a heap of their own
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(whole))] == vocabulary.library.encode([t for t in texts if t])
    assert vocabulary.encode([])[0].size == 0


def test_a_difference_is_an_error(vocabulary, monkeypatch):
    monkeypatch.setattr(vocabulary, "scores", -vocabulary.scores)
    with pytest.raises(RuntimeError, match="in different ways"):
        vocabulary.checked([" the", " unbelievably", " representation"])


def test_pieces(spark, vocabulary):
    texts = [None, *ODD, *made(2, 50), "word " * 20000]
    docs = table(spark, texts).repartition(3)
    rows = pieces.encoded(docs).collect()
    assert len(rows) == len(texts) + 2 and sum(r.doc_id == len(texts) - 1 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    want = {k: [*vocabulary.library.encode(t or ""), vocabulary.end] for k, t in enumerate(texts)}
    for r in rows:
        if r.doc_id is not None:
            assert list(r.ids) == want[r.doc_id] and r.decoded == vocabulary.library.decode(want[r.doc_id])
    got = {r.doc_id: r for r in pieces.op13_pieces(docs).collect()}
    for k, ids in want.items():
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256(vocabulary.library.decode(ids).encode()).hexdigest()
    assert pieces.encoded(docs.limit(0)).isEmpty()


def brute_groups(x: alignment.Aligner, text: str | None) -> list[tuple[list[int], list[int]]]:
    if not text:
        return []
    a, b = x.a.encode(" " + text, add_special_tokens=False).ids, x.b.library.encode(text)
    raw = [[x.bytes_a[i] for i in a], [x.bytes_b[i] for i in b]]
    if any(b"".join(r) != (" " + text).encode() for r in raw):
        return []
    ends = [np.cumsum([len(t) for t in r]).tolist() for r in raw]
    out, i, j = [], 0, 0
    for e in sorted({*ends[0]} & {*ends[1]}):
        p, q = ends[0].index(e) + 1, ends[1].index(e) + 1
        out.append((a[i:p], b[j:q]))
        i, j = p, q
    return out


def told(groups) -> str:
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def test_alignment(spark):
    x = alignment.aligner(alignment.default_tokenizer(), pieces.default_model())
    texts = [None, *ODD, *made(3, 400), *(f"the cat sat on thing {k % 7}, unbelievably" for k in range(40))]
    docs = table(spark, texts).repartition(5)  # several slices
    want = {k: brute_groups(x, t) for k, t in enumerate(texts)} | {None: brute_groups(x, "null id, e.g. this")}
    for r in alignment.alignments(docs).collect():
        assert r.groups == told(want[r.doc_id])
    links = {k: Counter((a, b) for p, q in g for a in p for b in q) for k, g in want.items()}
    count = Counter(chain.from_iterable(links.values()))
    held = Counter(p for k, c in links.items() for p in c for _ in range(1 + (k == len(texts) - 1)))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    rows = alignment.linked(docs).collect()
    assert len(rows) == len(texts) + 2 and count
    for r in rows:
        g, c = want[r.doc_id], links[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), sum(c.values()))
        assert (r.n_best, r.count_sum) == (sum(n for p, n in c.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in c.items()))
        assert r.groups_sha256 == (hashlib.sha256(told(g).encode()).hexdigest() if g else "")
    assert alignment.linked(docs.limit(0)).isEmpty()


def test_groups_of_many_equal_tokens_expand_once():
    x = alignment.aligner(alignment.default_tokenizer(), pieces.default_model())
    text = "".join(chr(0x4E00 + k % 3) for k in range(3000)) + " " * 4000 + "x"
    c = x.chunk([text])
    groups = brute_groups(x, text)
    assert c["n_links"].tolist() == [sum(len(a) * len(b) for a, b in groups)] and len(c["pairs"]) == len({(a, b) for p, q in groups for a in p for b in q})
    assert (c["cells"] & 255).sum() == c["n_links"][0] and c["docs"].tolist() == [1] * len(c["pairs"])


def brute_forms(n: dict[str, int]) -> dict[str, tuple]:
    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [v for v in n if v != w and near(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in by.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(by[w]), n[form[w]] if w in form else None) for w in n}


def forms(df) -> dict[str, tuple]:
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_match_brute_force(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(400)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaab", "baaaaaa", "x" * 60, "x" * 61, "x" * 40 + "y" + "x" * 20, "z" * 60}
    n = {w: rng.choice([5, 5, 5, 25, 25, 126, 700]) for w in words}
    got = forms(variants.grouped(spark.createDataFrame([*n.items()], "word string, n long").repartition(3)))
    assert got == brute_forms(n)
    assert variants.grouped(spark.createDataFrame([], "word string, n long")).isEmpty()


def test_words_of_documents(spark):
    texts = [None, "", "123 ,", "Spelling spelling SPELLING " * 40, "spellinx spellin Éclairage× éclairage " * 6, "q" * 20000, *("spelling wort" for _ in range(300))]
    docs = table(spark, texts)
    seen = Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(str.maketrans(variants.UPPER, variants.LOWER))
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    want = brute_forms({w: k for w, k in seen.items() if len(w) >= 6 and k >= 5})
    assert forms(variants.op12_variants(docs)) == want and want["spellinx"][:2] == ("spelling", "spelling")
    assert variants.op12_variants(docs.limit(0)).isEmpty()


def test_lines_of_words_with_equal_hashes_are_not_alike(spark):
    """Three of ten words differ, one of them from a word with the same 15, or 20, bits of hash: similarity 0.7, in words and letters."""
    words = spark.range(400_000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("xyzzy")).alias("s"))
    for bits, most in ((15, 20), (20, 20)):
        mates = words.groupBy((F.hash("s").bitwiseAND((1 << bits) - 1)).alias("h")).agg(F.collect_list("s").alias("m")).where("size(m) > 1").orderBy("h").limit(most).collect()
        rows = []
        for k, r in enumerate(mates):
            a, b = sorted(r.m)[:2]
            common = [f"common{k}{c}" for c in "abcdefg"]
            rows.append(([a, *common, "somethingelse", "altogether"], [b, *common, "quitedifferent", "unrelated"]))
        pairs = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(rows)], "a long, x array<string>, y array<string>")
        assert len(rows) == most and linededup.alike(pairs).isEmpty()
        near = spark.createDataFrame([(k, x, [y[0], *x[1:]]) for k, (x, y) in enumerate(rows)], "a long, x array<string>, y array<string>")
        assert linededup.alike(near).count() == most
        told = linededup.distances(pairs).select("far").collect()
        assert all(r.far.wlo == r.far.whi == 3 for r in told)
