"""The operators against brute force on small fixtures, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pefloom.llm import chat, common, decontaminate, learn, linededup, mix, neardup, pii, quality, tokens, toxicity, urlfilter, vectorjoin
from pefloom.llm.queries import QUERIES
from pefloom.llm.template import Template, TemplateError, unescape

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def docs_of(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", None if sources is None else sources[i], None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def prose(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


EDGES = [None, "", "   \n\n", "one", "One", "!!!", "x" * 5000, "é ü ß 中文 words", "a b c d e f g " * 3000]


# Shared parts.


def test_words_match_the_pattern():
    import pyarrow as pa

    r = random.Random(1)
    texts = EDGES + ["".join(r.choice("aB9 .é\n-_") for _ in range(r.randrange(60))) for _ in range(300)]
    for first, end, data, offs in tokens.slices(pa.array(texts, pa.string()), 700):
        h, start, stop, woffs = tokens.words(data, offs)
        raw = data.tobytes()
        for k in range(end - first):
            own = [raw[a:b].decode() for a, b in zip(start[woffs[k] : woffs[k + 1]], stop[woffs[k] : woffs[k + 1]], strict=True)]
            assert [low(w) for w in own] == WORD.findall(low(texts[first + k] or ""))
        names = defaultdict(set)
        for x, a, b in zip(h.tolist(), start, stop, strict=True):
            names[x].add(low(raw[a:b].decode()))
        assert all(len(v) == 1 for v in names.values())


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000), (6000, None)]
    got = {x.id: x.root for x in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e if v is not None}
    for _ in root:
        for a, b in edges:
            if b is not None:
                root[a] = root[b] = min(root[a], root[b])
    linked = {v for a, b in edges if b is not None and a != b for v in (a, b)}
    assert got == {v: root[v] for v in linked}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1: chat formatting.


def test_template_language():
    t = Template("{% set who = 'A' + 'I' %}{# no #}{% for m in messages %}{{ loop.index }}{% if loop.last %}.{% elif m.role == 'user' and not m.x %}u{% else %}{{ who }}{% endif %}{% generation %}{{ m['text'] | escape }}{% endgeneration %}{% endfor %}", ["<e>"])
    text, spans = t.render([{"role": "user", "text": "a<e>\\"}, {"role": "bot", "text": ""}, {"role": "bot", "text": "z"}])
    assert text == "1ua\\<e>\\\\2AI3.z" and [unescape(text[a:z]) for a, z in spans] == ["a<e>\\", "z"]
    folded = Template("{% if 1 == 2 %}x{% elif true %}y{{ 'a' | upper }}{% else %}{{ q }}{% endif %}")
    assert folded.tree == [("text", "yA")]
    assert Template("{{ m.__class__ }}{{ m.real }}").render([], m=3)[0] == ""
    for bad in ("{% for %}", "{{ 1 + }}", "{% if x %}", "{{ x | exec }}", "{% import os %}", "{{ (x }}"):
        with pytest.raises(TemplateError):
            Template(bad)


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 64)
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a:b", None]), r.choice([None, "", "plain", "### x", "</turn>\n", "\\", "\\</turn>", "ends <", "é\n### user: x</turn>\n"])) for c in (1, 2, None) for t in range(60)]
    rows += [(1, 3, "user", "tie"), (1, 3, "user", "tie"), (9, None, "assistant", "x")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, part string")
    want = {}
    for conv in {x[0] for x in rows} | {-7}:
        own = sorted(((t is not None, t or 0, p or "", x or "") for c, t, p, x in rows if c == conv)) if conv != -7 else [(1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "\\### Assistant: </turn> ok")]
        loss = "".join(x for *_, p, x in own if p == "assistant")
        want[conv] = (len(own), hashlib.sha256("".join(f"{p}\n{x}\n" for *_, p, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in chat.op1_chat(df).collect()}
    assert got == want
    assert chat.format_conversations(df.where("false")).count() == 0
    assert chat.op1_chat(df.where("false")).count() == 1


# 2: personal data.


def test_base_spans_match_the_patterns():
    patterns = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    tests = (lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 8 <= len(digits(s)) <= 15)
    r = random.Random(3)
    for _ in range(20000):
        text = "".join(r.choice("ab1239.+-@ ()_%ä") for _ in range(r.randrange(50)))
        assert pii.base_spans(text) == [(k, *m.span()) for k, (p, ok) in enumerate(zip(patterns, tests, strict=True)) for m in p.finditer(text) if ok(m[0])]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans("1" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_columns_with_the_names_of_results(spark):
    df = docs_of(spark, ["mail a.b@example.com", None]).withColumns({"base_": F.lit("x"), "spans_": F.lit(1), "counts_": F.lit(2.0)})
    rows = {x.doc_id: x for x in pii.tag(df).collect()}
    assert (rows[0].base_, list(rows[0].counts_), rows[1].base_) == ("email:5:20", [1, 0, 0, 0], "")
    pages = spark.createDataFrame([(0, "http://a.net/x", "own", "other"), (1, None, None, None)], "page_id long, url string, tokens_ string, tokens0 string")
    rows = {x.page_id: x for x in urlfilter.judge(pages).collect()}
    assert (rows[0].tokens_, rows[0].tokens0, rows[0].rule, rows[1].host) == ("own", "other", "net/", "")


def test_training_rows_are_bounded_with_repeated_ids(spark):
    ids = [i for i in range(40) if not held(i)][:12]
    docs = spark.createDataFrame([(i, t) for i in ids for t in ("b", "a", None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int")
    assert [tuple(x) for x in learn.training_rows(docs, labels, "toxic", 5).collect()] == [("a", 1)] * 5


def test_skip_edges_carry_labels(spark):
    r = random.Random(6)
    texts = [f"call +1 (555) 123-{1000 + i} now {prose(r, 5)}" for i in range(40)] + [f"pay 4111111111111111 or {r.randrange(3000)} in 2024 {prose(r, 5)}x 4111111111111111 thanks" for _ in range(40)]
    texts += ["mail joe.doe@x.example.com (or joe.doe@x.example.com) " + prose(r, 30)] * 20 + ["card 7536784127813050 4845168114407329 then " + prose(r, 40) + "x 4845168114407329 and 2024"] * 2 + EDGES
    out = pii.op2_pii(docs_of(spark, texts).withColumn("spans_", F.lit(1))).toPandas().sort_values("doc_id")
    assert len(out) == len(texts)
    for text, row in zip(texts, out.itertuples(), strict=True):
        base = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.base_spans(text or "")]
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(filter(None, row.spans.split(",")))
        if not base:
            assert row.spans == ""
    found = [texts[100][int(x.split(":")[1]) : int(x.split(":")[2])] for x in out.iloc[100].spans.split(",") if x]
    assert found.count("4845168114407329") == 2 and "2024" not in found
    assert pii.op2_pii(docs_of(spark, [])).count() == 0


def test_field_decides_without_base_spans(spark):
    r = random.Random(61)
    texts = [f"mail {'joe' * (1 + i % 9)}@example.com about {r.randrange(100)} things {prose(r, 3)}" for i in range(60)] + ["write to info@exämple.de soon", "see 12 things"]
    out = pii.op2_pii(docs_of(spark, texts)).toPandas().sort_values("doc_id")
    assert pii.base_spans(texts[60]) == [] and out.iloc[60].spans == "email:9:24" and out.iloc[61].spans == ""


def test_messages_reach_the_whole_chain():
    field = pii.Field({"node": {}, "chain": {}, "skip": {(k, k): 1000 for k in range(5)}})
    skip = np.array([(k, k + 1) for k in range(49)])
    p = field.beliefs(np.zeros(50, np.int64), np.array([3] + [0] * 49), np.zeros((0, 2), np.int64), skip)
    # on a chain the products of the potentials are exact
    step = np.exp(field.skip)
    want = np.eye(5)[3]
    for k in range(50):
        assert p[k] == pytest.approx(want / want.sum(), abs=0.02)
        want = want @ step
    assert p[49].argmax() == 3 and p[49, 3] > 0.25


def personal(r, k):
    """A made-up value of each kind by turns."""
    card = "".join(str(r.randrange(10)) for _ in range(15))
    card += next(d for d in "0123456789" if pii.luhn(card + d))
    return [f"u{r.randrange(900)}.{r.choice('abc')}@host{r.randrange(90)}.com", ".".join(str(r.randrange(256)) for _ in range(4)), card, f"+{r.randrange(1, 99)} {r.randrange(100, 999)} {r.randrange(100, 999)}-{r.randrange(1000, 9999)}"][k % 4]


def test_hidden_labels_are_found_again(spark):
    """Of texts that the field wasn't fitted on, a share of the base labels is hidden."""
    r = random.Random(31)
    texts = [" ".join(x for k in range(r.randrange(1, 9)) for x in (prose(r, 6), r.choice([personal(r, k), str(r.randrange(5000)), f"{r.randrange(30)}.{r.randrange(9)}", f"x{r.randrange(99)}"]))) for _ in range(500)]
    field = pii.Field(pii.statistics(docs_of(spark, texts[:300])))
    right = sure = hidden = 0
    for text in texts[300:]:
        g = pii.Graph()
        g.add(0, text, pii.base_spans(text))
        shapes, labels, chain, skip = g.arrays()
        if not len(shapes):
            continue
        away = np.array([r.random() < 0.3 for _ in labels])
        p = field.beliefs(shapes, np.where(away, 0, labels), chain, skip)
        told = np.where(p[:, 1:].max(1) >= pii.SURE, p[:, 1:].argmax(1) + 1, 0)
        free = away | (labels == 0)
        hidden += (labels[free] > 0).sum()
        sure += (told[free] > 0).sum()
        right += ((told[free] == labels[free]) & (told[free] > 0)).sum()
    assert hidden > 60 and right >= 0.8 * hidden and right >= 0.9 * sure


def test_pieces_of_a_number_are_one_span():
    text = "call +1 (826) 555 4081, 4111 1111 1111 1111 4111 a@b.c d@e.f"
    at = [m.span() for m in re.finditer(r"[^ ,]+", text)][1:]
    kinds = [3, 3, 3, 3, 2, 2, 2, 2, 2, 0, 0]
    got = pii.joined(text, [(k, *x) for k, x in zip(kinds, at, strict=True)])
    assert [text[s:e] for _, s, e in got] == ["+1 (826) 555 4081", "4111 1111 1111 1111", "4111", "a@b.c", "d@e.f"]
    assert pii.joined("1" * 10 + " and " + "1" * 9, [(3, 0, 10), (3, 15, 24)]) == [(3, 0, 10), (3, 15, 24)]


def test_every_span_labels_its_tokens():
    g = pii.Graph()
    g.add(0, "aaaaaaaaa 1234567", [(0, 0, 2), (0, 2, 4), (0, 4, 6), (1, 6, 8), (2, 8, 9), (3, 12, 17)])
    assert g.label == [4]
    g = pii.Graph()
    g.add(0, "1,2,3,4,5,6,7", [(0, k, k + 1) for k in range(6)] + [(2, 8, 13)])
    assert g.label == [1]


def test_loops_come_near_to_enumeration():
    """Marginals of small graphs with loops, by all labellings."""
    r = np.random.default_rng(4)
    for _ in range(5):
        field = pii.Field({"node": {}, "chain": {}, "skip": {}})
        field.node, field.chain, field.skip = r.normal(size=(pii.BITS, 5)), r.normal(size=(5, 5)) * 0.4, np.eye(5)
        shapes, labels = r.integers(1 << 6, size=6), np.array([0, 3, 0, 0, 0, 0])
        chain, skip = np.array([(k, k + 1) for k in range(5)]), np.array([(0, 3), (1, 4), (2, 5)])
        unary = (shapes[:, None] >> np.arange(pii.BITS) & 1) @ field.node
        want = np.zeros((6, 5))
        for y in itertools.product(range(5), repeat=6):
            if y[1] == 3:
                w = math.exp(sum(unary[k, v] for k, v in enumerate(y)) + sum(field.chain[y[a], y[b]] for a, b in chain) + sum(field.skip[y[a], y[b]] for a, b in skip))
                for k, v in enumerate(y):
                    want[k, v] += w
        want /= want.sum(1, keepdims=True)
        assert np.abs(field.beliefs(shapes, labels, chain, skip) - want).max() < 0.1


# 3: mixing.


def water(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        rate = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * rate >= most * sizes[s]}
        if not full:
            return out | {s: w[s] * rate for s in free}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(spark, seed):
    r = random.Random(seed)
    names = ["a", "b", "Ä", "z", None, "empty"]
    sources = [r.choices(names[:5], [60, 5, 20, 10, 5])[0] for _ in range(400)]
    texts = [None if r.random() < 0.03 else prose(r, r.choice([0, 1, 3, 50, 900])) for _ in sources] + [""]
    df = docs_of(spark, texts, [*sources, "empty"])
    df = df.union(df.where("doc_id < 5")).withColumn("target", F.lit("clash"))
    runs = [sorted(map(tuple, mix.op3_mix(d).collect()), key=str) for d in (df, df.repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == 406
    src = dict(enumerate([*sources, "empty"]))
    sizes, taken, targets = Counter(), Counter(), {}
    for i, size, source_size, target, got in runs[0]:
        assert size == len((texts[i] or "").split()) and got <= 2 * size
        sizes[src[i]] += size
        taken[src[i]] += got
        targets[src[i]] = (source_size, target)
    want = water({s: n for s, n in sizes.items()})
    for s, (source_size, target) in targets.items():
        assert source_size == sizes[s] and target == pytest.approx(want[s]) and abs(taken[s] - target) <= 1
    assert mix.op3_mix(df.where("false")).count() == 0


def test_slots(spark):
    goals = spark.createDataFrame([("a", 1000, 1500.0), ("b", 130, 260.0), ("c", 50, 7.0)], "source string, source_size long, target double")
    rows = mix.slots(goals, block=16, shard=8).toPandas()
    assert rows.groupby("source").words.sum().to_dict() == {"a": 1500, "b": 260, "c": 7}
    assert not rows.duplicated(["source", "pass", "index"]).any() and rows.groupby("shard").size().max() <= 8


# 4 and 6: classifiers.


def labelled(spark, good, bad, n=400):
    r = random.Random(9)
    texts = [(bad if i % 4 == 0 else good)(r) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(n)] + [(1, None, None), (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    return docs_of(spark, texts + EDGES), labels, n


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity(spark):
    df, labels, n = labelled(spark, lambda r: prose(r, 60), lambda r: prose(r, 30) + f" {r.choice(['vile scum', 'stupid fool', 'awful clown'])} " + prose(r, 30))
    out = toxicity.op6_toxicity(df, labels).toPandas()
    assert len(out) == n + len(EDGES) and (out.held_out == out.doc_id.map(held)).all() and out.score.between(0, 1).all()
    own = out[(out.doc_id < n) & out.held_out]
    assert (own.predicted == (own.doc_id % 4 == 0)).mean() > 0.95
    again = toxicity.op6_toxicity(df.repartition(5).withColumn("score", F.lit("clash")), labels.repartition(3)).toPandas()
    assert np.array_equal(out.sort_values("doc_id").score.to_numpy(), again.sort_values("doc_id").score.to_numpy())
    assert (toxicity.op6_toxicity(df, labels.where("false")).toPandas().predicted == 0).all()
    assert toxicity.op6_toxicity(df.where("false"), labels).count() == 0


def test_quality(spark):
    df, labels, n = labelled(spark, lambda r: ". ".join(prose(r, 12).capitalize() for _ in range(9)), lambda r: prose(r, 20) + " BUY!! NOW!! " * 60)
    out = quality.op4_quality(df, labels).toPandas()
    assert len(out) == n + len(EDGES) and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    own = out[(out.doc_id < n) & out.held_out]
    assert (own.predicted == (own.doc_id % 4 != 0)).mean() > 0.95
    assert (quality.op4_quality(df, labels.where("false")).toPandas().score == 0.5).all()
    assert quality.op4_quality(df.where("false"), labels).count() == 0


def test_attention_gradients():
    r = np.random.default_rng(1)
    m, x, poffs, y = quality.Attention(5, 4), r.normal(size=(9, quality.SIZE)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(s := m.forward(x, poffs)[0]) + (1 - y) * np.log(1 - s))
    for k, g in m.gradients(x, poffs, y).items():
        at = tuple(r.integers(n) for n in m.p[k].shape)
        m.p[k][at] += 1e-6
        up = loss()
        m.p[k][at] -= 2e-6
        down = loss()
        m.p[k][at] += 1e-6
        assert g[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


# 5: lines.


def within(a, b, most):
    """Whether the Levenshtein distance is ``most`` or less, by the cells at most so far from the diagonal."""
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        new[0] = min(i, far)
        left = new[lo - 1]
        for j in range(lo, hi + 1):
            left = new[j] = min(row[j] + 1, left + 1, row[j - 1] + (x != b[j - 1]))
        if min(new[max(0, lo - 1) : hi + 1], default=far) > most:
            return False
        row = new
    return row[-1] <= most


def close(a, b):
    """Whether the edit similarity is 0.8 or more; what one has beyond the other, in any order, is a lower bound of the distance."""
    bound = math.floor(0.2 * max(len(a), len(b)) + 1e-9)
    twos = lambda x: Counter(zip(x, x[1:], strict=False))
    if max((Counter(a) - Counter(b)).total(), (Counter(b) - Counter(a)).total()) > bound or (twos(a) - twos(b)).total() > 2 * bound:
        return False
    return within(a, b, bound)


def test_line_dedup(spark):
    r = random.Random(5)
    base = [prose(r, 30) for _ in range(25)]

    def vary(line):
        words = line.split()
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            words[r.randrange(len(words))] = r.choice(["zz", "qq", "yy"])
        return (" ".join(words) + r.choice(["", ".", "!"])).replace("w1", r.choice(["w1", "W1"]), 1)

    texts = ["\n".join(vary(r.choice(base)) if r.random() < 0.7 else prose(r, r.choice([1, 8, 60])) for _ in range(r.randrange(1, 8))) for _ in range(120)] + EDGES + [base[0]]
    df = docs_of(spark, texts)
    df = df.union(df.where("doc_id = 3")).withColumn("removed_", F.lit("clash"))
    lines = {(x.doc_id, x.line_no): x for x in linededup.hashed_lines(df).collect()}
    words = {(i, k): re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", line.lower()) for i, t in enumerate(texts) for k, line in enumerate((t or "").split("\n"))}
    assert set(lines) == {k for k, w in words.items() if w}
    place = sorted(lines)
    root = {k: k for k in place}
    kinds = {}
    for k in place:
        kinds.setdefault((lines[k].h1, lines[k].h2), []).append(k)
    reps = [v[0] for v in kinds.values()]
    pairs = [(v[0], x) for v in kinds.values() for x in v[1:]]
    for i, a in enumerate(reps):
        for b in reps[i + 1 :]:
            if ((lines[a].sim ^ lines[b].sim) & (1 << 64) - 1).bit_count() <= linededup.BITS_APART:
                x, y = " ".join(words[a]), " ".join(words[b])
                p, q = set(words[a]), set(words[b])
                if 3 * len(p & q) >= len(p | q) and (close(words[a], words[b]) or close(x, y)):
                    pairs.append((a, b))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    gone = {k for k in place if root[k] != k}
    got = linededup.op5_linededup(df).collect()
    assert len(got) == len(texts) + 1
    assert {(x.doc_id, int(k)) for x in got for k in filter(None, x.removed.split(","))} == gone and len(gone) > 100
    rows = linededup.dedup_lines(df).collect()
    assert rows[0].__fields__ == df.columns
    for x in rows:
        want = None if texts[x.doc_id] is None else "\n".join(line for k, line in enumerate(texts[x.doc_id].split("\n")) if (x.doc_id, k) not in gone)
        assert x.text == want and x.n_chars == (None if want is None else len(want))
    kept = {x.doc_id for x in linededup.dedup_lines(df, drop_empty=True).collect()}
    lost = {i for i in range(len(texts)) if (own := [k for k in place if k[0] == i]) and all(k in gone for k in own)}
    assert kept == set(range(len(texts))) - lost and lost
    assert linededup.op5_linededup(df.where("false")).count() == 0 and linededup.dedup_lines(df.where("false")).count() == 0


def test_line_dedup_finds_lines_of_edit_similarity(spark):
    r = random.Random(15)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.choice([2, 3, 4, 5, 6, 7, 8, 9]))) for _ in range(5000)]
    found, total = Counter(), Counter()
    lines, pairs = [], []
    for n in (5, 8, 15, 30, 60, 120, 200):
        for share in (0, 0.05, 0.1, 0.2):
            for _ in range(40):
                x = r.sample(words, n)
                y = list(x)
                for at in r.sample([k for k in range(n) if len(x[k]) >= 4] or [0], max(1, int(share * n))) if share * n <= sum(len(w) >= 4 for w in x) else ():
                    y[at] = r.choice([w for w in words if len(w) == len(y[at])])
                a, b = " ".join(x), " ".join(y)
                # places with other letters are an upper bound of the distance
                if a != b and sum(p != q for p, q in zip(a, b, strict=True)) <= math.floor(0.2 * len(a) + 1e-9):
                    pairs.append((len(lines), n, share))
                    lines += [a, b]
    gone = {x.doc_id for x in linededup.op5_linededup(docs_of(spark, lines)).collect() if x.n_removed}
    for i, n, share in pairs:
        total[n, share] += 1
        found[n, share] += i + 1 in gone
        assert i not in gone
    assert len(pairs) > 700 and sum(found.values()) >= 0.9 * len(pairs)
    assert all(sum(found[n, s] for s in (0, 0.05, 0.1, 0.2)) >= 0.75 * sum(total[n, s] for s in (0, 0.05, 0.1, 0.2)) for n in (5, 8, 15, 30, 60, 120, 200))


def test_lines_far_from_the_centre_of_a_large_group(spark):
    # 150 near copies of one line, 40 lines too far from all of them, and two pairs of those that are similar to each other
    r = random.Random(17)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(3000)]
    base = words[:40]

    def replaced(line, n):
        line = list(line)
        for at in r.sample(range(len(line)), n):
            line[at] = r.choice(words)
        return line

    lines = [base] + [replaced(base, 2) for _ in range(150)] + [replaced(base, 15) for _ in range(40)]
    lines += [replaced(lines[-1], 1), replaced(lines[-2], 1)]
    got = linededup.op5_linededup(docs_of(spark, [" ".join(x) for x in lines])).collect()
    assert {x.doc_id for x in got if x.n_removed} == {*range(1, 151), 191, 192}
    pairs = spark.createDataFrame([(lines[0], x) for x in lines[1:]], "x array<string>, y array<string>")
    far = [x.far for x in linededup.distances(pairs).select("far").collect()]
    for x, f in zip(lines[1:], far, strict=True):
        d = sum(p != q for p, q in zip(base, x, strict=True))
        assert f.wlo <= d <= f.whi and f.clo <= 8 * d and (f.nw, f.nc) == (40, 319)
    tied = spark.createDataFrame([(a, b) for a in far[:3] for b in far[160:163]] + [(far[0], far[1])], f"p {linededup.FAR}, q {linededup.FAR}")
    assert [x.c for x in tied.select(linededup.may_be_alike("p", "q").alias("c")).collect()] == [False] * 9 + [True]


def test_lines_unlike_a_large_group_meet_few_of_it(spark):
    # 60 lines share most of their least words, and so a bucket, with all of 240 near copies, but are like none of them; two of them are alike
    r = random.Random(18)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(4000)]
    h = {x.w: x.h for x in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    base = words[:80]
    least = set(sorted(base, key=lambda w: (h[w] & (1 << 64) - 1) >> 4)[:5])

    def replaced(line, n):
        line = list(line)
        for at in r.sample([k for k, w in enumerate(line) if w not in least], n):
            line[at] = r.choice(words)
        return line

    lines = [base] + [replaced(base, 4) for _ in range(239)] + [replaced(base, 30) for _ in range(60)]
    lines.append(replaced(lines[-1], 2))
    met = []
    by_words, linededup.by_words = linededup.by_words, lambda pairs: (met.append(pairs.count()), by_words(pairs))[1]
    try:
        got = linededup.op5_linededup(docs_of(spark, [" ".join(x) for x in lines])).collect()
    finally:
        linededup.by_words = by_words
    assert {x.doc_id for x in got if x.n_removed} == {*range(1, 240), 300}
    assert sum(met) < 8 * len(lines)  # 60 * 240 pairs of unlike lines share a bucket


def test_line_dedup_shuffles_few_rows_a_line(spark):
    # lines leave the tasks that read them without an exchange, and for ten buckets each
    r = random.Random(19)
    lines = linededup.sampled_lines(docs_of(spark, ["\n".join(prose(r, 40) for _ in range(3)) for _ in range(20)]))
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    keys = lines.select(F.explode(linededup.keys_of()).alias("k")).where("k IS NOT NULL")
    assert lines.count() == 60 and keys.count() == 600
    short = linededup.sampled_lines(docs_of(spark, ["alpha", "alpha beta", "alpha beta gamma", "alpha beta gamma delta"]))
    assert [x.n for x in short.orderBy("doc_id").select(F.size(F.array_compact(linededup.keys_of())).alias("n")).collect()] == [1, 3, 4, 4]


def test_lines_that_share_frequent_words_do_not_meet(spark):
    # unrelated lines of 30 frequent words of four letters and 15 long words of their own share no three samples
    r = random.Random(20)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    often = [word(4) for _ in range(60)]
    lines = linededup.sampled_lines(docs_of(spark, [" ".join(r.sample(often, 30) + [word(9) for _ in range(15)]) for _ in range(300)]))
    buckets = lines.select("doc_id", F.explode(linededup.keys_of()).alias("k")).where("k IS NOT NULL").groupBy("k").count().where("count > 1")
    assert buckets.count() < 30


def test_line_dedup_leaves_only_its_result_on_disk(spark):
    r = random.Random(21)
    lines = [prose(r, 40) for _ in range(30)]
    base = Path(common.shared_dir(spark).removeprefix("file:"))
    before = {x.name for x in base.iterdir()}
    found = linededup.repeated_lines(docs_of(spark, lines + [x + " zz" for x in lines]))
    assert found.count() == 30
    assert {x.split("-")[0] for x in {x.name for x in base.iterdir()} - before if x.startswith(("lines-", "removed-"))} == {"removed"}


def test_lanes_hold_long_lines(spark):
    r = random.Random(16)
    texts = [prose(r, n) for n in (3, 511, 512, 513, 2000)] + ["alpha beta " * 550_000 + "alpha"]
    df = docs_of(spark, texts)
    hashes = {x.w: x.h for x in spark.createDataFrame([(w,) for w in {w for t in texts for w in t.split()}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    got = {x.doc_id: x.sim & (1 << 64) - 1 for x in linededup.hashed_lines(df).collect()}
    votes = lambda w: 4 if len(w) >= 4 else 1
    for i, t in enumerate(texts):
        n = Counter(t.split())
        want = sum(1 << k for k in range(64) if 2 * sum(c * votes(w) for w, c in n.items() if hashes[w] >> k & 1) > sum(c * votes(w) for w, c in n.items()))
        assert got[i] == want


# 7: URLs.


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.NET/en/1", "http://net", "http://net/", "http://a.net?x=/", "http://xnet/", "https://b.example.net/de/", "http://m.Example.com/de/x#y", "http://example.com/den", "http://q.org/fr/?a=b", "x://y://net/", "http://notexample.net/en/"]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls * 3)], "page_id long, url string, rule string, tokens string")
    got = urlfilter.op7_urlfilter(df).collect()
    assert len(got) == len(urls) * 3
    for x in got:
        u = urls[x.page_id % len(urls)] or ""
        rest = u.partition("://")[2] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path, host = re.match(r"[^?#]*", rest[len(host) :])[0], low(host)
        fits = [r for r in urlfilter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule = max(fits, key=len, default=None)
        assert (x.host, x.path, x.rule) == (host, path, rule) and x.verdict in ("allow", "block")
        if rule:
            assert x.verdict == urlfilter.RULES[rule]
    assert urlfilter.op7_urlfilter(df.where("false")).count() == 0


def test_every_part_of_a_url_counts(spark):
    deep = ["http://{}/en/2024/casino/{}", "http://{}/en/2024/news/{}"]
    args = ["http://{}/x?a=1&b=2&c=3&bet={}", "http://{}/x?a=1&b=2&c=3&page={}"]
    fourth = ["http://ads.w.q.{}/y/{}", "http://shop.w.q.{}/y/{}"]
    urls = [u[k].format(("bad.net", "good.fr")[k], i) for u in (deep, args, fourth) for k in (0, 1) for i in range(30)]
    urls += ["http://other.io/de/a/b/casino/z", "http://other.io/v?a=1&b=2&c=3&d=4&bet=5", "http://ads.w.q.other.io/", "http://other.io/de/a/b/news/z"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: x.verdict for x in urlfilter.judge(df, {"bad.net/": "block", "good.fr/": "allow"}, default="none").collect()}
    assert [got[k] for k in range(180, 184)] == ["block", "block", "block", "allow"]


def test_mined_rules_match_brute_force(spark):
    r = random.Random(7)
    rows = [(sorted(r.sample("abcdef", r.randint(1, 4))), None) for _ in range(200)]
    rows = [(t, "block" if "a" in t and "b" in t or (t == ["c"]) else "allow") for t, _ in rows]
    got = urlfilter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.9)
    assert got
    for need, verdict, confidence, support in got:
        own = [v for t, v in rows if need <= set(t)]
        assert confidence == pytest.approx(own.count(verdict) / len(own)) and confidence >= 0.9 and support == pytest.approx(own.count(verdict) / len(rows))
    assert (frozenset("ab"), "block") in {(n, v) for n, v, *_ in got}


def test_mined_verdicts_are_those_of_all_rules(spark):
    """Against all rules by brute force: tokens b and c stand on the same pages, d and e nearly, p is of one verdict alone."""
    r = random.Random(11)
    rows = []
    for i in range(300):
        t = {x for x in "adgf" if r.random() < 0.5} | ({"b", "c"} if r.random() < 0.4 else set())
        t |= {"e"} if "d" in t and r.random() < 0.9 else set()
        bad = "a" in t and "b" in t or r.random() < 0.1
        rows.append((sorted(t | ({"p"} if not bad and r.random() < 0.5 else set())), "block" if bad else "allow", f"h{r.randint(0, 5)}" if "g" in t else "h0"))
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string, host string")
    names, base = sorted({t for x in rows for t in x[0]}), {v: sum(x[1] == v for x in rows) for v in ("allow", "block")}
    for hosts in (1, 3):
        rules, alike = urlfilter.mine_alike(df, 0.05, 0.8, 1.1, hosts)
        index = urlfilter.Index(rules, alike)
        assert rules and alike["c"] == "b"
        every = {}
        for k in range(1, len(names) + 1):
            for need in map(frozenset, itertools.combinations(names, k)):
                own = [x for x in rows if need <= set(x[0])]
                for v, n in base.items():
                    right = sum(x[1] == v for x in own)
                    if own and right >= 0.05 * 300 and right >= 0.8 * len(own) and right / len(own) * 300 >= 1.1 * n and len({x[2] for x in own}) >= hosts:
                        every[need, v] = right / len(own)
        for n in range(len(names) + 1):
            for page in itertools.combinations(names, n):
                held = {rules[k][1]: max(rules[j][2] for j in index.holding(list(page)) if rules[j][1] == rules[k][1]) for k in index.holding(list(page))}
                want = {}
                for (need, v), c in every.items():
                    if need <= set(page):
                        want[v] = max(c, want.get(v, 0))
                assert held.keys() == want.keys() and all(held[v] == pytest.approx(want[v]) for v in held)


def test_template_of_many_segments(spark):
    """25 segments that stand together on all pages of two hosts count as one."""
    deep = "/".join(f"s{k}" for k in range(25))
    urls = [f"http://{h}/{deep}/{'casino' if h == 'bad.net' else 'news'}/{i}" for h in ("bad.net", "good.fr") for i in range(250)]
    df = spark.createDataFrame([*enumerate(urls), (500, "http://o.io/casino/1"), (501, f"http://o.io/{deep}/x")], "page_id long, url string")
    start = time.time()
    got = {x.page_id: x.verdict for x in urlfilter.judge(df, {"bad.net/": "block", "good.fr/": "allow"}, default="none").collect()}
    assert (got[500], got[501]) == ("block", "none") and time.time() - start < 60


# 8: vectors.


@pytest.mark.parametrize("block", [7, 2048])
def test_vector_join(spark, block, monkeypatch):
    monkeypatch.setattr(vectorjoin.links, "__defaults__", (vectorjoin.COSINE, block))
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 8))
    rows = [c.tolist() for c in centres[r.integers(6, size=90)] + r.normal(size=(90, 8)) * r.choice([0.0, 0.15, 0.4], size=(90, 1))]
    rows += [rows[0]] * 9 + [[3 * x for x in rows[1]]] + [None, [0.0] * 8, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0], [1.0, 2.1], []]
    df = spark.createDataFrame([(3 * i + 1, v, "clash") for i, v in enumerate(rows)] + [(None, rows[0], "x")], "vec_id long, embedding array<double>, component_id string")
    ok = [i for i, v in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    cos = lambda a, b: float(np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)))
    link = {i: [j for j in ok if i != j and len(rows[i]) == len(rows[j]) and cos(rows[i], rows[j]) >= 0.95] for i in ok}
    root = {i: i for i in range(len(rows))}
    for _ in range(len(rows)):
        for i, js in link.items():
            for j in js:
                root[i] = root[j] = min(root[i], root[j])
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vectorjoin.op8_vectorjoin(df).collect()}
    assert got.pop(None) == (0, None, False)
    assert got == {3 * i + 1: (len(link.get(i, [])), 3 * root[i] + 1, root[i] == i) for i in range(len(rows))}
    assert vectorjoin.op8_vectorjoin(df.where("false")).count() == 0


def test_vectors_are_copied_once_a_tile(spark, monkeypatch):
    """Vectors without clusters went to nearly every cell, up to 2047 copies of each in one Arrow batch; now a batch and a pair of tiles are bounded."""
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 16))
    x[1500:1520] = x[:20] + 0.01 * r.normal(size=(20, 16))
    monkeypatch.setattr(vectorjoin.links, "__defaults__", (vectorjoin.COSINE, 16))
    points = spark.createDataFrame([(i, i, 1, v.tolist()) for i, v in enumerate(x)], "key long, id long, n long, vec array<double>").repartition(1)
    rows, kept = [], type(points).mapInArrow

    def watched(self, f, schema):
        def run(batches):
            for b in f(batches):
                assert b.num_rows <= vectorjoin.DEAL
                yield b

        rows.append(out := kept(self, run, schema))
        return out

    monkeypatch.setattr(type(points), "mapInArrow", watched)
    got = {(a.id, a.root) for a in vectorjoin.links(points).collect()}
    assert got == {(i, i % 1500) for k in range(20) for i in (k, 1500 + k)}
    wanted = math.ceil(math.sqrt(6 * spark.sparkContext.defaultParallelism))
    assert rows[-1].count() <= 3000 * 2 * (wanted + 1)
    first, pieces = vectorjoin.tiles_of(np.array([3, 3, 5, 20, 1]), 8)
    assert first.tolist() == [0, 0, 1, 2, 5] and pieces.tolist() == [1, 1, 1, 3, 1]


# 9: near copies.


def test_near_dedup(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 3)
    r = random.Random(8)
    hot = prose(r, 150)

    def vary(text, n):
        words = text.split()
        for _ in range(n):
            words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
        return " ".join(words)

    texts = [vary(hot, r.randrange(9)) for _ in range(120)] + [vary(prose(r, 90), 0) for _ in range(20)] + ["five words are here now", "Five words, are here: now!", "two words", "two words"] + EDGES
    texts += [vary(t, 1) for t in texts[120:135]] + texts[130:140]
    df = docs_of(spark, texts)
    df = df.union(df.where("doc_id = 7")).withColumn("root", F.lit("clash"))
    bags = []
    for t in texts:
        w = WORD.findall(low(t or ""))
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter())
    idf = neardup.idf_table(df)
    import pyarrow as pa

    weight = {}
    for first, end, data, offs in tokens.slices(pa.array(texts, pa.string())):
        shingle, count, soffs, *_ = neardup.counted(data, offs)
        for k in range(end - first):
            own = shingle[soffs[k] : soffs[k + 1]]
            assert sorted(count[soffs[k] : soffs[k + 1]].tolist()) == sorted(bags[first + k].values())
            weight[first + k] = dict(zip(own.tolist(), (count[soffs[k] : soffs[k + 1]] * neardup.idf_of(idf, own).astype(float)).tolist(), strict=True))
    df_true = Counter(x for k, w in weight.items() for x in w for _ in range(2 if k == 7 else 1))
    for k, w in weight.items():
        own = np.array(sorted(w), np.uint64)
        want = [math.log((len(texts) + 2) / (df_true[x] + 1)) + 1 for x in own.tolist()]
        assert np.abs(neardup.idf_of(idf, own) - want).mean() < 0.05 if len(own) else True
    root = list(range(len(texts)))
    pairs = []
    for i in range(len(texts)):
        for j in range(i):
            a, b = weight[i], weight[j]
            both = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
            if both and both >= neardup.SIMILAR * (sum(a.values()) + sum(b.values()) - both):
                pairs.append((j, i))
    for _ in range(len(texts)):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    got = neardup.op9_neardup(df).collect()
    assert len(got) == len(texts) + 1 and {x.doc_id: (x.component_id, x.kept) for x in got} == {i: (root[i], root[i] == i) for i in range(len(texts))}
    kept = neardup.drop_near(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i in range(len(texts)) if root[i] == i}
    assert neardup.op9_neardup(df.where("false")).count() == 0
    # of two texts with one doc_id only the copy goes
    two = docs_of(spark, [texts[125], texts[126], texts[125]]).withColumn("doc_id", F.least("doc_id", F.lit(1)))
    assert sorted((x.doc_id, x.text) for x in neardup.drop_near(two).collect()) == sorted([(0, texts[125]), (1, texts[126])])
    nameless = spark.createDataFrame([(None, hot, None, None, None)] * 2, DOCS)
    assert [(x.component_id, x.kept) for x in neardup.op9_neardup(nameless).collect()] == [(None, True)] * 2


def test_near_copies_within_a_large_group_of_copies(spark, monkeypatch, tmp_path):
    """What many copies share weighs little, so by weights alone near copies with a few words replaced fell out of their group."""
    monkeypatch.setattr(neardup, "SMALL", 3)
    r = random.Random(5)
    hot, other = prose(r, 200), prose(r, 200)

    def vary(text, n):
        words = text.split()
        for i in r.sample(range(len(words)), n):
            words[i] = f"new{r.randrange(10**6)}"
        return " ".join(words)

    texts = [hot] * 40 + [vary(hot, k) for k in (1, 2, 3, 4) for _ in range(25)] + [vary(hot, 60) for _ in range(20)] + [prose(r, 120) for _ in range(400)] + [other, vary(other, 3)] + EDGES
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    bags = [Counter(zip(*(w[i:] for i in range(5)), strict=False)) for w in (WORD.findall(low(t or "")) for t in texts[:-len(EDGES)])]

    def alike(a, b):
        both = sum((a & b).values())
        return both >= neardup.SIMILAR * (sum(a.values()) + sum(b.values()) - both)

    assert sum(alike(bags[0], b) for b in bags[40:140]) >= 95
    got = {x.doc_id: x.component_id for x in QUERIES["op9_neardup"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    assert all(got[k] == 0 for k in range(140) if alike(bags[0], bags[k]))
    assert got[561] == got[560] == 560 and all(got[k] == k for k in range(140, 560))


def test_weighted_samples_collide_as_often_as_texts_are_similar():
    r = np.random.default_rng(3)
    shingle = r.integers(1 << 62, size=400).astype(np.uint64)
    w = r.uniform(0.5, 9, 400).astype(np.float32)
    v = w * r.choice([1.0, 0.6], 400).astype(np.float32)
    one = lambda k, x: neardup.signatures(np.roll(shingle, k), np.roll(x, k), np.array([0, 400]), neardup._draws())
    old = neardup.BANDS, neardup.ROWS
    neardup.BANDS, neardup.ROWS = 3000, 1
    try:
        hits = (one(0, w) == one(5, v)).mean()
    finally:
        neardup.BANDS, neardup.ROWS = old
    assert hits == pytest.approx(np.minimum(w, v).sum() / np.maximum(w, v).sum(), abs=0.03)


# 10: benchmarks.


@pytest.mark.parametrize("part", [decontaminate.PART_WORDS, 12])
def test_decontamination(spark, part):
    r = random.Random(11)
    items = [prose(r, n, 30) for n in (1, 2, 4, 9, 10, 11, 25, 25, 60)] + [None, "", "!!"]
    names = [10, 9, 8, 7, 6, 5, 4, 3, 2, 1, 0, 11]
    bench = spark.createDataFrame([*zip(names, items, strict=True), (10, items[0]), (None, prose(r, 12, 30))], "item_id long, text string")
    texts = [prose(r, r.randrange(80), 30) for _ in range(150)] + EDGES
    for k in range(60):
        words, own = texts[k].split(), r.choice([x for x in items if x]).split()
        at, a = r.randrange(len(words) + 1), r.randrange(len(own))
        texts[k] = " ".join(words[:at] + own[a : a + r.choice([9, 10, 30])] + words[at:]).replace("w2 ", "W2, ")
    df = docs_of(spark, texts).withColumn("hit", F.lit("clash"))
    wins = defaultdict(set)
    for x in bench.collect():
        w = WORD.findall(low(x.text or ""))
        n = min(len(w), 10)
        for i in range(len(w) - n + 1) if w else ():
            wins[tuple(w[i : i + n])].add("" if x.item_id is None else str(x.item_id))
    want = {}
    spans = {}
    for i, t in enumerate(texts):
        w = WORD.findall(low(t or ""))
        hit, named = set(), set()
        for a in range(len(w)):
            for n in range(1, 11):
                if a + n <= len(w) and (ks := wins.get(tuple(w[a : a + n]))):
                    hit |= set(range(a, a + n))
                    named |= ks
        spans[i] = hit
        want[i] = (len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit))
    found = decontaminate.find_hits(df.select("doc_id", "text"), bench, part_words=part)
    got = {x.doc_id: (x.n_words_, sum(z - a for a, z in zip(x.hit_spans_[::2], x.hit_spans_[1::2], strict=True)), len(x.hit_items_), hashlib.sha256(",".join(x.hit_items_).encode()).hexdigest(), bool(x.hit_spans_)) for x in found.collect()}
    assert got == want and sum(x[4] for x in want.values()) > 50
    if part > 12:
        assert {x.doc_id: tuple(x)[1:] for x in decontaminate.op10_decontaminate(df, bench).collect()} == want
        kept = {x.doc_id: x for x in decontaminate.remove_hits(df, bench).collect()}
        for i, t in enumerate(texts):
            w = WORD.findall(low(t or ""))
            assert (i in kept) == (len(spans[i]) <= 0.8 * len(w))
            if i in kept:
                assert WORD.findall(low(kept[i].text or "")) == [x for k, x in enumerate(w) if k not in spans[i]] and (spans[i] or kept[i].text == t)
                assert kept[i].text is None or kept[i].n_chars == len(kept[i].text)
        assert decontaminate.op10_decontaminate(df.where("false"), bench).count() == 0
        assert not any(x.contaminated for x in decontaminate.op10_decontaminate(df, bench.where("false")).collect())


def test_benchmark_beyond_what_a_task_holds(spark):
    """Groups of parts find what one group finds, whatever the names of columns, for repeated rows and for items in several groups."""
    r = random.Random(5)
    items = [prose(r, r.choice([3, 9, 10, 25, 60]), 40) for _ in range(40)]
    bench = spark.createDataFrame([(k % 30, t) for k, t in enumerate(items)] + [(None, items[0]), (99, None)], "item_id long, text string")
    texts = [" ".join([prose(r, 30, 40), *r.sample(items, 3), prose(r, 20, 40)]) for _ in range(40)] + [prose(r, 60, 40) for _ in range(20)] + EDGES
    df = docs_of(spark, texts + texts[:9]).withColumns({"h1": F.lit("a"), "spans0": F.lit("b"), "Items0": F.lit("c"), "doc": F.lit("d"), "found": F.lit("e")})
    assert len(decontaminate._held(df, bench, part_words=50, held_words=100)) > 3
    rows = lambda d: sorted(d.collect(), key=lambda x: x.doc_id)
    for f in (decontaminate.find_hits, decontaminate.remove_hits):
        one, many = f(df, bench), f(df, bench, part_words=50, held_words=100)
        assert one.columns == many.columns and rows(one) == rows(many)
    assert decontaminate.find_hits(df.where("false"), bench, part_words=50, held_words=100).count() == 0


def test_document_frequencies_in_crowded_buckets(spark):
    """Common shingles are told from rare ones where each bucket holds many shingles."""
    r = random.Random(21)
    common_ = prose(r, 12)
    texts = [" ".join(f"u{r.randrange(10**9)}" for _ in range(60)) + (" " + common_ if k % 2 else "") for k in range(600)]
    idf = neardup.idf_table(docs_of(spark, texts), bits=10)
    import pyarrow as pa

    data, offs = tokens.buffer(pa.array([common_, texts[0]], pa.string()))
    shingle, _, soffs, *_ = neardup.counted(data, offs)
    told = neardup.idf_of(idf, shingle)
    assert told[: soffs[1]] == pytest.approx(math.log(601 / 301) + 1, abs=0.15)
    assert np.median(told[soffs[1] :]) > math.log(601 / 31) + 1


def test_origin_undoes_the_permutation(spark):
    rows = [(n, i) for n in (1, 2, 7, 128, 1000003) for i in range(min(n, 7))] + [(2**33 + 5, 2**33 + 4), (2**61 - 3, 12345678901)]
    df = spark.createDataFrame(rows, "n long, i long").withColumn("j", mix.origin(F.col("i"), F.col("n"), F.lit(3), F.lit("s")))
    df = df.withColumn("back", mix.permuted(F.col("j"), F.col("n"), F.lit(3), F.lit("s")))
    assert all(x.back == x.i and 0 <= x.j < x.n for x in df.collect())
