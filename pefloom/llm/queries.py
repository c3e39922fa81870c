"""The queries opN_<name> of this subpackage over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pefloom.llm import alignment, chat, decontaminate, linededup, mix, neardup, pieces, pii, quality, toxicity, urlfilter, variants, vectorjoin


def _on(f: Callable[..., DataFrame], *tables: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    """``f`` with its options over the named tables of a folder."""
    return lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables), **options)


QUERIES = {
    "op1_chat": _on(chat.op1_chat, "conversations"),
    "op6_toxicity": _on(toxicity.op6_toxicity, "documents", "labels"),
    "op2_pii": _on(pii.op2_pii, "documents"),
    "op3_mix": _on(mix.op3_mix, "documents"),
    "op4_quality": _on(quality.op4_quality, "documents", "labels"),
    "op5_linededup": _on(linededup.op5_linededup, "documents"),
    "op7_urlfilter": _on(urlfilter.op7_urlfilter, "pages"),
    "op8_vectorjoin": _on(vectorjoin.op8_vectorjoin, "embeddings"),
    "op9_neardup": _on(neardup.op9_neardup, "documents", plain=True),
    "op10_decontaminate": _on(decontaminate.op10_decontaminate, "documents", "benchmark"),
    "op11_align": _on(alignment.op11_align, "documents"),
    "op12_variants": _on(variants.op12_variants, "documents"),
    "op13_pieces": _on(pieces.op13_pieces, "documents"),
}

ORACLE_SQL = {
    "op1_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:'))
    + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 14 AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op8_vectorjoin": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, c AS component_id, e.vec_id = c AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON e.vec_id = r.a LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) p ON e.vec_id = p.a""",
    "op10_decontaminate": r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wins))),
found AS (SELECT DISTINCT doc_id, i, n, item FROM spots JOIN wins USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op12_variants": r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
own AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, run, count(*) AS n FROM runs GROUP BY ALL),
steps AS (
  SELECT run, n, flatten(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c), -1, -1, -1, -1, -1, -1, -1, -1]
    ELSE [195, -1, -1, -1, -1, -1, -1, -1, -1, unicode(c) - 64, -1, -1, -1, -1, -1, -1, -1, -1] END)) AS x FROM own),
sums AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], CAST(x AS BIGINT[])), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS h FROM steps),
told AS (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM sums),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM told WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
skips AS (SELECT word, n, left(word, i - 1) AS l, substr(word, i + 1) AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM skips a JOIN skips b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM skips a JOIN words b ON a.l || a.r = b.word
  UNION SELECT b.word, a.word, a.n FROM skips a JOIN words b ON a.l || a.r = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS m, arg_min(other, (-n, other)) AS other FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
led AS (SELECT word, word AS root, 0 AS far FROM forms UNION ALL SELECT l.word, f.form, far + 1 FROM led l JOIN forms f ON l.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(root, far) FROM led WHERE led.word = forms.word) AS root, n, n_near, form_n FROM forms""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
