"""The registered queries of this package: one opN_ query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrier.llm import ann, bpe, langid, line_dedup, lm, minhash, mixing, ngram_join, passages, periodic, phrases, syncmers, toxicity
from harrier.llm.common import read

QUERIES = {
    "op1_lm": lambda spark, sf_dir: lm.op1_lm(read(spark, sf_dir, "documents")),
    "op2_bpe": lambda spark, sf_dir: bpe.op2_bpe(read(spark, sf_dir, "documents")),
    "op3_langid": lambda spark, sf_dir: langid.op3_langid(read(spark, sf_dir, "documents")),
    "op4_syncmers": lambda spark, sf_dir: syncmers.op4_syncmers(read(spark, sf_dir, "documents")),
    "op5_lines": lambda spark, sf_dir: line_dedup.op5_lines(read(spark, sf_dir, "documents")),
    "op6_ann": lambda spark, sf_dir: ann.op6_ann(read(spark, sf_dir, "embeddings")),
    "op7_toxicity": lambda spark, sf_dir: toxicity.op7_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")),
    "op8_minhash": lambda spark, sf_dir: minhash.near_duplicates(read(spark, sf_dir, "documents")),
    "op9_passages": lambda spark, sf_dir: passages.op9_passages(read(spark, sf_dir, "documents")),
    "op10_mixing": lambda spark, sf_dir: mixing.op10_mixing(read(spark, sf_dir, "documents")),
    "op11_ngram_join": lambda spark, sf_dir: ngram_join.op11_ngram_join(read(spark, sf_dir, "documents")),
    "op13_phrases": lambda spark, sf_dir: phrases.op13_phrases(read(spark, sf_dir, "documents")),
    "op12_periodic": lambda spark, sf_dir: periodic.op12_periodic(read(spark, sf_dir, "documents")),
}

#: What SQL can say of two operators' results: what the mix aims at, and the edited texts that are fingerprinted.
QUERIES |= {
    "mixing_targets": lambda spark, sf_dir: mixing.op10_mixing(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target")),
    "syncmer_edits": lambda spark, sf_dir: syncmers.op4_syncmers(read(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256"),
}



def _jaccard_sql(size: int, percent: int, kept: str = "") -> str:
    """DuckDB SQL for documents linked by the likeness of their shingle sets, and the components of the links."""
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i : i + {size - 1}], ' ') FOR i IN range(1, len(w) - {size - 2})]) END AS g FROM d),
  u AS MATERIALIZED (SELECT list_sort(g) AS g, min(doc_id) AS id, len(g) AS n FROM s GROUP BY ALL),
  x AS MATERIALIZED (SELECT id, n, unnest(g) AS k FROM u),
  p AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.k = b.k AND a.id < b.id AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
    GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
  e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
  c(id, low) AS (SELECT id, id FROM u UNION SELECT e.b, c.low FROM c JOIN e ON e.a = c.id WHERE c.low < e.b),
  m AS (SELECT id, min(low) AS low FROM c GROUP BY id)
  SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE m.low END AS component_id{kept}
  FROM s LEFT JOIN u ON list_sort(s.g) = u.g LEFT JOIN m ON m.id = u.id"""


#: DuckDB twins, where SQL can express the operator on whole tables.
ORACLES: dict[str, str] = {
    "op8_minhash": _jaccard_sql(3, 85, ", s.doc_id = CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE m.low END AS kept"),
    "op11_ngram_join": _jaccard_sql(4, 85),
    "op13_phrases": r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
  g AS (SELECT lang, size, unnest([array_to_string(w[i : i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS phrase FROM w, (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size),
  f AS (SELECT lang, size, phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL),
  n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
  q AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size > 1 AND f >= 10),
  c AS (SELECT q.*, k, array_to_string(w[1 : k], ' ') AS fst, array_to_string(w[k + 1 : size], ' ') AS rst FROM q, (VALUES (1), (2)) s(k) WHERE k < size),
  s AS (SELECT c.lang, c.size, c.phrase, c.w, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM c JOIN f x ON x.lang = c.lang AND x.phrase = fst JOIN f y ON y.lang = c.lang AND y.phrase = rst),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  i AS (SELECT lang, inside, max(a) AS held FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inside FROM q WHERE size = 3) GROUP BY ALL)
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score
  FROM b JOIN n USING (lang) LEFT JOIN i ON i.lang = b.lang AND inside = phrase WHERE held IS NULL OR 100 * held < 50 * a QUALIFY rank <= 2000""",
    "mixing_targets": r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
  f AS (SELECT *, 2.0 * source_size AS top, 2.0 * source_size / w AS fill FROM s),
  l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(top) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f WINDOW o AS (ORDER BY fill, source NULLS LAST)),
  t AS (SELECT source, source_size, least(top, coalesce((SELECT arg_min(level, fill) FROM l WHERE fill >= level) * w, top)) AS target FROM l)
  SELECT d.doc_id, d.size, t.source_size, round(t.target::DOUBLE, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""",
    "syncmer_edits": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
  o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS after FROM d)
  SELECT doc_id, n AS n_chars, sha256(substr(text, 1, n - n // 2) || substr(after, 1, n // 2)) AS edited_sha256 FROM o""",
}
