"""Registered queries of the corpus operators, with their SQL where SQL can say the same."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import ann, bpe, collocations, decontam, hardneg, lengths, linededup, lm, neardup, quality, sharding, substring, toxicity

try:
    import public_tokenizers

    VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
except ImportError:  # the vocabulary's place is a parameter
    VOCABULARY = os.environ.get("PENUMBRA_VOCABULARY", "byte_bpe_50k.json")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_lm_scores(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark, sf_dir):
    return lengths.token_counts(lengths.length_histogram(table(spark, sf_dir, "documents"), VOCABULARY))


def op7_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op8_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    out = linededup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_substring_dedup(spark, sf_dir):
    out = substring.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hardneg.hard_negatives(vectors.withColumn("label", label))
    names = {"anchor": "anchor_id", "positive": "positive_id", "negative": "negative_id"}
    return out.withColumnsRenamed(names).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_collocations(spark, sf_dir):
    found = collocations.collocations(table(spark, sf_dir, "documents"))
    return collocations.best_of_each(found, 2000)


def op13_nearest(spark, sf_dir):
    out = ann.nearest(table(spark, sf_dir, "embeddings"), k=20, queries_every=20)
    return out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_lm_scores": op2_lm_scores,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_near_dedup": op7_near_dedup,
    "op8_sharding": op8_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_nearest": op13_nearest,
}

_WORD = r"[^\x20\x09-\x0D]+"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _stop_list() -> str:
    words = {w for ws in quality.STOP_WORDS.values() for w in ws}
    return ", ".join(f"'{w}'" for w in sorted(words | {w.capitalize() for w in words}))


def _quality_sql() -> str:
    def value(name):
        part = quality.SHARES.get(name)
        return f"coalesce({part[0]} / nullif({part[1]}, 0)::DOUBLE, 0)" if part else name

    bad = " OR ".join(f"{value(n)} {op} {limit}" for n, op, limit in quality.RULES)
    bullets = " OR ".join(f"starts_with(ltrim(x), '{m}')" for m in quality.BULLETS)
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents),
    g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(generate_series(1, len(w) - 2)) AS s(i)),
    r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
    c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM r, unnest([0, 1, 2]) AS s(k)) GROUP BY 1),
    m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                 length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
                 len(list_filter(l, lambda x: {bullets})) AS n_bullet_lines,
                 len(list_filter(l, lambda x: ends_with(rtrim(x), '...') OR ends_with(rtrim(x), '…'))) AS n_ellipsis_lines,
                 len(list_filter(w, lambda x: x IN ({_stop_list()}))) AS n_stop_words, coalesce(c.n, 0) AS n_repeat_words
          FROM d LEFT JOIN c USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT *, NOT base_failed AND NOT ({bad}) AS kept FROM b"""


ORACLES: dict[str, str] = {
    "op3_quality_rules": _quality_sql(),
    "op4_decontamination": f"""
    WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '{_ITEM_WORD}') AS w FROM benchmark),
    win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS g FROM i, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS x(s) WHERE len(w) > 0),
    d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ITEM_WORD}') AS w FROM documents),
    dw AS (SELECT doc_id, s, z.n, array_to_string(w[s:s + z.n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win) AS z, unnest(generate_series(1, len(w) - z.n + 1)) AS x(s)),
    h AS (SELECT doc_id, s, dw.n, item FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
    hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, p FROM h, unnest(generate_series(s, s + n - 1)) AS x(p)) GROUP BY 1),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op7_near_dedup": f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM d, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS x(i) WHERE len(w) > 0),
    z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
    arcs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach(root, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT root, arcs.b FROM reach JOIN arcs ON node = arcs.a)
    SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
    FROM d LEFT JOIN z USING (doc_id) JOIN (SELECT node, min(root) AS c FROM reach GROUP BY 1) m ON m.node = d.doc_id""",
    "op9_line_dedup": f"""
    WITH l AS (SELECT doc_id, i - 1 AS i, line, CAST('0x' || substr(md5(line), 1, 15) AS BIGINT) AS h, count(*) OVER (PARTITION BY doc_id) AS n
               FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
    p AS (SELECT *, CASE WHEN i + 1 < n THEN (h % {linededup.PRIME} + 31 * (lead(h) OVER w % {linededup.PRIME})) % {linededup.PRIME} END AS r, line || chr(10) || lead(line) OVER w AS pair FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    b AS (SELECT *, lag(r, 2) OVER w AS a2, lag(r) OVER w AS a1, lead(r) OVER w AS c1, lead(r, 2) OVER w AS c2 FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    c AS (SELECT doc_id, i, pair FROM b WHERE r IS NOT NULL AND (n <= 3 OR (r <= a1 AND r <= a2) OR (r <= a1 AND r <= c1) OR (r <= c1 AND r <= c2))),
    f AS (SELECT *, first_value((doc_id, i)) OVER (PARTITION BY pair ORDER BY doc_id, i) AS first FROM c),
    ways AS (SELECT DISTINCT doc_id, first[1] AS source, i - first[2] AS shift FROM f WHERE doc_id <> first[1] OR i <> first[2]),
    same AS (SELECT w.doc_id, w.source, w.shift, x.i FROM ways AS w JOIN l AS x USING (doc_id) JOIN l AS y ON y.doc_id = w.source AND y.i = x.i - w.shift AND y.line = x.line),
    gone AS (SELECT DISTINCT s.doc_id, s.i FROM same AS s JOIN same AS t ON t.doc_id = s.doc_id AND t.source = s.source AND t.shift = s.shift AND abs(t.i - s.i) = 1),
    q AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g.i IS NOT NULL) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS t FROM l LEFT JOIN gone AS g USING (doc_id, i) GROUP BY 1),
    m AS (SELECT doc_id, count(*) AS n_chunks FROM c GROUP BY 1)
    SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_removed, 0) AS n_removed, sha256(t) AS kept_sha256 FROM documents LEFT JOIN q USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op10_substring_dedup": f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(generate_series(1, len(w) - 12)) AS x(i)),
    r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS lo FROM g) WHERE lo < doc_id),
    gone AS (SELECT DISTINCT doc_id, p FROM r, unnest(generate_series(i, i + 12)) AS x(p)),
    k AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
    words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
    t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
    SELECT d.doc_id, len(w) AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(t.t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_hard_negatives": """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank, other AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""",
    "op12_collocations": r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
    t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY 1),
    f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM p, (VALUES (1), (2), (3), (4), (5)) AS z(k), unnest(generate_series(1, len(w) - k + 1)) AS x(i) GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT lang, phrase, f, unnest(generate_series(1, k - 1)) AS cut, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    s AS (SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, t.n, CAST((1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score, cut
          FROM c JOIN t USING (lang) JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    i AS (SELECT DISTINCT lang, k, f, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM (SELECT lang, k, f, string_split(phrase, ' ') AS w FROM f WHERE k > 2), (VALUES (2), (3), (4)) AS z(m), unnest(generate_series(1, k - m + 1)) AS x(s) WHERE m < k),
    g AS (SELECT lang, phrase, max(f) AS f FROM i GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
    FROM b LEFT JOIN g USING (lang, phrase) WHERE g.f IS NULL OR 100 * g.f < 100 * a QUALIFY rank <= 2000""",
}
