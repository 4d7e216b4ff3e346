"""The registered queries of the text operators: thin bindings to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decilog.llm import byte_bpe, chat, exact_dedup, html_extract, license_scan, line_crf, ngram_join, packing, pii, source_audit, token_align, toxicity, url_filter
from decilog.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str) -> str:
    """Where the vocabulary file lies; it is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op3_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents
), g AS (
  SELECT sha, count(*) AS group_size, max(n) AS top FROM d GROUP BY sha
), k AS (
  SELECT d.sha, min(d.doc_id) AS keep_id FROM d JOIN g ON d.sha = g.sha AND d.n = g.top GROUP BY d.sha
)
SELECT d.doc_id, k.keep_id, g.group_size, d.doc_id = k.keep_id AS kept, d.sha AS text_sha256
FROM d JOIN g ON d.sha = g.sha JOIN k ON d.sha = k.sha
"""


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


ORACLES["op9_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS k,
         coalesce(strlen(role) || ':' || role, '-') || '|' || coalesce(strlen(text) || ':' || text, '-') AS mark,
         '<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line
  FROM conversations
), prefixes AS (
  SELECT conv_id, k, string_agg(mark, chr(0)) OVER (PARTITION BY conv_id ORDER BY k) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
), whole AS (
  SELECT conv_id, n, prefix FROM prefixes WHERE k = n
), maximal AS (
  SELECT conv_id, n, prefix FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.prefix = w.prefix AND p.k < p.n)
), first AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies, any_value(n) AS n_turns FROM maximal GROUP BY prefix
)
SELECT f.conv_id, f.n_turns, f.copies, string_agg(t.line, '' ORDER BY t.k) AS chat
FROM first f JOIN turns t ON t.conv_id = f.conv_id
GROUP BY f.conv_id, f.n_turns, f.copies
"""


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), public_tokenizers.PATTERN, size=1024)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, threshold=85)
    return found.select("doc_id", "n_shingles", "component_id")


ORACLES["op2_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(words) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END)) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT c.a, c.b FROM c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b
  WHERE 100 * c.common >= 85 * (p.n + q.n - c.common)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
"""


@query
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.listed_labels(pages)).select("page_id", "host", "path", "rule", "verdict")


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: they are filed at four depths, from ``source/`` down to ``source/lang/dN/eM/``."""
    depth, part = F.col("doc_id") % 4, lambda letter, n: F.concat(F.lit(letter), F.floor(F.col("doc_id") / 4) % n)
    path = F.concat_ws("/", "source", F.when(depth >= 1, F.col("lang")), F.when(depth >= 2, part("d", 50)), F.when(depth >= 3, part("e", 70)), F.concat(F.lit("f"), F.col("doc_id")))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    return license_scan.scan(files).withColumnRenamed("file_id", "doc_id")


TERMS = ", ".join(f"('{name}', {number}, '{term}', {n})" for name, number, term, n in license_scan.template_terms())
ORACLES["op5_license_scan"] = rf"""
WITH tt(license, template, term, n) AS (VALUES {TERMS}), docs AS (
  SELECT doc_id, concat_ws('/', source, CASE WHEN doc_id % 4 >= 1 THEN lang END, CASE WHEN doc_id % 4 >= 2 THEN 'd' || (doc_id // 4 % 50) END, CASE WHEN doc_id % 4 >= 3 THEN 'e' || (doc_id // 4 % 70) END) AS dir, coalesce(text, '') AS t FROM documents
), lists AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM docs), whole AS (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+(?:\.[0-9]+)*')) AS term FROM docs
), size AS (SELECT count(*) AS n FROM docs), idf AS (
  SELECT v.term, ln((1 + (SELECT n FROM size)) / (1 + count(whole.doc_id))::DOUBLE) + 1 AS idf
  FROM (SELECT DISTINCT term FROM tt) v LEFT JOIN whole ON whole.term = v.term GROUP BY v.term
), near AS (
  SELECT DISTINCT doc_id FROM whole JOIN idf ON idf.term = whole.term
), spans AS (
  SELECT doc_id, width, unnest(range(1, len(l) - width + 2)) AS line, l FROM lists, (SELECT unnest(range(1, {license_scan.LINES} + 1)) AS width) WHERE len(l) >= width AND doc_id IN (SELECT doc_id FROM near)
), terms AS (
  SELECT doc_id, line, width, unnest(regexp_extract_all(lower(array_to_string(l[line:line + width - 1], ' ')), '[a-z0-9]+(?:\.[0-9]+)*')) AS term FROM spans
), w AS (
  SELECT doc_id, line, width, t.term, count(*) * coalesce(any_value(idf.idf), ln(1 + (SELECT n FROM size)) + 1) AS w
  FROM terms t LEFT JOIN idf ON idf.term = t.term GROUP BY doc_id, line, width, t.term
), norm AS (SELECT doc_id, line, width, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id, line, width), u AS (
  SELECT license, template, tt.term, tt.n * idf / sqrt(sum(tt.n * idf * tt.n * idf) OVER (PARTITION BY template)) AS unit FROM tt JOIN idf ON idf.term = tt.term
), s AS (
  SELECT w.doc_id, u.license, round(sum(w.w * u.unit) / any_value(norm.norm), 6) AS score
  FROM w JOIN u ON u.term = w.term JOIN norm ON norm.doc_id = w.doc_id AND norm.line = w.line AND norm.width = w.width GROUP BY w.doc_id, w.line, w.width, u.license, u.template
), own AS (
  SELECT doc_id, arg_max(license, (score, license)) AS own_license, max(score) AS own_score FROM s WHERE score >= {license_scan.THRESHOLD} GROUP BY doc_id
), votes AS (
  SELECT dir, own_license, count(*) AS n FROM docs JOIN own ON own.doc_id = docs.doc_id GROUP BY dir, own_license
), of_dir AS (SELECT dir, arg_min(own_license, (-n, own_license)) AS license FROM votes GROUP BY dir
), up AS (
  SELECT dir AS leaf, unnest(range(len(string_split(dir, '/')) + 1)) AS height, string_split(dir, '/') AS parts FROM (SELECT DISTINCT dir FROM docs)
), near_dir AS (
  SELECT leaf, arg_min(o.dir, height) AS dir, arg_min(o.license, height) AS license FROM up JOIN of_dir o ON o.dir = array_to_string(parts[1:len(parts) - height], '/') GROUP BY leaf
)
SELECT d.doc_id, d.dir || '/f' || d.doc_id AS path, own.own_license, own.own_score, coalesce(own.own_license, o.license) AS license,
  CASE WHEN own.own_license IS NOT NULL THEN d.dir || '/f' || d.doc_id ELSE o.dir END AS found_in
FROM docs d LEFT JOIN own ON own.doc_id = d.doc_id LEFT JOIN near_dir o ON o.leaf = d.dir
"""


@query
def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


ORACLES["op13_source_audit"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (SELECT id, lang, source, unnest(terms) AS term FROM d), kept AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(total) AS lang_size FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM d), n AS (
  SELECT t.lang, t.source, t.term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN kept ON kept.lang = t.lang AND kept.term = t.term GROUP BY ALL
), sizes AS (
  SELECT g.lang, g.source, coalesce(sum(n.n), 0) AS size FROM groups g LEFT JOIN n ON n.lang = g.lang AND n.source = g.source GROUP BY ALL
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(n.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(n.n, 0) + 1) // (s.size + v.v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (k.total + 1) // (v.lang_size + v.v) AS q
  FROM sizes s JOIN kept k ON k.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN n ON n.lang = s.lang AND n.source = s.source AND n.term = k.term
), pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0) AS value FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
), terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q), r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms QUALIFY rank <= 200
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r
"""


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_align.align_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"), public_tokenizers.PATTERN)


@query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))
