"""The thin queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from distloom.llm import licenses, mixing, packing, pii, quality, simhash, spotsigs, suffixarrays, suffixtrees, toolcalls
from distloom.llm.common import documents


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(documents(spark, sf_dir))
    base = ~quality.accepted(F.col("failures"), "base")
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality.accepted(F.col("failures")).alias("kept"), "n_lines", "failures", quality.sole_rule(F.col("failures")).alias("sole_rule"), quality.accepted(F.col("failures"), "v3").alias("kept_v3"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_suffixtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtrees.dedup(documents(spark, sf_dir), texts=False)


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.likeness(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.detect(docs, pii.train(docs))


def op9_suffixarrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixarrays.dedup(documents(spark, sf_dir), texts=False)


def op10_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.calls_of_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return toolcalls.link(calls, results, toolcalls.SCHEMAS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_quality": op2_quality,
        "op3_licenses": op3_licenses,
        "op4_suffixtrees": op4_suffixtrees,
        "op5_spotsigs": op5_spotsigs,
        "op6_mixing": op6_mixing,
        "op7_simhash": op7_simhash,
        "op8_pii": op8_pii,
        "op9_suffixarrays": op9_suffixarrays,
        "op10_toolcalls": op10_toolcalls,
    }


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]) AS n FROM g),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM h, range(0, 5) x(k) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
      FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
             + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
             + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
             + CASE WHEN n_lines = 1 AND n_words > 5000 THEN 64 ELSE 0 END + CASE WHEN n_symbols > 50 * n_lines THEN 128 ELSE 0 END)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed,
       failures & 15 = 0 AS kept, n_lines, failures, CASE failures & 15 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines' END AS sole_rule,
       failures & 255 = 0 AS kept_v3 FROM f
"""


def _op3_sql() -> str:
    """The licence scan in SQL: lists of words, the places of each template's key phrase, and its coverage there."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    columns, shares = [], []
    templates = [*licenses.BASE, *licenses.NOTICES]
    for i, t in enumerate(templates):
        test = " AND ".join(f"ws[s + {k}] = '{w}'" for k, w in enumerate(t.key_words))
        columns.append(f"list_filter(range(1, len(ws) + 1), lambda s: coalesce({test}, false)) AS p{i}")
        words = ", ".join(f"'{w}'" for w in t.words)
        same = f"len(list_filter(range(0, {len(t.words)}), lambda k: coalesce(s - {t.key_at} + k > 0 AND ws[s - {t.key_at} + k] = [{words}][k + 1], false)))"
        shares.append(f"coalesce(list_max(list_transform(p{i}, lambda s: {same} / {len(t.words)}::DOUBLE)), 0) AS c{i}")
    labels = lambda cases: f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL))), ',')"
    base = " || ".join(f"p{i}" for i in range(len(licenses.BASE)))
    base_cases = [f"CASE WHEN len(p{i}) > 0 THEN '{t.label}' END" for i, t in enumerate(licenses.BASE)]
    cases = [f"CASE WHEN c{i} >= {licenses.COVERAGE} THEN '{t.label}' END" for i, t in enumerate(templates)]
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, {", ".join(columns)} FROM w),
c AS (SELECT *, {", ".join(shares)} FROM p)
SELECT doc_id, len(ws)::BIGINT AS n_words, len({base})::BIGINT AS n_base, (list_min({base}) - 1)::BIGINT AS first_word, (list_max({base}) - 1)::BIGINT AS last_word,
       {labels(base_cases)} AS base_labels, {labels(cases)} AS labels, greatest({", ".join(f"c{i}" for i in range(len(templates)))})::DOUBLE AS score FROM c
"""


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
m AS (SELECT w, min(doc_id) AS least FROM g GROUP BY w),
r AS (SELECT DISTINCT doc_id, i + k AS j FROM g JOIN m USING (w), range(0, 13) x(k) WHERE least < doc_id),
gone AS (SELECT doc_id, list(j) AS js FROM r GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: NOT coalesce(list_contains(js, i), false)), ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

OP10_SQL = """
WITH RECURSIVE a AS (SELECT conv_id, turn, text, floor((turn - 1) / 2)::BIGINT AS k FROM conversations WHERE role = 'assistant'),
p AS (SELECT a.*, CASE WHEN k > 0 THEN floor((k - 1) / 2)::BIGINT * 2 + 1 END AS parent FROM a),
q AS (SELECT p.*, o.turn IS NOT NULL AS known FROM p LEFT JOIN a AS o ON o.conv_id = p.conv_id AND o.turn = p.parent),
lv AS (SELECT conv_id, turn, 0 AS level FROM q WHERE NOT known
       UNION ALL SELECT q.conv_id, q.turn, lv.level + 1 FROM q JOIN lv ON lv.conv_id = q.conv_id AND lv.turn = q.parent),
r AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n, min_by(text, turn) AS content, min(turn) AS at FROM conversations WHERE role = 'user' GROUP BY ALL),
f AS (SELECT coalesce(q.conv_id, r.conv_id) AS conv_id, coalesce(q.turn, r.turn) AS id, coalesce(q.turn, r.at) AS turn, q.turn IS NOT NULL AS called, q.* EXCLUDE (conv_id, turn), r.n, r.content
      FROM q FULL JOIN r ON r.conv_id = q.conv_id AND r.turn = q.turn)
SELECT f.conv_id, concat('call_', f.conv_id, '_', id) AS call_id, f.turn, lv.level::INT AS level,
       CASE WHEN called THEN ['search', 'translate', 'lookup'][k % 3 + 1] END AS name,
       CASE WHEN NOT called THEN 'no_call' ELSE array_to_string(list_filter([
         CASE WHEN id % 7 = 3 THEN 'invalid_json' END, CASE WHEN id % 7 <> 3 AND text IS NULL THEN 'missing:query' END, CASE WHEN id % 7 <> 3 AND id % 5 = 1 THEN 'type:limit' END,
         CASE WHEN parent IS NOT NULL AND NOT known THEN 'missing_dependency' END, CASE WHEN n IS NULL THEN 'no_result' WHEN n > 1 THEN 'several_results' END], lambda x: x IS NOT NULL), ',') END AS problems,
       coalesce(n, 0) AS n_results,
       concat('{"arguments":', CASE WHEN NOT called OR id % 7 = 3 THEN 'null' ELSE concat('{"limit":', CASE WHEN id % 5 = 1 THEN concat('"', id, '"') ELSE id::VARCHAR END, CASE WHEN text IS NULL THEN '' ELSE concat(',"query":', to_json(text)) END, '}') END,
              ',"call_id":', to_json(concat('call_', f.conv_id, '_', id)), ',"name":', CASE WHEN called THEN concat('"', ['search', 'translate', 'lookup'][k % 3 + 1], '"') ELSE 'null' END,
              ',"result":', coalesce(to_json(content)::VARCHAR, 'null'), '}') AS message
FROM f LEFT JOIN lv ON called AND lv.conv_id = f.conv_id AND lv.turn = f.id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality": OP2_SQL, "op3_licenses": _op3_sql(), "op4_suffixtrees": OP4_SQL, "op10_toolcalls": OP10_SQL}
