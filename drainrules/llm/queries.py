"""Registered queries of the corpus operators, with production parameters over whole tables, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drainrules.llm import chat, collocations, decontaminate, gam, html, licenses, lm, packing, prefix_trie, quality, records, simhash, toxicity
from drainrules.session import scratch_path

#: Chain order of the toxicity categories.  The labels carry two flags; the last category is both at once.
TOXICITY_TARGET = "toxic"


def toxicity_categories() -> dict[str, Column]:
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"low_quality": low, TOXICITY_TARGET: toxic, "toxic_low_quality": low & toxic}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), embedded=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "rule"
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), toxicity_categories(), TOXICITY_TARGET)
    return toxicity.score_toxicity(docs, chain)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def with_digest(pieces: DataFrame) -> DataFrame:
    """``ids`` replaced by their unsigned CRC-32."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return with_digest(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"
    )


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-records")
    index = records.write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    found = records.read_records(records.with_global_start(index), folder)
    return with_digest(found).select("doc_id", "start", "n_tokens", "ids_crc32")


#: A conversation of nothing but control strings, added to the table by the query's contract.
CONTROL_ONLY = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_ONLY, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(turns.unionByName(more)))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = prefix_trie.turn_steps(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.borrow_openings(steps))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gam.score_quality(docs, gam.fit_quality_gam(docs, table(spark, sf_dir, "labels")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_license_scan,
        op3_quality_rules,
        op4_toxicity,
        op5_lm_scoring,
        op6_packing,
        op7_token_records,
        op8_chat_formatting,
        op9_decontamination,
        op10_simhash,
        op11_prefix_trie,
        op12_quality_classifier,
        op13_collocations,
    )
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    rows = [(k, t) for k, ts in licenses.TEMPLATES.items() for t in ts]
    values = ", ".join(f"({i}, {_quoted(k)}, {_quoted(t)})" for i, (k, t) in enumerate(rows))
    norm = (
        "regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[.!?]+([ \\n])', chr(30) || '\\1', 'g'), "
        "'[^\\p{{L}}\\p{{N}}\\n' || chr(30) || ']+', ' ', 'g')"
    )
    words = "list_filter(string_split_regex({0}, '[ \\n' || chr(30) || ']+'), lambda x: x <> '')"
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
WITH templates(t, license_id, body) AS (VALUES {values}),
tw AS (SELECT t, license_id, {words.format(norm.format("body"))} AS w FROM templates),
tg AS (SELECT t, license_id, {grams.format("w")} AS g FROM tw),
d AS (SELECT row_number() OVER () AS r, doc_id, {norm.format("text")} AS norm FROM documents),
units AS (
  SELECT DISTINCT r, doc_id, unnest(list_concat(list_concat(string_split_regex(norm, '[\\n' || chr(30) || ']'), string_split(norm, chr(10))),
    list_concat(string_split_regex(norm, '\\n[ \\n]*\\n'), [norm]))) AS u FROM d),
uw AS (SELECT doc_id, {words.format("u")} AS w FROM units),
ug AS (SELECT doc_id, array_to_string(w, ' ') AS unit, {grams.format("w")} AS g FROM uw WHERE len(w) BETWEEN 2 AND 400),
m AS (
  SELECT doc_id, license_id, unit, 2.0 * len(list_intersect(ug.g, tg.g)) / (len(ug.g) + len(tg.g)) AS dice
  FROM ug JOIN tg ON list_has_any(ug.g, tg.g)),
k AS (SELECT * FROM m WHERE dice >= {licenses.THRESHOLD})
SELECT doc_id, license_id, round(max(dice)::DOUBLE, 6) AS dice, first(unit ORDER BY dice DESC, unit DESC) AS unit
FROM k GROUP BY doc_id, license_id
"""


def _chat_sql() -> str:
    extra = ", ".join(f"({c}, {t}, {_quoted(r)}, {_quoted(x)})" for c, t, r, x in CONTROL_ONLY)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {extra}) AS e(conv_id, turn, role, text)),
n AS (
  SELECT *, row_number() OVER o AS i, lag(role) OVER o AS before, count(*) OVER (PARTITION BY conv_id) AS turns_in
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (
  SELECT *, length(regexp_replace(text, '(\\\\|### Assistant:|### System:|### User:|### Role|</turn>)', '\\\\\\1', 'g'))
      + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 10 + greatest(1, 2 * strlen(role)) END + 9 AS formatted,
    CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
      WHEN 'assistant' THEN coalesce(before = 'user', false) ELSE false END
      AND (i < turns_in OR role = 'assistant') AS ok
  FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(formatted)::BIGINT AS formatted_chars, bool_and(ok) AS valid
FROM f GROUP BY conv_id
"""


def _prefix_trie_sql() -> str:
    # CRC-32 (reflected polynomial 0xEDB88320), one decimal digit at a time; eight shifts a byte.
    shift = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    for_byte = "list_reduce(list_concat([xor(acc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: {0})".format(shift)
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda acc, b: {for_byte}), 4294967295)"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS step
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, step) AS i, step,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),
c AS (SELECT conv_id, count(*) AS n_own, conv_id - conv_id % 20 AS lender, {crc} % 4 AS h FROM s GROUP BY conv_id),
p AS (SELECT c.*, least(h, coalesce(b.n_own, 0)) AS got FROM c LEFT JOIN (SELECT conv_id AS b_id, n_own FROM c) AS b ON b_id = lender),
r AS (
  SELECT p.conv_id, s.i AS d, s.step, s.words FROM p JOIN s ON s.conv_id = p.lender AND s.i <= p.h
  UNION ALL SELECT p.conv_id, s.i - p.h + p.got, s.step, s.words FROM p JOIN s ON s.conv_id = p.conv_id AND s.i > p.h
  UNION ALL SELECT conv_id, 0, '', 0 FROM p),
k AS (
  SELECT conv_id, d, words, sha256(string_agg(step, '/') OVER (PARTITION BY conv_id ORDER BY d)) AS key,
    max(d) OVER (PARTITION BY conv_id) AS n_steps FROM r),
l AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY d) AS above FROM k),
n AS (
  SELECT d, key, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = n_steps), '') AS ends
  FROM l GROUP BY d, key),
kids AS (SELECT d - 1 AS d, above AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, key)),
sub AS (
  SELECT l.d, l.key, sum((w.n_children = 0)::BIGINT) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved_tokens
  FROM w JOIN l ON l.conv_id = w.conv_id AND l.d <= w.d GROUP BY l.d, l.key)
SELECT w.conv_id, w.d::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, sub.n_leaves::BIGINT AS n_leaves,
  sub.saved_tokens::BIGINT AS saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN sub USING (d, key) LEFT JOIN n AS u ON u.d = w.d - 1 AND u.key = w.above
"""


def _collocation_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rules = collocations
    return f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) AS ks(k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {rules.MIN_COUNT}),
cuts AS (
  SELECT c.*, cut, array_to_string(list_slice(ws, 1, cut), ' ') AS first_part, array_to_string(list_slice(ws, cut + 1, k), ' ') AS rest
  FROM c, (VALUES (1), (2)) AS cs(cut) WHERE cut < k),
s AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, x.f AS l, y.f AS r, cut,
    (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = first_part JOIN f AS y ON y.lang = cuts.lang AND y.phrase = rest),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS longest
  FROM (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase AND best.k = 2
  WHERE longest IS NULL OR 100 * longest < {rules.DROP_PERCENT} * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {rules.TOP}
"""


ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": _license_sql(),
    "op8_chat_formatting": _chat_sql(),
    "op11_prefix_trie": _prefix_trie_sql(),
    "op13_collocations": _collocation_sql(),
}
