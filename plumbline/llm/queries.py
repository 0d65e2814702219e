"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    automaton_dedup, chat, decontaminate, exact_dedup, html_text, jaccard_join, language_id,
    line_dedup, packing, periodic_runs, ranked_search, robust_quality,
    suffix_dedup)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digests(suffix_dedup.repeated_spans(_read(spark, sf_dir, "documents")))


def op2_html_text(spark, sf_dir):
    return html_text.extract_main_text(_read(spark, sf_dir, "pages"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.digests(line_dedup.dedup_lines(_read(spark, sf_dir, "documents")))


def op4_automaton_dedup(spark, sf_dir):
    return automaton_dedup.digests(
        automaton_dedup.earlier_spans(_read(spark, sf_dir, "documents")))


def op5_chat_format(spark, sf_dir):
    extra = spark.range(2).selectExpr(
        "CAST(-1 AS bigint) AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role",
        "'</s>[INST] ok [/INST]' AS text")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digests(chat.format_chats(chat.message_log(rows.unionByName(extra))))


def op6_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.overlaps(_read(spark, sf_dir, "documents"),
                                  _read(spark, sf_dir, "benchmark"))


def op8_language_id(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"), keep="largest")


def op10_pack(spark, sf_dir):
    return packing.pack_documents(_read(spark, sf_dir, "documents"),
                                  tokenizer_path(packing.TOKENIZER))


def op11_robust_quality(spark, sf_dir):
    return robust_quality.judge(_read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    return periodic_runs.digests(periodic_runs.periodic_runs(
        _read(spark, sf_dir, "documents"), text=periodic_runs.repeat_some()))


def op13_ranked_search(spark, sf_dir):
    return ranked_search.rank_documents(_read(spark, sf_dir, "documents"),
                                        _read(spark, sf_dir, "benchmark"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_html_text": op2_html_text,
        "op3_line_dedup": op3_line_dedup,
        "op4_automaton_dedup": op4_automaton_dedup,
        "op5_chat_format": op5_chat_format,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_decontaminate": op7_decontaminate,
        "op8_language_id": op8_language_id,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_pack": op10_pack,
        "op11_robust_quality": op11_robust_quality,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_ranked_search": op13_ranked_search,
    }


def statements() -> dict[str, str]:
    return {
        "op3_line_dedup": _LINE_DEDUP,
        "op4_automaton_dedup": _AUTOMATON_DEDUP,
        "op5_chat_format": _CHAT_FORMAT,
        "op6_jaccard_join": _JACCARD_JOIN,
        "op7_decontaminate": _DECONTAMINATE,
        "op9_exact_dedup": _EXACT_DEDUP,
        "op13_ranked_search": _RANKED_SEARCH,
    }


_LINE_DEDUP = r"""
WITH cut AS (
    SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines
    FROM documents
), places AS (
    SELECT doc_id, unnest(range(1, len(lines) + 1)) AS pos, lines FROM cut
), windows AS (
    SELECT doc_id, pos, lines[pos] AS line,
           CASE WHEN pos + 2 <= len(lines)
                 AND regexp_matches(array_to_string(lines[pos:pos + 2], ' '), '[\pL\pN]')
                THEN lines[pos:pos + 2] END AS w
    FROM places
), ordered AS (
    SELECT *, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1
              AS earlier
    FROM windows
), covered AS (
    SELECT doc_id, pos, line, bool_or(earlier) OVER (
               PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone
    FROM ordered
), totals AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed,
           string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
    FROM covered GROUP BY doc_id
)
SELECT doc_id, len(lines)::BIGINT AS n_lines, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM cut LEFT JOIN totals USING (doc_id)
"""

_AUTOMATON_DEDUP = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), places AS (
    SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, words FROM words
), windows AS (
    SELECT doc_id, pos, words[pos] AS word,
           CASE WHEN pos + 19 <= len(words) THEN array_to_string(words[pos:pos + 19], ' ') END AS w
    FROM places
), ordered AS (
    SELECT doc_id, pos, word, w IS NOT NULL AND row_number() OVER (
               PARTITION BY w ORDER BY doc_id, pos) > 1 AS earlier
    FROM windows
), covered AS (
    SELECT doc_id, pos, word, bool_or(earlier) OVER (
               PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
    FROM ordered
), totals AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed,
           string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
    FROM covered GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN totals USING (doc_id)
"""

_CHAT_FORMAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), lines AS (
    SELECT *, role || chr(10) || text || chr(10) AS line,
           CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
           '<s>' || regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')
           || '[INST]' || regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')
           || '[/INST]</s>' || chr(10) AS piece
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(line, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(length(learned))::BIGINT AS loss_chars,
       sha256(string_agg(learned, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       sum(length(piece))::BIGINT AS formatted_chars
FROM lines GROUP BY conv_id
"""


_EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

# Windows of 13 words with at most two differences agree in one of three residue classes.
_DECONTAMINATE = r"""
WITH texts AS (
    SELECT 'doc' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') AS words
    FROM documents
    UNION ALL
    SELECT 'item', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') FROM benchmark
), sized AS (
    SELECT *, CASE WHEN kind = 'item' AND len(words) < 13 THEN len(words) ELSE 13 END AS n FROM texts
), lengths AS (
    SELECT DISTINCT n FROM sized WHERE kind = 'item' AND n >= 5
), places AS (
    SELECT kind, id, s.n AS n, unnest(range(1, len(words) - s.n + 2)) AS pos, words
    FROM sized s WHERE kind = 'item' AND s.n >= 5
    UNION ALL
    SELECT kind, id, l.n, unnest(range(1, len(words) - l.n + 2)), words
    FROM sized s, lengths l WHERE kind = 'doc'
), windows AS (
    SELECT kind, id, n, pos, words[pos:pos + n - 1] AS w FROM places
), classes AS (
    SELECT kind, id, n, pos, w, c,
           array_to_string(list_filter(w, lambda x, i: i % 3 = c), ' ') AS k
    FROM windows, (SELECT unnest([0, 1, 2]) AS c)
), pairs AS (
    SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.pos, d.n
    FROM classes d JOIN classes i ON d.kind = 'doc' AND i.kind = 'item'
         AND d.n = i.n AND d.c = i.c AND d.k = i.k
    WHERE len(list_filter(list_zip(d.w, i.w), lambda p: p[1] = p[2])) >= d.n - floor(d.n * 0.2)
)
SELECT doc_id, item_id, count(DISTINCT pos) AS n_windows, min(pos) - 1 AS first_word,
       max(pos + n) - 2 AS last_word
FROM pairs GROUP BY doc_id, item_id
"""

_JACCARD_JOIN = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [words]
           ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i:i + 2]))
           END AS shingles
    FROM texts
), distinct_sets AS (
    SELECT min(doc_id) AS node, list_sort(shingles) AS shingles
    FROM sets WHERE len(shingles) > 0 GROUP BY list_sort(shingles)
), members AS (
    SELECT node, len(shingles) AS n, unnest(shingles) AS s FROM distinct_sets
), links AS MATERIALIZED (
    SELECT x.node AS a, y.node AS b
    FROM members x JOIN members y
         ON x.s = y.s AND x.node <> y.node AND 100 * x.n >= 90 * y.n AND 100 * y.n >= 90 * x.n
    GROUP BY x.node, y.node, x.n, y.n
    HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (
    SELECT node, node AS to_node FROM distinct_sets
    UNION
    SELECT r.node, l.b FROM reach r JOIN links l ON r.to_node = l.a
), parts AS (
    SELECT node, min(to_node) AS component FROM reach GROUP BY node
)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles,
       coalesce(p.component, s.doc_id) AS component_id
FROM sets s LEFT JOIN distinct_sets d ON len(s.shingles) > 0 AND list_sort(s.shingles) = d.shingles
     LEFT JOIN parts p ON p.node = d.node
"""

_RANKED_SEARCH = r"""
WITH held AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), wanted AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY item_id, term
), sizes AS (
    SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id
), totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), counted AS (
    SELECT doc_id, term, count(*) AS tf FROM held
    WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM counted, totals GROUP BY term, docs
), measures AS (
    SELECT doc_id, 100 - 75 + (75 * n * docs) // terms AS m FROM sizes, totals
), scored AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM counted JOIN wanted USING (term) JOIN weights USING (term) JOIN measures USING (doc_id)
    GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
           doc_id, score
    FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
