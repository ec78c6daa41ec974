"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetlake.llm import (
    collocations,
    conversation_repair,
    html_density,
    jaccard_join,
    kneser_ney,
    mixing,
    multi_index,
    packing,
    secret_scan,
    suffix_dedup,
    token_fertility,
    topk,
    warc,
)
from sheetlake.llm.common import table

#: The tokenizer's vocabulary as ranks; the file of the same name in .json is the tokenizer itself.
RANKS = "byte_bpe_50k.tiktoken"
#: A vocabulary of pieces that falls back to bytes.
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = RANKS) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with perplexity and threshold; rejected ones have no row."""
    decided = kneser_ney.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return decided.where("keep").select("doc_id", "lang", "perplexity", "threshold")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"), k=3, threshold=90).select(
        "doc_id", "n_shingles", "component_id")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.main_texts(table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).drop("url")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"), with_bytes=False)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets that are left when false positives are removed; the candidate itself only as a digest."""
    found = secret_scan.scanned(table(spark, sf_dir, "documents"), secret_scan.words(table(spark, sf_dir, "benchmark")))
    return found.where("secret").select("doc_id", "place", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.inner_product_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_fertility.judged(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations")
    return conversation_repair.repaired(conversation_repair.damaged(convs), convs)


# shingles of every text, pairs by shared shingles, reachability by recursion
_OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
      ELSE list_transform(range(len(a) - 2), lambda i: array_to_string(list_slice(a, i + 1, i + 3), ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS i
      FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id
      AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * i >= 90 * (na + nb - i)),
r AS (SELECT a AS doc_id, a AS reach FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(min(r.reach), s.doc_id) AS component_id
FROM s LEFT JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.sh)"""

# the article element with its tags taken out; the block tags that these pages use become spaces
_OP4 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1) AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '(?i)</?(p|br|h1)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),
      '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c"""

# digests as hex in SQL: five hex digits are twenty bits, which are four base32 digits
_OP5 = r"""
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
n AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, CAST(i * 5 + 1 AS INTEGER), 5))::BIGINT) AS parts FROM d),
e AS (SELECT *, list_aggregate(list_transform(parts, lambda p: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((p >> 15) & 31 AS INTEGER) + 1, 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((p >> 10) & 31 AS INTEGER) + 1, 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((p >> 5) & 31 AS INTEGER) + 1, 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(p & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest FROM n),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f"""

# every window of every text as hex digits, those that occur twice, their runs, and what is left between them
_OP6 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(n - 199)) AS i FROM d WHERE n >= 200)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY g) > 1),
s AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM r),
t AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s),
p AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS b FROM t GROUP BY doc_id, k),
q AS (SELECT doc_id, count(*) AS m, CAST(sum(b - a) AS BIGINT) AS gone, list_concat([0], list(b ORDER BY a)) AS ends, list(a ORDER BY a) AS starts
      FROM p GROUP BY doc_id),
f AS (SELECT d.doc_id, h, n, coalesce(gone, 0) AS gone, coalesce(m, 0) AS m, coalesce(ends, [0]) AS ends,
      list_concat(coalesce(starts, []), [n]) AS starts FROM d LEFT JOIN q ON q.doc_id = d.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(m AS BIGINT) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, m + 2), lambda j: substr(h, 2 * ends[j] + 1, 2 * (starts[j] - ends[j]))), ''))) AS kept_sha256
FROM f"""

_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_OP9 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_USABLE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

# every phrase of one to four words by its place, counted; cuts and longer phrases by joins
_OP12 = r"""
WITH p AS (SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(part, '[\x20\x09]+'), lambda x: x <> '') AS a
      FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents)),
w AS (SELECT lang, piece, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM p),
q AS (SELECT lang, w, lead(w) OVER o AS x, lead(w, 2) OVER o AS y, lead(w, 3) OVER o AS z FROM w WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS MATERIALIZED (SELECT lang, k, CASE k WHEN 1 THEN [w] WHEN 2 THEN [w, x] WHEN 3 THEN [w, x, y] ELSE [w, x, y, z] END AS ws, CAST(count(*) AS HUGEINT) AS f
      FROM q, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k = 1 OR k = 2 AND x IS NOT NULL OR k = 3 AND y IS NOT NULL OR k = 4 AND z IS NOT NULL
      GROUP BY ALL HAVING k = 1 OR count(*) >= 30),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, ws, f AS a FROM f WHERE k > 1),
e AS MATERIALIZED (SELECT c.*, j, list_slice(ws, 1, j) AS head, list_slice(ws, j + 1, k) AS tail FROM c, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
h AS MATERIALIZED (SELECT e.*, f.f AS l FROM e JOIN f ON f.lang = e.lang AND f.ws = e.head),
s AS (SELECT h.lang, h.k, h.ws, h.a, j, l, f.f AS r, 2000000 * h.a // (l + f.f) AS score
      FROM h JOIN f ON f.lang = h.lang AND f.ws = h.tail
      QUALIFY row_number() OVER (PARTITION BY h.lang, h.ws ORDER BY score, j) = 1),
i AS (SELECT DISTINCT lang, list_slice(ws, t, t + m - 1) AS ws, a AS longer
      FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS t) WHERE m < k AND t + m - 1 <= k),
m AS (SELECT lang, ws, max(longer) AS longer FROM i GROUP BY lang, ws),
o AS (SELECT s.*, array_to_string(s.ws, ' ') AS phrase FROM s LEFT JOIN m ON m.lang = s.lang AND m.ws = s.ws
      WHERE m.longer IS NULL OR 100 * m.longer < 80 * s.a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o)
SELECT t.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000"""

# crc32 by its table, the damage, then the best (cost, audit) and its lines for each number of rows and state; inserts before a row or at the end
_OP13 = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
fated AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, CAST(i AS INTEGER), 1))::BIGINT)),
      lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295) % 20 AS fate FROM keyed, tab),
rws AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
      CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM fated, (SELECT unnest([0, 1]) AS again) WHERE fate <> 0 AND (again = 0 OR fate = 3)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(role || ':' || text)) AS i FROM rws),
fault AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE 'k' END AS kind,
      left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM num),
st AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (kind = 'b') AS blank, count(*) FILTER (kind = 'd') AS duplicate,
      count(*) FILTER (kind = 't') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
      FROM fault GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, '', []), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']),
      (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])) v(p, q, letters, more)),
step AS (SELECT * FROM (VALUES ('D', 0, 0, 'D'), ('D', 1, 1, 'D'), ('D', 2, 2, 'D'), ('D', 3, 3, 'D'), ('s', 0, 1, 'K'), ('u', 0, 2, 'K'), ('u', 1, 2, 'K'),
      ('a', 2, 3, 'K'), ('u', 3, 2, 'K'), ('R', 0, 2, 'R'), ('R', 1, 2, 'R'), ('R', 2, 3, 'R'), ('R', 3, 2, 'R')) v(c, p, q, letter)),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM st
  UNION ALL
  SELECT conv_id, i, s, cost, audit, lines FROM (
    SELECT dp.conv_id, dp.i + 1 AS i, step.q AS s, dp.audit || ins.letters || step.letter AS audit,
      dp.cost + 5 * length(ins.letters) + CASE step.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
        + CASE WHEN step.letter <> 'D' AND f.kind = 't' THEN 5 ELSE 0 END AS cost,
      list_concat(list_concat(dp.lines, ins.more), CASE step.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text]
        ELSE [CASE step.q WHEN 3 THEN 'assistant:' ELSE 'user:' END || f.text] END) AS lines
    FROM dp JOIN fault f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN ins ON ins.p = dp.s
    JOIN step ON step.p = ins.q AND (step.letter = 'D' OR f.kind IN ('t', 'k') AND (step.letter = 'R' OR step.c = f.c)))
  QUALIFY row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) = 1),
done AS (SELECT dp.conv_id, dp.cost + 5 * length(ins.letters) AS cost, dp.audit || ins.letters AS audit, list_concat(dp.lines, ins.more) AS lines
  FROM dp JOIN st ON st.conv_id IS NOT DISTINCT FROM dp.conv_id AND st.n = dp.i JOIN ins ON ins.p = dp.s AND ins.q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY dp.cost + 5 * length(ins.letters), dp.audit || ins.letters) = 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(array_to_string(coalesce(lines, []), chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id"""

#: name -> (query, DuckDB SQL for the same rows, or None where SQL cannot express it)
REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_mix_sources": (op1_mix_sources, None),
    "op2_quality": (op2_quality, None),
    "op3_jaccard": (op3_jaccard, _OP3),
    "op4_html_text": (op4_html_text, _OP4),
    "op5_warc": (op5_warc, _OP5),
    "op6_suffix_dedup": (op6_suffix_dedup, _OP6),
    "op7_pack": (op7_pack, None),
    "op8_secrets": (op8_secrets, None),
    "op9_topk": (op9_topk, _OP9),
    "op10_nearest": (op10_nearest, None),  # approximate; recall is tested
    "op11_fertility": (op11_fertility, None),
    "op12_collocations": (op12_collocations, _OP12),
    "op13_conversations": (op13_conversations, _OP13),
}
