"""The registered queries of the operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

import html as markup
from collections.abc import Callable
from html import entities

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, chat, collocations, knn, lm, mixing, quality, secrets, simhash, tokens, warc, wordtable
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def register(build: Query) -> Query:
        REGISTRY[name] = build
        return build

    return register


@query("op1_quality_rules")
def _op1(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"), quality.labels_of(spark, sf_dir))


@query("op2_nearest_neighbours")
def _op2(spark, sf_dir):
    return knn.nearest(table(spark, sf_dir, "embeddings"))


@query("op3_secret_scans")
def _op3(spark, sf_dir):
    return secrets.secret_scans(table(spark, sf_dir, "documents"))


@query("op4_simhash_near_dedup")
def _op4(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_token_counts")
def _op5(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@query("op6_byte_bpe")
def _op6(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


@query("op7_warc_derivatives")
def _op7(spark, sf_dir):
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


@query("op8_mix_sources")
def _op8(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op9_chat_tools")
def _op9(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return chat.link(chat.calls_of(conversations), chat.results_of(conversations))


@query("op10_lm_scoring")
def _op10(spark, sf_dir):
    return lm.lm_scores(table(spark, sf_dir, "documents"))


@query("op11_word_table_bpe")
def _op11(spark, sf_dir):
    return wordtable.encode_documents(table(spark, sf_dir, "documents"))


@query("op12_collocations")
def _op12(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_filter_audit")
def _op13(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# One component after the other, as the operator sums.
_DOT = "list_reduce(list_prepend(0.0::DOUBLE, [a.v[i] * b.v[i] for i in range(1, len(a.v) + 1)]), lambda x, y: x + y)"


def _norm(side: str) -> str:
    return _DOT.replace("a.v", f"{side}.v").replace("b.v", f"{side}.v")


ORACLES["op2_nearest_neighbours"] = f"""
WITH e AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
      AND len([1 for x in embedding if x <> 0]) > 0
),
n AS (SELECT a.vec_id, a.v, {_norm("a")} AS vv FROM e a),
pairs AS (
    SELECT a.vec_id AS query_id, b.vec_id, {_DOT} / sqrt(a.vv * b.vv) AS score
    FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {knn.EVERY} = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= {knn.NEAREST}"""

ORACLES["op8_mix_sources"] = r"""
WITH d AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
    FROM documents
),
s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM d GROUP BY source
),
-- Of all sources that could be full, as many are as keep the level above what they can take.
levels AS (
    SELECT s.*, 2.0::DOUBLE * source_size AS cap,
           (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
            - coalesce((SELECT sum(2.0::DOUBLE * o.source_size) FROM s o WHERE o.source_size / o.weight < s.source_size / s.weight), 0))
           / (SELECT sum(o.weight) FROM s o WHERE o.source_size / o.weight >= s.source_size / s.weight) AS level
    FROM s
),
t AS (
    SELECT source, source_size,
           least(cap, (SELECT max(level) FROM levels WHERE level <= cap / weight) * weight) AS target
    FROM levels
),
h AS (
    SELECT d.*, source_size, target,
           CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws(':', '17', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))),
               doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, floor(target) - whole * source_size - before)) AS BIGINT) AS taken
FROM h"""


def _uuid(*parts: str) -> str:
    h = f"md5(concat_ws(chr(10), {', '.join(parts)}))"
    return f"'<urn:uuid:' || concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12)) || '>'"


def _quoted(texts) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


def _references(text: str) -> str:
    """Character references by the standard's own table, token by token."""
    named = "map({}, {})".format(_quoted("&" + k for k in entities.html5), _quoted(entities.html5.values()))
    # Names that also count without a semicolon, the longest first.
    bare = "|".join(sorted((k for k in entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))
    # Numbers below 160 that do not stand for themselves.
    low = {str(n): markup.unescape(f"&#{n};") for n in range(160)}
    low = "map({}, {})".format(_quoted(low), _quoted("" if c == "\0" else c for c in low.values()))
    digits = "CASE WHEN regexp_matches(t, '^&#[xX]') THEN CAST('0x' || substr(rtrim(t, ';'), 4) AS HUGEINT) ELSE CAST(substr(rtrim(t, ';'), 3) AS HUGEINT) END"
    number = f"""CASE WHEN {digits} < 160 THEN {low}[CAST({digits} AS VARCHAR)]
        WHEN {digits} BETWEEN 55296 AND 57343 OR {digits} > 1114111 THEN chr(65533)
        WHEN {digits} BETWEEN 64976 AND 65007 OR {digits} % 65536 >= 65534 THEN '' ELSE chr(CAST({digits} AS INTEGER)) END"""
    name = f"""coalesce({named}[t], CASE WHEN regexp_matches(t, '^&({bare})') THEN
        {named}[regexp_extract(t, '^&({bare})')] || substr(t, 1 + length(regexp_extract(t, '^&({bare})'))) END, t)"""
    token = f"CASE WHEN regexp_matches(t, '^&#([0-9]+|[xX][0-9a-fA-F]+);?$') THEN {number} WHEN starts_with(t, '&') THEN {name} ELSE t END"
    parts = f"regexp_extract_all({text}, '&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{{1,32}};?)|[^&]+|&')"
    return f"replace(coalesce(array_to_string(list_transform({parts}, lambda t: {token}), ''), ''), chr(160), ' ')"


def _text(html: str) -> str:
    for pattern, by in ((warc.DROPPED, "' '"), (warc.BREAKS, "chr(10)"), (warc.TAGS, "''")):
        html = f"regexp_replace({html}, '{pattern}', {by}, 'g')"
    html = _references(html)
    for pattern, by in ((warc.BLANKS, "' '"), (warc.LINES, "chr(10)"), (warc.ENDS, "''")):
        html = f"regexp_replace({html}, '{pattern}', {by}, 'g')"
    return html


_LINE = "chr(13) || chr(10)"
ORACLES["op7_warc_derivatives"] = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (
    SELECT *, 'sha256:' || sha256(payload) AS payload_digest,
           {_uuid("'response'", "coalesce(CAST(page_id AS VARCHAR), '')", "target_uri", "'sha256:' || sha256(payload)")} AS refers_to,
           {_text("payload")} AS text
    FROM p
),
c AS (SELECT *, 'sha256:' || sha256(text) AS text_digest FROM r),
i AS (SELECT *, {_uuid("'conversion'", "refers_to", "text_digest")} AS conversion_id FROM c),
m AS (
    SELECT *, 'source-content-type: text/html' || {_LINE} || 'source-payload-digest: ' || payload_digest || {_LINE}
        || 'source-length: ' || strlen(payload) || {_LINE} || 'conversion: ' || conversion_id || {_LINE}
        || 'conversion-digest: ' || text_digest || {_LINE} || 'conversion-length: ' || strlen(text) || {_LINE} AS fields
    FROM i
),
derived AS (
    SELECT page_id, 'metadata' AS warc_type, {_uuid("'metadata'", "refers_to", "text_digest")} AS record_id, refers_to, target_uri,
           'application/warc-fields' AS content_type, fields AS block FROM m
    UNION ALL
    SELECT page_id, 'conversion', conversion_id, refers_to, target_uri, '{warc.PROFILE}', text FROM m
)
SELECT page_id, warc_type, record_id, refers_to, target_uri, '{warc.WARC_DATE}' AS warc_date, content_type,
       'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length, block
FROM derived"""

ORACLES["op9_chat_tools"] = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations
    WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL
),
-- Calls two turns apart build on each other: a chain is a run of them.
runs AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM c),
deep AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS depth FROM runs),
u AS (
    SELECT conv_id, turn, min(coalesce(text, '')) AS content FROM conversations
    WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn
),
a AS (
    SELECT d.*, u.content, u.conv_id IS NOT NULL AS linked,
        CASE n % 3 WHEN 0 THEN 'count_words' WHEN 1 THEN 'find_phrase' ELSE 'summarise' END AS name,
        CASE WHEN n % 7 <> 0 THEN NULL WHEN n % 3 = 0 THEN 'text_length is missing' WHEN n % 3 = 1 THEN 'phrase is no string'
             ELSE 'style is missing' END AS fault,
        CASE WHEN n % 7 <> 0 THEN CASE n % 3
            WHEN 0 THEN '{"limit":' || (n % 10) || ',"text_length":' || n || '}'
            WHEN 1 THEN '{"ignore_case":' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || ',"phrase":'
                || CAST(to_json(coalesce(regexp_extract(text, '([^ 	-
]+)', 1), '')) AS VARCHAR) || '}'
            ELSE '{"max_words":' || n || ',"style":"plain"}' END
        ELSE CAST(to_json(CASE n % 3 WHEN 0 THEN '{ "limit" : ' || n || ' }'
            WHEN 1 THEN '{ "phrase" : ' || n || ' , "ignore_case" : ' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || ' }'
            ELSE '{ "max_words" : ' || n || ' }' END) AS VARCHAR) END AS arguments
    FROM deep d LEFT JOIN u ON u.conv_id = d.conv_id AND u.turn = d.turn + 1
)
SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id, CAST(depth AS BIGINT) AS depth, name, fault, linked,
       '{"arguments":' || arguments || ',"id":"call-' || conv_id || '-' || turn || '","name":"' || name || '","result":'
       || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json
FROM a"""


ORACLES["op12_collocations"] = rf"""
WITH p AS (
    SELECT coalesce(lang, '{collocations.UNKNOWN_LANG}') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), '{collocations.UPPER}', '{collocations.LOWER}'), '{collocations.ENDS}')) AS piece
    FROM documents
),
q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
totals AS (SELECT lang, sum(len(w)) AS n FROM q GROUP BY lang),
g AS (
    SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase
    FROM q, (VALUES (1), (2), (3), (4), (5)) AS sizes(k)
),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= {collocations.LEAST}),
w AS (SELECT *, string_split(phrase, ' ') AS words FROM c WHERE k >= 2),
held AS (
    SELECT lang, phrase, max(f) AS most FROM (
        SELECT lang, f, unnest([array_to_string(words[i:i + m - 1], ' ') for i in range(1, k - m + 2)]) AS phrase
        FROM w, (VALUES (2), (3), (4)) AS sizes(m) WHERE m < k
    ) GROUP BY lang, phrase
),
cuts AS (
    SELECT w.lang, w.phrase, w.f AS a, totals.n, j, l.f AS l, r.f AS r,
           CAST((1000::HUGEINT * w.f * totals.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM w JOIN totals USING (lang) LEFT JOIN held ON held.lang = w.lang AND held.phrase = w.phrase,
         (VALUES (1), (2), (3), (4)) AS places(j), c AS l, c AS r
    WHERE j < w.k AND 100 * coalesce(most, 0) < 100 * w.f
      AND l.lang = w.lang AND l.phrase = array_to_string(w.words[1:j], ' ')
      AND r.lang = w.lang AND r.phrase = array_to_string(w.words[j + 1:], ' ')
),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked WHERE rank <= {collocations.TOP}"""

ORACLES["op13_filter_audit"] = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
least AS (SELECT text, min(doc_id) AS doc_id FROM d GROUP BY text),
l AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
),
f AS (
    SELECT part,
           CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
           + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * length(d.text) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN d.doc_id > least.doc_id THEN 16 ELSE 0 END AS failed,
           count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
    FROM d JOIN least ON d.text = least.text LEFT JOIN l ON l.doc_id = d.doc_id
    GROUP BY part, failed
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (
    SELECT filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS own,
           list_sum([1 << (instr('ABCDE', filter_order[i]) - 1) for i in range(1, step + 1)]) AS upto
    FROM orders, (VALUES (1), (2), (3), (4), (5)) AS places(step)
),
counted AS (
    SELECT part, filter_order, step, own,
           sum(CASE WHEN failed & upto = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN failed & upto = own THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN failed & own <> 0 AND failed & upto <> own THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN failed & upto = own THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN failed & upto = own THEN toxic ELSE 0 END) AS toxic_lost
    FROM f, (SELECT filter_order, step, CAST(own AS BIGINT) AS own, CAST(upto AS BIGINT) AS upto FROM steps)
    GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted"""
