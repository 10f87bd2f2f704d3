"""Registered queries of the training-data operators, each beside its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import (
    chat,
    contamination,
    filter_audit,
    jaccard,
    language_model,
    licenses,
    linedup,
    mixing,
    quality,
    resampling,
    secrets,
    token_files,
    topk,
)
from statloom.llm.common import table
from statloom.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_token_files")
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, folder, "documents"), files, tokenizer_path())
    return token_files.digests(spark, files)


CONTAMINATION_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM words WHERE len(w) > 0),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM places, (SELECT DISTINCT n FROM windows) WHERE i + n - 1 <= len(w)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op4_decontamination", CONTAMINATION_SQL)
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = contamination.contamination(docs, table(spark, folder, "benchmark"))
    c = F.col("_contamination")
    return judged.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c["item_ids"]), 256).alias("items_sha256"),
        c["contaminated"].alias("contaminated"),
    )


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    model = quality.learn(docs, table(spark, folder, "labels"), ~quality.held_out())
    return quality.score(docs, model).select(
        "doc_id",
        quality.held_out().alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


MIXING_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
sums AS (
  SELECT *, sum(3 * source_size) OVER w - 3 * source_size AS given, sum(weight) OVER () - sum(weight) OVER w + weight AS left_weight,
    sum(source_size) OVER () AS total
  FROM sources WINDOW w AS (ORDER BY 3 * source_size / weight, source ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT max(CAST(total - given AS DOUBLE) / CAST(left_weight AS DOUBLE)) AS level FROM sums
  WHERE CAST(total - given AS DOUBLE) / CAST(left_weight AS DOUBLE) * weight <= 3 * source_size),
goals AS (
  SELECT source, source_size, least(weight * level, CAST(3 * source_size AS DOUBLE)) AS target,
    CAST(CAST('0x' || substr(md5('{mixing.SEED}|' || CASE WHEN source IS NULL THEN 'null' ELSE 's|' || source END), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u
  FROM sources, level),
placed AS (
  SELECT s.doc_id, s.size, g.*, row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS place,
    CASE WHEN g.source_size > 0 THEN target / g.source_size ELSE 0 END AS rate
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(floor(rate * place + u) - floor(rate * (place - 1) + u) AS BIGINT) * size AS taken
FROM placed
"""


@query("op2_mixing", MIXING_SQL)
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    docs = docs.select("doc_id", "source", mixing.size_of().alias("size"), F.xxhash64("text").alias("hash"))
    taken = mixing.copies(docs)
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _spans_sql(pattern: str, kind: int) -> str:
    """Matches with their places, from what lies between them."""
    p = pattern.replace("'", "''")
    return f"""
      SELECT doc_id, {kind} AS kind, m[i] AS value, list_sum(list_transform(b[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (
        SELECT doc_id, string_split_regex(t, '{p}') AS b, regexp_extract_all(t, '{p}') AS m FROM texts))"""


def _secrets_sql() -> str:
    base, more = [], []
    for kind, (_, pattern, group, least) in enumerate(secrets.BASE):
        p = pattern.replace("(?i:(password|passwd|secret|token|api_?key))", _either_case("(password|passwd|secret|token|api_?key)"))
        value = f"regexp_extract(value, '{p.replace(chr(39), chr(39) * 2)}', {group})"
        base.append(f"SELECT * FROM ({_spans_sql(p, kind)}) WHERE length({value}) >= {least}")
    for kind, (_, pattern, needs, never, _, limit) in enumerate(secrets.CLASSES, len(secrets.BASE)):
        more.append(f"""
          SELECT *, {secrets.most_cost(limit)} AS most FROM
            (SELECT *, unnest(string_split_regex(value, '{secrets.ALLOWED}')) AS piece FROM ({_spans_sql(pattern, kind)}))
          WHERE length(piece) >= {secrets.WIDTH} AND regexp_matches(piece, '{needs}') AND NOT regexp_full_match(piece, '{never}')""")
    names = ", ".join(f"'{k}'" for k in secrets.KINDS)
    w = secrets.WIDTH
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(base)}),
candidates AS (SELECT *, row_number() OVER () AS id FROM ({" UNION ALL ".join(more)})),
windows AS (SELECT *, unnest(generate_series(1, length(piece) - {w - 1})) AS pos FROM candidates),
letters AS (SELECT doc_id, kind, s, value, most, id, pos, unnest(string_split(substr(piece, pos, {w}), '')) AS c FROM windows),
counted AS (SELECT doc_id, kind, s, value, most, id, pos, c, count(*) AS n FROM letters GROUP BY ALL),
summed AS (SELECT doc_id, kind, s, value, most, id, pos, sum(({list(secrets.costs())})[n + 1]) AS cost FROM counted GROUP BY ALL),
dense AS (SELECT doc_id, kind, value, s FROM summed GROUP BY doc_id, kind, s, value, most HAVING min(cost) <= most),
new AS (SELECT * FROM dense d WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = d.doc_id
  AND b.s < d.s + length(d.value) AND d.s < b.s + length(b.value))),
spans AS (SELECT *, ([{names}])[kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(value) AS BIGINT) AS span FROM
  (SELECT doc_id, kind, value, s FROM base UNION ALL SELECT doc_id, kind, value, s FROM new)),
listed AS (SELECT doc_id, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex,
  string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
  CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (doc_id)
"""


def _either_case(words: str) -> str:
    """Letters of either case by name: the other engine's own flag also folds non-ASCII letters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


@query("op6_secret_scan", _secrets_sql())
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents").select("doc_id", "text"))
    spans = F.col("_spans")
    return found.select(
        "doc_id",
        *[secrets.count_of(spans, kind).alias(f"n_{kind}") for kind, *_ in secrets.BASE],
        F.sha2(secrets.listed(spans, secrets.KINDS[: len(secrets.BASE)]), 256).alias("base_sha256"),
        secrets.listed(spans, secrets.KINDS).alias("spans"),
    )


CHAT_SQL = """
WITH told AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM told),
prefixes AS (SELECT conv_id, place, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY place) AS p,
  count(*) OVER (PARTITION BY conv_id) AS n FROM numbered),
whole AS (SELECT min(conv_id) AS conv_id, n, p FROM prefixes WHERE place = n GROUP BY n, p),
kept AS (SELECT conv_id, n FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefixes q WHERE q.place < q.n AND q.place = w.n AND q.p = w.p))
SELECT kept.conv_id, kept.n AS n_turns,
  string_agg('<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY place) AS text
FROM kept JOIN numbered USING (conv_id) GROUP BY kept.conv_id, kept.n
"""


@query("op1_chat_format", CHAT_SQL)
def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(table(spark, folder, "conversations"))


LINES_SQL = """
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
windows AS (SELECT doc_id, place - 1 AS place, l[place] AS a, l[place + 1] AS b, l[place + 2] AS c
  FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 2)) AS place FROM lines)),
firsts AS (SELECT *, min({'d': doc_id, 'p': place}) OVER (PARTITION BY a, b, c) AS f FROM windows WHERE trim(a || b || c) <> ''),
later AS (SELECT doc_id, place FROM firsts WHERE f <> {'d': doc_id, 'p': place}),
gone AS (SELECT DISTINCT doc_id, place + k AS place FROM later, (VALUES (0), (1), (2)) AS v(k)),
kept AS (SELECT doc_id, place, l[place + 1] AS line FROM (SELECT doc_id, l, unnest(generate_series(0, len(l) - 1)) AS place FROM lines)
  ANTI JOIN gone USING (doc_id, place)),
texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS t, count(*) AS n FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l), 0) - coalesce(n, 0) AS BIGINT) AS n_removed,
  CASE WHEN text IS NULL THEN NULL ELSE coalesce(t, '') END AS text
FROM lines LEFT JOIN texts USING (doc_id)
"""


@query("op5_line_dedup", LINES_SQL)
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = linedup.deduplicate(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines.before").alias("n_lines"), F.col("_lines.removed").alias("n_removed"), "text")


TOPK_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""


@query("op8_topk_search", TOPK_SQL)
def op8_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_jaccard_join")
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.join(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


@query("op7_language_model")
def op7_language_model(spark: SparkSession, folder: str) -> DataFrame:
    scored = language_model.score(table(spark, folder, "documents"))
    return scored.withColumn("held_out", language_model.held_out())


AUDIT_SQL = """
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
read AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
told AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
judged AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails FROM read LEFT JOIN told USING (doc_id)),
counted AS (SELECT part, fails, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM letters a, letters b, letters d, letters e, letters f
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
places AS (SELECT filter_order, CAST(step AS INTEGER) AS step, ascii(filter_order[step]) - 64 AS f,
  list_transform(string_split(filter_order[1:step - 1], ''), lambda x: ascii(x) - 64) AS earlier
  FROM orders, (SELECT unnest(generate_series(1, 5)) AS step)),
met AS (SELECT part, filter_order, step, f, n, good, toxic, fails[f] AS failing, fails,
  step > 1 AND len(list_filter(earlier, lambda x: coalesce(fails[x], false))) > 0 AS gone FROM counted, places),
stepped AS (SELECT part, filter_order, step, f,
  CAST(sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN failing AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN NOT gone AND failing AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN NOT gone AND failing AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM stepped
"""


@query("op13_filter_audit", AUDIT_SQL)
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def _licenses_sql() -> str:
    phrases = ", ".join(f"('{label}', string_split('{p}', ' '))" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"('{label}', list_distinct(string_split('{p}', ' ')))" for p, label in licenses.TEMPLATES.items())
    return rf"""
WITH read AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
phrases(label, line) AS (VALUES {phrases}),
templates(label, words) AS (VALUES {templates}),
starts AS (SELECT r, w, unnest(generate_series(0, len(w) - 1)) AS s FROM read),
places AS (SELECT r, s, label FROM starts JOIN phrases ON w[s + 1] = line[1] WHERE w[s + 1:s + len(line)] = line),
blocks AS (SELECT r, w[s + 1:s + {licenses.BLOCK}] AS b FROM starts WHERE s % {licenses.STRIDE} = 0),
met AS (SELECT r, label, len(list_intersect(words, b)) / len(words) AS share FROM blocks, templates
  WHERE len(list_intersect(words, b)) >= ceil(round({licenses.LEAST} * len(words), 9))),
base AS (SELECT r, count(*) AS n, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY r),
named AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM (SELECT r, label, 1.0 AS share FROM places UNION ALL SELECT * FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM read LEFT JOIN base USING (r) LEFT JOIN named USING (r)
"""


@query("op11_license_scan", _licenses_sql())
def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    return found.select(
        "row.doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        licenses.labels(base).alias("base_labels"),
        licenses.labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


RESAMPLING_SQL = f"""
WITH RECURSIVE told AS (
  SELECT 0 AS kind, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
read AS (SELECT kind, doc_id, r, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM told),
runs AS (SELECT kind, r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM read, (VALUES (1), (2), (3)) AS v(n)),
counted AS (SELECT kind, r, array_to_string(w[i:i + n - 1], ' ') AS feature, count(*) AS n FROM runs GROUP BY ALL),
bits AS (SELECT b, b AS c, 0 AS k FROM (SELECT unnest(generate_series(0, 255)) AS b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
lookup AS (SELECT b, c FROM bits WHERE k = 8),
hashed AS (SELECT DISTINCT feature, hex(encode(feature)) AS h, CAST(4294967295 AS BIGINT) AS c, 0 AS p FROM counted
  UNION ALL SELECT feature, h, xor(hashed.c >> 8, lookup.c), p + 1 FROM hashed
    JOIN lookup ON lookup.b = xor(hashed.c & 255, CAST('0x' || h[2 * p + 1:2 * p + 2] AS BIGINT)) WHERE 2 * p < length(h)),
buckets AS (SELECT feature, xor(c, 4294967295) % {resampling.BUCKETS} AS bucket FROM hashed WHERE 2 * p = length(h)),
placed AS (SELECT kind, r, bucket, sum(n) AS n FROM counted JOIN buckets USING (feature) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM placed GROUP BY bucket),
gains AS (SELECT bucket, floor({resampling.SCALE} * ln((t + 1.0::DOUBLE) * ((SELECT sum(s) FROM sums) + {resampling.BUCKETS})
  / ((s + 1.0::DOUBLE) * ((SELECT sum(t) FROM sums) + {resampling.BUCKETS})))) AS gain FROM sums),
weights AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM placed JOIN gains USING (bucket) WHERE kind = 0 GROUP BY r),
scored AS (SELECT doc_id, r, len(w) AS n_words, coalesce(weight, 0) AS weight,
    CAST(greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS BIGINT) AS n_features,
    coalesce(weight, 0) + CAST(floor(-{resampling.SCALE} * ln(-ln((CAST('0x' || substr(sha256('{resampling.SEED}:'
      || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM read LEFT JOIN weights USING (r) WHERE kind = 0),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_words >= {resampling.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {resampling.PERCENT} * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""


@query("op12_importance_resampling", RESAMPLING_SQL)
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select("row.doc_id", "n_features", "weight", "score", "rank")
