"""The registered queries of this subpackage, each over its whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaindex.llm import (
    ball_search, decontam, langid, licenses, minhash, packing, part_trees, pii, quality, rules, stream_packing, token_rollup,
    warc,
)
from areaindex.llm.common import scratch_path, table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _rules_sql() -> str:
    bits = " + ".join(f"CASE WHEN {condition} THEN {1 << i} ELSE 0 END" for i, (_, condition) in enumerate(rules.RULES))
    mask = rules.mask_of(rules.POLICIES["v2"])
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH texts AS (
  SELECT doc_id, text, regexp_extract_all(text, '{word}') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines
  FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, words FROM texts WHERE len(words) > 0),
windows AS (
  SELECT doc_id, pos, CASE WHEN pos + {rules.WINDOW - 1} <= len(words)
                           THEN list_slice(words, pos, pos + {rules.WINDOW - 1}) END AS win
  FROM starts),
counted AS (
  SELECT doc_id, pos, win IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS again FROM windows),
covered AS (
  SELECT doc_id, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (
           PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {rules.WINDOW - 1} PRECEDING AND CURRENT ROW) AS hit
  FROM counted),
repeats AS (SELECT doc_id, sum(hit) AS n FROM covered GROUP BY doc_id),
measured AS (
  SELECT doc_id, coalesce(len(words), 0) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) AS n_symbols,
         coalesce(len(lines) - len(list_distinct(lines)), 0) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, coalesce(len(lines), 0) AS n_lines,
         coalesce(len(list_filter(words, lambda w: regexp_matches(w, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]'))), 0) AS n_alpha_words,
         coalesce(length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')), 0) AS n_letters,
         coalesce(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')), 0) AS n_capitals,
         coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))), 0) AS n_bullet_lines
  FROM texts LEFT JOIN repeats USING (doc_id)),
failing AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed & {rules.mask_of(rules.BASE)} <> 0 AS base_failed, failed & {mask} = 0 AS kept, failed
FROM failing"""


@query("op4_rules", _rules_sql())
def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.ledger(table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.verdict("base")).alias("base_failed"), rules.verdict("v2").alias("kept"), "failed",
    )


def _ablations_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{policy}' AS policy, '{name}' AS rule, {rules.mask_of(rules.POLICIES[policy])} AS mask, {rules.mask_of([name])} AS bit"
        for policy in rules.POLICIES for name in rules.POLICIES[policy]
    )
    return f"""
WITH ledger AS ({_rules_sql()}), tried AS ({parts})
SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_only,
       count(*) FILTER (failed & mask = 0) AS n_kept, count(*) FILTER (failed & mask = 0 OR failed & mask = bit) AS n_kept_without
FROM ledger, tried GROUP BY policy, rule"""


@query("rule_ablations", _ablations_sql())
def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule costs under every policy version, from one ledger that is written once."""
    entries = written(rules.ledger(table(spark, sf_dir, "documents")).select("failed"), "ledger")
    tried = [rules.ablations(entries, policy).select(F.lit(policy).alias("policy"), "*") for policy in rules.POLICIES]
    return reduce(DataFrame.unionByName, tried)


@query("op5_minmax_dedup", """
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w]
                                      ELSE list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]) END) AS s
  FROM texts WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
rare AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS place
  FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS f FROM shingles)),
prefixes AS (SELECT doc_id, s, n FROM rare JOIN sizes USING (doc_id) WHERE place <= n - (80 * n + 99) // 100 + 1),
pairs AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb
  FROM prefixes a JOIN prefixes b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
shared AS (
  SELECT a, b, na, nb, count(*) AS i
  FROM pairs JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND x.s = y.s GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * i >= 80 * (na + nb - i)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(node, seen) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN edges e ON e.a = r.seen)
  SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN reach ON node = doc_id LEFT JOIN sizes USING (doc_id)""")
def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_vector_packing")
def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    digests = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(digests)


@query("op6_decontamination", r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS l FROM items WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, l, array_to_string(list_slice(w, s, s + l - 1), ' ') AS g
  FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM sized)),
grams AS (
  SELECT doc_id, l, s, array_to_string(list_slice(w, s, s + l - 1), ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s
        FROM docs, (SELECT DISTINCT l FROM sized) WHERE len(w) >= l)),
found AS (SELECT doc_id, item_id, s, l FROM grams JOIN wins USING (l, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM found) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)""")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def _license_sql() -> str:
    from areaindex.llm.license_rules import RULES

    values = ", ".join(
        f"({i}, '{r.keyword}', '^({r.pattern})( |$)', '{r.label}', {r.priority}, CAST({r.score} AS DOUBLE))"
        for i, r in enumerate(RULES)
    )
    reach = ", ".join(
        f"max(CASE WHEN priority <= {p} THEN stop END) OVER before AS reach{p}" for p in (1, 2, 3)
    )
    return rf"""
WITH rules(rule, keyword, pattern, label, priority, score) AS (VALUES {values}),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(0, len(w))) AS place FROM docs),
marked AS (
  SELECT doc_id, place, keyword, pattern, rule, label, priority, score,
         array_to_string(list_slice(w, place + 1, place + {licenses.REACH}), ' ') AS context
  FROM places JOIN rules ON keyword = w[place + 1]),
found AS (
  SELECT doc_id, place AS start, place + len(string_split(regexp_extract(context, pattern, 1), ' ')) AS stop,
         rule, label, priority, score
  FROM marked WHERE regexp_matches(context, pattern)),
reached AS (
  SELECT *, {reach} FROM found WINDOW before AS (
    PARTITION BY doc_id ORDER BY start, stop DESC, priority, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept AS (
  SELECT * FROM reached
  WHERE priority = 0 OR stop > coalesce(CASE priority WHEN 1 THEN reach1 WHEN 2 THEN reach2 ELSE reach3 END, -1)),
judged AS (
  SELECT doc_id, count(*) FILTER (priority = 0) AS n_base, min(start) FILTER (priority = 0) AS first_word,
         max(start) FILTER (priority = 0) AS last_word, max(score) AS score,
         array_to_string(list_sort(list(DISTINCT label) FILTER (priority = 0)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
  FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM docs LEFT JOIN judged USING (doc_id)"""


@query("op9_license_rules", _license_sql())
def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op10_warc_packages", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)""")
def op10_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        F.col("ident").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to",
    )


@query("op1_bilstm_pii")
def op1_bilstm_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2("base", 256)).drop("base")


@query("op7_crf_language")
def op7_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op2_site_quality")
def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_token_rollup")
def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are loaded under two tokenizers, copies of a text deleted, counts revised to hold an
    end token, and the load is sent once more, as after a failure."""
    docs = table(spark, sf_dir, "documents")
    counts = written(
        token_rollup.count_tokens(docs, {"words-1": None, "word_bpe_49k-1": vocabulary("word_bpe_49k.json")}), "counts"
    )
    digest = docs.select(F.col("doc_id").alias("doc"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    first = digest.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = written(digest.join(first, "digest").where("doc <> first").select("doc"), "copies")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rollup = token_rollup.TokenRollup(spark, scratch_path(spark, "rollup"), kind)
    load = counts.withColumn("action", F.lit(token_rollup.INSERT))
    rollup.apply("load", load)
    rollup.apply("copies", counts.join(copies, "doc").withColumn("action", F.lit(token_rollup.DELETE)))
    kept = counts.where("version = 'word_bpe_49k-1'").join(copies, "doc", "left_anti")
    rollup.apply("end-token", kept.withColumns({"action": F.lit(token_rollup.REVISE), "n_tokens": F.col("n_tokens") + 1}))
    rollup.apply("load", load)
    return rollup.totals()


@query("op12_sum_of_squares_packing")
def op12_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stream_packing.pack_stream(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def _codes_sql() -> str:
    squares = "CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = []
    for r in range(part_trees.ROUNDS + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT rn, p, min({{'d': d, 'e': e}}) AS best
  FROM (SELECT rn, p, e, {squares} AS d FROM parts JOIN books{r} USING (p)) GROUP BY rn, p)""")
        if r < part_trees.ROUNDS:
            steps.append(f"""
books{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m, c) AS c
  FROM books{r} LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m
    FROM (SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n
          FROM parts JOIN near{r} USING (rn, p), (SELECT unnest(range(1, w + 1)) AS i FROM (SELECT DISTINCT w FROM ints))
          GROUP BY ALL)
    GROUP BY p, e) USING (p, e))""")
    last = part_trees.ROUNDS
    return f"""
WITH ints AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS rn, len(embedding) // {part_trees.PARTS} AS w,
         list_transform(embedding, lambda x: CAST(floor({part_trees.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT rn, p, list_slice(v, p * w + 1, (p + 1) * w) AS x FROM ints, (SELECT unnest(range({part_trees.PARTS})) AS p)),
books0 AS MATERIALIZED (SELECT p, rn - 1 AS e, x AS c FROM parts WHERE rn <= {part_trees.ENTRIES}),{",".join(steps)},
coded AS (
  SELECT rn, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{last} GROUP BY rn),
digest AS (
  SELECT sha256(string_agg(v, ',' ORDER BY p, e)) AS codebooks_sha256
  FROM (SELECT p, e, array_to_string(list_transform(c, lambda y: CAST(y AS VARCHAR)), ',') AS v FROM books{last}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN ints USING (rn), digest"""


@query("op13_anchor_tree_codes", _codes_sql())
def op13_anchor_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = part_trees.compress(table(spark, sf_dir, "embeddings"))
    return coded.select(
        F.col("key").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"),
    )


@query("op11_ball_tree_search", r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
asked AS (
  SELECT item_id, t, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY ALL),
sizes AS (SELECT doc_id, len(words) AS n FROM docs WHERE len(words) > 0),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
spread AS (SELECT doc_id, 100 - 75 + (75 * n * n_docs) // n_terms AS m FROM sizes, corpus),
held AS (
  SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS t FROM docs)
  WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, corpus GROUP BY t, n_docs),
scored AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (t) JOIN held USING (t) JOIN spread USING (doc_id) GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 10""")
def op11_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
