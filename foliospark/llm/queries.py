"""The thin registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, jaccard_join, language, line_dedup, mixing, neighbours, pii, quality, runs, secrets, sharding, toxicity, tries
from foliospark.llm.shared import WORD, fold, read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, fold("doc_id", 5) == 0).select("doc_id", "held_out", "score", quality.predicted(), "top_attention")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    spans = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return toxicity.score(docs, model, fold("doc_id", 5) == 0).select("doc_id", "held_out", "score", toxicity.predicted(), spans.alias("offending"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_components(docs, k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 3) == 1
    return language.identify(docs, held_out, language.learn_profiles(docs.where(~held_out)))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.rates(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("secrets")).alias("spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents whose crc32 ends in 0 go on from word g % n with the same few words; texts of others, and of null ids, stay."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", "text", (crc % 10 == 0).alias("chosen"), F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10").alias("g"))
    docs = docs.withColumn("words", F.when(F.col("chosen"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    turns = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    repeated = F.array_join(F.concat(F.slice("words", 1, F.col("a")), F.slice(turns, 1, left)), " ")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(planted(read(spark, sf_dir, "documents")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    longest = [column.cast("long").alias(name) for name, column in runs.longest().items()]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *longest, F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", sharding.size_of(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), sharding.key_of(F.col("text")).alias("key"))
    # Only ids and hashes move.
    done = sharding.shard_rows(rows, F.col("key"), F.lit(1), "doc_id", shards=8)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tries.conversation_trie(read(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_toxicity, op3_jaccard_join, op4_language, op5_mix_sources, op6_secrets, op7_line_dedup, op8_neighbours, op9_decontaminate, op10_pii,
        op11_runs, op12_shards, op13_conversation_trie,
    )
}

#: Words per text for DuckDB, whose regular expressions know the same class.
_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"

ORACLE_SQL = {
    "op3_jaccard_join": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS seen FROM sizes UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.seen)
SELECT s.doc_id, s.n_shingles, (SELECT min(seen) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id FROM sizes s
""",
    "op5_mix_sources": rf"""
WITH hashed AS (SELECT doc_id, source, {_SIZE} AS size, md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')), CASE WHEN source IS NULL THEN '' ELSE '=' || source END)) AS row_hash FROM documents),
sized AS (SELECT *, row_number() OVER (PARTITION BY row_hash) AS nth FROM hashed),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
run AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
  coalesce(sum(source_size * 3) OVER before, 0)::BIGINT AS capped,
  (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS w_left
  FROM sums WINDOW before AS (ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, (total - capped) * w >= source_size * 3 * w_left AS at_cap FROM run),
level AS (SELECT *, arg_min(capped, capped) FILTER (NOT at_cap) OVER () AS lc, arg_min(w_left, capped) FILTER (NOT at_cap) OVER () AS lw FROM capped),
goal AS (SELECT source, source_size, CASE WHEN at_cap THEN (source_size * 3)::DOUBLE ELSE (total - lc)::DOUBLE * w / lw END AS target FROM level),
rated AS (SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('17:' || s.row_hash || ':' || s.nth), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS coin
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
""",
    "op7_line_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.owner AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
""",
    "op13_conversation_trie": r"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS turns,
  xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) WHEN crc % 2 = 1 THEN xor(crc // 2, 3988292384) ELSE crc // 2 END), 4294967295) % 4 AS h
  FROM turns GROUP BY conv_id),
paths AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS path FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
steps AS (SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM paths),
nodes AS (SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends FROM steps GROUP BY ALL),
weighed AS (SELECT *, (n_convs - 1) * len(regexp_extract_all(CASE WHEN depth > 0 THEN node[depth].text ELSE '' END, '[^\x20\x09-\x0D]+')) AS saved, EXISTS (FROM nodes k WHERE k.depth = n.depth + 1 AND k.node[1:n.depth] = n.node) AS has_children FROM nodes n),
above AS (SELECT node[1:top] AS node, top, depth, saved, has_children FROM (SELECT *, unnest(range(depth + 1)) AS top FROM weighed)),
sums AS (SELECT node, sum(saved)::BIGINT AS saved_tokens, count_if(NOT has_children)::BIGINT AS n_leaves, count_if(depth = top + 1)::BIGINT AS n_children FROM above GROUP BY node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.node[1:n.depth - 1]
""",
}
