"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.llm import (
    chat, decontamination, language, merkle, mixing, neardup, quality, repeats, secrets, sharding,
    simhash, warc, whitening,
)
from perilscope.session import run_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SHARDS = [f"shard-{i:03d}" for i in range(64)]


def sharding_sql() -> str:
    """The filled table as two hexadecimal digits a slot; the placement is worked out in SQL."""
    slots = "".join(f"{s:02x}" for s in sharding.fill_table(SHARDS))
    return f"""
WITH placed AS (
  SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {len(slots) // 2})::INT
    AS slot FROM documents
), filled AS (SELECT '{slots}' AS t)
SELECT doc_id, slot, ('0x' || substr(t, slot * 2 + 1, 2))::INT AS shard FROM placed, filled
"""


@query(sharding_sql())
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return sharding.place(docs, ["doc_id"], SHARDS).select("doc_id", "slot", "shard")


#: Sources of weight 5 are read evenly, those of weight 2 more towards the end, those of
#: weight 1 more at the beginning.
CURVES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
    ((0.0, 1.5), (1.0, 0.5)),
)


@query()
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = mixing.sizes_only(table(spark, folder, "documents"), "doc_id", "source", "text")
    mixed = mixing.assign(docs, (5, 2, 1), CURVES, sized="words")
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.get("positions", F.lit(0)).alias("position"),
        F.get("positions", F.lit(1)).alias("position_again"),
    ).orderBy(F.asc_nulls_last("position"), "doc_id")


@query()
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    planned = warc.plan_records(table(spark, folder, "pages"), "page_id", "url", "html")
    at = run_folder(spark, "archives")
    written = warc.write_archives(planned, at)
    records = warc.read_archives(spark, at, written, with_payload=False)
    return records.select(
        warc.page_of("record_id").cast("bigint").alias("page_id"),
        "payload_bytes", "payload_digest", "record_type",
        warc.page_of("refers_to_id").cast("bigint").alias("refers_to"),
    )


ORACLES["op6_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), g AS (
  SELECT html, min(page_id) AS first_id FROM p GROUP BY html
), d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, first_id
  FROM p JOIN g USING (html)
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, ((i * 5) // 4)::INT + 1, 2))::INT >> (3 - ((i * 5) % 4)::INT)) & 31) + 1,
    1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

ORACLES["op5_mixing"] = """
WITH d AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS n,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i
  FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(i % 3)::INT + 1] AS weight,
    sum(n) OVER () AS total
  FROM s
), o AS (  -- sources stop at their limit in the order of size per weight
  SELECT *, row_number() OVER (ORDER BY n::DOUBLE / weight, i) AS k,
    sum(n) OVER (ORDER BY n::DOUBLE / weight, i) AS n_to,
    sum(weight) OVER (ORDER BY n::DOUBLE / weight DESC, i DESC) AS w_from
  FROM w
), c AS (
  SELECT *, (3 * total - 4 * (n_to - n)) * weight > 4 * n * w_from AS above FROM o
), l AS (
  SELECT (3 * any_value(total) - 4 * coalesce(sum(n) FILTER (above), 0)) AS twice_left,
    sum(weight) FILTER (NOT above) AS w_left FROM c
), t AS (
  SELECT source, i, n::BIGINT AS source_size,
    CASE WHEN above THEN 2.0::DOUBLE * n::DOUBLE
      ELSE (twice_left * weight)::DOUBLE / (2 * w_left)::DOUBLE END AS target
  FROM c, l
), r AS (
  SELECT doc_id, size, h, i, source_size, target, floor(target + 0.5)::BIGINT AS budget,
    (sum(size) OVER (PARTITION BY i ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)
      - size)::BIGINT AS begun
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, CASE WHEN size > 0 THEN (budget // source_size) * size
      + greatest(least(budget % source_size - begun, size), 0) ELSE 0 END::BIGINT AS taken
  FROM r
), seg AS (
  SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE),
    (1, 0.0, 0.0, 0.5, 1.0, 1.0), (1, 0.375, 0.5, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 1.5, -1.0, 1.0))
    AS v(kind, d0, t0, w0, slope, whole)
), p AS (
  SELECT k.*, e.e, (begun + e.e * source_size)::DOUBLE AS c FROM k, (VALUES (0), (1)) e(e)
  WHERE size > 0 AND e.e * size < taken
), q AS (
  SELECT p.*, t0, w0 * target AS rate, slope * target AS slope, c - d0 * target AS need,
    row_number() OVER (PARTITION BY doc_id, e ORDER BY t0 DESC) AS last
  FROM p JOIN seg ON kind = i % 3 AND d0 * target <= c
), x AS (
  SELECT doc_id, e, least(t0 + CASE WHEN need > 0
    THEN need * 2.0 / (rate + sqrt(greatest(rate * rate + slope * need * 2.0, 0.0))) ELSE 0.0 END,
    1.0::DOUBLE) AS position
  FROM q WHERE last = 1
)
SELECT k.doc_id, size, source_size, target, taken, a.position, b.position AS position_again
FROM k LEFT JOIN x a ON a.doc_id = k.doc_id AND a.e = 0
  LEFT JOIN x b ON b.doc_id = k.doc_id AND b.e = 1
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BENCHMARK_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)


@query(f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {BENCHMARK_WORDS} AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, {BENCHMARK_WORDS} AS w FROM benchmark
), g AS (
  SELECT DISTINCT item, least(len(w), 13) AS n,
    unnest(list_transform(range(0, len(w) - least(len(w), 13) + 1),
      lambda i: array_to_string(w[i + 1:i + least(len(w), 13)], ' '))) AS gram
  FROM b WHERE len(w) > 0
), dw AS (
  SELECT rid, n, unnest(range(0, len(w) - n + 1)) AS i,
    unnest(list_transform(range(0, len(w) - n + 1),
      lambda i: array_to_string(w[i + 1:i + n], ' '))) AS gram
  FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n
), hit AS (
  SELECT rid, item, i, n FROM dw JOIN g USING (n, gram)
), places AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)
""")
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.report(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


#: Texts that look like the marks of the template.
ODD_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query(r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, len(regexp_extract_all(text,
      '<\\*/?s>|\[\\*/?INST\]|\[\\*/?ROLE\]|\[\\*TEXT\]')) + length(text) AS t,
    len(regexp_extract_all(role,
      '<\\*/?s>|\[\\*/?INST\]|\[\\*/?ROLE\]|\[\\*TEXT\]')) + length(role) AS r
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  sum(t + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 4 ELSE r + 26 END)::BIGINT
    AS formatted_chars
FROM e GROUP BY conv_id
""")
def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame(ODD_CONVERSATION, "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(odd)))


@query()
def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.scan(docs).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] < len(secrets.PATTERNS))

    def count(kind: int):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("secrets")).alias("spans"),
    )


@query()
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rated = quality.rate(docs.select("doc_id", "text"), table(spark, folder, "labels"))
    return rated.select("doc_id", *quality.MEASURES, "score", "base_failed", "kept")


def held_out(id: str = "doc_id"):
    """Documents that no language model learns from."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query()
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~held_out()))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte"
    )


@query()
def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, rules=neardup.Rules(width=4))


@query()
def op3_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.summary(table(spark, folder, "documents").select("doc_id", "text"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: The bits of a byte are taken one by one; DuckDB has no CRC-32.
CRC32 = """xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''),
      lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END),
    4294967295::BIGINT), 4294967295::BIGINT)"""


def _level_sql(name: str, leaves: str) -> str:
    """All nodes above the ``leaves`` (tree, pos, digest) of binary trees, level by level."""
    return f"""{name} AS (
  SELECT tree, pos, digest, 0 AS level, count(*) OVER (PARTITION BY tree) AS size FROM {leaves}
  UNION ALL
  SELECT tree, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), any_value(level) + 1,
    (any_value(size) + 1) // 2
  FROM {name} WHERE size > 1 GROUP BY tree, pos // 2
)"""


def _path_sql(name: str, nodes: str) -> str:
    """The siblings on the way from each leaf to the root: those of the odd places stand left."""
    return f"""{name} AS (
  SELECT a.tree, a.pos, n.level, (a.pos >> n.level) & 1 AS slot, coalesce(s.digest, '') AS sibling
  FROM {nodes} a JOIN {nodes} n
    ON n.tree = a.tree AND n.pos = a.pos >> n.level AND n.size > 1
  LEFT JOIN {nodes} s ON s.tree = n.tree AND s.level = n.level AND s.pos = xor(n.pos, 1::BIGINT)
  WHERE a.level = 0
)"""


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}, '-')"


def _leaf_sql(n_chars: str = "n_chars") -> str:
    return f"sha256({' || '.join(_field_sql(n_chars if f == 'n_chars' else f) for f in FIELDS)})"


@query(f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql()} AS digest,
    CASE WHEN {CRC32} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql()} END AS tampered,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
  FROM documents
),
{_level_sql("nodes", "leaves")},
subroots AS (
  SELECT '' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS pos
  FROM nodes WHERE size = 1
),
{_level_sql("tops", "subroots")},
{_path_sql("low", "nodes")},
{_path_sql("high", "tops")},
steps AS (
  SELECT tree, pos, level, slot, sibling FROM low
  UNION ALL
  SELECT l.tree, l.pos, 1000 + h.level, h.slot, h.sibling
  FROM leaves l JOIN subroots r ON r.name = l.tree JOIN high h ON h.pos = r.pos
),
proofs AS (
  SELECT tree, pos, string_agg(sibling, '' ORDER BY level) AS proof,
    list(struct_pack(slot := slot, sibling := sibling) ORDER BY level) AS path
  FROM steps GROUP BY tree, pos
),
folds AS (
  SELECT tree, pos, tampered AS node, coalesce(path, []) AS path, 1 AS k
  FROM leaves LEFT JOIN proofs USING (tree, pos)
  UNION ALL
  SELECT tree, pos, sha256(CASE WHEN path[k].slot = 1 THEN path[k].sibling || node
    ELSE node || path[k].sibling END), path, k + 1
  FROM folds WHERE k <= len(path)
)
SELECT doc_id, l.digest AS leaf, r.digest AS subroot, t.digest AS root,
  sha256(coalesce(proof, '')) AS proof_sha256, node AS folded_root, node = t.digest AS verified
FROM leaves l JOIN subroots r ON r.name = l.tree JOIN tops t ON t.size = 1
  JOIN folds f ON f.tree = l.tree AND f.pos = l.pos AND f.k = len(f.path) + 1
  LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos
""")
def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(*FIELDS)
    changed = [F.col("n_chars") + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(hit, merkle.leaf(changed)).alias("tampered")
    rows = merkle.manifest(docs, fields=FIELDS, more=[tampered])
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(merkle.siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query()
def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs)


@query()
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"))


ORACLES["op1_near_duplicates"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(0, len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' ')) END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * k >= 80 * (x.n + y.n - k)
), t AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, t.b FROM reach r JOIN t ON r.b = t.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

ORACLES["op3_repeats"] = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n
  FROM documents
), k AS (
  SELECT doc_id, lo, least(512, n - 99 - lo) AS m, substr(h, (2 * lo + 1)::INT, 1222) AS piece
  FROM (SELECT *, unnest(range(0, n - 99, 512)) AS lo FROM d WHERE n >= 100)
), w AS (
  SELECT doc_id, lo + i AS p, md5(substr(piece, (2 * i + 1)::INT, 200)) AS g
  FROM (SELECT *, unnest(range(0, m)) AS i FROM k)
), r AS (
  SELECT doc_id, p FROM w
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1
), e AS (
  SELECT doc_id, p,
    CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new
  FROM r
), s AS (
  SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM e
), spans AS (
  SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM s GROUP BY doc_id, run
), removed AS (
  SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last
  FROM spans GROUP BY doc_id
), gaps AS (
  SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS lo, lo AS hi FROM spans
  UNION ALL SELECT doc_id, coalesce(last, 0), n FROM d LEFT JOIN removed USING (doc_id)
), kept AS (
  SELECT doc_id, string_agg(substr(h, (2 * lo + 1)::INT, (2 * (hi - lo))::INT), '' ORDER BY lo) AS kept
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""
