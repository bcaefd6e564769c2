"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import documents, finished, settle, small_batches


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; the package that holds them is a parameter of the install."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.quality import graded

    return graded(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op5_seekable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.frames import read_frames, write_frames

    return read_frames(write_frames(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=2))


def op3_suffix_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.substrings import remove_repeats

    return finished(lambda: remove_repeats(documents(spark, sf_dir)), "repeats-removed")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.media import feature_text, fingerprint, to_wav

    media = settle(to_wav(documents(spark, sf_dir)), "media")  # the media column, stored and read back
    return fingerprint(media).withColumn("feature", feature_text(F.col("codes"), F.col("times")))


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.weighted import compare_with_next

    return compare_with_next(documents(spark, sf_dir))


def op7_bootstrapped_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.private import KINDS, find, span_text

    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return finished(lambda: find(documents(spark, sf_dir)).select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.concat("base", "added")).alias("spans"), "n_revealed"), "personal-data")


def op8_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.mixing import keyed, mix, stops, word_count

    rows = documents(spark, sf_dir).select(F.monotonically_increasing_id().alias("_row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = keyed(settle(rows, "mix-sizes"))
    mixed = mix(sized, stops(sized), F.col("size"), key_col="_key")
    return mixed.select("doc_id", "size", "_mix.source_size", "_mix.target", (F.col("size") * F.col("_mix.copies")).alias("taken"))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.minhash import near_duplicates

    return finished(lambda: near_duplicates(documents(spark, sf_dir)).drop("stands"), "near-duplicates")


def op10_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.toxicity import toxicity

    # a row without an id has no label to learn from, and is not held out either
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    scored = toxicity(documents(spark, sf_dir), labels, F.col("toxic"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.conversations import prefix_trie, rebuilt

    small_batches(spark)
    def build() -> DataFrame:
        turns, ids = rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
        return prefix_trie(turns, ["own", "rank"], ids)

    return finished(build, "trie")


def op12_pigeonhole_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.simhash import near_duplicates

    return finished(lambda: near_duplicates(documents(spark, sf_dir)), "fingerprint-groups")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.periodic import looped, periodic_runs

    docs = documents(spark, sf_dir)
    return periodic_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))).drop("n_words")


QUERIES = {f.__name__: f for f in (op1_ordinal_quality, op2_sum_of_squares_packing, op3_suffix_tree_repeats, op4_media_columns, op5_seekable_frames, op6_weighted_sampling, op7_bootstrapped_contexts, op8_pareto_mixing, op9_circulant_minhash, op10_noisy_channel_toxicity, op11_prefix_trie, op12_pigeonhole_simhash, op13_periodic_runs)}
OP8_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM per_source
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM weighted
), fill AS (
  SELECT arg_min(level, source_size::DOUBLE / weight) AS level FROM levels WHERE level * weight < 2 * source_size
), targets AS (
  SELECT source, source_size, least(coalesce(fill.level * weight, 2.0 * source_size)::DOUBLE, (2 * source_size)::DOUBLE) AS target FROM levels, fill
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS certain FROM targets
), lefts AS (
  SELECT *, target - certain * source_size AS "left" FROM parts
), classes AS (
  SELECT source, length(bin(size)) AS class, sum(size)::BIGINT AS words FROM sized GROUP BY ALL
), rated AS (
  SELECT c.*, l."left",
    coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS held,
    sum(class * words) OVER (PARTITION BY c.source ORDER BY class DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS mass
  FROM classes c JOIN lefts l ON c.source IS NOT DISTINCT FROM l.source
), rates AS (
  SELECT source, coalesce(arg_max(rate, class) FILTER (rate * class < 1), 0.0) AS rate
  FROM (SELECT *, CASE WHEN mass > 0 THEN ("left" - held) / mass ELSE 0.0 END AS rate FROM rated) GROUP BY source
), drawn AS (
  SELECT s.*, l.source_size, l.target, l.certain, l."left", least(1.0::DOUBLE, rate * length(bin(size))) AS p,
    (('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN lefts l ON s.source IS NOT DISTINCT FROM l.source JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
), ranked AS (
  SELECT *, CASE WHEN size = 0 THEN NULL WHEN p >= 1 THEN 0.0 WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM drawn
), summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM ranked WHERE q IS NOT NULL
), stops AS (
  SELECT source, max(q) AS stop FROM summed WHERE sofar + size / 2.0 <= "left" GROUP BY source
)
SELECT r.doc_id, r.size, r.source_size, r.target, (r.size * (r.certain + CASE WHEN r.q <= s.stop THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked r LEFT JOIN stops s ON r.source IS NOT DISTINCT FROM s.source
"""

OP3_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k FROM d, unnest(generate_series(1, len(w) - 34)) t(i)
), repeated AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1
), words AS (
  SELECT r, i, w[i] AS word FROM d, unnest(generate_series(1, len(w))) t(i)
), marked AS (
  SELECT words.*, count(repeated.i) OVER (PARTITION BY words.r ORDER BY words.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM words LEFT JOIN repeated ON words.r = repeated.r AND words.i = repeated.i
), kept AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM marked GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

OP9_SQL = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) t(i) WHERE len(w) > 0
), sizes AS (
  SELECT r, count(*) AS n FROM shingles GROUP BY r
), shared AS (
  SELECT a.r AS x, b.r AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * c >= 75 * (p.n + q.n - c)
), reached AS (
  SELECT r, r AS m FROM d UNION SELECT reached.r, links.y FROM reached JOIN links ON links.x = reached.m
), groups AS (
  SELECT reached.r, min(o.doc_id) AS component_id FROM reached JOIN d o ON o.r = reached.m GROUP BY reached.r
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN groups USING (r) LEFT JOIN sizes USING (r)
"""

#: crc32 of an id in decimal, bit by bit: a byte comes with the first of its eight steps.
CRC32 = """xor(list_reduce(flatten(list_transform(range(1, len({0}::VARCHAR) + 1), lambda i: [ascii(({0}::VARCHAR)[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
  lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 3988292384) ELSE xor(a, x) >> 1 END, 4294967295), 4294967295)"""

OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, {CRC32.format("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT ids.conv_id, 1 AS own, r, role, text FROM ids JOIN turns ON turns.conv_id = ids.conv_id AND r > h
  UNION ALL SELECT ids.conv_id, 0, r, role, text FROM ids JOIN turns ON turns.conv_id = ids.conv_id - ((ids.conv_id % 5) + 5) % 5 AND r <= h
), paths AS (
  SELECT ids.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY own, r) FILTER (role IS NOT NULL), []) AS path FROM ids LEFT JOIN rebuilt USING (conv_id) GROUP BY ids.conv_id
), nodes AS (
  SELECT d AS depth, path[1:d] AS node, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = d) AS ends
  FROM paths, unnest(generate_series(0, len(path))) t(d) GROUP BY d, path[1:d]
), below AS (
  SELECT up.depth, up.node, count(*) AS n_children FROM nodes up JOIN nodes down ON down.depth = up.depth + 1 AND down.node[1:up.depth] = up.node GROUP BY ALL
), known AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(node[depth].text) ELSE 0 END AS saved FROM nodes LEFT JOIN below USING (depth, node)
), sums AS (
  SELECT d AS depth, node[1:d] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM known, unnest(generate_series(0, depth)) t(d) GROUP BY d, node[1:d]
)
SELECT k.conv_id, k.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
FROM known k JOIN sums USING (depth, node) LEFT JOIN nodes up ON up.depth = k.depth - 1 AND up.node = k.node[1:k.depth - 1]
"""

OP13_SQL = f"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, {CRC32.format("doc_id")} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), placed AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split
), words AS (
  SELECT r, n, i, CASE WHEN i < a OR a IS NULL THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END AS word
  FROM placed, unnest(generate_series(0, n - 1)) t(i)
), equal AS (
  SELECT x.r, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT r, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS island FROM equal) GROUP BY r, p, island HAVING count(*) + p >= greatest(6, 4 * p)
), runs AS (
  SELECT r, start, length, min(p) AS period FROM stretches GROUP BY r, start, length
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.r = words.r AND words.i >= runs.start + runs.period AND words.i < runs.start + runs.length) GROUP BY r
), per_text AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
    arg_min({{'start': start, 'length': length, 'period': period}}, {{'l': -length, 's': start, 'p': period}}) AS best FROM runs GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM placed LEFT JOIN per_text USING (r) LEFT JOIN kept USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op3_suffix_tree_repeats": OP3_SQL, "op8_pareto_mixing": OP8_SQL, "op9_circulant_minhash": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op13_periodic_runs": OP13_SQL}
