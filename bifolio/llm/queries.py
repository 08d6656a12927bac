"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_kmeans, byte_pairs, language_id, toxicity
from .common import crc_mod, table
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .phrase_mining import collocations
from .pii import find_pii
from .quality import quality_scores
from .sentence_pieces import round_trip
from .substring_dedup import remove_repeats
from .token_records import token_records


def tokenizer_file(name: str) -> str:
    """The path of one of the public tokenizer files that are installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("file", "row")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=lambda i: crc_mod(i, 5) != 0)
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.with_inertia(*ball_kmeans.clusters(table(spark, sf_dir, "embeddings")))


OP1_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - least(10, len(w)), 0) + 2)) AS r(i)
  WHERE len(w) > 0
), hit AS (
  SELECT d.k, p AS a, s.l AS l, array_to_string(d.w[p:p + s.l - 1], ' ') AS g
  FROM d, (SELECT DISTINCT l FROM bw) AS s, unnest(range(1, len(d.w) - s.l + 2)) AS r(p)
), found AS (
  SELECT hit.k, hit.a, hit.l, bw.item_id FROM hit JOIN bw ON hit.l = bw.l AND hit.g = bw.g
), covered AS (
  SELECT k, count(DISTINCT q) AS n_hit FROM found, unnest(range(a, a + l)) AS r(q) GROUP BY k
), items AS (
  SELECT k, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY k
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN items USING (k)
"""

OP4_SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, crc_mod(F.col("doc_id"), 3) != 1)
    found = language_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.build(*toxicity.examples(docs, labels, learn=lambda i: crc_mod(i, 3) != 1))
    found = toxicity.toxicity_scores(docs, index)
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.array_join("evidence", ",").alias("evidence"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) AS r(i)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM g) WHERE k > 1
), gone AS (
  SELECT doc_id, list(DISTINCT q) AS q FROM later, unnest(range(i, i + 20)) AS r(q) GROUP BY doc_id
), flat AS (
  SELECT doc_id, unnest(q) AS q FROM gone
), kept AS (
  SELECT s.doc_id, string_agg(s.x, ' ' ORDER BY s.p) AS t
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d) AS s
  LEFT JOIN flat ON flat.doc_id = s.doc_id AND flat.q = s.p
  WHERE flat.q IS NULL GROUP BY s.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(CAST(len(gone.q) AS BIGINT), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


OP6_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT k, md5(array_to_string(w[i:i + 2], ' ')) AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS r(i) WHERE len(w) > 0
), n AS MATERIALIZED (
  SELECT k, count(*) AS n FROM s GROUP BY k
), pairs AS (
  SELECT a.k AS a, b.k AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n AS x ON x.k = a JOIN n AS y ON y.k = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least_id AS (
  SELECT a AS k, min(doc_id) AS m FROM reach JOIN d ON d.k = reach.b GROUP BY a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, m) AS component_id
FROM d LEFT JOIN n USING (k) LEFT JOIN least_id USING (k)
"""


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x
  FROM documents
), w AS MATERIALIZED (
  SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM p
), total AS (
  SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang
), g AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
  FROM w, unnest(range(1, 6)) AS s(k), unnest(range(1, len(w) - k + 2)) AS r(i)
  GROUP BY lang, k, phrase HAVING count(*) >= 100
), cut AS (
  SELECT g.lang, g.phrase, g.k, g.f AS a, c, string_split(g.phrase, ' ') AS w FROM g, unnest(range(1, 5)) AS r(c) WHERE c < g.k
), scored AS (
  SELECT cut.lang, cut.phrase, cut.k, a, x.f AS l, y.f AS r, n, c, (1000 * a * n) // (x.f * y.f) AS score
  FROM cut JOIN total USING (lang)
  JOIN g AS x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:c], ' ')
  JOIN g AS y ON y.lang = cut.lang AND y.phrase = array_to_string(w[c + 1:], ' ')
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), kept AS (
  SELECT * FROM best AS b WHERE NOT EXISTS (
    SELECT 1 FROM g AS q WHERE q.lang = b.lang AND q.k > b.k AND 100 * q.f >= 100 * b.a AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""


def _kmeans_sql(size: int = 64, k: int = 16, rounds: int = 3) -> str:
    """One pair of subqueries a round: every vector with its nearest centroid, and the centroids after it."""
    steps = [
        f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda e: CAST(floor({size} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = {size}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id IS NULL, sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x AS y FROM v QUALIFY c < {k}
)"""
    ]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (
  SELECT i, min((d, c)) AS m FROM (
    SELECT i, c, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{t}
  ) GROUP BY i
)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (
  SELECT c, coalesce(new, y) AS y FROM c{t} LEFT JOIN (
    SELECT c, list(CAST(floor_mean AS BIGINT) ORDER BY p) AS new FROM (
      SELECT c, p, CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS floor_mean FROM (
        SELECT m[2] AS c, p, sum(x[p]) AS s, count(*) AS n FROM a{t} JOIN v USING (i), unnest(range(1, {size + 1})) AS r(p) GROUP BY ALL
      )
    ) GROUP BY c
  ) USING (c)
)""")
    return ", ".join(steps) + f"""
SELECT vec_id, CAST(m[2] AS INTEGER) AS cluster, CAST(m[1] AS BIGINT) AS distance,
       CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia, CAST(sum(m[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (i) JOIN c{rounds} ON c = m[2]
"""


OP13_SQL = _kmeans_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_token_records": op2_token_records,
        "op3_quality": op3_quality,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_language_id": op7_language_id,
        "op8_toxicity": op8_toxicity,
        "op9_pii": op9_pii,
        "op10_sentence_pieces": op10_sentence_pieces,
        "op11_byte_pairs": op11_byte_pairs,
        "op12_collocations": op12_collocations,
        "op13_ball_kmeans": op13_ball_kmeans,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": OP1_SQL,
        "op4_exact_dedup": OP4_SQL,
        "op5_substring_dedup": OP5_SQL,
        "op6_jaccard_join": OP6_SQL,
        "op12_collocations": OP12_SQL,
        "op13_ball_kmeans": OP13_SQL,
    }
