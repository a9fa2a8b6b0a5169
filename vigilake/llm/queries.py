"""The operators' registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm import (
    bisectors,
    decontaminate,
    language,
    line_dedup,
    mixing,
    neighbours,
    secrets,
    set_join,
    simhash,
    substrings,
    toxicity,
    url_filter,
    whitening,
)
from vigilake.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


@query("op1_nearest_neighbours")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), is_query=F.col("vec_id") % 100 == 0)


@query("op2_toxicity")
def _(spark: SparkSession, folder: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    scored = toxicity.score_toxicity(
        table(spark, folder, "documents"), table(spark, folder, "labels"), learn=fold.isin(0, 3), calibrate=fold == 1,
    )
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op3_simhash_dedup")
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@query("op5_suffix_dedup")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


# The rules of the contract.
URL_RULES = {
    "com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block",
}


@query("op4_url_filter")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, folder, "pages"), URL_RULES)


@query("op6_language_id")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    filters = language.fit(docs, "doc_id", "text", "lang", allowed=~held_out(F.col("doc_id")))
    return language.predict(docs.select("doc_id", "text"), filters, F.col("text")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


@query("op7_source_mixing")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies"
    )


@query("op8_line_dedup", r"""
    WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    numbered AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM parts),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM numbered),
    repeated AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
                  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
    marked AS (SELECT doc_id, pos, line, r.k IS NOT NULL AND doc_id <> keeper AS gone
                 FROM keyed LEFT JOIN repeated r USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
      FROM marked GROUP BY doc_id""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


@query("op9_decontaminate", r"""
    WITH low AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
    items AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
    starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS t, least(len(w), 10) AS n FROM starts),
    lengths AS (SELECT DISTINCT n FROM windows),
    spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, lengths WHERE len(w) >= n),
    placed AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM spots),
    hits AS (SELECT doc_id, i, p.n, item_id FROM placed p JOIN windows USING (t, n)),
    marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
    named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                     string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
      FROM low LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op10_secret_scan")
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


@query("op11_jaccard_join", r"""
    WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0),
    tokens AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS t FROM starts),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
    met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM tokens a JOIN tokens b USING (t)
              JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
             WHERE a.doc_id < b.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY 1, 2),
    links AS MATERIALIZED (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
                            WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(a, b) AS (SELECT doc_id, doc_id FROM words UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM words LEFT JOIN sizes USING (doc_id)
      JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return set_join.join_sets(table(spark, folder, "documents")).select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id"
    )


@query("op12_embedding_whitening")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def _clustering_sql(k: int, rounds: int) -> str:
    """Rounds of assignment and floored means, one statement each."""
    nearest = """
        SELECT vec_id, v, unnest(arg_min({{c: c, d: d}}, (d, c))) FROM (
            SELECT vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - w[i]) * (v[i] - w[i])))::BIGINT AS d
              FROM kept, c{r}) GROUP BY vec_id, v"""
    steps = ["""kept AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
         WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR)) - 1 AS c, v AS w
                     FROM kept QUALIFY c < {k})"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(r=r)})")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
                SELECT c0.c, coalesce(m.w, o.w) AS w FROM c0 JOIN c{r} o ON o.c = c0.c LEFT JOIN (
                    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS w FROM (
                        SELECT c, i, sum(x) AS s, count(*) AS n
                          FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) m
                  ON m.c = c0.c)""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
               sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
          FROM a{rounds} a JOIN c{rounds} f ON f.c = a.c"""


@query("op13_centroid_clusters", _clustering_sql(8, 10))
def _(spark: SparkSession, folder: str) -> DataFrame:
    return bisectors.cluster_vectors(table(spark, folder, "embeddings")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
