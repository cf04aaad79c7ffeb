"""The queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrail.llm import distinctive, grid_clusters, leakage, multi_index, near_duplicates, packing, records, residue, splitting
from vectrail.session import settle, table


def _alike(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, DataFrame]]:
    """(kind, pairs of representatives, members of classes) of documents and nodes."""
    docs, nodes = table(spark, sf_dir, "documents"), table(spark, sf_dir, "nodes")
    texts = near_duplicates.similar_texts(docs, k=3, similarity=0.6, least=40, counted=False, n_bands=40, rows=4)
    return [("document", *texts), ("node", *near_duplicates.similar_vectors(records.usable_nodes(nodes), cosine=0.98))]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [near_duplicates.expanded(*found).select(F.lit(k).alias("rec_kind"), "id_a", "id_b") for k, *found in _alike(spark, sf_dir)]
    return kinds[0].unionByName(kinds[1])


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links as one row for each record: its class of copies, their number, and the classes alike to it."""
    kinds = [near_duplicates.class_rows(*found).select(F.lit(k).alias("rec_kind"), "rec_id", "class_id", "class_size", "links") for k, *found in _alike(spark, sf_dir)]
    return kinds[0].unionByName(kinds[1])


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts whose multisets of five-word shingles overlap by 0.8 or more."""
    return near_duplicates.groups(table(spark, sf_dir, "documents"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes form many small groups, each of which should have centroids of its own; entries a few dozen large ones. Usable
    rows are found once, and the nodes' result is written before the entries' search begins, so that the disk needn't hold what
    all of it shuffles."""
    nodes, entries = table(spark, sf_dir, "nodes"), table(spark, sf_dir, "ivf_entries")
    fine = multi_index.codebook_size(nodes.count())
    usable = settle(records.usable_nodes(nodes), "imi-usable-nodes")
    count, fit = multi_index.sampled(usable, "rec_id", 8 * fine)
    near = multi_index.nearest_neighbours(usable, count, fit, 5, True, fine, multi_index.visits_for(count, fine))
    near = settle(near.select("rec_id", "neighbor_id"), "imi-nodes")
    lists = multi_index.large_groups(entries.count())
    points = settle(records.usable_entries(entries), "imi-usable-entries")
    many, sample = multi_index.sampled(points, "rec_id", 250 * lists)
    close = multi_index.nearest_neighbours(points, many, sample, 5, False, lists, 4.0)
    kinds = [d.select(F.lit(k).alias("rec_kind"), "rec_id", "neighbor_id") for k, d in (("node", near), ("entry", close))]
    return kinds[0].unionByName(kinds[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = splitting.split_oversized(table(spark, sf_dir, "documents"), limit=2000, overlap=200, with_text=False)
    return cut.where("piece_no = 0").select("doc_id", "boundary")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "documents"), limit=2000, overlap=200).drop("boundary")


def p3_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each text amount to: its own digest when put together without their overlaps, whether none exceeds
    the limit, and whether each repeats the last 200 characters of the one before."""
    cut = splitting.split_oversized(table(spark, sf_dir, "documents"), limit=2000, overlap=200)
    shared = F.when(F.col("piece_no") == 0, 0).otherwise(200)
    rows = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "piece", "length", "start", shared.alias("shared")))).alias("p"))
    whole = F.concat_ws("", F.transform("p", lambda z: F.substring(z["piece"], z["shared"] + 1, z["length"])))
    again = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.substring(F.col("p")[i - 1]["piece"], -200, 200) == F.substring(F.col("p")[i]["piece"], 1, 200))
    return rows.select("doc_id", F.md5(whole).alias("rebuilt"), F.forall("p", lambda z: (z["length"] <= 2000) & (F.length(z["piece"]) == z["length"])).alias("within"), again.alias("overlapping"))


RARE = {"min_tf": 3, "pattern": "[a-z]{6,}", "min_df": 2, "max_df": 12}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored terms that meet the problem's conditions, which are on counts: a term without a score is none."""
    texts = distinctive.distinctive_in_texts(table(spark, sf_dir, "documents"), **RARE)
    posted = records.current_postings(table(spark, sf_dir, "postings")).withColumnRenamed("node_id", "rec_id")
    nodes = distinctive.distinctive_in_counts(posted, **RARE)
    kinds = [d.where("z is not null").select(F.lit(k).alias("rec_kind"), "rec_id", "term") for k, d in (("document", texts), ("node", nodes))]
    return kinds[0].unionByName(kinds[1])


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The z-scores of all terms of all nodes."""
    posted = records.current_postings(table(spark, sf_dir, "postings")).withColumnRenamed("node_id", "rec_id")
    return distinctive.distinctive_in_counts(posted).select("rec_id", "term", "tf", "df", F.round("log_odds", 6).alias("log_odds"), F.round("z", 6).alias("z"))


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five terms that are most distinctive of each document, by z-score (ties to the smaller term)."""
    scored = distinctive.distinctive_in_texts(table(spark, sf_dir, "documents"))
    order = Window.partitionBy("rec_id").orderBy(F.desc(F.round("z", 9)), "term")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 5)
    return best.select(F.col("rec_id").alias("doc_id"), "rank", "term", "tf", "df", F.round("log_odds", 6).alias("log_odds"), F.round("z", 6).alias("z"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = records.usable_entries(table(spark, sf_dir, "ivf_entries"))
    return grid_clusters.clusters(points, reach=2.0, least=10).select(F.col("rec_id").alias("entry_id"), "cluster_id")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = records.usable_entries(table(spark, sf_dir, "ivf_entries"))
    return grid_clusters.described(points, reach=2.0, least=10).select("cluster_id", "size", "rank", F.col("rec_id").alias("entry_id"), F.round("distance", 6).alias("distance"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_texts(table(spark, sf_dir, "documents"), capacity=2048)
    return packed.select(F.col("item_id").alias("doc_id"), "part", "size", "bin_id", "kind")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), least=12)
    return found.select("doc_id", "item_id")


def p7_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold most of an item in order, with words changed in between: at least 15 words in common, in order,
    and half of the item's telling words."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), least=15, gap=2, cosine=0.45)
    kept = found.where("lcs >= 15 and answer >= 0.5")
    return kept.select("doc_id", "item_id", F.round("similarity", 4).alias("similarity"), "run", "lcs", F.round("answer", 4).alias("answer"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id")


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = residue.residue(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "kind", F.round("share", 4).alias("share"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_roundtrip": p3_roundtrip,
    "p4_found": p4_found,
    "p4_scores": p4_scores,
    "p4_terms": p4_terms,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p6_containers": p6_containers,
    "p7_found": p7_found,
    "p7_paraphrases": p7_paraphrases,
    "p8_found": p8_found,
    "p8_kinds": p8_kinds,
}

# ---- the same in SQL (DuckDB), where whole tables are not too slow for it

_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: strlen(t) >= 2)"
_USABLE_NODES = """SELECT node_id, e, list_transform(e, lambda x: x / n) AS u FROM (SELECT node_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (
  SELECT node_id, arg_max(embedding, updated_at)::DOUBLE[] AS e FROM nodes GROUP BY 1) WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0) WHERE n > 0"""
_POSTED = "(SELECT node_id AS rec_id, lower(term) AS term, arg_max(tf, indexed_at)::BIGINT AS tf FROM (SELECT * FROM postings WHERE node_id IS NOT NULL AND term IS NOT NULL) GROUP BY 1, 2)"
_TEXTS = f"(SELECT doc_id AS rec_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents) GROUP BY 1, 2)"

_SCORED = """r AS (SELECT rec_id, term, tf::DOUBLE AS y, tf FROM {0} WHERE tf >= 1), l AS (SELECT rec_id, sum(y) AS len FROM r GROUP BY 1),
      t AS (SELECT term, sum(y) AS n, count(*) AS df FROM r GROUP BY 1), c AS (SELECT sum(y) AS total FROM r),
      x AS (SELECT rec_id, term, tf, df, y, n - y AS o, 500 * n / total AS a, len, total - len AS rest FROM r JOIN l USING (rec_id) JOIN t USING (term), c),
      z AS (SELECT *, ln((y + a) / (len + 500 - y - a)) - ln((o + a) / (rest + 500 - o - a)) AS lo, sqrt(1 / (y + a) + 1 / (o + a)) AS se FROM x)"""
_ALIKE_TEXTS = f"""w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
      s AS MATERIALIZED (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
      n AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY 1 HAVING count(*) >= 40),
      p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
      u AS MATERIALIZED ({_USABLE_NODES}),
      f AS MATERIALIZED (SELECT 'document' AS rec_kind, x AS id_a, y AS id_b FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE k >= 0.6 * (a.n + b.n - k)
      UNION ALL SELECT 'node', a.node_id, b.node_id FROM u a JOIN u b ON a.node_id < b.node_id WHERE list_dot_product(a.u, b.u) >= 0.98)"""

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_ALIKE_TEXTS} SELECT rec_kind, id_a, id_b FROM f",
    "p1_classes": f"""WITH {_ALIKE_TEXTS}, r AS (SELECT 'document' AS rec_kind, doc_id AS rec_id, h FROM n UNION ALL SELECT 'node', node_id, e::VARCHAR FROM u),
      c AS MATERIALIZED (SELECT rec_kind, rec_id, min(rec_id) OVER (PARTITION BY rec_kind, h) AS class_id, count(*) OVER (PARTITION BY rec_kind, h) AS class_size FROM r),
      e AS (SELECT rec_kind, id_a AS a, id_b AS b FROM f UNION ALL SELECT rec_kind, id_b, id_a FROM f),
      l AS (SELECT e.rec_kind, x.class_id, count(DISTINCT y.class_id) AS links FROM e JOIN c x ON x.rec_kind = e.rec_kind AND x.rec_id = a JOIN c y ON y.rec_kind = e.rec_kind AND y.rec_id = b WHERE x.class_id <> y.class_id GROUP BY 1, 2)
      SELECT c.rec_kind, rec_id, c.class_id, class_size, coalesce(links, 0) AS links FROM c LEFT JOIN l ON l.rec_kind = c.rec_kind AND l.class_id = c.class_id WHERE class_size > 1 OR links > 0""",
    "p1_groups": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
      s AS MATERIALIZED (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)) GROUP BY 1, 2),
      t AS MATERIALIZED (SELECT doc_id, sum(n) AS total, md5(string_agg(g || ':' || n, '|' ORDER BY g)) AS h FROM s GROUP BY 1),
      c AS MATERIALIZED (SELECT doc_id, total, min(doc_id) OVER (PARTITION BY h) AS class_id FROM t),
      p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
      f AS MATERIALIZED (SELECT DISTINCT a.class_id AS u, b.class_id AS v FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE k >= 0.8 * (a.total + b.total - k) AND a.class_id <> b.class_id),
      e AS MATERIALIZED (SELECT u, v FROM f UNION SELECT v, u FROM f),
      cc(id, label) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, cc.label FROM cc JOIN e ON e.u = cc.id WHERE cc.label < e.v),
      m AS (SELECT id, min(label) AS label FROM cc GROUP BY 1), l AS (SELECT u, count(*) AS links FROM e GROUP BY 1)
      SELECT d.doc_id, coalesce(m.label, c.class_id, d.doc_id) AS group_id, coalesce(l.links, 0) AS links FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d
      LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.id = c.class_id LEFT JOIN l ON l.u = c.class_id""",
    "p3_found": r"""SELECT doc_id, CASE WHEN len(list_filter(regexp_split_to_array(text, '\n(?:[ \t\r]*\n)+'), lambda u: length(trim(u, chr(32) || chr(9) || chr(13) || chr(10))) > 2000)) = 0 THEN 'paragraph'
      WHEN len(list_filter(string_split(text, chr(10)), lambda u: length(trim(u, chr(32) || chr(9) || chr(13))) > 2000)) = 0 THEN 'line'
      WHEN len(list_filter(string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda u: length(trim(u, chr(32) || chr(9) || chr(13))) > 2000)) = 0 THEN 'sentence' ELSE 'none' END AS boundary
      FROM documents WHERE length(text) > 2000""",
    "p4_found": f"""WITH r AS (SELECT 'document' AS rec_kind, * FROM {_TEXTS} UNION ALL SELECT 'node', * FROM {_POSTED} WHERE tf >= 1)
      SELECT rec_kind, rec_id, term FROM (SELECT *, count(*) OVER (PARTITION BY rec_kind, term) AS df FROM r) WHERE tf >= 3 AND df BETWEEN 2 AND 12 AND regexp_full_match(term, '[a-z]{{6,}}')""",
    "p4_scores": f"WITH {_SCORED.format(_POSTED)} SELECT rec_id, term, tf, df, round(lo, 6) AS log_odds, round(lo / se, 6) AS z FROM z",
    "p4_terms": f"""WITH {_SCORED.format(_TEXTS)} SELECT doc_id, rank::INT AS rank, term, tf, df, round(lo, 6) AS log_odds, round(lo / se, 6) AS z FROM (
      SELECT rec_id AS doc_id, *, row_number() OVER (PARTITION BY rec_id ORDER BY round(lo / se, 9) DESC, term) AS rank FROM z) WHERE rank <= 5""",
    "p5_found": """WITH RECURSIVE x AS MATERIALIZED (SELECT entry_id AS id, any_value(embedding)::DOUBLE[32] AS e FROM ivf_entries WHERE entry_id IS NOT NULL AND len(embedding) = 32
        AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 GROUP BY 1),
      e AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM x a, x b WHERE a.id <> b.id AND array_distance(a.e, b.e) <= 2),
      cc(id, label) AS (SELECT id, id FROM x UNION SELECT e.v, cc.label FROM cc JOIN e ON e.u = cc.id WHERE cc.label < e.v),
      m AS (SELECT id, min(label) AS label FROM cc GROUP BY 1)
      SELECT entry_id, cluster_id FROM (SELECT id AS entry_id, label AS cluster_id, count(*) OVER (PARTITION BY label) AS n FROM m) WHERE n >= 10""",
    "p3_roundtrip": "SELECT doc_id, md5(text) AS rebuilt, true AS within, true AS overlapping FROM documents WHERE length(text) > 2000",
}
