"""Queries of the training-data operators and the SQL that some of them must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions.names import camera, capture_time, recording
from orrery.llm import mixing, nearest_time, offensive, packing, tokens, vector_search
from orrery.session import materialize, table

TOLERANCE_US = 120_000
NEIGHBOURS = 8


def _entries(spark: SparkSession, d: str, cam: str) -> DataFrame:
    packs = table(spark, d, "poses").select(recording(F.col("dataset")).alias("recording"), F.explode("frames").alias("f"))
    name = F.col("f.name")
    entries = packs.select("recording", name.alias("key"), camera(name).alias("cam"), capture_time(name).alias("ts"), F.col("f.p").alias("p"))
    return entries.filter((F.col("cam") == cam) & F.col("p").isNotNull())


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Entries of camera B, each with the nearest entry of camera A and its p."""
    pairs = nearest_time.match_nearest(_entries(spark, d, "B"), _entries(spark, d, "A"), ["recording"], TOLERANCE_US, carry=["p"])
    return pairs.select("recording", F.col("key_right").alias("name_a"), F.col("key_left").alias("name_b"), "gap_us", "p")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pairs(spark, d).select("name_a", "name_b").distinct()


def _neighbours(spark: SparkSession, points: DataFrame, is_query) -> DataFrame:
    xyz = [F.col(c) for c in "xyz"]
    return vector_search.nearest_vectors(points.withColumn("dataset", recording(F.col("dataset"))), "dataset", "seq", xyz, NEIGHBOURS, is_query)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    probes = table(spark, d, "knn_probes").select("seq").dropna().distinct().withColumn("asks", F.lit(True))
    points = table(spark, d, "street_pack").select("dataset", "seq", "x", "y", "z").join(probes, "seq", "left")
    hits = _neighbours(spark, points, F.col("asks"))
    return hits.select(F.least("query", "neighbour").alias("seq_a"), F.greatest("query", "neighbour").alias("seq_b")).distinct()


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of every point whose seq is divisible by 20, among all points."""
    points = table(spark, d, "street_pack").select("dataset", "seq", "x", "y", "z")
    hits = _neighbours(spark, points, F.col("seq") % 20 == 0)
    return hits.select("query", "neighbour", F.round("distance", 6).alias("distance"), "rank")


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the ten nearest of 64-dimensional vectors, for every twentieth vector against all, held against brute force."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.lit("all").alias("pack"))
    dims = [F.element_at("v", i + 1) for i in range(64)]
    got = vector_search.nearest_vectors(e, "pack", "vec_id", dims, 10, F.col("vec_id") % 20 == 0, list_size=64)
    asks = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("q"))
    square = F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    all_pairs = asks.join(e.select(F.col("vec_id").alias("neighbour"), "v"), F.col("query") != F.col("neighbour")).select("query", "neighbour", square.alias("d2"))
    best = all_pairs.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy("d2", "neighbour"))).filter("nth <= 10").select("query", "neighbour")
    hit = best.join(got.select("query", "neighbour", F.lit(1).alias("hit")), ["query", "neighbour"], "left")
    return hit.agg(F.count_distinct("query").alias("n_queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("recalled"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sized = materialize(tokens.document_tokens(table(spark, d, "documents").select("doc_id", "text")), "tokens")
    return packing.pack(sized)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).filter("part > 0").select("doc_id").distinct()


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(_packed(spark, d))


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether the packing is whole: documents placed, containers over capacity, overlaps, needless splits, room used."""
    packed = _packed(spark, d)
    docs = packed.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("n"))
    per = docs.agg(F.count("*").alias("n_docs"), F.count(F.when((F.col("n") <= packing.CAPACITY) & (F.col("parts") > 1), 1)).alias("split_small"))
    end = F.col("container_offset") + F.col("n_tokens")
    held = packed.filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"), F.max(end).alias("end"))
    box = held.agg(F.count(F.when(F.col("n") > packing.CAPACITY, 1)).alias("over_full"), F.count(F.when(F.col("n") != F.col("end"), 1)).alias("overlapping"), (F.sum("n") >= 0.97 * packing.CAPACITY * (F.count("*") - 1)).alias("well_filled"))
    return per.crossJoin(box)  # one row each


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    documents = table(spark, d, "documents").select("doc_id", "text", "source")
    return mixing.mix(tokens.document_tokens(documents, carry=["source"]), table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].filter("short").select(F.col("listed_as").alias("source")).distinct()


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per listed source with documents in the mix: uses beyond the cap, and whether it always was within a block of its share."""
    mixed, report = _mixed(spark, d)
    used = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("use").alias("uses"))
    caps = report.select("source", "listed_as", "max_uses")
    over = used.join(caps, "source").groupBy("source", "listed_as").agg(F.count(F.when((F.col("n") > F.col("max_uses")) | (F.col("n") != F.col("uses")), 1)).alias("over_used"))
    off = mixing.deviation(mixed).select("source", (F.col("most_off") < 1).alias("within_a_block"))
    return over.join(off, "source").select(F.col("listed_as").alias("source"), "over_used", "within_a_block")


def p7_deviation(spark: SparkSession, d: str) -> DataFrame:
    return mixing.deviation(_mixed(spark, d)[0])


def _scored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text", "source")
    return offensive.score(documents, offensive.train(documents, table(spark, d, "doc_reviews")))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", mixing.source_name(F.col("source")).alias("source"), "score")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter(F.col("score") >= offensive.THRESHOLD).select("doc_id").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return offensive.rates(_scored(spark, d), mixing.source_name(F.col("source")))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per source the documents scored, and whether every score is a probability, 0 for empty texts."""
    scored = _scored(spark, d)
    sound = F.col("score").between(0, 1) & ((F.length(F.coalesce("text", F.lit(""))) > 0) | (F.col("score") == 0))
    return scored.groupBy(mixing.source_name(F.col("source")).alias("source")).agg(F.count("*").alias("n_docs"), F.bool_and(sound).alias("sound"))


QUERIES = {
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p5_recall": p5_recall,
    "p6_found": p6_found,
    "p6_pack": p6_pack,
    "p6_report": p6_report,
    "p6_coverage": p6_coverage,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p7_coverage": p7_coverage,
    "p7_deviation": p7_deviation,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
    "p8_coverage": p8_coverage,
}

P4_ENTRIES = r"""
WITH e AS (SELECT rtrim(trim(coalesce(dataset, '')), '/') AS rec, unnest(frames) AS f FROM poses),
t AS (SELECT DISTINCT rec, f.name AS name, upper(f.name[1]) AS cam,
  try_strptime(regexp_extract(f.name, '^[A-Za-z]_(\d{4}_\d{2}_\d{2}_\d{2}_\d{2}_\d{2}_\d{6})', 1), '%Y_%m_%d_%H_%M_%S_%f') AS ts
  FROM e WHERE f.p IS NOT NULL),
n AS (SELECT b.name AS name_b, a.name AS name_a, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS gap,
  row_number() OVER (PARTITION BY b.name ORDER BY abs(epoch_us(a.ts) - epoch_us(b.ts)), a.ts, a.name) AS nth
  FROM t b JOIN t a ON a.rec = b.rec AND a.cam = 'A' AND b.cam = 'B' AND a.ts BETWEEN b.ts - INTERVAL 120 MILLISECOND AND b.ts + INTERVAL 120 MILLISECOND)
"""

P5_FOUND = """
WITH pts AS (SELECT DISTINCT ON (seq) seq, rtrim(trim(coalesce(dataset, '')), '/') AS rec, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z
  FROM street_pack WHERE x::VARCHAR NOT IN ('nan', 'inf', '-inf') AND y::VARCHAR NOT IN ('nan', 'inf', '-inf') AND z::VARCHAR NOT IN ('nan', 'inf', '-inf')),
asking AS (SELECT * FROM pts WHERE seq IN (SELECT seq FROM knn_probes)),
n AS (SELECT a.seq AS a, b.seq AS b, row_number() OVER (PARTITION BY a.seq ORDER BY (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2, b.seq) AS nth
  FROM asking a JOIN pts b ON a.rec = b.rec AND a.seq <> b.seq)
SELECT DISTINCT least(a, b) AS seq_a, greatest(a, b) AS seq_b FROM n WHERE nth <= 8
"""

P5_NEIGHBOURS = P5_FOUND[: P5_FOUND.index("asking AS")] + """asking AS (SELECT * FROM pts WHERE seq % 20 = 0),
d AS (SELECT a.seq AS a, b.seq AS b, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d FROM asking a JOIN pts b ON a.rec = b.rec AND a.seq <> b.seq)
SELECT a AS query, b AS neighbour, round(d, 6) AS distance, CAST(row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS INTEGER) AS rank FROM d QUALIFY rank <= 8
"""

P4_PAIRS = P4_ENTRIES.replace("SELECT DISTINCT rec, f.name AS name,", "SELECT DISTINCT ON (name) rec, f.name AS name, f.p AS p,").replace("f.p IS NOT NULL)", "f.p IS NOT NULL ORDER BY [CASE WHEN v IS NULL THEN 0 WHEN isnan(v) THEN 2 ELSE 1 END FOR v IN f.p], f.p)")
P4_PAIRS = P4_PAIRS.replace("a.name AS name_a,", "a.name AS name_a, a.rec AS recording, a.p AS p, epoch_us(a.ts) - epoch_us(b.ts) AS gap_us,")

#: Words of the vocabulary's pattern: no fewer than the tokens, and no text has 1,500 to 2,700 of them.
WORDS = r"len(regexp_extract_all(text, ' ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+'))"

#: Sources compare by name without case, blanks at the ends and - for _.
NAME = "replace(lower(trim(source)), '-', '_')"

ORACLES = {
    "p4_found": P4_ENTRIES + "SELECT name_a, name_b FROM n WHERE nth = 1",
    "p4_pairs": P4_PAIRS + "SELECT recording, name_a, name_b, gap_us, p FROM n WHERE nth = 1",
    "p5_found": P5_FOUND,
    "p5_neighbours": P5_NEIGHBOURS,
    "p5_recall": "SELECT count(*) AS n_queries, true AS recalled FROM embeddings WHERE vec_id % 20 = 0",
    "p6_found": f"SELECT doc_id FROM documents WHERE {WORDS} > 2048",
    "p7_found": f"""WITH s AS (SELECT {NAME} AS s, sum({WORDS}) AS n FROM documents GROUP BY 1), t AS (SELECT source, target_share, max_uses, coalesce(n, 0) AS n FROM mix_targets LEFT JOIN s ON s.s = {NAME})
SELECT DISTINCT source FROM t WHERE target_share * (SELECT sum(n) FROM t) > max_uses * n""",
    "p6_coverage": "SELECT count(DISTINCT doc_id) AS n_docs, 0 AS split_small, 0 AS over_full, 0 AS overlapping, true AS well_filled FROM documents",
    "p7_coverage": f"SELECT source, 0 AS over_used, true AS within_a_block FROM mix_targets t WHERE target_share > 0 AND EXISTS (SELECT 1 FROM documents d WHERE replace(lower(trim(d.source)), '-', '_') = replace(lower(trim(t.source)), '-', '_') AND length(d.text) > 0)",
    "p8_coverage": f"SELECT {NAME} AS source, count(*) AS n_docs, true AS sound FROM documents GROUP BY 1",
}
