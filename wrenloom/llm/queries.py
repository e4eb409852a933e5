"""Queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wrenloom.llm import bestfit, crf, decontaminate, gif, hostgraph, langid, licences, ngramjoin, sharding, superkmer
from wrenloom.llm.common import table


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(langid.training_sample(docs)))


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.linked(table(spark, sf_dir, "documents"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.redact(table(spark, sf_dir, "documents"), crf.trained())


def best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.repeats(table(spark, sf_dir, "documents"))


def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences(table(spark, sf_dir, "documents"))


#: Seeds among the hosts of the synthetic pages.
TRUSTED = tuple(f"{name}.example.{end}" for name in ("tionsh", "ththon", "ththhe", "ththan", "therin") for end in ("com", "net", "org"))
BLOCKED = tuple(f"{name}.example.{end}" for name in ("cheap-pills", "casino-win", "free-bets", "ads-track") for end in ("com", "net", "org"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic pages link to their own hosts only, so the host graph is made from link targets that hosts share."""
    pages = table(spark, sf_dir, "pages")
    return hostgraph.filtered(pages, TRUSTED, BLOCKED, hostgraph.target_edges(pages))


def gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.frames(gif.vector_media(table(spark, sf_dir, "embeddings")))


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_licence_scan": licence_scan, "op2_url_filter": url_filter, "op3_gif_frames": gif_frames, "op10_sharding": sharded, "op4_best_fit_packing": best_fit, "op6_pii": pii, "op5_language_id": language_id, "op7_substring_dedup": substring_dedup, "op8_ngram_jaccard": ngram_jaccard, "op9_decontamination": decontamination}


#: Words as textcodes has them, with the capitals of ASCII made small.
WORDS = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"

NGRAM_JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {ngramjoin.N} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {ngramjoin.N} + 2), lambda i: array_to_string(w[i:i + {ngramjoin.N} - 1], ' ')) END)) AS g FROM words WHERE len(w) > 0),
classed AS (SELECT doc_id, g, min(doc_id) OVER (PARTITION BY g) AS least FROM sets),
grams AS (SELECT doc_id, len(g) AS size, unnest(g) AS gram FROM classed WHERE doc_id = least),
shared AS (SELECT gram FROM grams GROUP BY gram HAVING count(*) > 1),
few AS (SELECT grams.* FROM grams SEMI JOIN shared USING (gram)),
near AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS overlap, count(*) / (any_value(a.size) + any_value(b.size) - count(*)) AS j
    FROM few a JOIN few b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
ends AS (SELECT doc_a AS x, doc_b AS y FROM near WHERE j >= {ngramjoin.THRESHOLD} - 1e-12 UNION ALL SELECT doc_b, doc_a FROM near WHERE j >= {ngramjoin.THRESHOLD} - 1e-12),
reach AS (SELECT x, x AS y FROM (SELECT DISTINCT x FROM ends) UNION SELECT reach.x, ends.y FROM reach JOIN ends ON ends.x = reach.y),
heads AS (SELECT least AS doc, count(*) AS copies FROM classed GROUP BY 1)
SELECT doc_id, coalesce((SELECT min(y) FROM reach WHERE x = least), least) AS class_id, copies, (SELECT count(*) FROM ends WHERE x = least) AS links
FROM classed JOIN heads ON doc = least WHERE copies > 1 OR least IN (SELECT x FROM ends)"""


PLAIN_WORDS = WORDS.replace("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "text")
SUBSTRING_DEDUP = f"""
WITH words AS (SELECT DISTINCT doc_id, {PLAIN_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
spots AS (SELECT doc_id, w, unnest(range(0, len(w) - {superkmer.WIDTH} + 1)) AS spot FROM words WHERE len(w) >= {superkmer.WIDTH}),
windows AS (SELECT doc_id, spot, array_to_string(w[spot + 1:spot + {superkmer.WIDTH}], ' ') AS t FROM spots),
counted AS (SELECT doc_id, spot, count(*) OVER (PARTITION BY t) AS copies, row_number() OVER (PARTITION BY t ORDER BY doc_id, spot) = 1 AS is_first FROM windows),
several AS (SELECT *, spot - row_number() OVER (PARTITION BY doc_id, is_first ORDER BY spot) AS island FROM counted WHERE copies > 1)
SELECT doc_id, min(spot) AS start_word, max(spot) + {superkmer.WIDTH} AS end_word, max(copies) AS copies, is_first FROM several GROUP BY doc_id, is_first, island"""


def _gif_sql() -> str:
    """Frames and histograms of vector_media() computed from the vectors, without any GIF."""
    bins = [16 * (int(r) >> 6) + 4 * (int(g) >> 6) + (int(b) >> 6) for r, g, b in gif.PALETTE]
    hist = "list_transform(range(0, 64), lambda k: CAST(len(list_filter({}, lambda c: c >= 0 AND [" + ", ".join(map(str, bins)) + "][c + 1] = k)) AS INTEGER))"
    rgba = "string_agg(CASE WHEN c < 0 THEN '00000000' ELSE [" + ", ".join(f"'{int(r):02X}{int(g):02X}{int(b):02X}FF'" for r, g, b in gif.PALETTE) + "][c + 1] END, '' ORDER BY i)"
    inner = "(i // 8 BETWEEN 2 AND 5 AND i % 8 BETWEEN 2 AND 5)"
    return f"""
WITH px AS (SELECT vec_id AS id, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings WHERE len(embedding) = 64),
q AS (SELECT id, i, CAST(least(greatest(floor((CAST(v AS DOUBLE) + 0.6) / 1.2 * 16), 0), 15) AS INTEGER) AS q FROM px),
shown AS (SELECT id, 0 AS frame, i, q AS c FROM q
    UNION ALL SELECT id, 1, i, CASE WHEN {inner} AND 15 - q <> 0 THEN 15 - q ELSE q END FROM q
    UNION ALL SELECT id, 2, i, CASE WHEN i < 32 THEN 15 - q WHEN {inner} THEN -1 ELSE q END FROM q),
screens AS (SELECT id, frame, list(c ORDER BY i) AS cs, {rgba} AS hex FROM shown GROUP BY id, frame)
SELECT id, CAST(frame AS INTEGER) AS frame, CAST([0, 100, 150][frame + 1] AS BIGINT) AS start_ms, CAST([100, 50, 200][frame + 1] AS INTEGER) AS delay_ms,
    CAST(8 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, CAST(len(list_filter(cs, lambda c: c >= 0)) AS INTEGER) AS opaque,
    {hist.format("cs")} AS hist, from_hex(hex) AS rgba, CAST(NULL AS VARCHAR) AS error FROM screens"""


def _hosts_sql() -> str:
    """judge() with its iterations unrolled."""
    host = "nullif(lower(regexp_extract({}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)', 1)), '')"
    under = lambda seeds: " OR ".join(f"host = '{s}' OR ends_with(host, '.{s}')" for s in seeds)
    d, n = hostgraph.DAMPING, hostgraph.ITERATIONS
    steps = "".join(f"""
r{k + 1} AS MATERIALIZED (SELECT x.host, {1 - d} * x.t + {d} * (coalesce(f.c, 0) + lost.lt * x.t) AS trust, {1 - d} * x.b + {d} * (coalesce(g.c, 0) + lost.lb * x.b) AS distrust
    FROM base x LEFT JOIN (SELECT e.dst AS host, sum(r.trust / y.out_w * e.w) AS c FROM edges e JOIN r{k} r ON r.host = e.src JOIN base y ON y.host = e.src GROUP BY 1) f ON f.host = x.host
    LEFT JOIN (SELECT e.src AS host, sum(r.distrust / y.in_w * e.w) AS c FROM edges e JOIN r{k} r ON r.host = e.dst JOIN base y ON y.host = e.dst GROUP BY 1) g ON g.host = x.host
    CROSS JOIN (SELECT coalesce(sum(r.trust) FILTER (y.out_w IS NULL), 0) AS lt, coalesce(sum(r.distrust) FILTER (y.in_w IS NULL), 0) AS lb FROM r{k} r JOIN base y USING (host)) lost),""" for k in range(n))
    return f"""
WITH links AS (SELECT {host.format("url")} AS src, unnest(regexp_extract_all(html, 'href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages),
shared AS (SELECT src, href, count(*) AS n FROM links WHERE src IS NOT NULL AND starts_with(href, '/') AND NOT starts_with(href, '//') GROUP BY 1, 2),
owners AS (SELECT href, src AS dst FROM shared QUALIFY row_number() OVER (PARTITION BY href ORDER BY n DESC, src) = 1),
edges AS MATERIALIZED (SELECT src, dst, sum(w)::DOUBLE AS w FROM (SELECT src, {host.format("trim(href)")} AS dst, 1 AS w FROM links UNION ALL SELECT src, dst, n FROM shared JOIN owners USING (href)) WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY 1, 2),
hosts AS (SELECT host, sum(pages)::BIGINT AS pages FROM (SELECT {host.format("url")} AS host, 1 AS pages FROM pages UNION ALL SELECT src, 0 FROM edges UNION ALL SELECT dst, 0 FROM edges) WHERE host IS NOT NULL GROUP BY 1),
seeds AS (SELECT *, CAST({under(TRUSTED)} AS INTEGER)::DOUBLE AS t0, CAST({under(BLOCKED)} AS INTEGER)::DOUBLE AS b0 FROM hosts),
base AS MATERIALIZED (SELECT host, pages, t0 / greatest(sum(t0) OVER (), 1) AS t, b0 / greatest(sum(b0) OVER (), 1) AS b, out_w, in_w, count(*) OVER () AS n FROM seeds
    LEFT JOIN (SELECT src AS host, sum(w) AS out_w FROM edges GROUP BY 1) USING (host) LEFT JOIN (SELECT dst AS host, sum(w) AS in_w FROM edges GROUP BY 1) USING (host)),
r0 AS MATERIALIZED (SELECT host, t AS trust, b AS distrust FROM base),{steps}
final AS (SELECT b.host, round(trust * n, 6) AS trust, round(distrust * n, 6) AS distrust, b.b > 0 AS seed FROM r{n} JOIN base b USING (host))
SELECT page_id, host, trust, distrust, CASE WHEN seed OR distrust >= {hostgraph.BLOCK_AT} THEN 'blocked' WHEN trust >= {hostgraph.TRUST_AT} THEN 'trusted' ELSE 'unknown' END AS verdict FROM (SELECT page_id, {host.format("url")} AS host FROM pages) LEFT JOIN final USING (host)"""


def _shards_sql() -> str:
    """assign() with its rounds unrolled, each link a row: all pairs of a line's documents."""
    s = sharding.SHARDS
    even = f"((n + {s - 1}) // {s})"
    steps = "".join(f"""
a{r} AS (SELECT doc_id, shard, arg_max(there, votes * 1000000 - there) FILTER (there <> shard) AS target, max(votes) FILTER (there <> shard) AS most, coalesce(max(votes) FILTER (there = shard), 0) AS here
    FROM (SELECT l.doc_id, h.shard, t.shard AS there, sum(l.w) AS votes FROM links l JOIN h{r} h USING (doc_id) JOIN h{r} t ON t.doc_id = l.near GROUP BY 1, 2, 3) GROUP BY 1, 2),
q{r} AS MATERIALIZED (SELECT doc_id, rank, shard AS src, target AS dst, most - here AS gain FROM a{r} JOIN ranks USING (doc_id) WHERE most > here AND (rank >> {r // 2 % 8}) % 2 = {r % 2}),
f{r} AS (SELECT src, dst, count(*) AS asking FROM q{r} GROUP BY 1, 2),
w{r} AS (SELECT f.src, f.dst, f.asking, least(f.asking, coalesce(b.asking, 0)) AS swap FROM f{r} f LEFT JOIN f{r} b ON b.src = f.dst AND b.dst = f.src),
x{r} AS (SELECT src, dst, swap + greatest(0, least(asking - swap, most - coalesce(size, 0) - coalesce(sum(asking - swap) OVER (PARTITION BY dst ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota
    FROM w{r} LEFT JOIN (SELECT shard, count(*) AS size FROM h{r} GROUP BY 1) z ON z.shard = dst, room),
m{r} AS (SELECT doc_id, dst FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY gain DESC, rank) AS place FROM q{r}) JOIN x{r} USING (src, dst) WHERE place <= quota),
h{r + 1} AS MATERIALIZED (SELECT doc_id, coalesce(dst, shard) AS shard FROM h{r} LEFT JOIN m{r} USING (doc_id)),""" for r in range(sharding.ROUNDS))
    return f"""
WITH rows AS (SELECT DISTINCT doc_id, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents WHERE doc_id IS NOT NULL),
lines AS (SELECT * FROM rows WHERE length(line) >= {sharding.LEAST_LINE}),
links AS MATERIALIZED (SELECT a.doc_id, b.doc_id AS near, count(*) AS w FROM lines a JOIN lines b ON a.line = b.line AND a.doc_id <> b.doc_id GROUP BY 1, 2),
ranks AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
h0 AS MATERIALIZED (SELECT doc_id, CAST(rank % {s} AS INTEGER) AS shard FROM ranks),
room AS (SELECT {even} + CAST(floor({even} * {sharding.SLACK} + 1e-9) AS BIGINT) AS most FROM (SELECT count(*) AS n FROM h0)),{steps.rstrip(",")}
SELECT doc_id, shard FROM h{sharding.ROUNDS}"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _hosts_sql(), "op3_gif_frames": _gif_sql(), "op10_sharding": _shards_sql(), "op7_substring_dedup": SUBSTRING_DEDUP, "op8_ngram_jaccard": NGRAM_JACCARD}
