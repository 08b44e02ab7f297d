"""Queries over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import corpus as c
from corpusmill.sources.tables import read

_ELIGIBLE = """(SELECT DISTINCT hash, sloc, n_tokens FROM source_summary s
  WHERE n_tokens > 0 AND NOT EXISTS (SELECT 1 FROM failure f WHERE f.hash = s.hash))"""


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    return c.eligible(read(spark, d, "source_summary"), read(spark, d, "failure"))


def source_file_dedup(spark, d):
    return c.distinct_sources(read(spark, d, "source_file"))


def source_hash_check(spark, d):
    return read(spark, d, "source_file").select("hash", (c.file_hash("source") == F.col("hash")).alias("matches")).distinct()


def eligible_source(spark, d):
    return _eligible(spark, d)


def eligible_source_bytes(spark, d):
    return c.eligible_sources(read(spark, d, "source_file"), _eligible(spark, d)).select("hash", F.octet_length("source").cast("long").alias("n_bytes"), F.md5("source").alias("digest")).distinct()


def source_summaries(spark, d):
    return read(spark, d, "source_summary").select("hash", "sloc", "n_tokens").distinct()


def sources_with_repository(spark, d):
    sources = read(spark, d, "source_file").dropDuplicates(["hash"])
    return c.sources_with_repository(read(spark, d, "repository_source"), sources).select("owner", "name", "path", "hash", F.octet_length("source").cast("long").alias("n_bytes"), F.md5("source").alias("digest"))


def source_lookup(spark, d):
    sources = read(spark, d, "source_file")
    return c.lookup(c.distinct_sources(sources), "hash", sources.agg(F.min("hash")).scalar())


def corpus_language(spark, d):
    return read(spark, d, "meta").where("key = 'language'").select("value").distinct()


def file_uniqueness(spark, d):
    return c.is_unique(read(spark, d, "repository_source"))


def file_info(spark, d):
    return c.file_info(read(spark, d, "source_file", "hash"), read(spark, d, "repository_source"), read(spark, d, "repository"), read(spark, d, "source_summary"))


def repo_token_totals(spark, d):
    return c.repository_tokens(read(spark, d, "repository_source"), _eligible(spark, d))


def eligible_by_repository(spark, d):
    mappings = read(spark, d, "repository_source").select("owner", "name", "hash").distinct()
    return mappings.join(_eligible(spark, d).select("hash"), "hash", "left_semi").groupBy("owner", "name").agg(F.count(F.lit(1)).alias("n_hashes"))


def ntokens_subset(spark, d):
    return c.tokens_of_subset(read(spark, d, "source_summary"), read(spark, d, "result").select(F.col("good_file").alias("hash")))


def token_stats(spark, d):
    return c.token_statistics(_eligible(spark, d))


def list_unparsed(spark, d):
    return c.unparsed(read(spark, d, "source_file", "hash"), read(spark, d, "source_summary"), read(spark, d, "failure"))


def minified_break(spark, d):
    return c.two_class_break(c.with_ratio(read(spark, d, "source_summary")), "ratio")


def minified_files(spark, d):
    return c.minified_by_ratio(read(spark, d, "source_summary"))


def minified_glob(spark, d):
    return read(spark, d, "repository_source").where(c.minified_path("path")).select("owner", "name", "path", "hash").distinct()


def language_files(spark, d):
    mappings = read(spark, d, "repository_source").distinct()
    return mappings.agg(*(F.count_if(c.has_extension("path", x)).alias(x) for x in c.EXTENSIONS), F.count_if(~F.col("path").endswith(".min.js")).alias("not_minified"))


def repository_ids(spark, d):
    ids = read(spark, d, "repository").select(F.concat_ws("/", "owner", "name").alias("id")).distinct()
    parsed = c.repository_id(F.col("id"))
    return ids.select("id", parsed["owner"].alias("owner"), parsed["name"].alias("name"))


def cleaned_paths(spark, d):
    return read(spark, d, "repository_source").select("path", c.clean_path(F.col("path")).alias("clean"), F.concat_ws("/", "owner", "name", "path").alias("joined"), c.safe_path(F.col("path")).alias("safe")).distinct()


def failure_reasons(spark, d):
    return c.failure_reasons(read(spark, d, "failure"))


def missing_sources(spark, d):
    return c.missing_references(read(spark, d, "repository_source"), read(spark, d, "source_file", "hash"), ["hash"])


def missing_repositories(spark, d):
    return c.missing_references(read(spark, d, "repository_source"), read(spark, d, "repository"), ["owner", "name"])


def cascade(spark, d):
    gone = read(spark, d, "repository").where("license IS NULL")
    return c.cascade_delete(read(spark, d, "repository_source").distinct(), gone, ["owner", "name"]).groupBy("owner", "name").agg(F.count(F.lit(1)).alias("n_mappings"))


def summary_upsert(spark, d):
    old = read(spark, d, "source_summary").select("hash", "n_tokens")
    new = old.where("n_tokens >= 1000").select("hash", (F.col("n_tokens") + 1).alias("n_tokens"))
    return c.upsert(old, new, ["hash"], "n_tokens")


def clamped_balances(spark, d):
    return read(spark, d, "customer", "c_custkey", "c_acctbal").select("c_custkey", F.round(c.clamp(F.col("c_acctbal"), 0.0, 5000.0), 6).alias("clamped"), F.round(c.at_least(F.col("c_acctbal"), 100.0), 6).alias("floored"))


QUERIES = {
    f.__name__: f
    for f in (
        source_file_dedup, source_hash_check, eligible_source, eligible_source_bytes, source_summaries, sources_with_repository, source_lookup, corpus_language,
        file_uniqueness, file_info, repo_token_totals, eligible_by_repository, ntokens_subset, token_stats, list_unparsed, minified_break, minified_files,
        minified_glob, language_files, repository_ids, cleaned_paths, failure_reasons, missing_sources, missing_repositories, cascade, summary_upsert, clamped_balances,
    )
}

_RATED = "(SELECT DISTINCT hash, sloc, n_tokens, n_tokens / sloc AS ratio FROM source_summary WHERE n_tokens > 0 AND sloc > 0)"
_BREAK = f"""
  WITH e AS (SELECT ratio AS v, ln(ratio) AS x, CAST(count(*) AS DOUBLE) AS n FROM {_RATED} GROUP BY ratio),
  r AS (SELECT v, sum(n) OVER w AS n, sum(n * x) OVER w AS s, sum(n * x * x) OVER w AS q, sum(n) OVER () AS tn, sum(n * x) OVER () AS ts, sum(n * x * x) OVER () AS tq
        FROM e WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
  d AS (SELECT v, round((q - s * s / n) + ((tq - q) - (ts - s) * (ts - s) / (tn - n)), 9) AS d FROM r WHERE n < tn)
  SELECT round(v, 9) AS "break" FROM d ORDER BY d, v LIMIT 1"""

ORACLES = {
    "source_file_dedup": "SELECT DISTINCT hash, CAST(octet_length(source) AS BIGINT) AS n_bytes FROM source_file",
    "source_hash_check": "SELECT DISTINCT hash, sha256(source) = hash AS matches FROM source_file",
    "eligible_source": f"SELECT hash, sloc, n_tokens FROM {_ELIGIBLE}",
    "eligible_source_bytes": f"SELECT DISTINCT hash, CAST(octet_length(source) AS BIGINT) AS n_bytes, md5(source) AS digest FROM source_file WHERE hash IN (SELECT hash FROM {_ELIGIBLE})",
    "source_summaries": "SELECT DISTINCT hash, sloc, n_tokens FROM source_summary",
    "sources_with_repository": """SELECT r.owner, r.name, r.path, r.hash, s.n_bytes, s.digest FROM (SELECT DISTINCT owner, name, path, hash FROM repository_source) r
        JOIN (SELECT DISTINCT hash, CAST(octet_length(source) AS BIGINT) AS n_bytes, md5(source) AS digest FROM source_file) s ON r.hash = s.hash""",
    "source_lookup": "SELECT DISTINCT hash, CAST(octet_length(source) AS BIGINT) AS n_bytes FROM source_file WHERE hash = (SELECT min(hash) FROM source_file)",
    "corpus_language": "SELECT DISTINCT value FROM meta WHERE key = 'language'",
    "file_uniqueness": """SELECT hash, count(DISTINCT (owner, name, path)) AS n_mappings, count(DISTINCT (owner, name, path)) = 1 AS is_unique
        FROM repository_source GROUP BY hash""",
    "file_info": """
        WITH least AS (SELECT hash, min((owner, name, path)) AS m, count(DISTINCT (owner, name, path)) AS n_mappings FROM repository_source GROUP BY hash),
        repo AS (SELECT owner, name, min(revision) AS revision FROM repository GROUP BY owner, name),
        full_repo AS (SELECT r.owner, r.name, r.revision, min(x.license) FILTER (x.license IS NOT NULL) AS license, bool_or(x.license IS NULL) AS has_null
                      FROM repo r JOIN repository x ON x.owner = r.owner AND x.name = r.name AND x.revision = r.revision GROUP BY 1, 2, 3),
        s AS (SELECT hash, min((coalesce(sloc, -1), coalesce(n_tokens, -1))) AS v FROM source_summary GROUP BY hash)
        SELECT l.hash, l.m[1] AS owner, l.m[2] AS name, l.m[3] AS path, n_mappings, n_mappings = 1 AS is_unique, CASE WHEN has_null THEN NULL ELSE license END AS license,
          'https://github.com/' || l.m[1] || '/' || l.m[2] || '/blob/' || r.revision || '/' || l.m[3] AS href,
          CASE WHEN s.v[1] >= 0 THEN s.v[1] END AS sloc, CASE WHEN s.v[2] >= 0 THEN s.v[2] END AS n_tokens
        FROM least l JOIN full_repo r ON r.owner = l.m[1] AND r.name = l.m[2] LEFT JOIN s ON s.hash = l.hash
        WHERE l.hash IN (SELECT hash FROM source_file)""",
    "repo_token_totals": f"""SELECT r.owner, r.name, CAST(sum(e.n_tokens) AS BIGINT) AS n_tokens
        FROM (SELECT DISTINCT owner, name, hash, path FROM repository_source) r JOIN {_ELIGIBLE} e ON e.hash = r.hash GROUP BY r.owner, r.name""",
    "eligible_by_repository": f"""SELECT owner, name, count(DISTINCT hash) AS n_hashes FROM repository_source
        WHERE hash IN (SELECT hash FROM {_ELIGIBLE}) GROUP BY owner, name""",
    "ntokens_subset": """SELECT count(*) AS n_files, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM (SELECT DISTINCT hash, sloc, n_tokens FROM source_summary)
        WHERE hash IN (SELECT good_file FROM result)""",
    "token_stats": f"""
        WITH e AS (SELECT n_tokens FROM {_ELIGIBLE}), o AS (SELECT n_tokens, row_number() OVER (ORDER BY n_tokens) AS k, count(*) OVER () AS n FROM e),
        m AS (SELECT n_tokens AS m, n FROM o WHERE k = n // 2 + 1)
        SELECT CAST((SELECT count(*) FROM e) AS BIGINT) AS n_files, CAST((SELECT sum(n_tokens) FROM e) AS BIGINT) AS total, round((SELECT avg(n_tokens) FROM e), 6) AS mean,
          round(m.m - 0.5 + (m.n / 2.0 - (SELECT count(*) FROM e WHERE n_tokens < m.m)) / (SELECT count(*) FROM e WHERE n_tokens = m.m), 6) AS median_grouped,
          (SELECT n_tokens FROM e GROUP BY n_tokens ORDER BY count(*) DESC, n_tokens LIMIT 1) AS mode
        FROM m""",
    "list_unparsed": "SELECT hash FROM source_file EXCEPT SELECT hash FROM source_summary EXCEPT SELECT hash FROM failure",
    "minified_break": _BREAK,
    "minified_files": f"""
        WITH b AS ({_BREAK})
        SELECT hash, round(ratio, 6) AS ratio, CASE WHEN ratio > b."break" THEN 'gen' ELSE 'hw' END AS label,
          CASE WHEN ratio >= b."break" THEN printf('minified:>=%.1f', b."break") END AS reason FROM {_RATED}, b""",
    "minified_glob": "SELECT DISTINCT owner, name, path, hash FROM repository_source WHERE lower(path) GLOB '*[.-]min.js'",
    "language_files": """SELECT count(*) FILTER (path LIKE '%.java') AS java, count(*) FILTER (path LIKE '%.py') AS python, count(*) FILTER (path LIKE '%.js') AS javascript,
        count(*) FILTER (NOT path GLOB '*.min.js') AS not_minified FROM (SELECT DISTINCT owner, name, hash, path FROM repository_source)""",
    "repository_ids": r"""SELECT DISTINCT owner || '/' || name AS id, CASE WHEN ok THEN owner END AS owner, CASE WHEN ok THEN name END AS name
        FROM (SELECT owner, name, regexp_full_match(owner || '/' || name, '[\w\-.]+/[\w\-.]+') AS ok FROM repository)""",
    "cleaned_paths": r"""SELECT DISTINCT path, regexp_replace(path, '^[^/]*/', '') AS clean, owner || '/' || name || '/' || path AS joined,
        NOT starts_with(path, '/') AND NOT regexp_matches(path, '(^|/)\.\.(/|$)') AND NOT contains(path, chr(92)) AS safe FROM repository_source""",
    "failure_reasons": "SELECT hash, min(coalesce(nullif(trim(reason), ''), 'Syntax error')) AS reason FROM failure GROUP BY hash",
    "missing_sources": "SELECT DISTINCT hash FROM repository_source WHERE hash NOT IN (SELECT hash FROM source_file)",
    "missing_repositories": """SELECT DISTINCT owner, name FROM repository_source r
        WHERE NOT EXISTS (SELECT 1 FROM repository p WHERE p.owner = r.owner AND p.name = r.name)""",
    "cascade": """SELECT owner, name, count(*) AS n_mappings FROM (SELECT DISTINCT owner, name, hash, path FROM repository_source) r
        WHERE NOT EXISTS (SELECT 1 FROM repository p WHERE p.license IS NULL AND p.owner = r.owner AND p.name = r.name) GROUP BY owner, name""",
    "summary_upsert": """SELECT hash, max(CASE WHEN n_tokens >= 1000 THEN n_tokens + 1 ELSE n_tokens END) AS n_tokens FROM source_summary GROUP BY hash""",
    "clamped_balances": "SELECT c_custkey, round(greatest(0.0, least(5000.0, c_acctbal)), 6) AS clamped, round(greatest(c_acctbal, 100.0), 6) AS floored FROM customer",
}
