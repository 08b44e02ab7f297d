"""Queries over token sequences of the documents and over distributions of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import partition as p
from corpusmill.operators import queue as q
from corpusmill.operators import scoring as m
from corpusmill.operators import sequence as s
from corpusmill.operators.corpus import eligible
from corpusmill.runtime import beside
from corpusmill.sources.tables import read


def _documents(spark, d):
    return read(spark, d, "documents", "doc_id", "text")


def _vectors(spark, d):
    return s.vectors(_documents(spark, d))


def source_summary(spark, d):
    return _documents(spark, d).where("text IS NOT NULL").select("doc_id", F.size(s.tokens(F.col("text"))).cast("long").alias("n_tokens"), s.physical_lines(F.col("text")).cast("long").alias("sloc"))


def discover_vocabulary(spark, d):
    found = s.discovered_vocabulary(_documents(spark, d))
    return found.select("entry", s.to_index(F.col("entry")).alias("vind"))


def vectors(spark, d):
    return _vectors(spark, d).select("doc_id", F.array_join(F.col("vector").cast("array<string>"), " ").alias("vector"))


def vectors_printed(spark, d):
    return _vectors(spark, d).select("doc_id", s.printed(F.col("vector")).alias("printed"))


def vector_lengths(spark, d):
    return _vectors(spark, d).agg(F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0).cast("long")).alias("total"), F.count(F.lit(1)).alias("n"))


def oov_tokens(spark, d):
    words = _documents(spark, d).select(F.explode(s.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    known = s.vocabulary_map()[s.abstracted(F.col("token"))]
    return words.where(known.isNull())


def _contexts(spark, d, backwards):
    rows = s.contexts(_vectors(spark, d), 5, backwards)
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join(F.col("context").cast("array<string>"), " ").alias("context"), "target")


def contexts_forward(spark, d):
    return _contexts(spark, d, False)


def contexts_backward(spark, d):
    return _contexts(spark, d, True)


def batch_target_topk(spark, d):
    return s.batch_targets(_vectors(spark, d), 64, 5)


def _edited(spark, d):
    v = _vectors(spark, d).withColumn("edit", s.drawn_edit(F.col("vector"), F.col("doc_id")))
    return v.withColumn("mutant", s.applied(F.col("vector"), F.col("edit")))


def edits_apply(spark, d):
    return _edited(spark, d).select("doc_id", "edit.code", F.col("edit.index").cast("long").alias("index"), F.col("edit.token").cast("long").alias("token"), "edit.original", F.array_join(F.col("mutant").cast("array<string>"), " ").alias("mutant"))


def edits_inverse(spark, d):
    return _edited(spark, d).select("doc_id", s.serialised(F.col("edit")).alias("edit"), s.serialised(s.inverse(F.col("edit"))).alias("inverse"))


def edits_roundtrip(spark, d):
    e = _edited(spark, d)
    back = s.applied(F.col("mutant"), s.inverse(s.deserialised(s.serialised(F.col("edit")))))
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(back == F.col("vector")).alias("restored"), F.count_if(F.col("mutant") != F.col("vector")).alias("changed"))


def token_distance(spark, d):
    return _edited(spark, d).select("doc_id", s.distance(F.col("vector"), F.col("mutant")).cast("long").alias("levenshtein"))


def determine_fix(spark, d):
    lines = s.token_lines(F.col("text"))
    e = s.with_single_fix(_edited(spark, d).join(_documents(spark, d).where("text IS NOT NULL"), "doc_id"), "vector", "mutant")
    # unfolded from an array: a filter on fix would be pushed down and work everything out again
    fixes = e.select("doc_id", s.edit_line(lines, F.col("fix")).alias("line"), F.inline(F.array_compact(F.array("fix"))))
    return fixes.select("doc_id", "code", "index", F.col("line").cast("long").alias("line"), s.to_text(F.col("token")).alias("new_token"), s.to_text(F.col("original")).alias("old_token"))


def _positions(spark, d):
    e = read(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    half = F.size("v") / 2
    forwards, backwards = m.softmax(F.slice("v", F.lit(1), half.cast("int"))), m.softmax(F.slice("v", half.cast("int") + 1, half.cast("int")))
    return m.with_metrics(e.select("vec_id", "label", F.pmod("vec_id", F.lit(32)).cast("int").alias("truth"), forwards.alias("forwards"), backwards.alias("backwards")))


def distribution_metrics(spark, d):
    return _positions(spark, d).select("vec_id", *(F.round(c, 6).alias(c) for c in ("xentropy", "indexed_prob", "cosine", "agreement")), "normal")


def position_rank_topk(spark, d):
    scored = _positions(spark, d).withColumn("xentropy", F.round("xentropy", 6))
    return m.worst_positions(scored, "label", "vec_id").select("label", F.col("rank").cast("long").alias("rank"), "vec_id", "xentropy")


def best_suggestions(spark, d):
    return _positions(spark, d).select("vec_id", F.array_join(F.array_sort(m.suggestions(F.col("forwards"), F.col("backwards"))).cast("array<string>"), " ").alias("suggestions"), m.argmax(F.col("forwards")).cast("int").alias("argmax"))


def fix_candidates(spark, d):
    files = _positions(spark, d).withColumn("xentropy", F.round("xentropy", 6)).select(F.col("label").alias("file"), F.col("vec_id").alias("position"), "truth", "xentropy", "forwards", "backwards")
    return m.fix_candidates(files)


def ngram_scores(spark, d):
    return m.bigram_model(_vectors(spark, d), s.SIZE).withColumn("probability", F.round("probability", 9))


def _eligible_repositories(spark, d):
    e = eligible(read(spark, d, "source_summary"), read(spark, d, "failure")).select("hash", "n_tokens")
    return read(spark, d, "repository_source").distinct().join(e, "hash")


def partition_assign(spark, d):
    totals = _eligible_repositories(spark, d).groupBy("owner", "name").agg(F.sum(F.col("n_tokens").cast("long")).alias("n_tokens"))
    return p.balanced_partitions(totals, ["owner", "name"], "n_tokens")


def _split(spark, d):
    repositories = read(spark, d, "repository_source").select("owner", "name").distinct()
    digit = F.conv(F.substring(F.sha2(F.concat_ws("/", "owner", "name"), 256), 64, 1), 16, 10).cast("int")
    return p.split_sets(repositories.withColumn("partition", F.pmod(digit, F.lit(5))), ["owner", "name"])


def partition_split(spark, d):
    return _split(spark, d)


def _assigned_hashes(spark, d):
    mappings = read(spark, d, "repository_source").select("owner", "name", "hash").distinct()
    return p.first_seen(beside(mappings, _split(spark, d), ["owner", "name"]))


def partition_dedup(spark, d):
    return _assigned_hashes(spark, d)


def partition_leaks(spark, d):
    return p.leaking(_split(spark, d), ["owner", "name"])


def first_n_subset(spark, d):
    return p.first_n(_assigned_hashes(spark, d), 10)


def queue_split(spark, d):
    done, dead = q.split_jobs(read(spark, d, "events"), F.col("event_type") == "error")
    return done.select("event_id", F.lit("done").alias("state")).unionByName(dead.select("event_id", F.lit("dead").alias("state")))


def retry_dedup(spark, d):
    _, dead = q.split_jobs(read(spark, d, "events"), F.col("event_type") == "error")
    return q.retries(dead, ["user_id"])


def queue_pending(spark, d):
    jobs = read(spark, d, "events").select("event_id", "user_id")
    done, _ = q.split_jobs(read(spark, d, "events"), F.col("event_type") == "error")
    return q.pending(jobs, done, ["event_id"])


QUERIES = {
    f.__name__: f
    for f in (
        source_summary, discover_vocabulary, vectors, vectors_printed, vector_lengths, oov_tokens, contexts_forward, contexts_backward, batch_target_topk, edits_apply,
        edits_inverse, edits_roundtrip, token_distance, determine_fix, distribution_metrics, position_rank_topk, best_suggestions, fix_candidates, ngram_scores,
        partition_assign, partition_split, partition_dedup, partition_leaks, first_n_subset, queue_split, retry_dedup, queue_pending,
    )
}


def _quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_TOKENS = f"regexp_extract_all(text, '{s.PATTERN}')"
_SELF = _quoted([*s.KEYWORDS, *s.PUNCTUATION])
_ENTRY = f"CASE WHEN list_contains({_SELF}, t) THEN t WHEN regexp_matches(t, '^\\p{{N}}') THEN '<NUMBER>' WHEN regexp_matches(t, '^[\\p{{L}}_]') THEN '<IDENTIFIER>' ELSE '<OTHER>' END"
_INDEX = f"CASE WHEN list_contains({_quoted(s.ENTRIES)}, {_ENTRY}) THEN list_position({_quoted(s.ENTRIES)}, {_ENTRY}) + 2 ELSE 0 END"
_ALL = _quoted(s.SPECIAL + s.ENTRIES)
_VEC = f"(SELECT doc_id, list_transform({_TOKENS}, lambda t: CAST({_INDEX} AS INTEGER)) AS v, text FROM documents WHERE text IS NOT NULL)"
_JOIN = "array_to_string(list_transform({}, lambda x: CAST(x AS VARCHAR)), ' ')"
_V, _F0 = s.SIZE, s.FIRST
_DRAWN = f"""(
  SELECT *, CASE code WHEN 'i' THEN (doc_id * 31) % {_V - _F0} + {_F0} WHEN 's' THEN CASE WHEN original < {_F0} THEN step WHEN step >= original THEN step + 1 ELSE step END END AS token
  FROM (SELECT *, CASE WHEN code <> 'i' THEN v[idx + 1] END AS original, (doc_id * 31) % {_V - _F0 - 1} + {_F0} AS step
    FROM (SELECT *, CASE WHEN code = 'i' THEN draw % (len(v) + 1) ELSE draw % greatest(len(v), 1) END AS idx
      FROM (SELECT *, CASE WHEN doc_id % 3 = 0 OR len(v) = 0 THEN 'i' WHEN doc_id % 3 = 1 THEN 'x' ELSE 's' END AS code, (doc_id * 7919 + 13) % 1000003 AS draw FROM {_VEC}))))"""
_MUTANT = f"""(SELECT *, CASE code WHEN 'i' THEN v[1:idx] || [CAST(token AS INTEGER)] || v[idx + 1:] WHEN 'x' THEN v[1:idx] || v[idx + 2:]
  ELSE v[1:idx] || [CAST(token AS INTEGER)] || v[idx + 2:] END AS w FROM {_DRAWN})"""


def _context(slice_: str) -> str:
    return f"SELECT doc_id, i AS pos, {_JOIN.format(slice_)} AS context, v[i + 1] AS target FROM (SELECT doc_id, v, unnest(range(len(v))) AS i FROM {_VEC})"


_SOFT = "list_transform({0}, lambda x: exp(x - list_max({0})) / list_sum(list_transform({0}, lambda y: exp(y - list_max({0})))))"
_HALVES = "(SELECT vec_id, label, CAST(vec_id % 32 AS INTEGER) AS truth, CAST(embedding AS DOUBLE[])[1:32] AS a, CAST(embedding AS DOUBLE[])[33:64] AS b FROM embeddings)"
_DIST = f"(SELECT vec_id, label, truth, {_SOFT.format('a')} AS f, {_SOFT.format('b')} AS g FROM {_HALVES})"
_XENT = "-ln(greatest(f[truth + 1], 1.401298464324817e-45)) - ln(greatest(g[truth + 1], 1.401298464324817e-45))"
_TOP = "list_transform(list_sort(list_transform(range(32), lambda i: {{'p': -{0}[i + 1], 'i': i}}))[1:3], lambda z: z.i)"
_REPOS = "(SELECT DISTINCT owner, name FROM repository_source)"
_DIGEST = "sha256(owner || '/' || name)"
_SPLIT = f"""(
  SELECT owner, name, partition, CASE WHEN k <= floor(n * 0.8) THEN 'training' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS set_name
  FROM (SELECT owner, name, partition, row_number() OVER (PARTITION BY partition ORDER BY {_DIGEST}) AS k, count(*) OVER (PARTITION BY partition) AS n
    FROM (SELECT owner, name, CAST((strpos('0123456789abcdef', {_DIGEST}[64]) - 1) % 5 AS INTEGER) AS partition FROM {_REPOS})))"""
_FIRST = f"""(
  SELECT hash, arg_min(partition, o) AS partition, arg_min(set_name, o) AS set_name FROM (
    SELECT r.hash, s.partition, s.set_name, s.partition * 10 + CASE s.set_name WHEN 'training' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END AS o
    FROM (SELECT DISTINCT owner, name, hash FROM repository_source) r JOIN {_SPLIT} s ON s.owner = r.owner AND s.name = r.name) GROUP BY hash)"""

ORACLES = {
    "source_summary": f"""SELECT doc_id, len({_TOKENS}) AS n_tokens,
        len(list_filter(string_split(text, chr(10)), lambda l: len(regexp_extract_all(l, '{s.PATTERN}')) > 0)) AS sloc FROM documents WHERE text IS NOT NULL""",
    "discover_vocabulary": f"SELECT DISTINCT {_ENTRY} AS entry, CAST({_INDEX} AS INTEGER) AS vind FROM (SELECT unnest({_TOKENS}) AS t FROM documents)",
    "vectors": f"SELECT doc_id, {_JOIN.format('v')} AS vector FROM {_VEC}",
    "vectors_printed": f"SELECT doc_id, array_to_string(list_transform(v, lambda x: {_ALL}[x + 1]), ' ') AS printed FROM {_VEC}",
    "vector_lengths": f"SELECT CAST(coalesce(sum(len(v)), 0) AS BIGINT) AS total, count(*) AS n FROM {_VEC}",
    "oov_tokens": f"SELECT t AS token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS t FROM documents) WHERE {_ENTRY} = '<OTHER>' GROUP BY t",
    "contexts_forward": _context("(list_transform(range(5), lambda x: 1) || v)[i + 1:i + 5]"),
    "contexts_backward": _context("(v || list_transform(range(5), lambda x: 2))[i + 2:i + 6]"),
    "batch_target_topk": f"""
        WITH c AS (SELECT doc_id, i // 64 AS batch, v[i + 1] AS x, count(*) AS n FROM (SELECT doc_id, v, unnest(range(len(v))) AS i FROM {_VEC}) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, batch ORDER BY n DESC, x) AS k, sum(n) OVER (PARTITION BY doc_id, batch) AS a FROM c)
        SELECT doc_id, batch, CASE WHEN k <= 5 THEN {_ALL}[x + 1] ELSE '[other]' END AS target, CAST(sum(n) AS BIGINT) AS n, round(100.0::DOUBLE * sum(n) / a, 2) AS percent
        FROM r GROUP BY doc_id, batch, a, least(k, 6), CASE WHEN k <= 5 THEN {_ALL}[x + 1] ELSE '[other]' END""",
    "edits_apply": f"SELECT doc_id, code, idx AS index, token, original, {_JOIN.format('w')} AS mutant FROM {_MUTANT}",
    "edits_inverse": f"""SELECT doc_id, code || ':' || idx || ':' || coalesce(CAST(token AS VARCHAR), '') || ':' || coalesce(CAST(original AS VARCHAR), '') AS edit,
        CASE code WHEN 'i' THEN 'x' WHEN 'x' THEN 'i' ELSE 's' END || ':' || idx || ':' || coalesce(CAST(original AS VARCHAR), '') || ':' || coalesce(CAST(token AS VARCHAR), '') AS inverse FROM {_MUTANT}""",
    "edits_roundtrip": f"SELECT count(*) AS n, count(*) AS restored, count(*) FILTER (v <> w) AS changed FROM {_MUTANT}",
    "token_distance": f"""SELECT doc_id, levenshtein(array_to_string(list_transform(v, lambda x: chr(x + 33)), ''), array_to_string(list_transform(w, lambda x: chr(x + 33)), '')) AS levenshtein
        FROM {_MUTANT}""",
    "determine_fix": f"""
        WITH m AS (SELECT *, list_position(list_transform(range(1, least(len(v), len(w)) + 1), lambda i: v[i] <> w[i]), true) AS p FROM {_MUTANT}),
        a AS (SELECT *, CASE WHEN coalesce(p, 0) > 0 THEN p - 1 ELSE least(len(v), len(w)) END AS loc,
          flatten(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: list_transform(regexp_extract_all(string_split(text, chr(10))[i], '{s.PATTERN}'), lambda t: i))) AS lines FROM m)
        SELECT doc_id, code, CAST(loc AS INTEGER) AS index, lines[CASE WHEN code = 'i' THEN greatest(loc - 1, 0) ELSE loc END + 1] AS line,
          CASE WHEN code <> 'x' THEN {_ALL}[w[loc + 1] + 1] END AS new_token, CASE WHEN code <> 'i' THEN {_ALL}[v[loc + 1] + 1] END AS old_token FROM a""",
    "distribution_metrics": f"""
        SELECT vec_id, round({_XENT}, 6) AS xentropy, round(f[truth + 1] * g[truth + 1], 6) AS indexed_prob, round(list_cosine_similarity(f, g), 6) AS cosine,
          round(1 - list_sum(list_transform(range(1, 33), lambda i: abs(f[i] - g[i]))) / 2, 6) AS agreement,
          abs(list_sum(f) - 1) <= 0.01 * greatest(list_sum(f), 1) AND abs(list_sum(g) - 1) <= 0.01 * greatest(list_sum(g), 1) AS normal FROM {_DIST}""",
    "fix_candidates": f"""
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round({_XENT}, 6) DESC, vec_id) AS rank FROM {_DIST}),
        w AS (SELECT *, {_TOP.format('f')} AS a, {_TOP.format('g')} AS b FROM r WHERE rank <= 3),
        o AS (SELECT *, a || list_filter(b, lambda x: NOT list_contains(a, x)) AS offered FROM w),
        e AS (SELECT label, rank, vec_id, truth, list_transform(offered, lambda t: {{'code': 'i', 'token': t, 'original': NULL::INTEGER}}) || [{{'code': 'x', 'token': NULL::INTEGER, 'original': truth}}]
          || list_transform(offered, lambda t: {{'code': 's', 'token': t, 'original': truth}}) AS edits FROM o)
        SELECT label AS file, CAST(rank AS INTEGER) AS rank, CAST(i - 1 AS INTEGER) AS step, edits[i].code AS code, CAST(vec_id AS INTEGER) AS index, CAST(edits[i].token AS INTEGER) AS token, CAST(edits[i].original AS INTEGER) AS original
        FROM (SELECT *, unnest(range(1, len(edits) + 1)) AS i FROM e)""",
    "position_rank_topk": f"""SELECT label, rank, vec_id, xentropy FROM (SELECT label, vec_id, round({_XENT}, 6) AS xentropy,
        row_number() OVER (PARTITION BY label ORDER BY round({_XENT}, 6) DESC, vec_id) AS rank FROM {_DIST}) WHERE rank <= 3""",
    "best_suggestions": f"""SELECT vec_id, {_JOIN.format(f"list_sort(list_distinct({_TOP.format('f')} || {_TOP.format('g')}))")} AS suggestions,
        CAST(list_position(f, list_max(f)) - 1 AS INTEGER) AS argmax FROM {_DIST}""",
    "ngram_scores": f"""
        WITH c AS (SELECT v[i] AS previous, v[i + 1] AS next, count(*) AS n FROM (SELECT v, unnest(range(1, len(v))) AS i FROM {_VEC}) GROUP BY ALL)
        SELECT previous, next, n, round((n + 1.0::DOUBLE) / (sum(n) OVER (PARTITION BY previous) + {_V}), 9) AS probability FROM c""",
    "partition_split": f"SELECT owner, name, partition, set_name FROM {_SPLIT}",
    "partition_dedup": f"SELECT hash, partition, set_name FROM {_FIRST}",
    "partition_leaks": f"SELECT owner, name, count(DISTINCT (partition, set_name)) AS n_sets FROM {_SPLIT} GROUP BY owner, name HAVING count(DISTINCT (partition, set_name)) > 1",
    "first_n_subset": f"SELECT hash, partition, set_name FROM (SELECT *, row_number() OVER (PARTITION BY partition, set_name ORDER BY hash) AS k FROM {_FIRST}) WHERE k <= 10",
    "queue_split": "SELECT event_id, CASE WHEN coalesce(event_type = 'error', true) THEN 'dead' ELSE 'done' END AS state FROM events",
    "retry_dedup": "SELECT DISTINCT user_id FROM events WHERE coalesce(event_type = 'error', true)",
    "queue_pending": "SELECT event_id, user_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type <> 'error')",
}
