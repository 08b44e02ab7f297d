"""Queries over the tokens of source files, with the SQL that lexes Java by the same pattern."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import code as c
from corpusmill.operators import languages
from corpusmill.operators import sequence as s
from corpusmill.runtime import beside, spread
from corpusmill.sources.tables import read


def _of_language(spark, d, name):
    """Distinct sources that occur under a path of the language."""
    path = read(spark, d, "repository_source", "hash", "path")
    hashes = path.where(languages.language_of(F.col("path")) == name).select("hash").where("hash IS NOT NULL").distinct()
    return beside(spread(read(spark, d, "source_file"), "hash").dropDuplicates(["hash"]), hashes, "hash")


def _vectors(spark, d):
    return c.java_vectors(_of_language(spark, d, "java"))


def java_vectors(spark, d):
    return _vectors(spark, d).select("hash", F.size("vector").cast("long").alias("n_tokens"), F.array_join(F.col("vector").cast("array<string>"), " ").alias("vector"))


def java_entries(spark, d):
    rows = _of_language(spark, d, "java").select(F.explode(c.java_texts(F.col("source"))).alias("t")).select(F.coalesce(c.java_entry(F.col("t")), F.lit("<UNK>")).alias("entry"))
    return rows.groupBy("entry").agg(F.count(F.lit(1)).alias("n"))


def _contexts(spark, d, backwards):
    rows = s.contexts(_vectors(spark, d), 5, backwards, "hash")
    return rows.select("hash", F.col("pos").cast("long").alias("pos"), F.array_join(F.col("context").cast("array<string>"), " ").alias("context"), "target")


def java_contexts_forward(spark, d):
    return _contexts(spark, d, False)


def java_contexts_backward(spark, d):
    return _contexts(spark, d, True)


def java_neighbours(spark, d):
    return c.neighbour_counts(_vectors(spark, d))


def _edited(spark, d):
    """Vectors with an edit drawn by the first digits of their hash, and what it makes of them."""
    v = _vectors(spark, d).withColumn("seed", F.conv(F.substring("hash", 1, 6), 16, 10).cast("long"))
    v = v.withColumn("edit", s.drawn_edit(F.col("vector"), F.col("seed")))
    return v.withColumn("mutant", s.applied(F.col("vector"), F.col("edit")))


def java_edits_apply(spark, d):
    return _edited(spark, d).select("hash", "edit.code", F.col("edit.index").cast("long").alias("index"), F.col("edit.token").cast("long").alias("token"), "edit.original", F.array_join(F.col("mutant").cast("array<string>"), " ").alias("mutant"))


def java_token_distance(spark, d):
    return _edited(spark, d).select("hash", s.distance(F.col("vector"), F.col("mutant")).cast("long").alias("levenshtein"))


def java_determine_fix(spark, d):
    fixed = s.with_single_fix(_edited(spark, d), "vector", "mutant")
    return fixed.select("hash", F.inline(F.array_compact(F.array("fix")))).select("hash", "code", "index", "token", "original")


def java_batch_topk(spark, d):
    rows = _vectors(spark, d).select("hash", F.posexplode("vector").alias("pos", "v")).groupBy("hash", F.floor(F.col("pos") / 64).alias("batch"), "v").agg(F.count(F.lit(1)).alias("n"))
    best = rows.groupBy("hash", "batch").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "v"))).alias("r"))
    return best.select("hash", "batch", F.posexplode(F.slice("r", 1, 5)).alias("k", "x")).select("hash", "batch", (F.col("k") + 1).cast("long").alias("rank"), F.col("x.v").alias("target"), (-F.col("x.m")).alias("n"))


def _lengths(spark, d, name):
    lexed = c.lexed_vectors(_of_language(spark, d, name), name)
    return lexed.select("hash", F.size("vector").alias("n_tokens"), F.size(F.array_distinct("lines")).alias("n_lines"), F.size(F.filter("vector", lambda x: x == 0)).alias("n_unknown"))


def python_vector_lengths(spark, d):
    return _lengths(spark, d, "python")


def javascript_vector_lengths(spark, d):
    return _lengths(spark, d, "javascript")


def java_fixes(spark, d):
    """The single edits that mend the Java files that do not parse."""
    sources = _of_language(spark, d, "java").withColumn("language", F.lit("java"))
    verdicts = languages.parsed(sources).select("hash", "reason")
    lexed = c.lexed_vectors(sources, "java")
    broken = lexed.join(verdicts.where("reason IS NOT NULL"), "hash", "left_semi")
    valid = lexed.join(verdicts.where("reason IS NULL"), "hash", "left_semi")
    return c.fixes(broken, c.neighbour_counts(valid))


def java_mutant_fixes(spark, d):
    """Of each source spoilt by a drawn edit: the edits found that make it parse, in order, and whether one
    gives the source's tokens back."""
    e = _edited(spark, d).select("hash", "vector", "mutant")
    broken = e.select("hash", F.col("mutant").alias("vector"), F.array_repeat(F.lit(1), F.size("mutant")).alias("lines"))
    tried = c.fixes(broken, c.neighbour_counts(_vectors(spark, d)))
    edit = F.struct("code", "index", "token", "original")
    found = tried.join(e, "hash").withColumn("back", s.applied(F.col("mutant"), edit) == F.col("vector"))
    return found.select("hash", "rank", "step", "code", "index", "token", "original", "back")


QUERIES = {
    f.__name__: f
    for f in (java_vectors, java_entries, java_contexts_forward, java_contexts_backward, java_neighbours, java_edits_apply, java_token_distance, java_determine_fix, java_batch_topk, python_vector_lengths, javascript_vector_lengths, java_fixes, java_mutant_fixes)
}

_PATTERN = c.JAVA_PATTERN.replace("'", "''")
_FIXED = {text: kind for kind, text in c.JAVA_TEXT.items() if kind not in c.JAVA_CLASSES or kind == "UNDERSCORE"}
_QUOTED = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
_NUMBER = """CASE WHEN lower(t) LIKE '%l' THEN 'LONGLITERAL' WHEN lower(t) LIKE '%f' AND (lower(t) NOT LIKE '0x%' OR lower(t) LIKE '%p%') THEN 'FLOATLITERAL'
  WHEN t LIKE '%.%' OR lower(t) LIKE '%p%' OR (lower(t) NOT LIKE '0x%' AND (lower(t) LIKE '%e%' OR lower(t) LIKE '%d')) THEN 'DOUBLELITERAL' ELSE 'INTLITERAL' END"""
_ENTRY = f"""CASE WHEN regexp_matches(t, '^\\.?[0-9]') THEN {_NUMBER} WHEN len(t) > 1 AND t LIKE '"%' THEN 'STRINGLITERAL' WHEN len(t) > 1 AND t LIKE '''%' THEN 'CHARLITERAL'
  ELSE coalesce(({_QUOTED(list(_FIXED.values()))})[list_position({_QUOTED(list(_FIXED))}, t)], CASE WHEN regexp_matches(t, '^[\\p{{L}}_$]') THEN 'IDENTIFIER' END) END"""
_TEXTS = f"""(SELECT hash, list_filter(regexp_extract_all(x, '{_PATTERN}'), lambda t: NOT (t LIKE '/*%' OR t LIKE '//%')) AS w FROM (
  SELECT DISTINCT s.hash, TRY(decode(s.source)) AS x FROM source_file s WHERE s.hash IN (SELECT hash FROM repository_source WHERE path LIKE '%.java')) WHERE x IS NOT NULL)"""
_VECTOR = f"(SELECT hash, list_transform(w, lambda t: CAST(coalesce(list_position({_QUOTED(c.JAVA_ENTRIES)}, {_ENTRY}) + 2, 0) AS INTEGER)) AS v FROM {_TEXTS})"
_JOIN = "array_to_string(list_transform({}, lambda x: CAST(x AS VARCHAR)), ' ')"


_V, _F0 = s.SIZE, s.FIRST
_DRAWN = f"""(
  SELECT *, CASE code WHEN 'i' THEN (seed * 31) % {_V - _F0} + {_F0} WHEN 's' THEN CASE WHEN original < {_F0} THEN step WHEN step >= original THEN step + 1 ELSE step END END AS token
  FROM (SELECT *, CASE WHEN code <> 'i' THEN v[idx + 1] END AS original, (seed * 31) % {_V - _F0 - 1} + {_F0} AS step
    FROM (SELECT *, CASE WHEN code = 'i' THEN draw % (len(v) + 1) ELSE draw % greatest(len(v), 1) END AS idx
      FROM (SELECT *, CASE WHEN seed % 3 = 0 OR len(v) = 0 THEN 'i' WHEN seed % 3 = 1 THEN 'x' ELSE 's' END AS code, (seed * 7919 + 13) % 1000003 AS draw
        FROM (SELECT hash, v, CAST('0x' || hash[1:6] AS BIGINT) AS seed FROM {_VECTOR})))))"""
_MUTANT = f"""(SELECT *, CASE code WHEN 'i' THEN v[1:idx] || [CAST(token AS INTEGER)] || v[idx + 1:] WHEN 'x' THEN v[1:idx] || v[idx + 2:]
  ELSE v[1:idx] || [CAST(token AS INTEGER)] || v[idx + 2:] END AS w FROM {_DRAWN})"""


def _context(part: str) -> str:
    return f"SELECT hash, i AS pos, {_JOIN.format(part)} AS context, v[i + 1] AS target FROM (SELECT hash, v, unnest(range(len(v))) AS i FROM {_VECTOR})"


ORACLES = {
    "java_vectors": f"SELECT hash, CAST(len(v) AS BIGINT) AS n_tokens, {_JOIN.format('v')} AS vector FROM {_VECTOR}",
    "java_entries": f"SELECT coalesce({_ENTRY}, '<UNK>') AS entry, count(*) AS n FROM (SELECT unnest(w) AS t FROM {_TEXTS}) GROUP BY 1",
    "java_contexts_forward": _context("(list_transform(range(5), lambda x: 1) || v)[i + 1:i + 5]"),
    "java_contexts_backward": _context("(v || list_transform(range(5), lambda x: 2))[i + 2:i + 6]"),
    "java_edits_apply": f"SELECT hash, code, idx AS index, token, original, {_JOIN.format('w')} AS mutant FROM {_MUTANT}",
    "java_token_distance": f"""SELECT hash, levenshtein(array_to_string(list_transform(v, lambda x: chr(x + 1)), ''), array_to_string(list_transform(w, lambda x: chr(x + 1)), '')) AS levenshtein
        FROM {_MUTANT}""",
    "java_determine_fix": f"""
        WITH m AS (SELECT *, list_position(list_transform(range(1, least(len(v), len(w)) + 1), lambda i: v[i] <> w[i]), true) AS p FROM {_MUTANT}),
        a AS (SELECT *, CASE WHEN coalesce(p, 0) > 0 THEN p - 1 ELSE least(len(v), len(w)) END AS loc FROM m)
        SELECT hash, code, CAST(loc AS INTEGER) AS index, CASE WHEN code <> 'x' THEN w[loc + 1] END AS token, CASE WHEN code <> 'i' THEN v[loc + 1] END AS original FROM a""",
    "java_batch_topk": f"""
        SELECT hash, batch, rank, target, n FROM (SELECT hash, batch, x AS target, n, row_number() OVER (PARTITION BY hash, batch ORDER BY n DESC, x) AS rank
          FROM (SELECT hash, i // 64 AS batch, v[i + 1] AS x, count(*) AS n FROM (SELECT hash, v, unnest(range(len(v))) AS i FROM {_VECTOR}) GROUP BY ALL)) WHERE rank <= 5""",
    "java_neighbours": f"SELECT x[i] AS previous, x[i + 1] AS next, count(*) AS n FROM (SELECT x, unnest(range(1, len(x))) AS i FROM (SELECT [1] || v || [2] AS x FROM {_VECTOR})) GROUP BY 1, 2",
}
