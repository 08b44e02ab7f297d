"""License of each file and repository.

Statements are the evidence of a small Bayesian network: the license is the hidden node, each
statement a child that names the true license with its reliability and any other one with the rest,
spread evenly. The posterior ranks what was named. ``agreement`` is the probability that all
statements are true at once, which is zero where two of them name different licenses.

Three statements decide a file's license: its opening comment, the license files in the root of its
repository, and the repository's recorded license. Without one the prior stands, and the license is
unknown; without agreement it is a conflict. Manifests and readmes in the root are evidence, too, for
the posterior of files and repositories. License files are known by their title or by their body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import comments
from corpusmill.runtime import beside, cut, spread
from corpusmill.sources.tables import owner_key

_V = r"[\s,-]*(?:version|v)?\.?\s*"
# Spellings of the licenses.
NAMES = {
    "LGPL-2.1": rf"(?:\blgpl|\blesser general public licen[cs]e|\blesser gpl){_V}2\.1(?!\.?\d)",
    "GPL-2.0": rf"(?:\bgpl|\bgnu general public licen[cs]e){_V}2(?:\.0)?(?!\.?\d)",
    "GPL-3.0": rf"(?:\bgpl|\bgnu general public licen[cs]e){_V}3(?:\.0)?(?!\.?\d)",
    "Apache-2.0": rf"(?:\bapache(?: software)?(?: licen[cs]e)?|\basl){_V}2(?:\.0)?(?!\.?\d)",
    "BSD-2-Clause": r"\bbsd[\s-]*(?:2|two)\b|\b(?:2|two)[\s-]*clause\s+bsd\b|\bsimplified bsd\b|\bfreebsd licen[cs]e\b",
    "BSD-3-Clause": r"\bbsd[\s-]*(?:3|three)\b|\b(?:3|three)[\s-]*clause\s+bsd\b|\b(?:modified|new|revised) bsd\b",
    "MPL-2.0": rf"(?:\bmpl|\bmozilla public licen[cs]e){_V}2(?:\.0)?(?!\.?\d)",
    "ISC": r"\bisc\b",
    "MIT": r"\bmit\b|\bexpat\b",
    "Unlicense": r"\bunlicense\b",
}
_NAMES = {key: re.compile(pattern, re.IGNORECASE) for key, pattern in NAMES.items()}
#: What places a file under a license; a name alone does not.
_PLACED = re.compile(
    r"SPDX-License-Identifier:|@licen[cs]e\b|\blicen[cs]e:|\b(?:licen[cs]ed|released|distributed|redistributed|published|provided|available|offered|covered)\s+under\b"
    r"|\bgoverned by\b|\bsubject to\b|\bterms of\b|\bdistributed with \S+ -",
    re.IGNORECASE,
)
_SENTENCE_END = re.compile(r"[.;](?=\s+[A-Z]|\s*\Z)")
_COPYRIGHT = re.compile(r"(?:copyright\b|\(c\)|\xa9|all rights reserved)", re.IGNORECASE)
FILE_NAME = r"(?:^|/)(?:LICENSE|LICENCE|COPYING|UNLICENSE|License)(?:\.[^/.]*)?$"
#: Chance that a statement names the true license: opening comment, license file, recorded license.
RELIABILITY = {"header": 0.97, "file": 0.95, "recorded": 0.85, "manifest": 0.9, "readme": 0.7}
DECIDING = ["header", "file", "recorded"]
# Sentences of the licenses' bodies, with single spaces, in lower case.
BODIES = {
    "MIT": ["permission is hereby granted, free of charge, to any person obtaining a copy"],
    "ISC": ["permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"],
    "BSD-3-Clause": ["redistribution and use in source and binary forms", "endorse or promote products derived"],
    "BSD-2-Clause": ["redistribution and use in source and binary forms"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "Apache-2.0": ["terms and conditions for use, reproduction, and distribution", "http://www.apache.org/licenses/"],
}
MANIFEST_NAME = r"^(?:package\.json|setup\.py|setup\.cfg|pyproject\.toml|Cargo\.toml|pom\.xml|composer\.json)$"
README_NAME = r"(?i)^readme(?:\.[^/.]*)?$"
_MANIFEST = re.compile(r"""\blicen[cs]e["']?[ \t]*[:=][ \t]*[^\n,}]*|<licen[cs]e>.*?</licen[cs]e>|\blicen[cs]e[ \t]*::[^"'\n]*""", re.IGNORECASE | re.DOTALL)
_README = re.compile(r"^(?:#+[ \t]*licen[cs]e\b[^\n]*\n|licen[cs]e[ \t]*\n[-=~]+[ \t]*\n)(.*?)(?=^#+ |^[^\n]+\n[-=~]{3,}[ \t]*$|\Z)", re.IGNORECASE | re.MULTILINE | re.DOTALL)


def named(text: str) -> list[str]:
    """Licenses that a phrase names, in order."""
    return sorted(key for key, pattern in _NAMES.items() if pattern.search(text))


def _named_behind(rest: str, after: str, prose: bool) -> set[str]:
    """Licenses named in what follows a phrase on its line, with names that are wrapped to the next line.
    In prose the next line counts as far as the sentence goes if the phrase's line names none."""
    found = set(named(rest))
    if _SENTENCE_END.search(rest) or not after.strip():
        return found
    found.update(key for key, pattern in _NAMES.items() if any(m.start() < len(rest) for m in pattern.finditer(f"{rest} {after}")))
    return found or set(named(_SENTENCE_END.split(after)[0]) if prose else ())


def stated_in_header(text: str) -> list[str]:
    """Licenses under which the opening comment places the file; phrases and names may be wrapped."""
    found: set[str] = set()
    lines = comments.lines(comments.opening(text)[0])
    for line, after, later in zip(lines, [*lines[1:], ""], [*lines[2:], "", ""]):
        for place in _PLACED.finditer(f"{line} {after}"):
            if place.start() >= len(line):
                continue
            wrapped = place.end() - len(line) - 1
            rest, following = (after[wrapped:], [later, ""]) if wrapped > 0 else (line[place.end():], [after, later])
            if not rest.strip(" :"):
                rest, *following = following
            found.update(_named_behind(rest, following[0] if rest.strip() and following else "", place[0][-1] != ":" and place[0][0] != "@"))
    return sorted(found)


def stated_in_file(text: str) -> list[str]:
    """Licenses that a license file states in its title: the first lines with text that are no copyright
    notice, up to a blank line or such a notice."""
    title: list[str] = []
    for line in text.lstrip("﻿").split("\n"):
        bare = line.strip(" \t#=*-")
        if _COPYRIGHT.match(bare) or not line.strip():
            if title:
                break
        elif bare:
            title.append(bare)
    return named(" ".join(title)) or stated_in_body(text)


def stated_in_body(text: str) -> list[str]:
    """The license whose sentences the whole text holds, wherever they are wrapped; the first of BODIES."""
    if not any(x in text for x in ("ermission", "PERMISSION", "edistribution", "REDISTRIBUTION", "ublic domain", "TERMS AND CONDITIONS")):
        return []
    plain = " ".join(text.lower().split())
    return next(([key] for key, sentences in BODIES.items() if all(x in plain for x in sentences)), [])


def stated_in_manifest(text: str) -> list[str]:
    """Licenses that a package's manifest states in its license field or classifiers."""
    return named(" ; ".join(m[0] for m in _MANIFEST.finditer(text))) if "icen" in text or "ICEN" in text else []


def stated_in_readme(text: str) -> list[str]:
    """Licenses named in the sections on the license of a readme, whole."""
    return named(" ; ".join(m[0] for m in _README.finditer(text))) if "icen" in text or "ICEN" in text else []


STATEMENTS = {"header": stated_in_header, "file": stated_in_file, "manifest": stated_in_manifest, "readme": stated_in_readme}


def statements(source_file: DataFrame) -> DataFrame:
    """hash, header, file, manifest, readme: what each source states in its opening comment, and what it
    would as a license file, manifest or readme. Kept in the shared folder, as several joins read it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [comments.readable(s) for s in frame["source"]]
            yield pd.DataFrame({"hash": frame["hash"], **{kind: [read(t) for t in texts] for kind, read in STATEMENTS.items()}})

    schema = ", ".join(["hash string", *(f"{kind} array<string>" for kind in STATEMENTS)])
    return cut(spread(source_file.select("hash", "source").where("hash IS NOT NULL"), "hash").mapInPandas(run, schema).dropDuplicates(["hash"]))


def canonical(column: str | Column) -> Column:
    """License of a recorded spelling, null for none or an unknown one."""
    c = F.lower(F.col(column) if isinstance(column, str) else column)
    out = F.lit(None).cast("string")
    for key in reversed(NAMES):
        out = F.when(c.rlike(NAMES[key]), key).otherwise(out)
    return out


def posterior(evidence: dict[str, Column], known: int) -> Column:
    """Struct (license_id, probability, agreement) of the most probable license named, and the probability
    that all statements are true; null where none is named.

    Each piece of evidence is an array of names; one that names several spreads over them.
    """
    every = F.array_sort(F.array_distinct(F.concat(*evidence.values())))
    size = {kind: F.size(names) for kind, names in evidence.items()}

    def likelihood(candidate: Column, all_true: bool = False) -> Column:
        out = F.lit(1.0 / known)
        for kind, names in evidence.items():
            r = RELIABILITY[kind]
            true = F.array_contains(names, candidate) & ((size[kind] == 1) if all_true else F.lit(True))
            hit = F.when(true, F.lit(r) / size[kind]).otherwise(F.lit(0.0 if all_true else (1 - r) / max(known - 1, 1)))
            out = out * F.when(size[kind] > 0, hit).otherwise(F.lit(1.0))
        return out

    rest = F.lit(1.0 / known)
    for kind in evidence:
        rest = rest * F.when(size[kind] > 0, F.lit((1 - RELIABILITY[kind]) / max(known - 1, 1))).otherwise(F.lit(1.0))
    add = lambda acc, x: acc + x
    weights = F.transform(every, lambda x: F.struct(likelihood(x).alias("w"), x.alias("x")))
    total = F.aggregate(F.transform(weights, lambda x: x["w"]), F.lit(0.0), add) + rest * (F.lit(known) - F.size(every))
    agreed = F.aggregate(F.transform(every, lambda x: likelihood(x, True)), F.lit(0.0), add)
    best = F.array_max(weights)
    return F.when(F.size(every) > 0, F.struct(best["x"].alias("license_id"), (best["w"] / total).alias("probability"), (agreed / total).alias("agreement")))


def verdict(found: Column) -> Column:
    """License of a posterior: unknown where nothing is named, conflict where no license makes all
    statements true, else the most probable one."""
    return F.when(found.isNull(), "unknown").when(found["agreement"] <= 0, "conflict").otherwise(found["license_id"])


def repository_statements(repository_source: DataFrame, repository: DataFrame, stated: DataFrame) -> DataFrame:
    """_owner, name, file, manifest, readme, recorded: licenses by the root's files and on record. The
    owner is in its common spelling; every array holds at most the known licenses. Kept in the shared
    folder: one short row a repository."""
    kind = F.when(F.col("path").rlike(FILE_NAME), "file").when(F.col("path").rlike(MANIFEST_NAME), "manifest").when(F.col("path").rlike(README_NAME), "readme")
    roots = repository_source.where(~F.contains("path", F.lit("/"))).select(owner_key("owner").alias("_owner"), "name", "hash", kind.alias("_kind")).where("_kind IS NOT NULL").distinct()
    own = F.when(F.col("_kind") == "file", F.col("file")).when(F.col("_kind") == "manifest", F.col("manifest")).otherwise(F.col("readme"))
    names = lambda k: F.array_distinct(F.flatten(F.collect_set(F.when(F.col("_kind") == k, F.col("_names"))))).alias(k)
    files = roots.join(stated, "hash").select("_owner", "name", "_kind", own.alias("_names")).distinct().groupBy("_owner", "name").agg(*map(names, ("file", "manifest", "readme")))
    recorded = repository.select(owner_key("owner").alias("_owner"), "name", canonical("license").alias("license")).groupBy("_owner", "name").agg(F.collect_set("license").alias("recorded"))
    return cut(files.join(recorded, ["_owner", "name"], "full"))


def _listed(c: str, items: Column | None = None) -> Column:
    none = F.coalesce(F.col(c), F.array().cast("array<string>"))
    return (none if items is None else F.array_intersect(none, items)).alias(c)


def file_licenses(repository_source: DataFrame, source_file: DataFrame, repository: DataFrame, license_item: DataFrame) -> DataFrame:
    """owner, name, hash, path, license_id, probable, probability, agreement and the statements: one row
    per file that is not a license file.

    license_id is the license on which header, license files and record agree, ``unknown`` where none
    names one of ``license_item``, ``conflict`` where they name different ones; ``agreement`` is theirs.
    ``probable`` is the best name by all evidence, with its posterior; null for none. Repeated rows
    count once; mappings without a source row are no files.
    """
    stated = statements(source_file)
    items = license_item.agg(F.collect_set("license_id")).scalar()  # a dictionary of a few rows
    files = repository_source.select("owner", "name", "hash", "path").distinct().where(~F.col("path").rlike(FILE_NAME) | F.col("path").isNull())
    about = repository_statements(repository_source, repository, stated)
    headed = files.join(stated.select("hash", "header"), "hash").withColumn("_owner", owner_key("owner"))
    joined = beside(headed, about, ["_owner", "name"], "left")  # one repository may hold a large part of the files
    evidence = joined.select("owner", "name", "hash", "path", *(_listed(c, items) for c in RELIABILITY))
    decided = posterior({c: F.col(c) for c in DECIDING}, len(NAMES))
    best = posterior({c: F.col(c) for c in RELIABILITY}, len(NAMES))
    return evidence.withColumn("_decided", decided).withColumn("_best", best).select(
        "owner", "name", "hash", "path", verdict(F.col("_decided")).alias("license_id"), F.col("_best.license_id").alias("probable"),
        F.round("_best.probability", 6).alias("probability"), F.round("_decided.agreement", 6).alias("agreement"), *RELIABILITY,
    )


def repository_licenses(repository_source: DataFrame, source_file: DataFrame, repository: DataFrame) -> DataFrame:
    """owner, name, license_id, probable, probability of every repository by its license files and record
    (license_id), and by its manifests and readmes as well."""
    about = repository_statements(repository_source, repository, statements(source_file))
    kinds = ["file", "recorded", "manifest", "readme"]
    about = about.select("_owner", "name", *(_listed(c) for c in kinds))
    decided, best = posterior({c: F.col(c) for c in kinds[:2]}, len(NAMES)), posterior({c: F.col(c) for c in kinds}, len(NAMES))
    return about.withColumn("_decided", decided).withColumn("_best", best).select(
        F.col("_owner").alias("owner"), "name", verdict(F.col("_decided")).alias("license_id"), F.col("_best.license_id").alias("probable"), F.round("_best.probability", 6).alias("probability"),
    )
