"""Generated, minified or vendored source files, and data saved as code.

Every source gets a Re-Pair grammar over its tokens (``grammar``) and the marks of its opening
comment. A notice counts as a generator's where the grammar shows one: its rules are reused, or its
start rule is short, as no hand-written file's is. A directory for libraries that may also hold own
code counts as a library's where its files share their long rules with repositories of other names,
copies with changed lines included. A file that is one literal is data; its literal's
incompressibility tells blobs from tables. What remains is hand-written.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import comments, grammar, neardup, windows
from corpusmill.llm.licenses import FILE_NAME
from corpusmill.runtime import beside, cut, spread

_TOKENS = re.compile(
    r"/\*.*?(?:\*/|\Z)|//[^\n]*|#[^\n]*"
    r"|[rRbBuUfF]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
    r"|(?:0[xX][0-9a-fA-F_]+|\d[\w.]*)|[^\W\d]\w*|[^\s]",
    re.DOTALL,
)
#: A notice that a program wrote the file, at the start of a line of the opening comment or by itself,
#: or an order to keep one's hands off it.
_NOTICE = re.compile(
    r"^@generated\b|^<auto-?generated|^auto-?\s?generated\b|\bautomatically (?:created|generated|produced|built|written) (?:by|from|with|using|file)\b"
    r"|\bautomatisch (?:erzeugt|erstellt|generiert)\b|^(?:this )?(?:code|file|source|source file|module|class|program) (?:was |is |has been )?(?:auto-?|automatically |machine-?)?(?:generated|created|produced|written) by\b"
    r"|^(?:auto-?)?generated (?:by|from|with|using|on)\b|^produced by \S+ (?:out of|from|with)\b|^machine[- ](?:written|generated|made|produced)\b"
    r"|^(?:généré|créé) automatiquement\b|^generado automáticamente\b"
    r"|\bany (?:manual )?(?:edits?|changes?) (?:is|are|will be) (?:overwritten|lost)\b"
    r"|\bdo not (?:edit|modify|change)\b|\b(?:changes|edits) (?:will be|are going to be|are) (?:lost|overwritten)\b|\bregenerate with\b|^(?-i:[A-Z][A-Z0-9_-]+ OUTPUT)$",
    re.IGNORECASE,
)
_BANNER = re.compile(r"^!?\s*@?([A-Za-z][\w.-]*?)(?:\.js)?(?: -)?,? (?:v|version |Version )?(\d+\.\d+(?:\.\d+)?(?:-[\w.]+)?)\b(?=\s*(?:[|(,*-]|$))")
#: Words that stand before a number without naming a library.
_NO_LIBRARY = {"version", "copyright", "python", "java", "javascript", "ecmascript", "es", "node", "since", "release", "revision", "requires", "section", "chapter", "step", "table", "figure"}
#: A generator's grammar: mean uses of a rule, or the start rule's part of the tokens.
REUSE = 6.0
START = 0.52
#: Tokens below which no grammar shows, so that a notice stands alone.
SHORT = 100
#: Part of a source's long rules that others must share.
SHARED = 0.5
#: Sources whose grammars are inferred together; bounds a worker's arrays.
AT_ONCE = 1000
# Words that are data.
_CONSTANTS = {"true", "false", "null", "None", "True", "False", "undefined", "NaN"}
_DECLARES = {"var", "let", "const", "export", "default", "final", "static", "public", "private", "protected", "abstract"}
_HOLDERS = {"class", "interface", "enum"}


def code_tokens(text: str) -> list[str]:
    """Tokens without comments, for any of the languages."""
    return [t for t in _TOKENS.findall(text) if not (t[0] == "#" or (t[0] == "/" and t[1:2] in ("/", "*")))]


def _kind(token: str) -> str:
    c = token[-1]
    if c in "\"'" and len(token) > 1:
        return "s"
    if token[0].isdigit():
        return "0"
    return "c" if token in _CONSTANTS else token if not (c.isalnum() or c == "_") else "n"


class _Kinds(dict):
    """Kind of a token; those met are remembered."""

    def __missing__(self, token: str) -> str:
        if len(self) > 400_000:
            self.clear()
        kind = self[token] = _kind(token)
        return kind


_kinds = _Kinds()


class _Data:
    """Recognises a file that is one literal: maybe bound to a name, in a class, or exported."""

    def __init__(self, tokens: list[str]) -> None:
        self.t = tokens + [""]
        self.k = [*map(_kinds.__getitem__, tokens), ""]
        self.items = self.chars = 0

    def value(self, i: int) -> int:
        """Behind the literal at ``i``, or -1. Works off nesting with a stack."""
        k, t = self.k, self.t
        stack: list[str] = []
        want = True
        while True:
            kind = k[i]
            if want:
                if kind in ("[", "(", "{"):
                    stack.append({"[": "]", "(": ")", "{": "}"}[kind])
                    i += 1
                    if k[i] == stack[-1]:
                        stack.pop()
                        i += 1
                        want = False
                    continue
                if kind in ("-", "+") and k[i + 1] == "0":
                    i += 1
                    continue
                if kind in ("0", "c"):
                    self.items += 1
                    i += 1
                elif kind == "s":
                    self.items += 1
                    self.chars += len(t[i])
                    i += 1
                    while k[i] == "s" or (k[i] == "+" and k[i + 1] == "s"):
                        self.chars += len(t[i])
                        i += 1
                elif kind == "n" and stack and stack[-1] == "}" and k[i + 1] == ":":
                    i += 1
                elif kind == "n" and (t[i] == "new" or k[i + 1] in ("(", ".")):
                    if t[i] == "new":
                        i += 1
                    while k[i] == "n" and k[i + 1] == ".":
                        i += 2
                    if k[i] != "n":
                        return -1
                    i += 1
                    while k[i] == "[" and k[i + 1] == "]":
                        i += 2
                    if k[i] not in ("(", "{"):
                        return -1
                    continue
                else:
                    return -1
                want = False
                continue
            if not stack:
                return i
            if kind == ",":
                i += 1
                if k[i] == stack[-1]:
                    stack.pop()
                    i += 1
                else:
                    want = True
            elif kind == ":" and stack[-1] == "}":
                i += 1
                want = True
            elif kind == stack[-1]:
                stack.pop()
                i += 1
            else:
                return -1

    def only(self) -> bool:
        t, k, i, n = self.t, self.k, 0, len(self.t) - 1
        while t[i] in ("import", "package", "from") and t[i + 1] != "(":  # what decodes the literal
            i += 1
            while k[i] == "n" and (k[i - 1] == "." or t[i - 1] in ("import", "package", "from")) or k[i] in (".", "*") or t[i] == "import":
                i += 1
            if k[i] == ";":
                i += 1
        closes = 0
        held = False
        while True:
            j = i
            while t[j] in _DECLARES:
                j += 1
            if t[j] in _HOLDERS and k[j + 1] == "n" and k[j + 2] == "{":
                held, closes, i = True, closes + 1, j + 3
            else:
                break
        while t[i] in _DECLARES:
            i += 1
        j = i
        while k[j] in ("n", ".", "[", "]", "<", ">", ",", ":") and j < n and not (k[j] == "[" and j == i):
            j += 1
        name = t[j - 1] if k[j] == "=" and k[j - 1] == "n" else ""
        if k[j] == "=" and j > i:
            name = next((x for x in reversed(t[i:j]) if _kind(x) == "n"), "")
            i = j + 1
        elif held:
            return False
        end = self.value(i)
        if end < 0:
            return False
        while closes or k[end] == ";":
            if k[end] == ";":
                end += 1
            elif k[end] == "}" and closes:
                closes -= 1
                end += 1
            else:
                return False
        if end < n and name:  # a name may be handed on
            rest = [x for x in t[end:n] if x not in (";", "export", "default", "module", ".", "exports", "=", "{", "}")]
            if len(rest) != 1 or _kind(rest[0]) != "n" or n - end > 8:
                return False
        elif end < n:
            return False
        return self.items >= 8 or self.chars >= 200


def minified(text: str, tokens: list[str]) -> bool:
    """Whether a script has been squeezed: few line ends and hardly any space for its code."""
    code = text[comments.opening(text)[1]:].strip()
    if len(code) < 200:
        return False
    if len(code) / (code.count("\n") + 1) < 150 or code[0] == "<" or sum(map(code.count, " \t\n")) >= 0.1 * len(code):
        return False
    long = sum(len(line) for line in code.split("\n") if len(line) >= 200)
    words = sum(1 for t in tokens if t[0].isalpha() or t[0] in "_$")
    marks = sum(map(code.count, "(){};=,"))
    return long >= 0.6 * len(code) and words >= 0.2 * max(len(tokens), 1) and marks >= 0.1 * len(code)


FEATURES = (
    "hash string, notice boolean, banner string, version string, squeezed boolean, data boolean, "
    "tokens int, rules int, start int, reuse double, literals double, incompressible double"
)


def banner_of(head: list[str]) -> tuple[str | None, str | None]:
    """Library and version that a comment names at the start of one of its first three lines or of a later
    paragraph."""
    for i, line in enumerate(head):
        if i < 3 or not head[i - 1].strip():
            m = _BANNER.match(line)
            if m and m[1].lower() not in _NO_LIBRARY:
                return m[1], m[2]
    return None, None


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = windows.Hashes()
    for frame in (whole.iloc[at : at + AT_ONCE] for whole in frames for at in range(0, len(whole), AT_ONCE)):
        rows, sequences = [], []
        for key, source in zip(frame["hash"], frame["source"]):
            text = comments.readable(source)
            head = comments.lines(comments.opening(text.lstrip("﻿"))[0])
            tokens = code_tokens(text)
            kind = list(map(_kinds.__getitem__, tokens))
            sequences.append(np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens)))
            literals = (kind.count("s") + kind.count("0") + kind.count("c")) / max(1, len(kind) - sum(map(kind.count, ",:;{}[]()")))
            longest = max(map(len, tokens), default=0)
            data = (literals >= 0.4 or longest >= 0.5 * len(text) > 0) and _Data(tokens).only()
            quoted = "".join(t for t in tokens if len(t) >= 64 and t[-1] in "\"'").encode() if data else b""
            rows.append(
                (key, any(_NOTICE.search(x) for x in head), *banner_of(head), minified(text, tokens), data, literals, len(zlib.compress(quoted, 1)) / len(quoted) if quoted else 0.0)
            )
        out = pd.DataFrame(rows, columns=["hash", "notice", "banner", "version", "squeezed", "data", "literals", "incompressible"])
        found = grammar.infer(sequences)
        out["tokens"], out["rules"], out["start"], out["reuse"] = found["size"], found["rules"], found["start"], found["reuse"]
        yield out[[c.split()[0] for c in FEATURES.split(", ")]]


def source_features(source_file: DataFrame) -> DataFrame:
    """One row per distinct hash with the marks and the grammar of its source.

    Kept in the shared folder, some two hundred bytes a source, as several joins read it.
    """
    return cut(spread(source_file.select("hash", "source").where("hash IS NOT NULL"), "hash").mapInPandas(_features, FEATURES).dropDuplicates(["hash"]))


# Directories that hold other projects' code, and those that hold own code as often.
_OTHERS = "_vendor|vendored|third_party|third-party|thirdparty|3rdparty|node_modules|bower_components|site-packages|dist-packages|jspm_packages|extern|external|externals|deps"
_EITHER = "libs|packages|lib|ext|contrib|plugins"
_PLACES = [rf"^(?:.*/)?({holders})/(?:(?:java|js|python|py|src)/)?(@?[^/]*?[A-Za-z][^/]*?)(-v?[0-9]+\.[0-9][^/]*)?/" for holders in (f"{_OTHERS}|vendor", _EITHER)]
_OPEN_VENDOR = r"^(?:(?:static|assets|public|web|app|src|resources|www)/)*vendor/"


def _library(path: Column, group: int) -> Column:
    """Holder, library directory or version in a path: of the last place for others' code, else of the last for either."""
    firm, loose = (F.regexp_extract(path, place, group) for place in _PLACES)
    found = F.when(path.rlike(_PLACES[0]), firm).otherwise(loose)
    return F.when(found != "", found)


RULE_ROWS = "bucket int, rules binary, names binary, own binary, keys binary"


def _cut_by(place: np.ndarray, buckets: int, *columns: np.ndarray) -> list[list[bytes]]:
    """For each bucket the bytes of the columns' values in it; the places are in order."""
    at = np.searchsorted(place, np.arange(buckets + 1))
    return [[column[at[b] : at[b + 1]].tobytes() for column in columns] for b in range(buckets)]


def _rule_rows(frames: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """Rows RULE_ROWS, one a bucket for some sources together: distinct long rules with the (hashed) names they
    stand under, and those of the wanted sources with these sources' keys."""
    hashes = windows.Hashes()
    for frame in (whole.iloc[at : at + AT_ONCE] for whole in frames for at in range(0, len(whole), AT_ONCE)):
        tokens = (code_tokens(comments.readable(source)) for source in frame["source"])
        of, rule = grammar.shareable(grammar.infer([np.fromiter(map(hashes.__getitem__, x), np.uint64, len(x)) for x in tokens]))
        first, last, named, key, wanted = (frame[c].to_numpy()[of] for c in ("first", "last", "named", "key", "wanted"))
        name = np.concatenate([first[named], last[named & (first != last)]]).astype(np.int32)
        under = np.concatenate([rule[named], rule[named & (first != last)]])
        place = under % np.uint64(buckets)
        order = np.lexsort((under, name, place))
        place, name, under = place[order], name[order], under[order]
        if len(under):
            new = np.append(True, (under[1:] != under[:-1]) | (name[1:] != name[:-1]))
            place, name, under = place[new], name[new], under[new]
        key, own = key[wanted], rule[wanted]
        own_place = own % np.uint64(buckets)
        order = np.argsort(own_place, kind="stable")
        rows = [(b, *x, *y) for b, (x, y) in enumerate(zip(_cut_by(place, buckets, under, name), _cut_by(own_place[order], buckets, own[order], key[order].astype(np.int64)))) if x[0] or y[0]]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RULE_ROWS.split(", ")])


def _shared_rules(bucket: pd.DataFrame) -> pd.DataFrame:
    """key, n, shared: of each wanted source its long rules in a bucket, and those that stand under several names."""
    rules, names, own, keys = (np.frombuffer(b"".join(bucket[c]), kind) for c, kind in (("rules", np.uint64), ("names", np.int32), ("own", np.uint64), ("keys", np.int64)))
    wide = np.zeros(0, np.uint64)
    if len(rules):
        order = np.argsort(rules)
        rules, names = rules[order], names[order]
        start = np.flatnonzero(np.append(True, rules[1:] != rules[:-1]))
        wide = rules[start[np.minimum.reduceat(names, start) != np.maximum.reduceat(names, start)]]
    order = np.lexsort((own, keys))
    own, keys = own[order], keys[order]
    if len(own):  # rows of one hash count once
        new = np.append(True, (own[1:] != own[:-1]) | (keys[1:] != keys[:-1]))
        own, keys = own[new], keys[new]
    key, of = np.unique(keys, return_inverse=True)
    return pd.DataFrame({"key": key, "n": np.bincount(of, minlength=len(key)), "shared": np.bincount(of[np.isin(own, wide)], minlength=len(key))})


def shared_sources(mappings: DataFrame, source_file: DataFrame) -> DataFrame:
    """hash of the wanted sources of which half of the long rules stand in repositories of several names; forks
    share theirs. ``mappings``: name, hash, and wanted for the files that it has to be known of.

    All long rules of all sources are compared. They are inferred here, not kept with the features, and
    travel in packed rows to buckets by hash, some nine tenths of the bytes of the sources' texts in hashes;
    a source's names are its first and last.
    """
    named = mappings.where("hash IS NOT NULL").groupBy("hash").agg(F.min("name").alias("_a"), F.max("name").alias("_b"), F.max("wanted").alias("wanted"))
    key = F.xxhash64("hash")
    named = named.select("hash", F.hash("_a").alias("first"), F.hash("_b").alias("last"), F.col("_a").isNotNull().alias("named"), key.alias("key"), "wanted")
    sources = source_file.select("hash", "source").where("hash IS NOT NULL")
    buckets = neardup.n_buckets(sources)
    rows = beside(spread(sources, "hash"), named, "hash").drop("hash").mapInPandas(lambda frames: _rule_rows(frames, buckets), RULE_ROWS)
    parts = rows.groupBy("bucket").applyInPandas(_shared_rules, "key bigint, n bigint, shared bigint").groupBy("key").agg((F.sum("shared") / F.sum("n")).alias("_part"))
    return named.where("wanted").join(parts.where(F.col("_part") >= SHARED).select("key"), "key").select("hash", F.lit(True).alias("_shared"))


def judged_files(repository_source: DataFrame, source_file: DataFrame) -> DataFrame:
    """owner, name, hash, path of every file, with reason: generated, minified, data, vendored or null.

    Distinct mappings whose hash has a source row; license files have no reason. Where several
    reasons hold, the first of generated, minified, data, vendored is given. Null paths belong to no
    library and no language; null and empty sources carry no marks.
    """
    features = source_features(source_file)
    files = repository_source.select("owner", "name", "hash", "path").distinct().join(features, "hash")
    files = files.withColumn("_holder", _library(F.col("path"), 1)).withColumn("_library", _library(F.col("path"), 2)).withColumn("_version", _library(F.col("path"), 3))
    others = F.coalesce(F.col("_holder").rlike(f"^({_OTHERS})$") | F.col("_version").isNotNull() | F.col("path").rlike(_OPEN_VENDOR), F.lit(False))
    # files in a library's directory, whosever it is; the rest joins nothing
    held = files.where("_library IS NOT NULL")
    unsure = cut(held.where(~others).select("_library", "_holder", "owner", "name", "hash", "path"))
    places = repository_source.select("name", "hash", "path", *(_library(F.col("path"), i).alias(c) for i, c in enumerate(("_holder", "_library", "_version"), 1)))
    shared = shared_sources(places.select("name", "hash", (F.col("_library").isNotNull() & ~others).alias("wanted")), source_file)
    # a library is known by a banner or by a directory of others' code; its name may then stand in any place for libraries
    known = held.where(others).select("_library").unionByName(files.where("banner IS NOT NULL").select(F.col("banner").alias("_library"))).distinct().withColumn("_known", F.lit(True))
    marked = unsure.join(shared, "hash", "left").join(known, "_library", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    vendored = marked.where(yes("_shared") & ((F.col("_holder") != "lib") | yes("_known"))).select("owner", "name", "hash", "path", F.lit(True).alias("_vendored"))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"v.{c}")) for c in ("hash", "path", "owner", "name")]
    marked = files.alias("f").join(vendored.alias("v"), same, "left").select("f.*", "v._vendored")
    library = F.col("_library").isNotNull() & (others | yes("_vendored"))
    at_home = F.col("banner").isNotNull() & ((F.lower("banner") == F.lower("name")) | F.lower("path").startswith(F.concat(F.lower("banner"), F.lit("/"))))
    script = F.lower("path").rlike(r"\.[cm]?jsx?$")
    written = (F.col("reuse") >= REUSE) | (F.col("start") <= START * F.col("tokens")) | (F.col("tokens") < SHORT)
    reason = (
        F.when(F.col("path").rlike(FILE_NAME), None)
        .when(F.col("notice") & written, "generated")
        .when(F.col("squeezed") & script & ~F.col("data"), "minified")
        .when(F.col("data"), "data")
        .when(library | (F.col("banner").isNotNull() & ~F.coalesce(at_home, F.lit(False))), "vendored")
    )
    return marked.select("owner", "name", "hash", "path", reason.alias("reason"), "tokens", "rules", "reuse", "literals", "incompressible")


def report(repository_source: DataFrame, source_file: DataFrame) -> DataFrame:
    """owner, name, reason (handwritten where none), n_files, mean_reuse."""
    return judged_files(repository_source, source_file).groupBy("owner", "name", F.coalesce("reason", F.lit("handwritten")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_files"), F.round(F.avg("reuse"), 4).alias("mean_reuse")
    )
