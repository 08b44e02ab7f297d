"""Token sequences: lexing prose, vocabularies, vectors, contexts and edits.

Everything is an array expression on one row per document, so a document's tokens are never
shuffled; rows are exploded only where the result has a row per token.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.binding import let

PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# The words that keep their text when tokens are abstracted.
KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield"
).split()
PUNCTUATION = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
SPECIAL = ["<UNK>", "<s>", "</s>"]
UNKNOWN, START, END = 0, 1, 2
ENTRIES = ["<IDENTIFIER>", "<NUMBER>", *KEYWORDS, *PUNCTUATION]
SIZE = len(SPECIAL) + len(ENTRIES)
FIRST = len(SPECIAL)


def tokens(text: Column) -> Column:
    """Words and single marks of a text, in order; null for null."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def tokens_with_lines(text: Column) -> Column:
    """Structs (token, line) with lines counted from 1. No token spans lines."""
    lines = F.split(text, "\n")
    return F.flatten(F.transform(lines, lambda line, i: F.transform(tokens(line), lambda t: F.struct(t.alias("token"), (i + 1).alias("line")))))


def token_lines(text: Column) -> Column:
    """Line of each token."""
    return F.flatten(F.transform(F.split(text, "\n"), lambda line, i: F.array_repeat(i + 1, F.size(tokens(line)))))


def abstracted(token: Column) -> Column:
    """Entry of a token: keywords and marks stand for themselves, other words for their class."""
    return F.when(token.isin(KEYWORDS) | token.isin(PUNCTUATION), token).when(token.rlike(r"^\p{N}"), "<NUMBER>").when(token.rlike(r"^[\p{L}_]"), "<IDENTIFIER>").otherwise("<OTHER>")


def vocabulary_map(entries: list[str] | None = None) -> Column:
    """Literal map from entry to index; indices begin behind the special entries."""
    return F.create_map(*(F.lit(x) for i, entry in enumerate(entries or ENTRIES) for x in (entry, i + FIRST)))


def to_index(entry: Column, strict: bool = False) -> Column:
    """Index of an entry; of unknown ones 0, or an error with ``strict``."""
    found = vocabulary_map()[entry]
    return F.coalesce(found, F.raise_error(F.concat(F.lit("out of vocabulary: "), entry)).cast("int") if strict else F.lit(UNKNOWN))


def to_text(index: Column) -> Column:
    """Entry of an index; null outside the vocabulary."""
    return F.get(F.array(*(F.lit(x) for x in SPECIAL + ENTRIES)), index)


def vectors(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and vector: the indices of each text's tokens. Null texts have none and are left out."""
    index = F.transform(tokens(F.col(text)), lambda t: to_index(abstracted(t)))
    return documents.where(F.col(text).isNotNull()).select(key, index.alias("vector"))


def discovered_vocabulary(documents: DataFrame, text: str = "text") -> DataFrame:
    """Distinct entries that occur, each document's reduced to its own before they are shuffled."""
    own = F.array_distinct(F.transform(tokens(F.col(text)), abstracted))
    return documents.select(F.explode(own).alias("entry")).distinct()


def printed(vector: Column) -> Column:
    """Texts of a vector, separated by spaces."""
    return F.array_join(F.transform(vector, to_text), " ")


def ascii_code(vector: Column) -> Column:
    """A vector as a string of one ASCII character for each index."""
    return F.array_join(F.transform(vector, lambda v: F.chr(v.cast("long") + 33)), "")


def forward_contexts(vector: Column, k: int) -> Column:
    """Per position a struct (c1 .. ck, target): the k indices before it, padded with <s>.

    Shifted copies of the whole vector are zipped: work grows with k times its length.
    """
    n = F.size(vector)
    shifted = [F.slice(F.concat(F.array_repeat(F.lit(START), j), vector), F.lit(1), n).alias(f"c{j}") for j in range(k, 0, -1)]
    return F.arrays_zip(*shifted, vector.alias("target"))


def backward_contexts(vector: Column, k: int) -> Column:
    """Per position a struct (c1 .. ck, target): the k indices behind it, in order, padded with </s>."""
    n = F.size(vector)
    rest = lambda j: F.slice(vector, F.least(F.lit(j), n) + 1, F.greatest(n - j, F.lit(0)))
    shifted = [F.slice(F.concat(rest(j), F.array_repeat(F.lit(END), j)), F.lit(1), n).alias(f"c{j}") for j in range(1, k + 1)]
    return F.arrays_zip(*shifted, vector.alias("target"))


def contexts(vectors_: DataFrame, k: int, backwards: bool = False, key: str = "doc_id") -> DataFrame:
    """A row per token with its context."""
    order = range(1, k + 1) if backwards else range(k, 0, -1)
    zipped = (backward_contexts if backwards else forward_contexts)(F.col("vector"), k)
    rows = vectors_.select(key, F.posexplode(zipped).alias("pos", "c"))
    return rows.select(key, "pos", F.array(*(F.col(f"c.c{j}") for j in order)).alias("context"), F.col("c.target").alias("target"))


def batch_targets(vectors_: DataFrame, size: int, top: int, key: str = "doc_id") -> DataFrame:
    """key, batch, target, n, percent: the most frequent targets of each run of ``size`` tokens, lower
    indices first among equals, and [other] for the rest."""
    rows = vectors_.select(key, F.posexplode("vector").alias("pos", "v")).groupBy(key, F.floor(F.col("pos") / size).alias("batch"), "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = rows.groupBy(key, "batch").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("v").alias("v")))).alias("r"))
    best = F.transform(F.slice("r", 1, top), lambda x: F.struct(to_text(x["v"]).alias("target"), (-x["m"]).alias("n")))
    rest = F.aggregate(F.slice("r", top + 1, size), F.lit(0).cast("long"), lambda acc, x: acc - x["m"])
    lines = F.when(rest > 0, F.concat(best, F.array(F.struct(F.lit("[other]").alias("target"), rest.alias("n"))))).otherwise(best)
    return ranked.select(key, "batch", "all", F.inline(lines)).select(key, "batch", "target", "n", F.round(F.lit(100.0) * F.col("n") / F.col("all"), 2).alias("percent"))


# edits: structs (code, index, token, original); codes i, x and s


def inserted(vector: Column, index: Column, token: Column) -> Column:
    return F.concat(F.slice(vector, F.lit(1), index), F.array(token), F.slice(vector, index + 1, F.greatest(F.size(vector) - index, F.lit(0))))


def removed(vector: Column, index: Column) -> Column:
    return F.concat(F.slice(vector, F.lit(1), index), F.slice(vector, index + 2, F.greatest(F.size(vector) - index - 1, F.lit(0))))


def substituted(vector: Column, index: Column, token: Column) -> Column:
    return F.transform(vector, lambda v, i: F.when(i == index, token).otherwise(v))


def applied(vector: Column, edit: Column) -> Column:
    """The vector after an edit; an error for an unknown code or an index out of bounds, null for a null vector."""
    code, index, token = edit["code"], edit["index"], edit["token"]
    fits = (index >= 0) & (index < F.size(vector) + (code == "i").cast("int"))
    changed = F.when(code == "i", inserted(vector, index, token)).when(code == "x", removed(vector, index)).when(code == "s", substituted(vector, index, token))
    return F.when(vector.isNull() | edit.isNull(), None).when(fits & code.isin("i", "x", "s"), changed).otherwise(F.raise_error(F.lit("edit does not fit")).cast("array<int>"))


def inverse(edit: Column) -> Column:
    """The edit that undoes an edit."""
    code = edit["code"]
    return F.struct(
        F.when(code == "i", "x").when(code == "x", "i").otherwise("s").alias("code"), edit["index"].alias("index"), edit["original"].alias("token"), edit["token"].alias("original")
    )


def serialised(edit: Column) -> Column:
    """code, index, token and original as text; absent parts are empty."""
    return F.concat_ws(":", edit["code"], edit["index"].cast("string"), F.coalesce(edit["token"].cast("string"), F.lit("")), F.coalesce(edit["original"].cast("string"), F.lit("")))


def deserialised(text: Column) -> Column:
    """The edit of a text; an error where its code lacks a part."""
    part = F.split(text, ":")
    number = lambda i: F.when(part[i] != "", part[i].cast("int"))
    edit = F.struct(part[0].alias("code"), part[1].cast("int").alias("index"), number(2).alias("token"), number(3).alias("original"))
    fits = ((part[0] == "i") & number(2).isNotNull()) | ((part[0] == "x") & number(3).isNotNull()) | ((part[0] == "s") & number(2).isNotNull() & number(3).isNotNull())
    return F.when(fits, edit).otherwise(F.raise_error(F.lit("edit lacks a part")).cast("struct<code:string,index:int,token:int,original:int>"))


def drawn_edit(vector: Column, seed: Column) -> Column:
    """An edit drawn by a number: kind, place and token follow from it, so it can be drawn again.

    Tokens are drawn evenly from the representable indices, for a substitution without the original;
    an empty vector can only take an insertion.
    """
    n = F.size(vector)
    pick = seed % 3
    code = F.when((pick == 0) | (n == 0), "i").when(pick == 1, "x").otherwise("s")
    draw = (seed * 7919 + 13) % 1_000_003
    index = F.when(code == "i", draw % (n + 1)).otherwise(draw % F.greatest(n, F.lit(1))).cast("int")
    original = F.get(vector, index)
    step = (seed * 31) % (SIZE - FIRST - 1) + FIRST
    other = F.when(step >= original, step + 1).otherwise(step)
    token = F.when(code == "i", (seed * 31) % (SIZE - FIRST) + FIRST).when(code == "s", F.when(original < FIRST, step).otherwise(other)).cast("int")
    return F.struct(code.alias("code"), index.alias("index"), token.alias("token"), F.when(code != "i", original).alias("original"))


def with_single_fix(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """``pairs`` with fix: the one edit that turns ``before`` into ``after``, placed behind their common
    beginning; null if none does.

    Step by step in columns, so that the common beginning is looked for once.
    """
    a, b = F.col(before), F.col(after)
    shortest = F.least(F.size(a), F.size(b))
    differs = F.zip_with(F.slice(a, F.lit(1), shortest), F.slice(b, F.lit(1), shortest), lambda x, y: x != y)
    found = pairs.withColumn("_at", F.array_position(differs, True).cast("int") - 1)
    found = found.withColumn("_at", F.when(F.col("_at") < 0, shortest).otherwise(F.col("_at")))
    at, more = F.col("_at"), F.size(b) - F.size(a)
    rest = lambda v, skip: F.slice(v, at + 1 + skip, F.greatest(F.size(v) - at - skip, F.lit(0)))
    code = F.when(more == 1, "i").when(more == -1, "x").when((more == 0) & (at < F.size(a)), "s")
    found = found.withColumn("_code", code).withColumn("_same", rest(a, (F.col("_code") != "i").cast("int")) == rest(b, (F.col("_code") != "x").cast("int")))
    edit = F.struct(
        F.col("_code").alias("code"), at.alias("index"), F.when(F.col("_code") != "x", F.get(b, at)).alias("token"), F.when(F.col("_code") != "i", F.get(a, at)).alias("original")
    )
    return found.withColumn("fix", F.when(F.col("_same"), edit)).drop("_at", "_code", "_same")


def _different_ends(a: Column, b: Column) -> Column:
    """Struct (a, b) of two strings without what they have in common at the beginning and at the end."""

    def cut(x: Column, y: Column) -> Column:
        least = F.least(F.length(x), F.length(y))
        # halving: the longest common beginning, in as many comparisons as its length has digits
        def step(acc: Column, _: Column) -> Column:
            middle = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
            same = F.substring(x, F.lit(1), middle) == F.substring(y, F.lit(1), middle)
            return F.struct(F.when(same, middle).otherwise(acc["lo"]).alias("lo"), F.when(same, acc["hi"]).otherwise(F.greatest(middle - 1, acc["lo"])).alias("hi"))

        start = F.struct(F.lit(0).alias("lo"), least.cast("int").alias("hi"))
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(least, F.lit(1)) + 1)).cast("int"))
        return F.aggregate(rounds, start, step, lambda acc: acc["lo"])

    def without(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        return let(cut(x, y), lambda n: F.struct(F.substring(x, n + 1, F.length(x) - n).alias("x"), F.substring(y, n + 1, F.length(y) - n).alias("y")))

    backwards = lambda s: F.struct(F.reverse(s["x"]).alias("x"), F.reverse(s["y"]).alias("y"))
    return let(let(let(F.struct(a.alias("x"), b.alias("y")), without), backwards), without)


def string_distance(a: Column, b: Column, bands: tuple[int, ...] = (32, 1024)) -> Column:
    """Edit distance of two strings: common ends are cut off, then ever wider bands of the table are
    filled until the distance lies inside; only what lies in none takes the whole table."""

    def within(s: Column) -> Column:
        out = F.levenshtein(s["x"], s["y"])
        for band in reversed(bands):
            tried = F.levenshtein(s["x"], s["y"], band)
            out = F.when(tried >= 0, tried).otherwise(out)
        return out

    return let(_different_ends(a, b), within)


def distance(before: Column, after: Column) -> Column:
    """Token edit distance of two vectors."""
    return string_distance(ascii_code(before), ascii_code(after))


def edit_line(lines: Column, edit: Column) -> Column:
    """Line of an edit in the text before it: of the token it changes, or for an insertion of the one
    before it. Null without tokens."""
    at = F.when(edit["code"] == "i", F.greatest(edit["index"] - 1, F.lit(0))).otherwise(edit["index"])
    return F.get(lines, at)


# reports on edits


def line_text(tokens_: Column, columns: Column) -> Column:
    """A line put together from its tokens at their columns; tokens never overlap."""
    zipped = F.arrays_zip(tokens_.alias("t"), columns.alias("c"))
    return F.aggregate(zipped, F.lit(""), lambda acc, x: F.concat(F.rpad(acc, F.greatest(x["c"], F.length(acc)), " "), x["t"]))


def suggestion(file: Column, line: Column, column: Column, edit: Column, old: Column, new: Column, text: Column) -> Column:
    """Four lines: where, what to try, the line and a caret under its place. Columns count from 0, the
    place is written from 1."""
    what = F.when(edit["code"] == "i", F.format_string("try inserting '%s'", new)).when(edit["code"] == "x", F.format_string("try removing '%s'", old)).otherwise(F.format_string("try replacing '%s' with '%s'", old, new))
    return F.concat_ws("\n", F.format_string("%s:%d:%d: syntax error", file, line, column + 1), what, F.concat(F.lit("    "), text), F.concat(F.lit("    "), F.repeat(F.lit(" "), column), F.lit("^")))


def location_end(text: Column, line: Column, column: Column) -> Column:
    """Struct (line, column) of the last character of a token that begins at a place."""
    parts = F.split(text, "\n")
    n = F.size(parts)
    last = F.length(F.element_at(parts, -1))
    return F.struct((line + n - 1).alias("line"), (F.when(n == 1, column + last).otherwise(last) - 1).alias("column"))


def spanned_lines(first: Column, last: Column) -> Column:
    return F.sequence(first, last)


def physical_lines(text: Column) -> Column:
    """Number of lines that hold a token."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: F.size(tokens(line)) > 0))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
