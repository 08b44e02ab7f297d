"""Texts cut off by field limits or on the way.

Each text's length is taken again under the encodings in which a store may have counted it: code
points, UTF-8 bytes, UTF-16 units, with HTML entities, as a JSON string, with CRLF line ends. Per
source and encoding, every length at which most of the texts that reach it end may be a hidden limit;
of the encodings that show a pile of texts, the one that holds most of it is kept. Then
the endings are inspected: one that is inside a word, sentence or code block says that the text was
cut; one that may be either (a link, a signature, a number before a full stop, an open bracket) says
so only for texts that stand at a hidden limit of their source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.runtime import cut

ENCODINGS = ["chars", "utf8", "utf16", "html", "json", "crlf"]
COMPLETE, EITHER, CUT = 0, 1, 2
_CLOSING = "\"')]*_\u00bb\u201d\u2019"
_SIGNATURE = re.compile(r"\n-- ?\n[^\n]+\Z")
_LINK = re.compile(r"(?:\b\w+:\s*)?\b[a-z][a-z0-9+.-]*://[^\s<>]*\Z", re.IGNORECASE)
_FULL_LINK = re.compile(r"[a-z][a-z0-9+.-]*://(?:[\w-]+\.)+[a-z]{2,}(?::\d+)?(?:/\S*[\w/])?\Z", re.IGNORECASE)
_REMARK = re.compile(r"\s[(\[][^()\[\]]+[)\]]\Z")
_SMILEY = re.compile(r"(?:(?<!\S)(?:[:;=8xX]['^]?-?[)(DPpOo3/\\|*]|<3|\^_?\^)|[\U0001F000-\U0001FAFF\u2600-\u27BF\u2300-\u23FF\u2B00-\u2BFF\uFE0F\u200D]+)\Z")
_STOP = ".!?\u3002\uff01\uff1f"
_BEGIN = re.compile(r"\n[ \t]*(?:\n|[-*+>#]+ |\d+[.)] )|```")
_SENTENCE = re.compile(rf"[{_STOP}][{re.escape(_CLOSING)}]*\s")


def lengths(text: str) -> list[int]:
    """Lengths in the order of ENCODINGS; a replacement character at the end stands for a broken one
    and is not counted."""
    text = text.rstrip("\ufffd")
    n = len(text)
    ascii_ = text.isascii()
    newlines = text.count("\n") - text.count("\r\n")
    quotes = text.count('"')
    return [
        n,
        n if ascii_ else len(text.encode("utf-8", "replace")),
        n if ascii_ else len(text.encode("utf-16-le", "replace")) // 2,
        n + 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * (quotes + text.count("'")),
        n + quotes + text.count("\\") + text.count("\n") + text.count("\r") + text.count("\t"),
        n + newlines,
    ]


def _last_sentence(text: str, line: int) -> str:
    """The last line, which begins at ``line``, with what its sentence has on the lines before, as far as
    the paragraph, list item or code block goes."""
    if "(" not in text:
        return text[line:]
    begin = max((m.end() for m in _BEGIN.finditer(text) if m.start() < line), default=0)
    return text[max((m.end() for m in _SENTENCE.finditer(text, begin, line)), default=begin) :]


def ending(text: str | None) -> int:
    """COMPLETE, EITHER or CUT by the end of the text; null and blank texts are complete."""
    text = (text or "").rstrip().rstrip("\u200b\ufeff")
    if not text:
        return COMPLETE
    if text.count("```") % 2:
        return CUT
    verdict = COMPLETE
    signature = _SIGNATURE.search(text)
    if signature:
        text, verdict = text[: signature.start()].rstrip(), EITHER
    elif text.endswith("\n--") or text.endswith("\n-"):
        return CUT
    while True:
        if not text:
            return verdict
        if text.endswith("```"):
            return verdict
        link = _LINK.search(text)
        if link:
            if not _FULL_LINK.search(text):
                return CUT
            text, verdict = text[: link.start()].rstrip(), EITHER
            continue
        remark = _REMARK.search(text)
        if remark and text[-2] not in _STOP:
            text = text[: remark.start()].rstrip()
            continue
        smiley = _SMILEY.search(text)
        if smiley:
            text = text[: smiley.start()].rstrip()
            if not text:
                return verdict
            continue
        break
    body = text.rstrip(_CLOSING)
    if body.endswith("`") and body.rstrip("`")[-1:] in _STOP:
        body = body.rstrip("`")
    if not body or body[-1] not in _STOP:
        return CUT
    last = text[text.rfind("\n") + 1 :]
    if last.replace("```", "").count("`") % 2:
        return CUT
    sentence = _last_sentence(text, len(text) - len(last))
    open_bracket = sentence.rfind("(")
    if (body[-2:-1].isdigit() and body[-1] == ".") or (open_bracket >= 0 and ")" not in sentence[open_bracket:] and sentence[open_bracket - 1 : open_bracket] not in (":", "-")):
        return max(verdict, EITHER)
    return verdict


def inspected(documents: DataFrame) -> DataFrame:
    """doc_id, source, ending, digest of the text and the length of each encoding, for every document.

    Kept in the shared folder, some eighty bytes a document, as the limits and the verdicts read it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            out = pd.DataFrame([lengths(t) if t else [0] * len(ENCODINGS) for t in texts], columns=ENCODINGS, dtype="int64")
            out["ending"] = [ending(t) for t in texts]
            out["digest"] = [xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "replace")) - (1 << 63) for t in texts]
            out["doc_id"], out["source"] = frame["doc_id"].to_numpy(), frame["source"].to_numpy()
            yield out

    kind = documents.schema["doc_id"].dataType.simpleString()
    return cut(
        documents.select("doc_id", "source", "text").mapInPandas(run, ", ".join(f"{e} bigint" for e in ENCODINGS) + f", ending int, digest bigint, doc_id {kind}, source string").select(
            "doc_id", "source", "ending", "digest", *ENCODINGS
        )
    )


def piles(sizes: np.ndarray, counts: np.ndarray, least: int, share: float, slack: int) -> list[tuple[int, int, int]]:
    """(length L, texts in [L - slack, L], texts that reach it) of a histogram with ascending sizes.

    Every length is tested. There are at least ``least`` texts in [L - slack, L], at least ``share``
    of all texts of L - slack or more that do not stand at a longer pile, so a second limit hides no
    first one; and they are four standard deviations more than the lengths before, eight times as
    many, let expect. L is the last frequent length of its pile.
    """
    total = np.append(0, np.cumsum(counts))
    before = lambda x: total[np.searchsorted(sizes, x)]
    at = before(sizes + 1) - before(sizes - slack)
    wide = np.clip(sizes - slack - 1, 1, 8 * (slack + 1))
    usual = (before(sizes - slack) - before(sizes - slack - wide)) * (slack + 1) / wide
    likely = (at >= least) & (at > usual + 4 * np.sqrt(usual))
    found: list[tuple[int, int, int]] = []
    beyond = 0  # texts at the longer piles
    floor = None
    for i in np.flatnonzero(likely)[::-1]:
        size = int(sizes[i])
        lo, hi = np.searchsorted(sizes, [size - slack, size + slack + 1])
        frequent = counts[lo:hi].max() / 2
        if counts[i] < frequent or (counts[i + 1 : hi] >= frequent).any() or (floor is not None and size >= floor):
            continue
        reach = int(total[-1] - before(size - slack)) - beyond
        if at[i] >= share * reach:
            found.append((size, int(at[i]), reach))
            beyond += int(at[i])
            floor = size - slack
    return found


def hidden_limits(lengths_: DataFrame, least: int = 5, share: float = 0.5, slack: int = 3) -> DataFrame:
    """source, encoding, size_limit, n_at_limit: the lengths where most texts end that come so far.

    Equal texts of a source count once, so that no copies make or hide a limit. Every length of a
    source's histogram of an encoding is tested (see ``piles``); the slack is for characters of
    several bytes that did not fit any more. A limit shows in other encodings too, less sharply: of
    the piles that share most of their texts, the one with the most is kept, with others only if they
    hold the same texts at the same length. The histogram has one row per source, encoding and
    length, whatever the number of documents.
    """
    texts = lengths_.select("source", "digest", *ENCODINGS).where("chars > 0").dropDuplicates(["source", "digest"])
    long = texts.select("source", F.explode(F.create_map(*[x for e in ENCODINGS for x in (F.lit(e), F.col(e))])).alias("encoding", "size"))
    histogram = long.groupBy("source", "encoding", "size").agg(F.count(F.lit(1)).alias("n"))

    def candidates(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size")
        rows = [
            (frame["source"].iloc[0], e, *pile)
            for e in ENCODINGS
            for own in [frame[frame["encoding"] == e]]
            for pile in piles(own["size"].to_numpy(), own["n"].to_numpy(), least, share, slack)
        ]
        return pd.DataFrame(rows, columns=["source", "encoding", "size_limit", "n", "reach"])

    def sharpest(frame: pd.DataFrame) -> pd.DataFrame:
        tried = frame["tried"].iloc[0]
        at = np.array([[k in set(x) for k in range(len(tried))] for x in frame["stands"]])
        n = frame["n"].to_numpy()
        left = np.ones(len(n), bool)  # texts that stand at no kept limit
        whole = n @ at
        rows = []
        while True:
            new = (n * left) @ at
            fit = (new >= least) & (new >= share * whole)
            if not fit.any():
                break
            best = max(np.flatnonzero(fit), key=lambda k: (new[k], new[k] / tried[k]["reach"], -k))
            for k, x in enumerate(tried):
                if x["size_limit"] == tried[best]["size_limit"] and (at[:, k] == at[:, best]).all():
                    rows.append((frame["source"].iloc[0], x["encoding"], x["size_limit"], int(whole[k])))
            left &= ~at[:, best]
        return pd.DataFrame(rows, columns=["source", "encoding", "size_limit", "n_at_limit"])

    found = histogram.groupBy("source").applyInPandas(candidates, "source string, encoding string, size_limit bigint, n bigint, reach bigint")
    tried = found.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("encoding", "size_limit", "reach"))).alias("tried")).withColumnRenamed("source", "_source")
    size = lambda x: F.coalesce(*[F.when(x["encoding"] == e, F.col(e)) for e in ENCODINGS])
    stands = F.filter(
        F.transform("tried", lambda x, i: F.when(size(x).between(x["size_limit"] - slack, x["size_limit"]), i)), lambda i: i.isNotNull()
    )
    standing = texts.join(F.broadcast(tried), texts["source"].eqNullSafe(F.col("_source"))).select("source", "tried", stands.alias("stands")).where(F.size("stands") > 0)
    patterns = standing.groupBy("source", "tried", "stands").agg(F.count(F.lit(1)).alias("n"))
    return patterns.groupBy("source").applyInPandas(sharpest, "source string, encoding string, size_limit bigint, n_at_limit bigint")


def judged(documents: DataFrame, slack: int = 3) -> DataFrame:
    """doc_id, source, ending, at_limit (encodings whose limit the text stands at), cut.

    ``documents``: doc_id, text, source; repeated rows are judged each. Null sources are a source of
    their own without limits. Blank and null texts are complete. An empty table gives an empty result.
    """
    seen = inspected(documents)
    limits = hidden_limits(seen, slack=slack).groupBy("source").agg(F.collect_list(F.struct("encoding", "size_limit")).alias("_limits"))
    stands = lambda e: F.exists("_limits", lambda x: (x["encoding"] == e) & F.col(e).between(x["size_limit"] - slack, x["size_limit"]))
    here = [F.when(stands(e), F.lit(e)) for e in ENCODINGS]
    return seen.join(F.broadcast(limits), "source", "left").select(
        "doc_id", "source", "ending", F.array_compact(F.array(*here)).alias("at_limit")
    ).withColumn("cut", (F.col("ending") == CUT) | ((F.col("ending") == EITHER) & (F.size("at_limit") > 0)))


def rates(documents: DataFrame) -> DataFrame:
    """source, n_documents, n_cut, n_at_limit, rate."""
    return judged(documents).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if("cut").alias("n_cut"), F.count_if(F.col("cut") & (F.size("at_limit") > 0)).alias("n_at_limit")
    ).withColumn("rate", F.round(F.col("n_cut") / F.col("n_documents"), 6))
