"""Re-Pair grammars over token sequences, for many documents at once.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new symbol until no pair
repeats. Here every round replaces, in all documents together, each pair that repeats in its document
and is more frequent there than the pairs it overlaps (ties go to the left), so the rounds are
logarithmic in the length instead of one per rule, and each is a few sorts of flat arrays.

A symbol is the hash of the tokens it stands for (a polynomial modulo 2 ** 64), whatever pairs it was
built from. So rules of different documents are equal when they expand to the same tokens.
"""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _pair_counts(doc: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the pair at each position (the last of a document pairs with nothing), and its count."""
    key = symbols[:-1] * _MIX
    key ^= key >> np.uint64(31)
    key += symbols[1:]
    key *= _MIX
    key ^= key >> np.uint64(29)
    key += doc[:-1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)  # pairs of other documents are other pairs
    inside = doc[:-1] == doc[1:]
    order = np.argsort(key, kind="quicksort")
    ranked = key[order]
    run = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    length = np.diff(np.append(run, len(ranked)))
    count = np.empty(len(key), np.int64)
    count[order] = np.repeat(length, length)
    count[~inside] = 0
    return key, count


def _phrases(doc: np.ndarray, symbols: np.ndarray, power: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every run of ``width`` symbols of the start rules."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = symbols[:n].copy()
    for i in range(1, width):
        out = out * power[i : n + i] + symbols[i : n + i]
    inside = doc[:n] == doc[width - 1 :]
    return doc[:n][inside], out[inside]


def infer(sequences: list[np.ndarray], long: int = 8) -> dict[str, np.ndarray]:
    """Grammars of sequences of token hashes (uint64).

    Of each sequence size: its length; rules of the grammar; start: length of the start rule after all
    replacements; reuse: mean number of uses of a rule, 0 without rules. Empty sequences have all zeros.
    rule_of, rule: what others can share, as sequence and hash of the tokens: the rules that expand to at
    least ``long`` tokens, and the runs of ``long`` symbols on the right side of the start rule.
    """
    n = len(sequences)
    size = np.fromiter(map(len, sequences), np.int64, n)
    doc = np.repeat(np.arange(n), size)
    symbols = np.concatenate(sequences).astype(np.uint64) if n and size.sum() else np.zeros(0, np.uint64)
    power = np.full(len(symbols), _BASE)
    length = np.ones(len(symbols), np.int64)
    rules, uses = np.zeros(n, np.int64), np.zeros(n, np.int64)
    finished_start = np.zeros(n, np.int64)
    rule_of, rule = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    while len(symbols) > 1:
        key, count = _pair_counts(doc, symbols)
        left = np.append(np.int64(0), count[:-1])
        right = np.append(count[1:], np.int64(0))
        take = (count >= 2) & (count > left) & (count >= right)
        # in a run of equal counts every other position, from the first that overlaps none taken
        tie = (count >= 2) & (count == left) & (count >= right)
        here = np.arange(len(tie))
        first = np.maximum.accumulate(np.where(tie & ~np.append(False, tie[:-1]), here, 0))
        after_taken = np.append(False, take[:-1])[first]
        take |= tie & ((here - first) % 2 == after_taken)
        take &= ~np.append(False, take[:-1])
        if not take.any():
            break
        at = np.flatnonzero(take)
        order = np.argsort(key[at], kind="stable")
        ranked = key[at][order]
        begins = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        occurrences = np.diff(np.append(begins, len(ranked)))
        good = occurrences >= 2  # a rule used once saves nothing
        keep = np.empty(len(at), bool)
        keep[order] = np.repeat(good, occurrences)
        if not keep.any():
            break
        made = at[order[begins[good]]]  # one place of each new rule
        at = at[keep]
        whole = symbols[made] * power[made + 1] + symbols[made + 1]
        far = length[made] + length[made + 1] >= long
        rule_of.append(doc[made[far]])
        rule.append(whole[far])
        rules += np.bincount(doc[made], minlength=n)
        uses += np.bincount(doc[at], minlength=n)
        symbols, power, length = symbols.copy(), power.copy(), length.copy()
        symbols[at] = symbols[at] * power[at + 1] + symbols[at + 1]
        power[at] *= power[at + 1]
        length[at] += length[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        before = np.bincount(doc, minlength=n)
        symbols, power, length, doc = symbols[stay], power[stay], length[stay], doc[stay]
        # documents that a round leaves as they are have no more rules
        still = np.bincount(doc, minlength=n) != before
        finished = ~still & (before > 0)
        if finished.any():
            finished_start[finished] = before[finished]
            alive = ~finished[doc]
            of, phrase = _phrases(doc[~alive], symbols[~alive], power[~alive], long)
            rule_of.append(of)
            rule.append(phrase)
            symbols, power, length, doc = symbols[alive], power[alive], length[alive], doc[alive]
    finished_start += np.bincount(doc, minlength=n)
    of, phrase = _phrases(doc, symbols, power, long)
    rule_of.append(of)
    rule.append(phrase)
    return {
        "size": size, "rules": rules, "start": finished_start, "reuse": np.where(rules > 0, uses / np.maximum(rules, 1), 0.0),
        "rule_of": np.concatenate(rule_of), "rule": np.concatenate(rule),
    }


def shareable(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All distinct shareable rules, as sequence and mixed hash, ordered by both."""
    of, rule = found["rule_of"], found["rule"] * _MIX
    rule ^= rule >> np.uint64(32)
    order = np.lexsort((rule, of))
    of, rule = of[order], rule[order]
    if len(of):
        new = np.append(True, (of[1:] != of[:-1]) | (rule[1:] != rule[:-1]))
        of, rule = of[new], rule[new]
    return of, rule


def sampled(found: dict[str, np.ndarray], most: int) -> list[np.ndarray]:
    """Of each sequence the ``most`` least hashes of its shareable rules: a sample of the rules, the same for
    equal grammars, so that samples can be compared. No query decides by it."""
    of, rule = shareable(found)
    n = np.bincount(of, minlength=len(found["size"]))
    at = np.append(0, np.cumsum(n))
    return [rule[at[i] : min(at[i] + most, at[i + 1])] for i in range(len(n))]
