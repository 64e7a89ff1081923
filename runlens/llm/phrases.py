"""Phrases of a text cut at rolling-digest triggers, in NumPy.

A trigger is the position with the smallest rolling digest of ``core`` bytes among all such
positions inside a string of ``width`` bytes (the last of equals). Equal strings have their trigger
at the same place, wherever they stand, so the strings of a text fall into runs with one trigger
each: its phrases. ``width`` = 2 * ``core`` leaves about ``core`` / 2 strings to a phrase.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from runlens.llm import bytes as B


@dataclass
class Phrases:
    doc: np.ndarray      # row of the run
    low: np.ndarray      # first start of a string, in the document
    high: np.ndarray     # last start
    core: np.ndarray     # digest of the trigger's own bytes
    whole: np.ndarray    # digest of all bytes of the phrase and of how the trigger lies in it


def last_minimum(values: np.ndarray, span: int) -> np.ndarray:
    """For each i the position of the smallest of values[i : i + span], the last of equals."""
    at = np.arange(len(values), dtype=np.int32)
    best, have = values, 1
    while have < span:
        step = min(have, span - have)
        n = len(best) - step
        later = best[step:step + n] <= best[:n]
        at = np.where(later, at[step:step + n], at[:n])
        best = np.where(later, best[step:step + n], best[:n])
        have += step
    return at


def phrases(run: B.Run, width: int, core: int) -> Phrases:
    span = width - core + 1
    n = len(run.buf)
    empty = np.zeros(0, np.int64)
    if n < width:
        return Phrases(empty, empty, empty, empty.astype(B.U64), empty.astype(B.U64))
    table = B.digest_table(run.buf)
    grams = B.digests(table, np.arange(n - core + 1), np.arange(core, n + 1))
    trigger = last_minimum(grams, span)[:n - width + 1].astype(np.int64)
    length = run.ends - run.starts
    doc = np.repeat(np.arange(run.n), length)[:n - width + 1]
    start = np.arange(n - width + 1)
    whole = start + width <= run.ends[doc]  # strings never cross documents
    start, doc, trigger = start[whole], doc[whole], trigger[whole]
    if not len(start):
        return Phrases(empty, empty, empty, empty.astype(B.U64), empty.astype(B.U64))
    new = np.ones(len(start), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1
    low, high, d = start[at], start[last], doc[at]
    second = B.digest_table(run.buf, seed=1)
    shape = B.mix(((trigger[at] - low) * 1024 + (high - low)).astype(B.U64))
    digest = B.digests(second, low, high + width) ^ shape
    return Phrases(d, low - run.starts[d], high - run.starts[d], grams[trigger[at]], digest)


def string_digests(run: B.Run, starts: np.ndarray, width: int) -> np.ndarray:
    """Digests of the strings of ``width`` bytes at these positions of the run."""
    return B.digests(B.digest_table(run.buf, seed=2), starts, starts + width)


@dataclass
class Pieces:
    """Parts of phrases: strings whose trigger lies ``step * k`` to ``step * (k + 1) - 1`` bytes in."""

    phrase: np.ndarray   # number of the phrase
    k: np.ndarray
    low: np.ndarray      # first and last start, in the run
    high: np.ndarray
    core: np.ndarray     # digest of the bytes that every string of the piece would cover
    whole: np.ndarray    # digest of the bytes its strings cover, and of their number


def pieces(run: B.Run, low: np.ndarray, high: np.ndarray, width: int, core: int, step: int) -> Pieces:
    """Cut phrases with starts ``low`` to ``high`` (positions in the run) into pieces."""
    table, second = B.digest_table(run.buf), B.digest_table(run.buf, seed=1)
    trigger = np.zeros(len(low), np.int64)
    for i, (a, b) in enumerate(zip(low, high)):
        at = np.arange(b, a + width - core + 1)  # the trigger lies in every string of the phrase
        grams = B.digests(table, at, at + core)
        trigger[i] = at[len(at) - 1 - np.argmin(grams[::-1])]
    first, last = (trigger - high) // step, (trigger - low) // step
    count = last - first + 1
    phrase = np.repeat(np.arange(len(low)), count)
    k = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + first[phrase]
    p_low = np.maximum(low[phrase], trigger[phrase] - step * k - step + 1)
    p_high = np.minimum(high[phrase], trigger[phrase] - step * k)
    begin = trigger[phrase] - step * k
    shape = B.mix(((begin - p_low) * 1024 + (p_high - p_low)).astype(B.U64))
    return Pieces(phrase, k, p_low, p_high, B.digests(table, begin, begin + width - step + 1),
                  B.digests(second, p_low, p_high + width) ^ shape)
