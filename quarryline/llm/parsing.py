"""Prefix-free parsing: the order of all suffixes of a text collection from the suffix arrays of its dictionary and its parse.

A rolling hash of ``WIDTH`` bytes runs over every text; where it is divisible by ``MODULUS`` a trigger begins. A phrase reaches from a
trigger (or the beginning of a text) to the end of the next one (or the end of the text), so neighbours overlap by ``WIDTH`` bytes. The distinct phrases
are the dictionary, the sequence of phrases of each text is the parse. Ends of phrases that are longer than a trigger form a prefix-free set, so two suffixes
of the collection are ordered by the phrase ends that they begin with, and where these are equal by the suffixes of the parse behind them. Repetitive
text has few distinct phrases: each is sorted once, however often it occurs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WIDTH = 6
MODULUS = 24
#: Bytes of a key: nine bits each, as a byte is one of 256 and the end of a phrase comes before all of them.
KEY_BYTES = 7

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def suffix_ranks(first: np.ndarray, left: np.ndarray, span: int) -> np.ndarray:
    """Ranks of all suffixes of sequences that stand one after another, each with an end mark; equal suffixes have equal ranks, end marks rank 0.

    ``first`` orders suffixes by their first ``span`` symbols, ``left`` counts the symbols before each suffix's end mark. Prefix doubling: ranks by k symbols
    give ranks by 2k; groups of one suffix, or of suffixes that have ended, are settled.
    """
    n = len(first)
    order = np.flatnonzero(left)
    order = order[np.argsort(first[order], kind="stable")]
    rank = np.zeros(n, np.int64)
    places = np.arange(len(order))
    new = np.concatenate([[True], np.diff(first[order]) != 0]) if len(order) else np.empty(0, bool)
    head = np.maximum.accumulate(np.where(new, places, 0)) if len(order) else places
    rank[order] = head + 1
    size = np.bincount(head, minlength=len(order))
    open_ = places[(size[head] > 1) & (left[order] >= span)]
    while len(open_):
        at = order[open_]
        key = rank[at] * np.int64(n + 2) + rank[at + span]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        new = np.concatenate([[True], np.diff(key) != 0])
        group = np.cumsum(new) - 1
        rank[at] = open_[new][group] + 1
        span *= 2
        open_ = open_[(np.bincount(group)[group] > 1) & (left[at] >= span)]
    return rank


@dataclass
class Parsing:
    """A collection as dictionary and parse."""

    ends: np.ndarray
    #: Per phrase occurrence: where it begins in the collection, its phrase, and its place in the parse, in which every text has an end mark.
    begins: np.ndarray
    phrase: np.ndarray
    place: np.ndarray
    #: The dictionary's phrases, one after another with end marks: where each begins, its length, and per byte the first ``KEY_BYTES`` bytes as one number.
    at: np.ndarray
    length: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    #: The suffix arrays, as ranks of every suffix.
    of_dictionary: np.ndarray
    of_parse: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, ends: np.ndarray, width: int = WIDTH, modulus: int = MODULUS) -> Parsing:
        """``data`` holds the texts' bytes, ``ends`` (n + 1) their bounds."""
        texts = np.flatnonzero(np.diff(ends) > 0)
        start = np.zeros(len(data) + 1, bool)
        start[ends[:-1][texts]] = True
        if len(data) >= width:
            rolling = np.zeros(len(data) - width + 1, np.uint64)
            for i in range(width):
                rolling = rolling * _FACTOR + data[i : len(data) - width + 1 + i]
            rolling ^= rolling >> np.uint64(29)
            found = np.flatnonzero((rolling * _FACTOR >> np.uint64(33)) % np.uint64(modulus) == 0)
            inside = ends[np.searchsorted(ends, found, "right")] >= found + width
            start[found[inside]] = True
        begins = np.flatnonzero(start)
        text = np.searchsorted(ends, begins, "right") - 1
        last = np.concatenate([text[1:] != text[:-1], [True]]) if len(begins) else np.empty(0, bool)
        stops = np.where(last, ends[text + 1], np.append(begins[1:], 0) + width)
        raw = data.tobytes()
        coded = pa.array([raw[a:b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)], pa.binary()).dictionary_encode()
        phrase = coded.indices.to_numpy().astype(np.int64)
        phrases = coded.dictionary.to_pylist()
        length = np.array([len(p) for p in phrases], np.int64)
        is_last = np.zeros(len(phrases), bool)
        is_last[phrase] = last
        at = np.cumsum(length + 1) - (length + 1)
        flat = np.frombuffer(b"\0".join(phrases) + b"\0", np.uint8).astype(np.int64) + 1 if phrases else np.empty(0, np.int64)
        flat[at + length] = 0
        left = np.repeat(at + length, length + 1) - np.arange(len(flat))
        keys = np.zeros(len(flat), np.int64)
        padded = np.concatenate([flat, np.zeros(KEY_BYTES, np.int64)])
        for i in range(KEY_BYTES):
            keys = keys << 9 | np.where(left > i, padded[i : i + len(flat)], 0)
        of_dictionary = suffix_ranks(keys, left, KEY_BYTES)
        place = np.arange(len(begins)) + np.cumsum(np.concatenate([[0], last[:-1]])) if len(begins) else begins
        parse = np.zeros(len(begins) + int(last.sum()) + 1, np.int64)
        parse[place] = of_dictionary[at[phrase]] if len(begins) else 0
        marks = np.flatnonzero(parse == 0)
        behind = marks[np.searchsorted(marks, np.arange(len(parse)))] - np.arange(len(parse))
        return cls(ends, begins, phrase, place, at, length, is_last, keys, of_dictionary, suffix_ranks(parse, behind, 1))

    def order(self, starts: np.ndarray, cap: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """``starts`` in the order of their suffixes (as indices, equal ones in their given order), and how many bytes, up to ``cap``, each has in common with the one before."""
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        owner = np.searchsorted(self.begins, starts, "right") - 1
        inside = self.at[self.phrase[owner]] + starts - self.begins[owner]
        head, tail = self.of_dictionary[inside], self.of_parse[self.place[owner] + 1]
        order = np.argsort(head * np.int64(len(self.of_parse) + 2) + tail, kind="stable")
        common = np.zeros(len(order), np.int64)
        a, b = order[:-1], order[1:]
        same = head[a] == head[b]
        other = np.flatnonzero(~same)
        common[other + 1] = self._in_dictionary(inside[a[other]], inside[b[other]], np.full(len(other), cap))
        # Equal phrase ends: the bytes before the next phrase, then phrase by phrase along the parse.
        same = np.flatnonzero(same)
        p, q = owner[a[same]], owner[b[same]]
        rest = self.length[self.phrase[p]] - (starts[a[same]] - self.begins[p])
        ended = self.last[self.phrase[p]]
        reach = np.where(ended, rest, rest - width)
        common[same + 1] = np.minimum(rest, cap)
        live = np.flatnonzero(~ended & (rest < cap))
        while len(live):
            p[live] += 1
            q[live] += 1
            x, y = self.phrase[p[live]], self.phrase[q[live]]
            differ = x != y
            d = live[differ]
            common[same[d] + 1] = np.minimum(reach[d] + self._in_dictionary(self.at[x[differ]], self.at[y[differ]], cap - reach[d]), cap)
            live, x = live[~differ], x[~differ]
            full = reach[live] + self.length[x]
            common[same[live] + 1] = np.minimum(full, cap)
            reach[live] = full - width
            live = live[~self.last[x] & (full < cap)]
        return order, common

    def _in_dictionary(self, p: np.ndarray, q: np.ndarray, cap: np.ndarray) -> np.ndarray:
        """Bytes that different phrase ends have in common, up to ``cap``."""
        out = np.zeros(len(p), np.int64)
        live = np.flatnonzero(cap > 0)
        while len(live):
            x = self.keys[p[live] + out[live]] ^ self.keys[q[live] + out[live]]
            for i in range(1, KEY_BYTES):
                out[live] += x >> (9 * i) == 0
            equal = x == 0
            out[live[equal]] += 1
            live = live[equal]
            live = live[out[live] < cap[live]]
        return np.minimum(out, cap)


def corpus_order(texts: list[bytes], cap: int = 1 << 30) -> list[tuple[int, int, int]]:
    """All suffixes of the texts in order as (text, offset, bytes in common with the one before); equal ones by text."""
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.arange(len(data))
    order, common = Parsing.of(data, ends).order(starts, cap)
    text = np.searchsorted(ends, starts, "right") - 1
    return [(int(text[i]), int(i - ends[text[i]]), c) for i, c in zip(order.tolist(), common.tolist(), strict=True)]


def repeated_windows(data: np.ndarray, ends: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """For every window of ``length`` bytes, text by text, whether the weights of all of its places are two or more."""
    windows = np.maximum(np.diff(ends) - length + 1, 0)
    owner = np.repeat(np.arange(len(windows)), windows)
    starts = ends[:-1][owner] + np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner]
    order, common = Parsing.of(data, ends).order(starts, length)
    group = np.cumsum(common < length) - 1 if len(order) else order
    out = np.empty(len(order), bool)
    out[order] = (np.bincount(group, weights[owner[order]]) > 1)[group] if len(order) else out
    return out
