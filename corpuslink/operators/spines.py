"""Spine scores of all rows of a block for many queries at once: tokens by postings, whole queries by the words around one that must stand alone."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


def _listed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of an array of lists of strings: the row and the code of every item, and the strings by code."""
    flat = lists.flatten()
    flat = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).dictionary_encode()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return row, flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()


def _grouped(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their codes, and where each code begins."""
    return np.argsort(codes, kind="stable"), np.r_[0, np.cumsum(np.bincount(codes, minlength=n))]


class Words:
    """The words of texts that single spaces part, and which texts hold another one, wherever it stands."""

    def __init__(self, texts: pa.Array) -> None:
        self.row, self.code, self.names = _listed(pc.split_pattern(texts, " "))
        self.of = {w: i for i, w in enumerate(self.names)}
        self.order, self.first = _grouped(self.code, len(self.names))
        self.rising = sorted(self.names)
        self.rank = np.empty(len(self.names), int)
        self.rank[[self.of[w] for w in self.rising]] = np.arange(len(self.names))
        self.back = sorted(w[::-1] for w in self.names)
        self.back_rank = np.empty(len(self.names), int)
        self.back_rank[[self.of[w[::-1]] for w in self.back]] = np.arange(len(self.names))

    @staticmethod
    def _range(names: list[str], start: str) -> tuple[int, int]:
        return bisect_left(names, start), bisect_right(names, start, key=lambda x: x[: len(start)])

    def _at(self, places: np.ndarray, step: int, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which places have a word so many steps on in their text, and its code."""
        to = places + step
        there = (to >= 0) & (to < len(self.code))
        to = np.where(there, to, 0)
        return there & (self.row[to] == row), self.code[to]

    def holding(self, text: str) -> np.ndarray:
        """The rows whose texts hold ``text``: its inner words as they are, its first one at the end of a word, its last one at the beginning."""
        words = text.split(" ")
        if len(words) == 1:
            held = np.array([text in w for w in self.names], bool)
            return np.unique(self.row[held[self.code]])
        (a, b), (c, d) = self._range(self.back, words[0][::-1]), self._range(self.rising, words[-1])
        inner = words[1:-1]
        if not inner:
            k = 0
            places = np.flatnonzero(((self.back_rank >= a) & (self.back_rank < b))[self.code])
        else:
            codes = [self.of.get(w) for w in inner]
            if None in codes:
                return np.empty(0, int)
            k = min(range(len(codes)), key=lambda i: self.first[codes[i] + 1] - self.first[codes[i]])
            places = self.order[self.first[codes[k]] : self.first[codes[k] + 1]] - k - 1  # where the first word stands
            for i, code in enumerate(codes):
                if i != k:
                    ok, found = self._at(places + k + 1, i - k, self.row[places + k + 1])
                    places = places[ok & (found == code)]
            ok, found = self._at(places + k + 1, -k - 1, self.row[places + k + 1])
            places = places[ok]
            places = places[(self.back_rank[found[ok]] >= a) & (self.back_rank[found[ok]] < b)]
        ok, found = self._at(places, len(words) - 1, self.row[places])
        ok &= (self.rank[found] >= c) & (self.rank[found] < d)
        return np.unique(self.row[places[ok]])


class Tokens:
    """The distinct tokens of texts, runs of at least two ASCII letters and digits, and the rows that have each."""

    def __init__(self, texts: pa.Array) -> None:
        row, code, names = _listed(pc.split_pattern(pc.replace_substring_regex(texts, "[^a-z0-9]+", " "), " "))
        kept = np.array([len(w) > 1 for w in names], bool)[code] if len(names) else np.empty(0, bool)
        pairs = np.unique(code[kept].astype(np.int64) * max(1, len(texts)) + row[kept])
        self.row = pairs % max(1, len(texts))
        self.first = np.searchsorted(pairs // max(1, len(texts)), np.arange(len(names) + 1))
        self.of = {w: i for i, w in enumerate(names)}
        self.sizes = np.bincount(self.row, minlength=len(texts))

    def rows(self, token: str) -> np.ndarray:
        i = self.of.get(token)
        return self.row[self.first[i] : self.first[i + 1]] if i is not None else self.row[:0]


def best_spines(ident: str, limit: int, gate: float, recall: float, phrase: float, likeness: float):
    """For ``applyInPandas``: of rows (ident, _s, _h) and queries (ord, _q, _a) the first ``limit`` rows of every query, with scores above ``gate``."""

    def best(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"ord": asked["ord"].iloc[:0], ident: held[ident].iloc[:0], "score": np.empty(0)})]
        if not len(held) or not len(asked):
            return out[0]
        held = held.sort_values(ident, ignore_index=True)
        texts = pa.array(held["_h"], pa.large_string())
        words, tokens, ids, static = Words(texts), Tokens(texts), held[ident].to_numpy(), held["_s"].to_numpy()
        for order, text, said in zip(asked["ord"].tolist(), asked["_q"].tolist(), asked["_a"]):
            both, hit = np.zeros(len(ids)), np.zeros(len(ids))
            names, times = np.unique(np.asarray(said, object), return_counts=True)
            for name, n in zip(names.tolist(), times.tolist()):
                rows = tokens.rows(name)
                both[rows] += 1
                hit[rows] += n
            whole = words.holding(text)
            like = both / np.maximum(1, len(names) + tokens.sizes - both)
            like[whole] = 1.0
            more = np.zeros(len(ids))
            more[whole] = phrase
            score = recall * hit / len(said) + more + likeness * like + static
            found = np.flatnonzero(score > gate)
            if not len(found):
                continue
            rounded = np.round(score[found], 9)
            if len(found) > limit:
                kept = rounded >= np.partition(rounded, -limit)[-limit]
                found, rounded = found[kept], rounded[kept]
            top = found[np.lexsort((found, -rounded))[:limit]]
            out.append(pd.DataFrame({"ord": np.full(len(top), order), ident: ids[top], "score": score[top]}))
        return pd.concat(out)

    return best
