"""Evaluation passages inside a corpus.

Method: Wu-Manber multi-pattern search over words. The patterns are all runs of
``RUN`` consecutive words of every passage. A shift table over blocks of two words says how
far a window of ``RUN`` words may jump; where the shift is 0, the hash of the window's last
words picks a bucket of patterns, and direct comparison of the words confirms. Texts are cut
into lanes that overlap by ``RUN`` - 1 words, and all lanes of a batch move at once.

Whole texts are searched, each once for every block of at most ``ITEM_CHARS`` characters of
passages (one block unless the evaluation set is very large), so what is sent to the
executors is bounded. Nothing is shuffled but the hits.

Defined cases: null or empty texts and passages match nothing; passages under ``RUN`` words
match nothing; equal passages are all reported; repeated documents are reported once per
``doc_id``; texts of any length are searched whole; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.plans.runtime import cut

#: Consecutive words that make a leak.
RUN = 12
#: Passage characters held by one search pass.
ITEM_CHARS = 32_000_000
#: Words of a text that one lane walks.
LANE = 1024
_WORD = re.compile(r"[^\W_]+")
_MASK = (1 << 20) - 1
_K = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, without case."""
    return [w.casefold() for w in _WORD.findall(text)] if text else []


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slot of a block of two words in the shift table."""
    return ((a.astype(np.uint64) * _K + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)).astype(np.int64) & _MASK


class Searcher:
    """Shift table, suffix buckets and patterns of a set of passages."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN) -> None:
        self.run, self.vocab = run, {}
        rows, owner, place = [], [], []
        self.length: dict[int, int] = {}
        for item, passage in items:
            got = words(passage)
            self.length[item] = len(got)
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in got]
            for i in range(len(ids) - run + 1):
                rows.append(ids[i : i + run])
                owner.append(item)
                place.append(i)
        pats = np.array(rows, np.int32).reshape(-1, run)
        # the bucket of a pattern is the hash of its last four words; equal patterns lie side by side
        key = self._suffix(pats)
        order = np.lexsort((*pats.T[::-1], key))
        self.pats, self.key = pats[order], key[order]
        self.owner, self.place = np.array(owner, np.int64)[order], np.array(place, np.int32)[order]
        self.shift = np.full(_MASK + 1, run - 1, np.uint8)
        for j in range(1, run):
            np.minimum.at(self.shift, _block(pats[:, j - 1], pats[:, j]), run - 1 - j)

    @staticmethod
    def _suffix(win: np.ndarray) -> np.ndarray:
        h = np.zeros(len(win), np.uint64)
        for j in range(max(0, win.shape[1] - 4), win.shape[1]):
            h = h * _K + win[:, j].astype(np.uint64)
        return h

    def search(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, word number, item and place in the passage of every run found."""
        get, run = self.vocab.get, self.run
        ids, starts = [], []
        for t in texts:
            got = _WORD.findall(t) if t else []
            ids.append(np.fromiter(map(get, map(str.casefold, got), repeat(0)), np.int32, len(got)))
        sizes = np.array([len(x) for x in ids])
        flat, base = np.concatenate([*ids, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(ids) else np.zeros(0, int)
        # a lane owns the windows that end at words [begin, end) of the flat array
        lanes = [(b + i, min(b + i + LANE, b + n)) for b, n in zip(base.tolist(), sizes.tolist()) for i in range(run - 1, n, LANE)]
        cursor, stop = (np.array(x, np.int64) for x in zip(*lanes)) if lanes else (np.zeros(0, np.int64),) * 2
        ends: list[np.ndarray] = []
        while len(cursor):
            jump = self.shift[_block(flat[cursor - 1], flat[cursor])].astype(np.int64)
            stay = jump == 0
            if stay.any():
                ends.append(cursor[stay])
            cursor = cursor + np.where(stay, 1, jump)
            keep = cursor < stop
            cursor, stop = cursor[keep], stop[keep]
        none = np.zeros(0, np.int64)
        if not ends or not len(self.pats):
            return none, none, none, none
        at = np.concatenate(ends)
        win = flat[at[:, None] + np.arange(1 - run, 1)]
        key = self._suffix(win)
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        hit = hi > lo
        at, win, lo, hi = at[hit], win[hit], lo[hit], hi[hit]
        # direct comparison with every pattern of the bucket
        many = hi - lo
        row = np.repeat(np.arange(len(at)), many)
        pat = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(at) else none
        same = (win[row] == self.pats[pat]).all(1) if len(at) else np.zeros(0, bool)
        row, pat = row[same], pat[same]
        text = np.searchsorted(base, at[row], "right") - 1
        # empty texts share their base with the next one; the last of them owns the words
        return text, at[row] - base[text] - (run - 1), self.owner[pat], self.place[pat]


def _blocks(items: DataFrame, chars: int) -> Iterator[list[tuple[int, str]]]:
    """Passages in blocks of about ``chars`` characters; the driver holds one block at a time."""
    slim = items.select("item_id", "passage").filter("item_id is not null and passage is not null").distinct()
    n = max(1, -(-(items.agg(F.sum(F.length("passage"))).first()[0] or 0) // chars))
    for i in range(n):
        part = slim.filter(F.pmod(F.xxhash64("item_id", "passage"), F.lit(n)) == i) if n > 1 else slim
        yield [(r.item_id, r.passage) for r in part.collect()]  # bounded by chars


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, chars: int = ITEM_CHARS) -> DataFrame:
    """``doc_id, item_id, windows, first_word, longest_run, covered``, one row per leak.

    ``windows`` counts the distinct runs of ``run`` passage words found, ``first_word`` is the
    word of the text where the first begins, ``longest_run`` the longest stretch of passage
    words standing consecutively in the text, ``covered`` the share of passage words found.
    """
    spark = documents.sparkSession
    slim = documents.select("doc_id", "text").filter("text is not null")
    found = shared = None
    for block in _blocks(items, chars):
        if found is not None:
            # one block of patterns at a time lies on the executors
            found = cut(found)
            shared.unpersist()
        shared = spark.sparkContext.broadcast(Searcher(block, run))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            s = shared.value
            for b in batches:
                text, at, item, place = s.search(b.text.tolist())
                if len(text):
                    hits = pd.DataFrame({"doc_id": b.doc_id.to_numpy()[text], "item_id": item, "at": at, "place": place})
                    yield _summed(hits, s)

        out = slim.mapInPandas(scan, "doc_id long, item_id long, windows long, first_word long, longest_run long, covered double")
        found = out if found is None else found.unionByName(out)
    kind = items.schema["item_id"].dataType
    return (
        found.groupBy("doc_id", "item_id")
        .agg(F.max("windows").alias("windows"), F.min("first_word").alias("first_word"), F.max("longest_run").alias("longest_run"), F.max("covered").alias("covered"))
        .withColumn("item_id", F.col("item_id").cast(kind))
    )


def _summed(hits: pd.DataFrame, s: Searcher) -> pd.DataFrame:
    """One row for each document and item of a batch."""
    run = s.run
    hits = hits.drop_duplicates().assign(diag=lambda x: x["at"] - x["place"]).sort_values(["doc_id", "item_id", "diag", "at"])
    key = hits[["doc_id", "item_id", "diag"]]
    new = (key != key.shift()).any(axis=1) | (hits["at"].diff() != 1)
    stretch = hits.assign(part=new.cumsum()).groupby(["doc_id", "item_id", "part"]).size().add(run - 1).groupby(["doc_id", "item_id"]).max()
    got = hits.groupby(["doc_id", "item_id"]).agg(windows=("place", "nunique"), first_word=("at", "min"))
    places = hits.drop_duplicates(["doc_id", "item_id", "place"]).sort_values(["doc_id", "item_id", "place"])
    gap = places.groupby(["doc_id", "item_id"])["place"].diff().fillna(run).clip(upper=run)
    got["covered"] = gap.groupby([places["doc_id"], places["item_id"]]).sum()
    got["longest_run"] = stretch
    got = got.reset_index()
    got["covered"] = got["covered"] / got["item_id"].map(s.length)
    return got[["doc_id", "item_id", "windows", "first_word", "longest_run", "covered"]]


def report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per suite and held-out part: items, items that leaked, documents that hold some."""
    meta = items.select("item_id", "suite", "held_out").dropDuplicates(["item_id"])
    per_item = found.groupBy("item_id").agg(F.count("*").alias("docs"), F.max("covered").alias("covered"))
    return (
        meta.join(per_item, "item_id", "left")
        .groupBy("suite", "held_out")
        .agg(F.count("*").alias("items"), F.count("docs").alias("leaked"), F.coalesce(F.sum("docs"), F.lit(0)).alias("hits"), F.max("covered").alias("most_covered"))
    )
