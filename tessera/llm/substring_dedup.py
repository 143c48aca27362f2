"""Substring deduplication with suffix automata.

A word goes if it lies in a window of WINDOW words that also starts in a document with a smaller id.

A window's anchor is the least hash among its 5-word grams, so equal windows have equal anchors. Only anchors
found in two or more documents matter; around those, documents are cut into pieces: runs of windows with one
anchor. The distinct pieces of one anchor, each with the first document that holds it, are a reference shard.
A suffix automaton over the shard's words, grown in the order of those documents, knows for every state the
first document of its passages; the pieces are streamed through it for matching statistics, and every window
that ends in a match of WINDOW words or more from an earlier document is a span to remove. A document behind the
first one of a piece loses all the piece's windows; only the first holder depends on the automaton.

Sending every shard to every task would cost shards times documents, so shards are not broadcast: the anchor
brings each piece to the only shard that can match it. An anchor with very many distinct pieces is not gathered;
its windows are matched one by one by their whole content.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, durable, release, small_batches, text_or_empty
from .words import chunks, window_hashes, word_hashes

WINDOW = 13
GRAM = 5
#: Windows in one piece, at most.
SPAN = WINDOW - GRAM + 1
#: Distinct pieces of one anchor that are gathered in one automaton.
SHARD_PIECES = 2_000


class SuffixAutomaton:
    """Of several sequences; first[s] is the owner of the first sequence in which state s's passages occur."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, length: int, owner, follow: dict) -> int:
        self.next.append(follow)
        self.link.append(0)
        self.length.append(length)
        self.first.append(owner)
        return len(self.next) - 1

    def _split(self, p: int, c, q: int) -> int:
        """The state for the passage p + c, parted from the longer passages of q."""
        clone = self._state(self.length[p] + 1, self.first[q], dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence, owner) -> None:
        """Owners must come in rising order for `first` to be the least."""
        last = 0
        for c in sequence:
            if (q := self.next[last].get(c)) is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
                continue
            new, p = self._state(self.length[last] + 1, owner, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
            last = new

    def owners(self, sequence, size: int) -> list:
        """For each window of `size` items of the sequence, the first owner of an equal window, or None."""
        out, s, matched = [], 0, 0
        for k, c in enumerate(sequence):
            while s and c not in self.next[s]:
                s = self.link[s]
                matched = self.length[s]
            if c in self.next[s]:
                s, matched = self.next[s][c], matched + 1
            while s and self.length[self.link[s]] >= size:
                s = self.link[s]
                matched = self.length[s]
            if k + 1 >= size:
                out.append(self.first[s] if matched >= size else None)
        return out


def _words(text: str) -> list[bytes]:
    """bytes.split() parts at the six ASCII blanks and nothing else."""
    return text.encode("utf-8", "surrogatepass").split()


def _anchors_of(texts: list[str]) -> Iterator[tuple]:
    """(range of texts, text of each window, its anchor, its first word, text of each word) chunk by chunk."""
    for lo, hi in chunks(texts):
        h, text, *_ = word_hashes(texts[lo:hi], lower=False)
        n = len(h) - WINDOW + 1
        if n <= 0:
            yield lo, hi, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), text
            continue
        grams = window_hashes(h, GRAM)
        least = grams[:n].copy()
        for j in range(1, SPAN):
            np.minimum(least, grams[j : n + j], out=least)
        ok = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
        yield lo, hi, text[ok], least[ok], ok, text


def _anchor_rows(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs, hashes, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
        for lo, _, text, least, *_ in _anchors_of(texts):
            new = np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])] if len(least) else np.zeros(0, bool)
            text, least = text[new], least[new]
            order = np.lexsort((least, text))
            text, least = text[order], least[order]
            new = np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1])] if len(least) else np.zeros(0, bool)
            text, least = text[new] + lo, least[new]
            yield pa.RecordBatch.from_arrays([pa.array(docs[text]), pa.array(hashes[text]), pa.array(least.view(np.int64))], ["doc_id", "th", "anchor"])


def _piece_rows(batches) -> Iterator[pa.RecordBatch]:
    """Documents with their shared anchors -> pieces."""
    for b in batches:
        docs, hashes, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
        shared = [np.sort(np.array(x, dtype=np.int64)) for x in b.column(3).to_pylist()]
        for lo, hi, text, least, first, all_text in _anchors_of(texts):
            least = least.view(np.int64)
            inside = np.searchsorted(text, np.arange(hi - lo + 1))
            begin = np.searchsorted(all_text, np.arange(hi - lo))
            rows: list[tuple] = []
            for k in range(hi - lo):
                a, z = inside[k], inside[k + 1]
                mine, keys = shared[lo + k], least[a:z]
                if a == z or not len(mine):
                    continue
                at = np.minimum(np.searchsorted(mine, keys), len(mine) - 1)
                hit = mine[at] == keys
                cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                words, place = _words(texts[lo + k]), (first[a:z] - begin[k]).tolist()
                for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
                    if not hit[s]:
                        continue
                    for p in range(s, e, SPAN):
                        q = min(e, p + SPAN)
                        passage = b" ".join(words[place[p] : place[q - 1] + WINDOW])
                        rows.append((int(keys[s]), docs[lo + k], hashes[lo + k], place[p], q - p, xxhash.xxh3_128_digest(passage), passage))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in PIECE.split(", ")])


PIECE = "anchor long, doc_id long, th long, start int, windows int, ph binary, passage binary"


def _match_shards(batches, shard_pieces: int) -> Iterator[pa.RecordBatch]:
    """Sorted (anchor, first_doc, ph, passage, n) -> ph, mask: bit w if window w is in an earlier document.

    Pieces of an anchor that has more than shard_pieces give their windows instead, one by one, as they pass.
    """
    anchor, shard = None, []

    def matched() -> Iterator[tuple]:
        automaton, cut = SuffixAutomaton(), [(doc, ph, passage.split(b" ")) for doc, ph, passage in shard]
        for doc, _, words in cut:
            automaton.add(words, doc)
        for doc, ph, words in cut:
            mask = sum(1 << w for w, owner in enumerate(automaton.owners(words, WINDOW)) if owner is not None and owner < doc)
            if mask:
                yield ph, mask, None, None, None

    for b in batches:
        out: list[tuple] = []
        for key, doc, ph, passage, n in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if key != anchor:
                out.extend(matched())
                anchor, shard = key, []
            if n <= shard_pieces:
                shard.append((doc, ph, passage))
            else:
                words = passage.split(b" ")
                out += [(ph, None, doc, w, xxhash.xxh3_128_digest(b" ".join(words[w : w + WINDOW]))) for w in range(len(words) - WINDOW + 1)]
        yield _matches(out)
    yield _matches(list(matched()))


MATCH = "ph binary, mask int, first_doc long, w int, wh binary"


def _matches(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in MATCH.split(", ")])


def _apply(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, kept = [], [], []
        for text, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = _words(text)
            n, stay = len(words), words
            if marks:
                edge = np.zeros(n + 1, dtype=np.int64)
                for m in marks:
                    for w in range(SPAN):
                        if m["bits"] >> w & 1:
                            edge[m["start"] + w] += 1
                            edge[min(m["start"] + w + WINDOW, n)] -= 1
                stay = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            n_words.append(n)
            n_removed.append(n - len(stay))
            kept.append(b" ".join(stay).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])


def _rows(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))


def shared_anchors(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), anchors: those of its anchors that another document has too."""
    rows = _rows(docs).where(F.col("doc_id").isNotNull()).mapInArrow(_anchor_rows, "doc_id long, th long, anchor long")
    found = rows.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where(F.col("lo") != F.col("hi")).select("anchor")
    return durable(rows.join(found, "anchor").groupBy("doc_id", "th").agg(F.collect_list("anchor").alias("anchors")), "anchors")


def pieces(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    joined = _rows(docs).join(anchors, ["doc_id", "th"]).select("doc_id", "th", "text", "anchors")
    return durable(joined.mapInArrow(_piece_rows, PIECE), "pieces", "zstd")


def earlier_windows(found: DataFrame, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """ph, first_doc, mask for every distinct piece: its first document, and which windows an earlier one has."""
    spark = found.sparkSession
    small_batches(spark)
    distinct = durable(found.groupBy("anchor", "ph").agg(F.min("doc_id").alias("first_doc"), F.first("passage").alias("passage")), "reference", "zstd")
    release(spark)
    # The count brings an anchor's pieces to one task, which streams them; only a shard of bounded size is held.
    shards = distinct.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor"))).where(F.col("n") > 1)
    shards = shards.sortWithinPartitions("anchor", "first_doc", "ph").select("anchor", "first_doc", "ph", "passage", "n")
    matches = durable(shards.mapInArrow(functools.partial(_match_shards, shard_pieces=shard_pieces), MATCH), "matches")
    release(spark)
    whole = matches.where(F.col("wh").isNotNull())
    least = whole.groupBy("wh").agg(F.min("first_doc").alias("least"))
    earlier = whole.join(least, "wh").where(F.col("least") < F.col("first_doc")).groupBy("ph").agg(F.sum(F.expr("shiftleft(1, w)")).cast("int").alias("mask"))
    masks = matches.where(F.col("mask").isNotNull()).select("ph", "mask").unionAll(earlier)
    out = durable(distinct.select("ph", "first_doc").join(masks, "ph", "left").select("ph", "first_doc", F.coalesce("mask", F.lit(0)).alias("mask")), "masks")
    discard(distinct, matches)
    return out


def marks(found: DataFrame, earlier: DataFrame) -> DataFrame:
    """doc_id, th, marks: start and bits of the windows to remove."""
    every = F.expr("shiftleft(1, windows) - 1")
    rows = found.select("doc_id", "th", "start", "windows", "ph").join(earlier, "ph")
    rows = rows.withColumn("bits", F.when(F.col("doc_id") > F.col("first_doc"), every).otherwise(F.col("mask"))).where(F.col("bits") != 0)
    return durable(rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "bits")).alias("marks")), "marks")


def substring_dedup(docs: DataFrame, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, text (the kept words joined by one blank), n_words, n_removed for every row of docs (doc_id, text).

    Null text has no word. Rows with a null doc_id lose nothing and take nothing from others. Rows with one
    doc_id are one document, which takes nothing from itself; each of its texts is judged. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    anchors = shared_anchors(docs)
    found = pieces(docs, anchors)
    discard(anchors)
    release(spark)
    earlier = earlier_windows(found, shard_pieces)
    gone = marks(found, earlier)
    discard(found, earlier)
    release(spark)
    out = _rows(docs).join(gone, ["doc_id", "th"], "left").select("doc_id", "text", "marks")
    return out.mapInArrow(_apply, "doc_id long, text string, n_words long, n_removed long")
