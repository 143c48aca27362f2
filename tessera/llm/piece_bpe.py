"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text is cut where no piece of the vocabulary can span; the distinct words of a batch lie one after another in
flat numpy arrays. In every round each word finds the least rank among its adjacent pairs (a segmented minimum)
and merges the leftmost pairs of that rank at the same time; merged cells are then compacted away, and words
without any pair left retire. Words met before come from a bounded cache in the worker.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

SPACE = "▁"
NO_RANK = np.iinfo(np.int64).max
CACHE_WORDS = 400_000
#: A word with more cells than this goes through a priority queue instead of rounds, whose number may be its length.
LONG_WORD = 2_000
#: Cells that go through the rounds at once.
ROUND_CELLS = 1 << 18


class PieceModel:
    """What the encoder needs of a model: pieces, scores, kinds, and the pairs that may merge."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        self.end_id, self.unk_id = p.eos_id(), p.unk_id()
        self.control = np.array([p.is_control(i) for i in range(n)])
        plain = np.array([not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)) for i in range(n)])
        self.byte_of = {i: int(self.pieces[i][1:-1], 16) for i in range(n) if p.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.id_of = {x: i for i, x in enumerate(self.pieces) if plain[i]}
        self.score = np.array([p.get_score(i) for i in range(n)])
        # Cells hold ids of pieces, or n + code point for a character that is no piece.
        self.n = n
        # The best score has rank 0; equal scores share a rank.
        self.rank = np.searchsorted(np.unique(-self.score), -self.score)
        pairs: dict[int, int] = {}
        self.joined: set[str] = set()
        for x, i in self.id_of.items():
            self.joined.update(x[k : k + 2] for k in range(len(x) - 1))
            for k in range(1, len(x)):
                a, b = x[:k], x[k:]
                left, right = self._cell(a), self._cell(b)
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.pair_id = pairs
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys = keys
        self.pair_to = np.array([pairs[k] for k in keys.tolist()], dtype=np.int64)
        # Merging every pair of one rank at a time equals merging the leftmost first, unless a merged piece makes a
        # pair that ranks no later than itself; those pieces are merged one at a time.
        self.one_by_one = np.zeros(n, dtype=bool)
        made = self.rank[self.pair_to]
        for side in (keys >> 32, keys & 0xFFFFFFFF):
            whole = side < n
            early = whole.copy()
            early[whole] = made[whole] <= self.rank[side[whole]]
            self.one_by_one[side[early]] = True
        alone = [c for c in ("\n", "\t") if not any(c in x for x in self.joined)]
        stop = "".join(re.escape(c) for c in alone)
        self.word = re.compile(f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" + (f"|[{stop}]" if stop else ""), re.S)
        if any(SPACE in x.lstrip(SPACE) for x in self.id_of):
            raise ValueError("a piece spans words; this encoder cuts texts before each blank")
        shown = ["" if self.control[i] else self.pieces[i].replace(SPACE, " ") for i in range(n)]
        shown[self.unk_id] = " ⁇ "
        self.raw_of = [bytes([self.byte_of[i]]) if i in self.byte_of else x.encode("utf-8") for i, x in enumerate(shown)]

    def _cell(self, x: str) -> int | None:
        return self.id_of.get(x, self.n + ord(x) if len(x) == 1 else None)

    def cells(self, word: str) -> list[int]:
        return [self._cell(c) for c in word]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair, NO_RANK where it can't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        to = np.where(self.pair_keys[at] == key, self.pair_to[at], -1)
        return np.where(to >= 0, self.rank[to], NO_RANK), to

    def emit(self, cell: int) -> list[int]:
        """Ids of a finished cell: the piece, or the bytes of a character that is none."""
        if cell < self.n:
            return [cell]
        if not self.id_of_byte:
            return [self.unk_id]
        return [self.id_of_byte[b] for b in chr(cell - self.n).encode("utf-8", "surrogatepass")]


def merge_rounds(model: PieceModel, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the cells of all words to the end. word: number of the word of each cell, not falling."""
    done_s, done_w = [], []
    while len(symbols) > 1:
        same = word[:-1] == word[1:]
        rank, to = model.lookup(symbols[:-1], symbols[1:])
        rank[~same] = NO_RANK
        # Segmented minimum: a word's cells are adjacent.
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least = np.minimum.reduceat(np.r_[rank, NO_RANK], first)
        size = np.diff(np.r_[first, len(symbols)])
        least_of = np.repeat(least, size)
        open_ = least_of != NO_RANK
        if not open_.all():
            done_s.append(symbols[~open_])
            done_w.append(word[~open_])
            if not open_.any():
                symbols, word = symbols[:0], word[:0]
                break
            keep = open_
            rank, to = np.r_[rank, NO_RANK][keep][:-1], np.r_[to, -1][keep][:-1]
            symbols, word, least_of = symbols[keep], word[keep], least_of[keep]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            # The last pair of a word was no pair, so pairs still line up with their left cells.
        hit = rank == least_of[:-1]
        at = np.flatnonzero(hit)
        # Of hits that overlap in a row, every second one counts, from the left.
        new_row = np.r_[True, at[1:] != at[:-1] + 1]
        row_start = np.maximum.accumulate(np.where(new_row, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - row_start) % 2 == 0
        at = at[take]
        # Where a merged piece might rank before the pairs still waiting, only the word's first hit counts.
        w = word[at]
        lead = np.r_[True, w[1:] != w[:-1]]
        careful = np.logical_or.reduceat(model.one_by_one[to[at]], np.flatnonzero(lead))[np.cumsum(lead) - 1]
        at = at[~careful | lead]
        symbols[at] = to[at]
        gone = np.ones(len(symbols), dtype=bool)
        gone[at + 1] = False
        symbols, word = symbols[gone], word[gone]
    done_s.append(symbols)
    done_w.append(word)
    s, w = np.concatenate(done_s), np.concatenate(done_w)
    order = np.argsort(w, kind="stable")
    return s[order], w[order]


def merge_long(model: PieceModel, cells: list[int]) -> list[int]:
    """The same merges by a priority queue, for a single long word."""
    n = len(cells)
    after, before, cells = [*range(1, n), -1], list(range(-1, n - 1)), list(cells)
    queue: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j >= 0 and (to := model.pair_id.get(cells[i] << 32 | cells[j])) is not None:
            heapq.heappush(queue, (int(model.rank[to]), i, cells[i], cells[j]))

    for i in range(n):
        push(i)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i]
        if cells[i] != a or j < 0 or cells[j] != b:
            continue
        cells[i], cells[j] = model.pair_id[a << 32 | b], -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return [c for c in cells if c >= 0]


class Encoder:
    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.cache: dict[str, tuple[int, ...]] = {}

    def words(self, text: str) -> list[str]:
        return self.model.word.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, words: set[str]) -> None:
        """Encode words that the cache lacks."""
        new = [w for w in words if w not in self.cache]
        m, at = self.model, 0
        while at < len(new):
            chunk, size = [], 0
            while at < len(new) and size < ROUND_CELLS:
                w = new[at]
                at += 1
                if len(w) > LONG_WORD:
                    self.cache[w] = tuple(i for c in merge_long(m, m.cells(w)) for i in m.emit(c))
                else:
                    chunk.append(w)
                    size += len(w)
            if not chunk:
                continue
            flat = np.frombuffer("".join(chunk).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            points, inverse = np.unique(flat, return_inverse=True)
            cells = np.array([m._cell(chr(c)) for c in points.tolist()], dtype=np.int64)[inverse]
            word = np.repeat(np.arange(len(chunk)), [len(w) for w in chunk])
            s, w = merge_rounds(m, cells, word)
            ends = np.searchsorted(w, np.arange(len(chunk)), side="right").tolist()
            s, start = s.tolist(), 0
            plain = max(s) < m.n
            for x, end in zip(chunk, ends, strict=True):
                ids = s[start:end]
                self.cache[x] = tuple(ids if plain else (i for c in ids for i in m.emit(c)))
                start = end

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cut = [self.words(t) for t in texts]
        self.learn(set().union(*cut) if cut else set())
        cache = self.cache
        return [[i for w in ws for i in cache[w]] for ws in cut]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, bytes put together to characters, the first blank dropped."""
        m = self.model
        first = next((i for i in ids if not m.control[i]), None)
        try:
            # Pieces are whole characters, so all is valid UTF-8 just if every run of byte pieces is.
            text = b"".join(map(m.raw_of.__getitem__, ids)).decode("utf-8")
        except UnicodeDecodeError:
            parts = (b"".join(map(m.raw_of.__getitem__, run)) for _, run in itertools.groupby(ids, m.byte_of.__contains__))
            text = "".join(map(_characters, parts))
        return text[1:] if first is not None and m.pieces[first].startswith(SPACE) else text


def _characters(raw: bytes) -> str:
    """UTF-8, with one replacement character for each byte that belongs to none."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + size].decode("utf-8"))
                    k += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _encode(batches, path: str, end: bool) -> Iterator[pa.RecordBatch]:
    enc = _encoder(path)
    tail = [enc.model.end_id] if end else []
    for b in batches:
        ids = [x + tail for x in enc.encode_batch(b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _decode(batches, path: str) -> Iterator[pa.RecordBatch]:
    enc = _encoder(path)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])


def _digest(batches, path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = _encoder(path)
    end = enc.model.end_id
    shown = [str(i) for i in range(enc.model.n)]
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for b in batches:
        n, of_ids, of_text = [], [], []
        coded = enc.encode_batch(b.column(1).to_pylist())
        for ids in coded:
            ids.append(end)
            n.append(len(ids))
            of_ids.append(sha(" ".join(map(shown.__getitem__, ids))))
            of_text.append(sha(enc.decode(ids)))
        cols, names = [b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols, names = [*cols, pa.array(coded, pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(cols, names)


def _rows(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def piece_encode(docs: DataFrame, model_path: str, end: bool = True) -> DataFrame:
    """doc_id, ids for every row of docs; null text is empty and gives the end id only.

    The model file is one that every executor has at model_path. Rows are encoded one by one: repeated rows, null
    ids and empty tables need nothing special.
    """
    return _rows(docs).mapInArrow(functools.partial(_encode, path=model_path, end=end), "doc_id long, ids array<int>")


def piece_decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text for every row of encoded (doc_id, ids); null ids give the empty text."""
    small_batches(encoded.sparkSession)
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(functools.partial(_decode, path=model_path), "doc_id long, text string")


def piece_digests(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and perhaps ids: encode with an end id, then decode, in one pass.

    Same cases as piece_encode.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _rows(docs).mapInArrow(functools.partial(_digest, path=model_path, with_ids=with_ids), schema)
