"""Personal data: base patterns, and a character BiLSTM-CRF that adds spans the patterns miss.

The tagger is a bidirectional LSTM over characters (with piecewise linear gates) under CRF transitions, written and
trained in numpy. It learns from labelled spans: windows of a bounded sample of documents, labelled by the base
patterns, and windows of the same documents with written-out variants planted in them: numbers in words, `at` and
`dot`, other alphabets' digits. It reads every character of every text: a text is cut into overlapping windows, each is
decoded by itself, and every character takes its tag from the window in which it lies most centrally.
"""

from __future__ import annotations

import functools
import pickle
import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_blas_thread, small_batches, spread, text_or_empty

KINDS = ("email", "ip", "card", "phone")
TAGS = ("outside", *KINDS)
#: The tagger is fitted on at most so many documents, those with the smallest hashes of the id, and windows of each.
TRAIN_DOCS = 300
TRAIN_WINDOWS = 6
TRAIN_CHARS = 110
WINDOW = 512
OVERLAP = 64
#: Mean posterior of a span's characters, not to be outside, for it to be added.
CERTAIN = 0.8
HIDDEN, EMBED, EPOCHS, BATCH, RATE, SEED = 12, 8, 10, 48, 0.02, 7
#: Windows that are decoded at once, and characters whose windows are cut at once.
DECODE_BATCH = 1024
CHUNK = 1 << 21

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is entered at its start only: entering it later could find nothing else.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Digits in words: fixed values.
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_DIGIT_WORD = re.compile(r"(?i)\b(" + "|".join((*DIGIT_WORDS, "oh")) + r")\b")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
        else:
            end = max(end, at + 1)
        at = text.find("@", at + 1)


def _small_part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by kind and start."""
    found = list(_emails(text))
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small_part, m[0].split(".")))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


# --- the tagger


@functools.cache
def _code_table() -> np.ndarray:
    """Code of every code point: its ASCII form's, else 128 for letters, 129 for the rest; 0 is padding."""
    out = np.full(0x110000, 129, dtype=np.uint8)
    for i in range(0x110000):
        if i < 128:
            out[i] = max(1, i)
        elif (c := chr(i)).isalpha():
            out[i] = 128
        elif (d := unicodedata.decimal(c, None)) is not None:
            out[i] = 48 + d
    # Wide forms of ASCII signs.
    out[0xFF01:0xFF5F] = np.arange(0x21, 0x7F)
    return out


def text_codes(text: str) -> np.ndarray:
    return _code_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def char_codes(texts: list[str]) -> np.ndarray:
    """One row of codes for each text, padded with 0."""
    out = np.zeros((len(texts), max(map(len, texts))), dtype=np.int64)
    for i, x in enumerate(texts):
        out[i, : len(x)] = text_codes(x)
    return out


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(x * np.float32(0.25) + np.float32(0.5), 0, 1)


def _inside(y: np.ndarray, low: float) -> np.ndarray:
    return ((y > low) & (y < 1)).astype(np.float32)


class Tagger:
    """BiLSTM-CRF. While it learns, arrays are (time, direction, batch, ...), the second direction turned round; padding carries mask 0."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        h, e, k = HIDDEN, EMBED, len(TAGS)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.p = {"emb": init(130, e) * np.float32(np.sqrt(130) * 0.3), "wx": init(2, e, 4 * h), "wh": init(2, h, 4 * h), "b": np.zeros((2, 1, 4 * h), np.float32), "out": init(2 * h, k), "out_b": np.zeros(k, np.float32), "trans": np.zeros((k, k), np.float32)}
        self.p["b"][..., h : 2 * h] = 1

    def _lstm(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        """x (time, 2, batch, embedding) -> hidden states, and what the way back needs."""
        t, _, b, _ = x.shape
        h = HIDDEN
        gates = x @ self.p["wx"] + self.p["b"]
        kept = {name: np.zeros((t + (name in "hc"), 2, b, n), np.float32) for name, n in (("h", h), ("c", h), ("ifo", 3 * h), ("u", h), ("tc", h))}
        for s in range(t):
            g, m = gates[s] + kept["h"][s] @ self.p["wh"], mask[s]
            ifo, u = _gate(g[..., : 3 * h]), np.clip(g[..., 3 * h :], -1, 1)
            c = ifo[..., h : 2 * h] * kept["c"][s] + ifo[..., :h] * u
            c = kept["c"][s] + (c - kept["c"][s]) * m
            tc = np.clip(c, -1, 1)
            kept["h"][s + 1] = kept["h"][s] + (ifo[..., 2 * h :] * tc - kept["h"][s]) * m
            kept["c"][s + 1], kept["ifo"][s], kept["u"][s], kept["tc"][s] = c, ifo, u, tc
        return kept["h"][1:], kept

    def _lstm_back(self, x: np.ndarray, mask: np.ndarray, kept: dict, grad: np.ndarray, g: dict) -> np.ndarray:
        h = HIDDEN
        dg = np.zeros((*x.shape[:3], 4 * h), np.float32)
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        turn = self.p["wh"].transpose(0, 2, 1)
        live = np.concatenate([_inside(kept["ifo"], 0) * np.float32(0.25), _inside(kept["u"], -1)], axis=-1) * mask
        live_c = _inside(kept["tc"], -1)
        for s in range(len(x) - 1, -1, -1):
            i, f, o = (kept["ifo"][s][..., k * h : (k + 1) * h] for k in range(3))
            m = mask[s]
            dh = dh + grad[s]
            dct = (dc + dh * o * live_c[s]) * m
            dg[s] = np.concatenate([dct * kept["u"][s], dct * kept["c"][s], dh * kept["tc"][s], dct * i], axis=-1) * live[s]
            dh = dh * (1 - m) + dg[s] @ turn
            dc = dc * (1 - m) + dct * f
        for d in range(2):
            flat = dg[:, d].reshape(-1, 4 * h)
            g["wh"][d] += kept["h"][:-1, d].reshape(-1, h).T @ flat
            g["wx"][d] += x[:, d].reshape(-1, x.shape[-1]).T @ flat
            g["b"][d] += flat.sum(axis=0)
        return dg @ self.p["wx"].transpose(0, 2, 1)

    def scores(self, codes: np.ndarray) -> tuple:
        both = lambda v: np.stack([v, v[::-1]], axis=1)
        mask = (codes.T > 0).astype(np.float32)
        x, mask2 = both(self.p["emb"][codes.T]), both(mask)[..., None]
        hid, kept = self._lstm(x, mask2)
        hid = np.concatenate([hid[:, 0], hid[::-1, 1]], axis=-1)
        return hid @ self.p["out"] + self.p["out_b"], (mask, mask2, x, hid, kept)

    def _sums(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """e (time, batch, tag): scaled forward and backward sums, the scales, exp of the scores, log Z.

        With a as forward and z as backward sums, a z is the posterior of each tag.
        """
        t, step = len(e), np.exp(self.p["trans"])
        top = e.max(axis=2, keepdims=True)
        w = np.exp(e - top)
        a, z, scale = np.empty_like(e), np.ones_like(e), np.ones((t, e.shape[1], 1), e.dtype)
        for s in range(t):
            v = w[s] if s == 0 else (a[s - 1] @ step) * w[s]
            c = v.sum(axis=1, keepdims=True)
            if s:
                m = mask[s, :, None]
                a[s], scale[s] = np.where(m > 0, v / c, a[s - 1]), np.where(m > 0, c, 1)
            else:
                a[s], scale[s] = v / c, c
        for s in range(t - 2, -1, -1):
            v = ((w[s + 1] * z[s + 1]) @ step.T) / scale[s + 1]
            z[s] = np.where(mask[s + 1, :, None] > 0, v, z[s + 1])
        return a, z, scale, w, (np.log(scale[..., 0]) + top[..., 0] * mask).sum(axis=0)

    def learn(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        e, (mask, mask2, x, hid, kept) = self.scores(codes)
        a, z, scale, w, log_z = self._sums(e, mask)
        t, n, k = e.shape
        trans, tags = self.p["trans"], tags.T
        gold = np.eye(k, dtype=np.float32)[tags] * mask[..., None]
        g = {name: np.zeros_like(v) for name, v in self.p.items()}
        after = w[1:] * z[1:] / scale[1:] * mask[1:, :, None]
        g["trans"] += np.exp(trans) * np.einsum("tbi,tbj->ij", a[:-1], after)
        np.add.at(g["trans"], (tags[:-1], tags[1:]), -mask[1:])
        loss = float(log_z.sum() - (e * gold).sum() - (trans[tags[:-1], tags[1:]] * mask[1:]).sum())
        de = a * z * mask[..., None] - gold
        flat = de.reshape(-1, k)
        g["out"] = hid.reshape(-1, hid.shape[-1]).T @ flat
        g["out_b"] = flat.sum(axis=0)
        dh = de @ self.p["out"].T
        dx = self._lstm_back(x, mask2, kept, np.stack([dh[..., :HIDDEN], dh[::-1, :, HIDDEN:]], axis=1), g)
        np.add.at(g["emb"], codes.T, dx[:, 0] + dx[::-1, 1])
        return loss / n, {name: v / n for name, v in g.items()}

    def fit(self, texts: list[str], spans: list[list[Span]], epochs: int = EPOCHS) -> list[float]:
        """Adam on shuffled batches; the same for the same input. Returns the mean loss of each epoch."""
        order, losses = np.random.default_rng(SEED), []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            total, batches = 0.0, 0
            # Windows of like length go together, in random order.
            ids = order.permutation(len(texts))
            ids = ids[np.argsort([len(texts[i]) for i in ids], kind="stable")]
            starts = np.arange(0, len(ids), BATCH)
            for k in order.permutation(starts).tolist():
                part = ids[k : k + BATCH]
                codes = char_codes([texts[i] for i in part])
                tags = np.zeros_like(codes)
                for row, i in enumerate(part):
                    tags[row] = tag_row(spans[i], codes.shape[1])
                loss, g = self.learn(codes, tags)
                total, batches, step = total + loss, batches + 1, step + 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for name, x in g.items():
                    x = x * min(1.0, 5.0 / max(norm, 1e-9))
                    m[name] = 0.9 * m[name] + 0.1 * x
                    v2[name] = 0.999 * v2[name] + 0.001 * x * x
                    rate = RATE * (1 - epoch / epochs)
                    self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total / max(1, batches))
        return losses

    # Decoding: arrays are (time, feature, batch), so that every step works on whole rows.

    def _folded(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights over (hidden, embedding, one, padding), and the embedding with the last two; padding empties the cell."""
        h = HIDDEN
        w = np.vstack([self.p["wh"][d], self.p["wx"][d], self.p["b"][d], np.zeros((1, 4 * h), np.float32)])
        w[:, : 3 * h] *= np.float32(0.25)
        w[-2, : 3 * h] += np.float32(0.5)
        w[-1, : 3 * h] = -1e4
        sign = np.zeros((130, 2), np.float32)
        sign[:, 0], sign[0, 1] = 1, 1
        return np.ascontiguousarray(w.T), np.ascontiguousarray(np.hstack([self.p["emb"], sign]).T)

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """codes (time, batch) -> scores of the tags (time, tag, batch)."""
        t, b = codes.shape
        h = HIDDEN
        e = np.empty((t, len(TAGS), b), np.float32)
        for d in range(2):
            w, emb = self._folded(d)
            out = np.ascontiguousarray(self.p["out"][d * h : (d + 1) * h].T)
            state, g = np.zeros((h + len(emb), b), np.float32), np.empty((4 * h, b), np.float32)
            cell, held, part = np.zeros((h, b), np.float32), np.empty((h, b), np.float32), np.empty((len(TAGS), b), np.float32)
            i, f, o, u = (g[k * h : (k + 1) * h] for k in range(4))
            for s in range(t - 1, -1, -1) if d else range(t):
                np.take(emb, codes[s], axis=1, out=state[h:], mode="clip")
                np.matmul(w, state, out=g)
                np.clip(g[: 3 * h], 0, 1, out=g[: 3 * h])
                np.clip(u, -1, 1, out=u)
                np.multiply(cell, f, out=cell)
                np.multiply(i, u, out=i)
                np.add(cell, i, out=cell)
                np.clip(cell, -1, 1, out=held)
                np.multiply(o, held, out=state[:h])
                if d:
                    np.matmul(out, state[:h], out=part)
                    np.add(e[s], part, out=e[s])
                else:
                    np.matmul(out, state[:h], out=e[s])
        e += self.p["out_b"][None, :, None]
        return e

    def may_hold(self, e: np.ndarray) -> np.ndarray:
        """Which windows could have a best path with a tag: where a bound on what tags can gain doesn't exclude it.

        Against staying outside, a run of tags gains at most the sum over its characters of (the best score over
        outside's, with the best transition from a tag), the best surplus of entering, and the best transition back.
        """
        rel = self.p["trans"] - self.p["trans"][0, 0]
        stay = rel[1:, 1:].max(axis=0)
        gain = (e[:, 1:] - e[:, :1] + stay[None, :, None]).max(axis=1)
        run = gain[0].copy()
        best = run.copy()
        for x in gain[1:]:
            np.maximum(run, 0, out=run)
            np.add(run, x, out=run)
            np.maximum(best, run, out=best)
        return best + float((rel[0, 1:] - stay).max()) + max(0.0, float(rel[1:, 0].max())) > 0

    def decode(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag path (Viterbi), and how sure it is that a character is not outside; e (time, tag, batch), mask (time, batch)."""
        t, k, n = e.shape
        best, back = e[0].copy(), np.zeros((t, k, n), dtype=np.int8)
        stay = np.arange(k, dtype=np.int8)[:, None]
        for s in range(1, t):
            v = best[:, None] + self.p["trans"][:, :, None]
            m = mask[s] > 0
            back[s] = np.where(m, v.argmax(axis=0), stay)
            best = np.where(m, v.max(axis=0) + e[s], best)
        path = np.empty((t, n), dtype=np.int64)
        path[-1] = best.argmax(axis=0)
        each = np.arange(n)
        for s in range(t - 1, 0, -1):
            path[s - 1] = back[s, path[s], each]
        sure = np.zeros((t, n), np.float32)
        if (some := np.flatnonzero(path.any(axis=0))).size:
            a, z, *_ = self._sums(np.ascontiguousarray(e[:, :, some].transpose(0, 2, 1)), mask[:, some])
            sure[:, some] = 1 - (a * z)[..., 0]
        return path, sure


def tag_row(spans: list[Span], width: int) -> np.ndarray:
    row = np.zeros(width, dtype=np.int64)
    for kind, start, end in spans:
        row[start:end] = TAGS.index(kind)
    return row


# --- labelled windows


def in_words(digits: str, r: random.Random) -> str:
    return r.choice((" ", " ", "-", ", ")).join("oh" if c == "0" and r.random() < 0.3 else DIGIT_WORDS[int(c)] for c in digits)


def in_alphabet(x: str, r: random.Random) -> str:
    """The same with another alphabet's digits."""
    zero = r.choice((0xFF10, 0x0660, 0x06F0, 0x0966))
    return "".join(chr(zero + ord(c) - 48) if "0" <= c <= "9" else c for c in x)


def variants(r: random.Random) -> tuple[str, str]:
    """A written-out form of one kind, some within the base patterns and some outside them."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwyz") for _ in range(r.randint(2, 9)))
    kind = r.choice(KINDS)
    style = r.random()
    if kind == "email":
        dot, at = r.choice(((".", "@"), (" . ", " @ "), ("[.]", "[@]"), (".", " @ "), (" dot ", "@"), (" dot ", " at "), (" dot ", " at "), ("(dot)", "(at)"), (" (dot) ", " (at) "), ("[dot]", "[at]"), (" DOT ", " AT "), (".", " at "), (".", " (at) ")))
        name = word() + r.choice(("", d(2), "_" + word(), "-" + word(), (dot if len(dot) > 1 else ".") + word()))
        return kind, f"{name}{at}{word()}{r.choice(('', '', d(1)))}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr', f'example{dot}com', word()))}"
    if kind == "ip":
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        if style < 0.2:
            return kind, r.choice((" dot ", " point ")).join(in_words(p, r) for p in parts)
        x = r.choice((".", ".", "[.]", " . ", "(.)", " dot ", "(dot)")).join(parts)
        return kind, in_alphabet(x, r) if style < 0.3 else x
    if kind == "card":
        body = r.choice("3456") + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        if style < 0.2:
            return kind, in_words(body, r)
        x = r.choice(("", "", " ", "-", ".", "/", " - ")).join(body[k : k + 4] for k in range(0, 16, 4))
        return kind, in_alphabet(x, r) if style < 0.3 else x
    area = d(3)
    if style < 0.2:
        return kind, r.choice(("", "plus one ")) + in_words(area + d(7), r)
    x = r.choice((f"+1 ({area}) 555-{d(4)}", f"({area}) 555-{d(4)}", f"{area}-555-{d(4)}", f"{area}.555.{d(4)}", f"{area} 555 {d(4)}", f"+{r.randint(20, 99)} {d(3)} {d(3)} {d(3)}", f"00{r.randint(20, 99)} {d(3)} {d(6)}"))
    return kind, in_alphabet(x, r) if style < 0.3 else x


def decoys(r: random.Random) -> str:
    """Text with digits, digits in words, an @, an `at` or a `dot` that is no personal data."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    few = lambda: r.choice(DIGIT_WORDS)
    secret = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64))))
    return r.choice(
        (
            f"{r.randint(1, 9)}.{r.randint(0, 9)}",
            f"version {r.randint(1, 20)}.{r.randint(0, 20)}.{d(1)}",
            f"{r.randint(1900, 2030)}-{d(2)}-{d(2)}",
            f"{d(2)}.{d(2)}.{r.randint(1900, 2030)}",
            f"{d(2)}/{d(2)}/{r.randint(1900, 2030)}",
            d(r.randint(1, 7)),
            d(r.randint(20, 40)),
            f"@{d(2)}name",
            f"{d(2)}:{d(2)}:{d(2)}",
            f"{d(3)},{d(3)}.{d(2)}",
            f"{d(3)},{d(3)},{d(3)}",
            secret,
            f'token = "{secret}"',
            f"{few()} of the {few()}",
            f"{few()} or {few()} times",
            f"look at one dot",
            f"at {few()} at night",
            f"page {d(2)}, {d(2)} and {d(3)}",
        )
    )


def _unclear(piece: str, spans: list[Span]) -> bool:
    """Whether a long number stands outside the labelled spans: it may be one that the patterns miss."""
    return any(len(_digits(m[0])) >= 7 and not any(s <= m.start() and m.end() <= e for _, s, e in spans) for m in re.finditer(r"[0-9](?:[ .()/-]{0,3}[0-9])*", piece))


def training_windows(text: str, doc_id: int, most: int = TRAIN_WINDOWS) -> list[tuple[str, list[Span]]]:
    """Windows of one document with their labelled spans: as they stand, and with variants or decoys planted."""
    r = random.Random(f"{SEED}:{doc_id}")
    spans, out = base_spans(text), []
    places = [m.start() for m in re.finditer(r"[0-9@]+", text)]
    for p in r.sample(places, min(len(places), most // 2)):
        at = max(0, p - r.randrange(TRAIN_CHARS // 2))
        piece = text[at : at + TRAIN_CHARS]
        mine = [(k, s - at, e - at) for k, s, e in spans if s >= at and e <= at + len(piece)]
        if not _unclear(piece, mine):
            out.append((piece, mine))
    while len(out) < most:
        at = r.randrange(max(1, len(text) - TRAIN_CHARS))
        piece, mine = re.sub("[0-9@]+", "", text[at : at + r.randint(TRAIN_CHARS // 2, 3 * TRAIN_CHARS // 2)]), []
        for _ in range(r.choice((0, 1, 1, 1, 2))):
            cut = r.randrange(len(piece) + 1) if not mine else len(piece)
            gap = r.choice((" ", " ", "\n", ": "))
            if r.random() < 0.7:
                kind, x = variants(r)
                mine.append((kind, cut + len(gap), cut + len(gap) + len(x)))
            else:
                x = decoys(r)
            piece = piece[:cut] + gap + x + r.choice((" ", ". ", ", ")) + piece[cut:]
            if not mine:
                break
        out.append((piece, mine))
    return [x for x in out if x[0]]


def _window_rows(batches, most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [w for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w in training_windows(text, doc, most)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([listed(s) for _, s in rows], pa.string())], ["window", "spans"])


def fit_tagger(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS) -> Tagger:
    """Fits on one row each of at most train_docs documents; train_docs * train_windows windows in all come to the driver, however few documents give them."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ids = [r[0] for r in rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).collect()]
    most = train_docs * train_windows // max(1, len(ids))
    # Of repeated rows of one id the least text stands for all.
    sample = rows.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min("text").alias("text"))
    got = sorted(tuple(r) for r in sample.mapInArrow(functools.partial(_window_rows, most=most), "window string, spans string").collect())
    # Variants alone when there is nothing to sample.
    got = got or [(w, listed(s)) for w, s in training_windows("", 0, most)]
    sample = docs.sparkSession.createDataFrame(got, "window string, spans string").coalesce(1)
    return pickle.loads(sample.mapInArrow(_train, "tagger binary").first()[0])


def _train(batches) -> Iterator[pa.RecordBatch]:
    """All labelled windows -> the tagger, trained in one task: the sample is bounded."""
    one_blas_thread()
    texts, spans = [], []
    for b in batches:
        texts += b.column(0).to_pylist()
        spans += [[(k, int(s), int(e)) for k, s, e in (x.split(":") for x in labels.split(",") if x)] for labels in b.column(1).to_pylist()]
    tagger = Tagger()
    tagger.fit(texts, spans)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tagger)], pa.binary())], ["tagger"])


# --- windows of documents, and their tags put together


def windows(sizes: np.ndarray, width: int = WINDOW, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, start and end of every window: they cover each text, and neighbours share `overlap` characters."""
    step = width - overlap
    n = np.where(sizes > 0, np.maximum(0, -(-(sizes - width) // step)) + 1, 0)
    text = np.repeat(np.arange(len(sizes)), n)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step
    return text, start, np.minimum(start + width, sizes[text])


def tagged(model: Tagger, texts: list[str], width: int = WINDOW, overlap: int = OVERLAP) -> list[list[tuple[str, int, int, float]]]:
    """Spans of every text with their mean posterior: (kind, start, end, sure).

    A character takes its tag from the window in which it lies farthest from an edge: windows hand over in the
    middle of what they share.
    """
    codes = text_codes("\x00".join([*texts, ""]))
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    text, start, end = windows(sizes, width, overlap)
    own_from, own_to = np.where(start > 0, start + overlap // 2, 0), np.where(end < sizes[text], end - overlap + overlap // 2, end)
    order = np.argsort(start - end, kind="stable")
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def decode() -> None:
        """Windows that may hold a span, of all batches read, are decoded together."""
        part, t = np.concatenate([x for x, _ in held]), max(len(e) for _, e in held)
        e = np.concatenate([np.pad(e, ((0, t - len(e)), (0, 0), (0, 0))) for _, e in held], axis=2)
        held.clear()
        place = np.arange(t)[:, None]
        path, sure = model.decode(e, (place < (end - start)[part]).astype(np.float32))
        at = start[part] + place
        path[(at < own_from[part]) | (at >= own_to[part])] = 0
        row, col = np.nonzero(path)
        hits.append((begin[text[part]][col] + at[row, col], path[row, col], sure[row, col]))

    for k in range(0, len(order), DECODE_BATCH):
        part = order[k : k + DECODE_BATCH]
        place = np.arange(int((end - start)[part].max()))[:, None]
        inside = place < (end - start)[part]
        e = model.emissions(np.where(inside, codes[np.minimum((begin[text] + start)[part] + place, len(codes) - 1)], 0))
        e[:, 1:][~np.broadcast_to(inside[:, None], e[:, 1:].shape)] = -1e4
        some = np.flatnonzero(model.may_hold(e))
        if some.size:
            held.append((part[some], np.ascontiguousarray(e[:, :, some])))
        if sum(len(x) for x, _ in held) >= DECODE_BATCH:
            decode()
    if held:
        decode()
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    if not sum(len(x[0]) for x in hits):
        return out
    where, tag, sure = (np.concatenate(x) for x in zip(*hits, strict=True))
    order = np.argsort(where)
    where, tag, sure = where[order], tag[order], sure[order]
    first = np.flatnonzero(np.r_[True, (np.diff(where) != 1) | (np.diff(tag) != 0)])
    size = np.diff(np.r_[first, len(where)])
    mean = np.add.reduceat(sure, first) / size
    owner = np.searchsorted(begin, where[first], side="right") - 1
    for i, j, n, p in zip(owner.tolist(), first.tolist(), size.tolist(), mean.tolist(), strict=True):
        s = int(where[j] - begin[i])
        out[i].append((TAGS[tag[j]], s, s + n, p))
    return out


def plain(x: str) -> str:
    """Digits of any alphabet and digits in words become ASCII digits."""
    x = "".join(c if c < "\x80" or (d := unicodedata.decimal(c, None)) is None else str(d) for c in x)
    return _DIGIT_WORD.sub(lambda m: "0" if m[0].lower() == "oh" else str(DIGIT_WORDS.index(m[0].lower())), x)


_EMAIL_LIKE = re.compile(r"(?is)[a-z0-9].*?(?:[@＠]|[\s(\[]at[\s)\]]).*?[a-z0-9].*?(?:[.．]|[\s(\[]dot[\s)\]]).*?[a-z]")


def plausible(kind: str, x: str) -> bool:
    """What a found span must have to be of its kind, however it is written."""
    if kind == "email":
        return bool(_EMAIL_LIKE.search(x))
    x = plain(x)
    if kind == "ip":
        parts = re.sub(r"[^0-9.]+", "", re.sub(r"(?i)dot|point", ".", x)).split(".")
        return len(parts) == 4 and all(p and _small_part(p) for p in parts)
    d = _digits(x)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return 8 <= len(d) <= 15 and bool(re.search(r"[0-9][^0-9]+[0-9]", x))


def likely(kind: str, x: str) -> str | None:
    """The kind that a span has after all: the one found, if it is plausible, else another one of numbers."""
    return next((k for k in ((kind,) if kind == "email" else (kind, "card", "ip", "phone")) if plausible(k, x)), None)


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    while s < e and (text[s].isspace() or text[s] in ".,;:"):
        s += 1
    while e > s and (text[e - 1].isspace() or text[e - 1] in ".,;:"):
        e -= 1
    return s, e


def added_spans(text: str, base: list[Span], found: list[tuple[str, int, int, float]], certain: float = CERTAIN) -> list[Span]:
    """Found spans that are sure and plausible and overlap no base span; of one that isn't plausible, its parts between blanks that are."""
    taken = [(s, e) for _, s, e in base]
    out = []
    for kind, start, end, sure in found:
        if sure < certain:
            continue
        whole = _trimmed(text, start, end)
        parts = [whole] if likely(kind, text[slice(*whole)]) else [_trimmed(text, start + m.start(), start + m.end()) for m in re.finditer(r"\S+", text[start:end])]
        for s, e in parts:
            if s < e and (k := likely(kind, text[s:e])) and not any(a < e and s < b for a, b in taken):
                out.append((k, s, e))
    return out


def _find(batches, tagger, certain: float) -> Iterator[pa.RecordBatch]:
    one_blas_thread()
    model: Tagger = tagger.value
    for b in batches:
        ids, texts = b.column(0), b.column(1).to_pylist()
        base_col = [base_spans(x) for x in texts]
        found: list = []
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (not part or size + len(texts[at]) < CHUNK):
                part.append(texts[at])
                size += len(texts[at])
                at += 1
            found += tagged(model, part)
        added_col = [added_spans(*x, certain) for x in zip(texts, base_col, found, strict=True)]
        counts = [pa.array([sum(k == x[0] for x in base) for base in base_col], pa.int64()) for k in KINDS]
        all_ = [listed(x + y) for x, y in zip(base_col, added_col, strict=True)]
        n_spans = [len(x) + len(y) for x, y in zip(base_col, added_col, strict=True)]
        yield pa.RecordBatch.from_arrays([ids, *counts, pa.array([listed(x) for x in base_col]), pa.array(all_), pa.array([len(x) for x in added_col], pa.int64()), pa.array(n_spans, pa.int64())], [*OUT_NAMES])


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long, n_spans long"
OUT_NAMES = [x.split()[0] for x in OUT.split(", ")]


def find_pii(docs: DataFrame, certain: float = CERTAIN) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base, spans, n_added, n_spans for every row of docs (doc_id, text).

    base and spans list kind:start:end; n_spans counts all spans, n_added those that the tagger adds. Null or empty
    text has none. An added span never overlaps a base span. Rows are judged one by one: null ids and repeated rows
    need nothing special. A text of any length is read window by window. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tagger = spark.sparkContext.broadcast(fit_tagger(docs))
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # A character costs a thousand times what its way through a shuffle does, and files may be few or uneven.
    rows = spread(rows, "doc_id", F.xxhash64("text"))
    return rows.mapInArrow(functools.partial(_find, tagger=tagger, certain=certain), OUT)
