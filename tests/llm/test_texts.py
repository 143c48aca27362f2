import random

import public_tokenizers
import pytest
import sentencepiece
from helpers import awkward, frame
from pyspark.sql import functions as F

from tessera.llm import pii
from tessera.llm.chat_format import chat_perspectives
from tessera.llm.language_id import SlicedFilters, gram_hashes, language_id
from tessera.llm.piece_bpe import Encoder, merge_long, piece_decode, piece_encode

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_encode_equals_library(library):
    e, r = Encoder(MODEL), random.Random(3)
    parts = [" ", "  ", "a", "b", "th", "the", "er", "aaaa", "\n", "\t", "\r", "0", "12", "é", "日本", "🎉", "▁", "́", "x" * 50, "----", "\x00", "　", "thth", "ininin", "<s>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(2000)] + [" " * k for k in range(70)] + ["a" * k for k in range(60)] + ["ab" * 3000, " " * 4000, "é" * 2500]
    assert e.encode_batch(texts) == library.encode(texts)
    for x, ids in zip(texts, e.encode_batch(texts), strict=True):
        assert e.decode([*ids, 2]) == library.decode(ids), x
    for _ in range(3000):
        ids = [r.randrange(32000) if r.random() < 0.6 else r.randrange(3, 259) for _ in range(r.randint(0, 12))]
        assert e.decode(ids) == library.decode(ids)
    word = "▁" + "the" * 40
    assert [i for c in merge_long(e.model, e.model.cells(word)) for i in e.model.emit(c)] == e.encode_batch(["the" * 40])[0]


def test_encode_rows(spark, library):
    rows = awkward(n=10)
    docs = frame(spark, rows).withColumn("ids", F.lit(1))
    got = piece_encode(docs, MODEL).collect()
    want = [(d, [*library.encode(t or ""), 2]) for d, t, *_ in rows]
    assert sorted(((r[0], r[1]) for r in got), key=repr) == sorted(want, key=repr)
    back = piece_decode(piece_encode(docs, MODEL), MODEL).collect()
    assert sorted(((r[0], r[1]) for r in back), key=repr) == sorted(((d, library.decode(i)) for d, i in want), key=repr)
    assert piece_encode(frame(spark, []), MODEL).count() == 0


def test_bloom_masks():
    h, _, _ = gram_hashes(["abcd efgh"])
    f = SlicedFilters([f"l{i}" for i in range(70)], [h if i in (3, 69) else h[:0] for i in range(70)], "l0")
    m = f.masks(h)
    assert m.shape[0] == 2 and (m[0] == 1 << 3).all() and (m[1] == 1 << 5).all()
    assert f.predict(["abcd", "", "12 34", "zzzzz"]) == (["l3", "und", "und", "l0"], [0.5, 0.0, 0.0, 0.0])


def test_language(spark):
    r = random.Random(5)
    vocab = {"xx": ["bako", "luri", "meta", "siro", "nado"], "yy": ["strof", "gwink", "plerd", "thrax", "quolm"]}
    rows = [(i, " ".join(r.choice(vocab[k]) for _ in range(30)), k, "s", 1) for i in range(400) for k in ["xx" if i % 2 else "yy"]]
    rows += [(500, None, "xx", "s", 0), (501, "12 34 !!", "yy", "s", 0), (502, "bako luri siro", None, "s", 0), (None, "gwink plerd thrax", None, None, 0)]
    got = {r["doc_id"]: r for r in language_id(frame(spark, rows).withColumn("score", F.lit(1))).collect()}
    assert len(got) == len(rows)
    assert all(got[d]["lang_pred"] == k for d, _, k, *_ in rows[:400])
    assert (got[500]["lang_pred"], got[501]["lang_pred"], got[502]["lang_pred"], got[None]["lang_pred"]) == ("und", "und", "xx", "yy")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id(frame(spark, [])).count() == 0
    assert {r["lang_pred"] for r in language_id(frame(spark, [(1, "abc", None, None, 3)])).collect()} == {"und"}


def brute_base(text):
    import re

    digits = lambda x: "".join(c for c in x if c in "0123456789")
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans():
    r = random.Random(1)
    texts = ["".join(r.choice("a1.2@-+ ()_5 9%") for _ in range(r.randint(0, 40))) for _ in range(20000)]
    texts += ["me@x.org and you@y.z-1.com 4111 1111 1111 1111, 10.0.0.256 1.2.3.4.5.6.7.8 +1 (212) 555-0187", "9" * 50000, "a" * 50000 + "@", "1." * 20000]
    for t in texts:
        assert pii.base_spans(t) == brute_base(t)


def test_tagger_gradient():
    t = pii.Tagger()
    t.p = {k: v.astype("float64") for k, v in t.p.items()}
    codes = pii.char_codes(["ab@c.de 12", "x 1.2"])
    import numpy as np

    tags = np.random.default_rng(1).integers(0, len(pii.TAGS), codes.shape)
    _, g = t.learn(codes, tags)
    for name in ("emb", "wx", "wh", "b", "out", "trans"):
        at = tuple(np.argwhere(np.abs(g[name]) > 1e-6)[0])
        keep, ends = t.p[name][at], []
        for step in (1e-3, -1e-3):
            t.p[name][at] = keep + step
            ends.append(t.learn(codes, tags)[0])
        t.p[name][at] = keep
        assert abs((ends[0] - ends[1]) / 2e-3 - g[name][at]) < 2e-2 * max(1, abs(g[name][at])), name


def invented(r, n):
    return " ".join("".join(r.choice("abcdefghilmnoprstuvz") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def tagger():
    r = random.Random(9)
    rows = [w for k in range(300) for w in pii.training_windows(invented(r, 60), k)]
    t = pii.Tagger()
    losses = t.fit([w for w, _ in rows], [s for _, s in rows], epochs=8)
    assert losses[-1] < losses[0] / 5
    return t


def test_tagger_finds_variants_it_has_not_seen(tagger):
    """Held-out windows: of the planted spans that the patterns miss, at least 0.8 are added, and few others."""
    r = random.Random(10)
    held = [w for k in range(150) for w in pii.training_windows(invented(r, 60), 1000 + k)]
    wanted = hit = wrong = added = 0
    for (w, spans), found in zip(held, pii.tagged(tagger, [w for w, _ in held]), strict=True):
        base = pii.base_spans(w)
        more = pii.added_spans(w, base, found)
        missed = [x for x in spans if x not in base]
        wanted += len(missed)
        hit += sum(any(k == kind and s < e2 and s2 < e for kind, s, e in more) for k, s2, e2 in missed)
        added += len(more)
        wrong += sum(not any(s < e2 and s2 < e for _, s2, e2 in spans) for _, s, e in more)
    assert hit >= 0.8 * wanted and wrong <= 0.03 * added, (hit, wanted, wrong, added)


def test_whole_texts_are_read(tagger):
    """A form without any digit or @ is found anywhere in a long text, also across the edges of windows, once; plain text gives nothing."""
    r = random.Random(11)
    x = "jane dot doe at mailer dot example dot com"
    step = pii.WINDOW - pii.OVERLAP
    body = invented(r, 1500)
    for at in (0, 5, step - 20, step, step + 20, 2 * step - 5, len(body) // 2, len(body)):
        cut = body.find(" ", at) if at < len(body) - 20 else len(body)
        t = body[:cut] + " " + x + " " + body[cut:]
        more = pii.added_spans(t, [], pii.tagged(tagger, [t])[0])
        assert len(more) == 1 and more[0][0] == "email" and more[0][1] < cut + 1 + len(x) and cut + 1 < more[0][2], (at, more)
    plain = [invented(r, 800) for _ in range(20)]
    assert not any(pii.added_spans(t, [], f) for t, f in zip(plain, pii.tagged(tagger, plain), strict=True))


def test_decoding_equals_learning(tagger):
    import numpy as np

    texts = ["write to a@b.com now", "x", "call 555 123 4567 or not at all", "\u0661\u0662 10.0.0.1"]
    codes = pii.char_codes(texts)
    slow, (mask, *_) = tagger.scores(codes)
    fast = tagger.emissions(codes.T.astype(np.uint8)).transpose(0, 2, 1)
    assert np.abs((slow - fast) * mask[..., None]).max() < 1e-3
    r = np.random.default_rng(3)
    e = r.standard_normal((6, len(pii.TAGS), 400)).astype(np.float32) * 2
    e[:, 1:] -= 2
    ones = np.ones((6, 400), np.float32)
    path, sure = tagger.decode(e, ones)
    assert not (path.any(axis=0) & ~tagger.may_hold(e)).any() and (~tagger.may_hold(e)).any()
    import itertools

    for n in range(40):
        score = {}
        for way in itertools.product(range(len(pii.TAGS)), repeat=6):
            score[way] = sum(e[s, k, n] for s, k in enumerate(way)) + sum(tagger.p["trans"][a, b] for a, b in itertools.pairwise(way))
        best = max(score, key=score.get)
        assert abs(score[tuple(path[:, n])] - score[best]) < 1e-3
        if path[:, n].any():
            top = max(score.values())
            z = sum(np.exp(v - top) for v in score.values())
            out = [sum(np.exp(v - top) for w, v in score.items() if w[s] == 0) / z for s in range(6)]
            assert np.abs(1 - np.array(out) - sure[:, n]).max() < 1e-3


def test_windows_cover_texts():
    import numpy as np

    sizes = np.array([0, 1, pii.WINDOW, pii.WINDOW + 1, 10 * pii.WINDOW])
    text, start, end = pii.windows(sizes)
    for k, n in enumerate(sizes.tolist()):
        mine = sorted(zip(start[text == k].tolist(), end[text == k].tolist(), strict=True))
        assert (not mine) == (n == 0)
        if mine:
            assert mine[0][0] == 0 and mine[-1][1] == n and all(b[0] == a[1] - pii.OVERLAP for a, b in zip(mine, mine[1:], strict=False))


def test_plausible():
    assert pii.plausible("card", "four one one one one one one one one one one one one one one one")
    assert not pii.plausible("card", "4111 1111 1111 1112") and pii.plausible("card", "\u0664111 1111 1111 1111")
    assert pii.plausible("ip", "one nine two dot 168 dot 0 dot one") and not pii.plausible("ip", "1.2.3.256")
    assert pii.plausible("email", "jane at example dot com") and not pii.plausible("email", "look at one thing")
    assert pii.added_spans("4465758382889437 4465758382889437", [], [("card", 0, 33, 1.0)]) == [("card", 0, 16), ("card", 17, 33)]


def test_pii_rows(spark):
    rows = [(1, "write to a.b@c.example.com or +1 (212) 555-0187", "en", "s", 0), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "10.0.0.1", "en", "s", 0), (1, "plain words", "en", "s", 0)]
    got = sorted((tuple(r)[:7] for r in pii.find_pii(frame(spark, rows).withColumn("base", F.lit(1))).collect()), key=repr)
    want = [(1, 1, 0, 0, 1, "email:9:26,phone:30:47"), (2, 0, 0, 0, 0, ""), (3, 0, 0, 0, 0, ""), (None, 0, 1, 0, 0, "ip:0:8"), (1, 0, 0, 0, 0, "")]
    assert [x[:6] for x in got] == sorted(want, key=repr)
    assert pii.find_pii(frame(spark, [])).count() == 0


def test_pii_query(spark, tmp_path):
    """The registered query: base columns as by brute force, planted forms added, clean documents left alone."""
    import hashlib

    from tessera.llm.queries import op8_pii

    r = random.Random(12)
    rows = [(i, invented(r, 120), "en", "s", 0) for i in range(700)] + [(900, None, None, None, None), (901, "x " * 200_000 + "10.0.0.1", "en", "s", 0)]
    planted = {}
    for i in range(60):
        kind, x = pii.variants(r)
        words = rows[i][1].split(" ")
        at = r.randrange(len(words))
        planted[i] = (kind, len(" ".join(words[:at])) + (at > 0), x)
        rows[i] = (i, " ".join([*words[:at], x, *words[at:]]), "en", "s", 0)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in op8_pii(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    hit = 0
    for d, t, *_ in rows:
        base = brute_base(t or "")
        assert got[d]["base_sha256"] == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(k == x[0] for x in base) for k in pii.KINDS]
        spans = [x.split(":") for x in got[d]["spans"].split(",") if x]
        assert got[d]["n_spans"] == len(spans) == len(base) + got[d]["n_added"]
        if d in planted:
            kind, at, x = planted[d]
            hit += any(k == kind and int(s) < at + len(x) and at < int(e) for k, s, e in spans)
        else:
            assert not got[d]["n_added"]
    assert hit >= 0.8 * len(planted), hit


def test_chat(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (None, 1, "cy", "null"), (3, None, None, "x"), (1, 300, "bob", "late")]
    out = chat_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1)))
    got = {(r["conv_id"], r["perspective"], r["chunk"]): r for r in out.collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (1, "ann", 1), (1, "bob", 1), (None, "cy", 0), (3, "unknown", -1)}
    ann = got[(1, "ann", 0)]
    assert ann["text"] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n"
    assert [ann["text"][slice(*map(int, m.split(":")))] for m in ann["mask"].split(",")] == ["hi < |im_end|><|im_end|>", "bye<|im_end|>"]
    assert got[(1, "ann", 1)]["mask"] == "" and got[(1, "bob", 0)]["n_target_turns"] == 1
    assert chat_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
