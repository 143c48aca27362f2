import numpy as np
import pytest
from helpers import frame

from tessera.llm.language_id import gram_hashes, language_id


@pytest.mark.parametrize("texts", [["ab\x00cd efgh", "ijkl", "", "\x00\x00x\x00\x00\x00y", "\x00", "12", "İstanbul\x00", "\U0001f389ab cd"], ["\x00" * 9 + "abcd"], [""], []])
def test_grams_of_a_text_do_not_hang_on_its_neighbours(texts):
    h, text, has = gram_hashes(texts)
    assert len(has) == len(texts)
    for i, x in enumerate(texts):
        alone, _, letters = gram_hashes([x])
        assert np.array_equal(h[text == i], alone) and has[i] == letters[0] == any(map(str.isalpha, x))
    # A zero in a text is a blank like all that is no letter.
    assert np.array_equal(h, gram_hashes([x.replace("\x00", " ") for x in texts])[0])


def test_language_of_texts_with_zeros(spark):
    word = {"xx": "bako luri meta siro nado ", "yy": "strof gwink plerd thrax quolm "}
    rows = [(i, word[k] * 6, k, "s", 1) for i in range(200) for k in ["xx" if i % 2 else "yy"]]
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id(frame(spark, rows)).collect()}
    zeros = [(d, t.replace(" ", "\x00") if d % 3 else t, k, s, n) for d, t, k, s, n in rows]
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id(frame(spark, zeros)).collect()} == plain
    assert all(plain[d][0] == k for d, _, k, *_ in rows)
