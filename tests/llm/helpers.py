"""Small documents with every awkward case, and brute-force versions of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def awkward(seed=1, n=60):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(200)] + ["É", "the", "The", "ß", "日本", "　x", "a b", "🎉"]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(30, 90))) for _ in range(12)]
    line = "A shared line of more than twenty letters"
    rows = []
    for i in range(n):
        t = base[i % 12]
        if i % 3 == 1:
            words = t.split(" ")
            words[r.randrange(len(words))] = "edit%d" % i
            t = " ".join(words)
        if i % 4 == 0:
            t = t + "\n" + line + ("  " if i % 8 else "") + "\n" + line.upper()
        rows.append((i, t, "en" if i % 2 else "fr", None if i % 7 == 0 else "s%d" % (i % 3), len(t)))
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \t\n ", "en", "s1", 4), (103, "one two", "en", "s1", 7), (104, "one two", "en", "s1", 7)]
    rows += [(105, "le " * 400, "fr", "s2", 1200), (106, " ".join(vocab[i % 150] for i in range(30000)), "en", "s2", 1), (None, base[0], "en", "s1", 9), (None, None, None, None, None)]
    rows += [rows[3], rows[3]]
    return rows


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def words(t):
    return WORD.findall(t or "")
