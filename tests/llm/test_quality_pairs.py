import random

from helpers import frame
from test_native import LABELS


def test_query_tells_a_text_from_its_shuffled_words(spark, tmp_path):
    from tessera.llm.queries import op10_quality_rules

    r = random.Random(4)
    after = {f"w{i}": [f"w{(7 * i + j) % 60}" for j in (1, 5)] for i in range(60)}
    rows = []
    for d in range(300):
        w = [f"w{d % 60}"]
        while len(w) < 200:
            w.append(r.choice(after[w[-1]]))
        rows.append((d, " ".join(w), "en", "s", 1))
    shuffled = rows[250][1].split()
    r.shuffle(shuffled)
    rows.append((900, " ".join(shuffled), "en", "s", 1))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d in range(200)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    llr = {x["doc_id"]: x["llr"] for x in op10_quality_rules(spark, str(tmp_path)).collect()}
    assert llr[900] < min(llr[d] for d in range(300)) - 0.01
