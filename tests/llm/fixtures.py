"""Small tables with nulls, empties, long texts, ties, repeated rows and extra columns of clashing names."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, skey string, _hits string, taken int, shard int, bucket string"


def odd_documents(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(60)
    near = base.split()
    near[30] = "changed"
    texts = [None, "", "   \n\t", "one", base, base, " ".join(near), say(3000), say(40) + "\n" + base, "É" * 500, "a\x1cb 'll !", base.upper(), say(80), "😀 " * 30]
    rows = [(k, t, "en", rng.choice(["s1", "s2", None]), len(t or ""), -1, "x", "y", 7, 9, "z") for k, t in enumerate(texts)]
    rows += [rows[4], (None, "no id at all", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
