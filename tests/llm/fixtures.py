"""Small tables with copies, shared passages, nulls, empty and long texts, repeated rows and awkward columns."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def corpus(n=60, seed=0, vocabulary=400):
    """(doc_id, text): some rows share passages, some are copies, one is long; ids may repeat or be null."""
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcdeéßñ中") for _ in range(rnd.randint(1, 7))) for _ in range(vocabulary)]
    passages = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(8, 40))) for _ in range(5)]
    rows = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (None, passages[0]), (None, passages[0] + " tail")]
    for i in range(n):
        parts = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 4))]
        for _ in range(rnd.randint(0, 2)):
            parts.insert(rnd.randint(0, len(parts)), rnd.choice(passages))
        rows.append((rnd.randint(0, 200), rnd.choice([" ", "\n", "  "]).join(parts)))
    rows += [(300 + k, rows[10][1]) for k in range(8)] + [rows[10], rows[10]]
    rows.append((400, " ".join(rnd.choice(pool) for _ in range(5000)) + " " + passages[1] + " " + "ab " * 200))
    rows.append((401, "the " * 300))
    rows.append((402, "the " * 260 + passages[1]))
    rnd.shuffle(rows)
    return rows


def frame(spark, rows, schema="doc_id long, text string", parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)
