"""Small documents with every awkward case: nulls, empty and blank texts, repeated rows, ties, long and odd texts."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def documents(spark, n=60, seed=5, extra=True):
    r = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma,", "δέλτα", "e", "zêta.", "x1", "the", "of", "and"] + [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    base = [" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 4, 5, 25, 80, 200]))) for _ in range(n)]
    rows = []
    for i, t in enumerate(base):
        if i % 7 == 3:
            t = base[(i * 3) % n]
        if i % 5 == 1:
            t = f"{t} {passage}\n\t{t[:20]}"
        if i % 11 == 2:
            ws = base[(i * 5) % n].split()
            if len(ws) > 40:
                ws[7] = "changed"
            t = " ".join(ws)
        rows.append((i * 3 + 1, t, ["en", "de", None][i % 3], ["s1", "s0", "s2", None][i % 4], len(t)))
    if extra:
        rows += [(2, None, "en", "s0", 0), (5, "", "de", "s1", 0), (8, " \t\n ", None, None, 4), (11, "a a a a " * 30, "en", "s1", 240), (14, "漢字 😀 x y " * 9, "de", "s2", 100), (None, "no id here", "en", "s0", 10), (17, "... 123 ###", "en", "s1", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.repartition(3)


def rows_of(df):
    return [r.asDict() for r in df.collect()]
