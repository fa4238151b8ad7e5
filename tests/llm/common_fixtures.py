"""Small documents tables with every odd case: nulls, empty and long texts, repeats, clashing extra columns."""

import random
from collections import Counter

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def odd_rows() -> list[tuple]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    words = [word() for _ in range(300)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, line = sentence(120), sentence(30)
    rows = [
        (1, base, "en", "src1"),
        (2, base.replace(" ", "  \t", 5), "en", "src1"),  # equal after white space
        (3, base + " " + sentence(3), "en", "src2"),  # near copy
        (4, None, "en", "src1"),
        (5, "", None, "src1"),
        (6, " \n\t ", "de", None),
        (7, line + "\n" + sentence(40) + "\n" + line, "en", "src1"),
        (8, sentence(20) + "\n" + line, "en", "src1"),
        (9, "word " * 400, "en", "src1"),
        (10, "### $$$ " + " ".join(w + "***" for w in words[:60]), "en", "src1"),
        (11, "two words", "en", "src1"),
        (12, "two words", "en", "src2"),
        (13, "TWO Words", "en", "src2"),
        (14, sentence(20000), "fr", "src3"),  # long
        (15, "日本語 <|endoftext|> ﬁn Å İstanbul 😀 ½", "ja", "src4"),
        (17, "éé" * 300, "fr", "src3"),
    ]
    rows += [(20 + k, sentence(rng.randint(5, 90)) + ("\n" + line) * (k % 3 == 0), rng.choice(["en", "de"]), f"src{k % 5}") for k in range(40)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def odd_documents(spark, extra: bool = True, repeats: bool = False):
    rows = odd_rows()
    if repeats:
        rows += [rows[0], rows[3], (None, "no id at all here", "en", "src1", 17), (None, rows[0][1], "en", "src1", 5)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:  # names that the operators use themselves
        for name in ("kept", "uid", "raw", "sha", "value", "n", "cid", "label", "score", "copies", "ids", "n_tokens", "_text", "h"):
            docs = docs.withColumn(name, F.lit("mine"))
    return docs


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def texts() -> dict[int, str]:
    return {r[0]: r[1] or "" for r in odd_rows()}


def five_words(raw: dict[int, str]) -> dict[int, tuple[int, int]]:
    """(shingles, smallest id of its component) of every text, by all pairs that share a shingle."""
    sets, holders, both, parent = {}, {}, Counter(), {i: i for i in raw}
    for i, t in raw.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[i]:
            both.update((j, i) for j in holders.setdefault(s, []))
            holders[s].append(i)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, j), n in both.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in raw}
