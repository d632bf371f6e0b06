"""Small tables that every operator is tried on."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = ["th", "er", "on", "an", "re", "nd", "ou", "ea", "ti", "en"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def documents(seed=1, n=60):
    """Prose with exact and near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(3, 160)) for _ in range(n)]
    passage = prose(rng, 70)
    rows = []
    for i, text in enumerate(base):
        if i % 7 == 3:
            text = base[i - 1]
        elif i % 7 == 5:
            words = base[i - 2].split()
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif i % 11 == 4:
            text = text + "\n" + passage + "\t" + prose(rng, 20)
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
    rows += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, " \n\t ", "en", None, 4), (103, prose(rng, 3000), "en", "src1", 1), (104, "É" * 300 + " Ünï", "fr", "", 5)]
    rows += [(105, base[0], "en", "src2", 1), (105, base[0], "en", "src2", 1), (None, base[1], "en", "src3", 1), (None, "alone without an id", None, "src3", 1)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOC).repartition(3)
