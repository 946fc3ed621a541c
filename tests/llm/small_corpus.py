"""A small corpus with the cases that every operator must bear."""

import random

SYLLABLES = {"en": "the an ing ou st er re nd wh sh".split(), "fr": "eau é oi ch ê tion qu eux le mé".split(), "de": "sch ung ei ü ach keit ver ö zu pf".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, component_id string, labels string, n long, id long, word string"


def words(rng, lang, n):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng, lang, n):
    out = words(rng, lang, n)
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(out))


def rows(seed=1, n=120):
    """doc_id, text, lang, source of n documents and then of the odd ones."""
    rng = random.Random(seed)
    made = []
    for i in range(n):
        lang = ("en", "fr", "de")[i % 3]
        made.append((i, prose(rng, lang, rng.randint(30, 160)), lang, f"s{i % 4}"))
    base = made[3][1].split()
    for j in range(12):  # near copies: a word changed here and there
        copy = list(base)
        for _ in range(j % 4):
            copy[rng.randrange(len(copy))] = "changed"
        made.append((n + j, " ".join(copy), "en", "s0"))
    made += [(n + 20 + j, made[5][1], "de", "s1") for j in range(6)]  # equal copies
    at = n + 40
    odd = [None, "", "   \n\t ", "one", "two words", "Ünïcödé ☃ 日本 !!", "a " * 3000, "x" * 5000, "1 2 3 4 5", made[0][1].upper()]
    made += [(at + j, t, None if j % 2 else "en", None if j % 3 else "s2") for j, t in enumerate(odd)]
    made += [made[7], made[7], (None, made[8][1], "en", "s3"), (None, None, None, None)]  # repeated rows, null ids
    return made


def table(spark, made):
    """Documents with further columns whose names operators use themselves."""
    return spark.createDataFrame([(d, t, lang, s, len(t or ""), 0.5, 7, "x", "y", 1, 2, "z") for d, t, lang, s in made], SCHEMA)
