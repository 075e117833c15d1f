"""Small tables with NULLs, empty and long texts, ties, repeated rows and columns with clashing names."""

import random

WORDS = "the of and river stone morning paper walks under bright seven letters carry slowly green market people sing over hill".split()


def text(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice(".,") if rng.random() < 0.1 else "") for _ in range(n))


def rows():
    shared = text(60, 99)
    out = [(i, text(40 + 7 * i, i), "en", "src", 0) for i in range(20)]
    out += [(20, out[3][1], "en", "src", 0), (21, out[3][1], "de", "src0", 0)]  # copies
    out += [(22, shared + " " + text(30, 500), "en", "s", 0), (23, text(30, 501) + " " + shared, "en", "s", 0), (24, text(10, 502) + "\n" + shared + "\n" + text(9, 503), "en", "s", 0)]
    near = text(200, 7).split()
    out += [(25, " ".join(near), "en", "s", 0), (26, " ".join([*near[:-2], "other", "end"]), "en", "s", 0)]
    out += [(27, None, None, None, None), (28, "", "en", "s", 0), (29, " \n\t", "en", "s", 0), (30, "one", "en", "s", 0), (31, "Two words", "en", "s", 0)]
    out += [(32, text(20000, 8), "en", "s", 0), (33, "a" * 3000, "en", "s", 0), (34, "éà ü " * 40 + "日本語 テキスト", "fr", "s", 0)]
    out += [(None, text(50, 5), "en", "s", 0), (None, None, None, None, None)]
    out += [out[4], out[4]]  # repeated rows
    return out


def documents(spark, data=None):
    """The rows with more columns, whose names clash with those that operators use."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, n long, key long, fp string, words string, `votes` int, `a.b` int"
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3, 4) for r in (rows() if data is None else data)], kinds)
