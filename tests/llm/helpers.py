"""Small tables with every awkward case: nulls, empties, repeats, long texts, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone_id string, twice_id int, perplexity double, Node string, _log_p int, label string"


def prose(seed: int, words: int = 120) -> str:
    r = random.Random(seed)
    lexicon = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(400)]
    return " ".join(r.choice(lexicon) + ("." if k % 11 == 10 else "") for k in range(words))


def awkward(spark):
    rows = [(None, prose(1)), (None, None), (1, None), (2, ""), (3, prose(2)), (3, prose(2)), (4, prose(2)), (5, prose(3, 40_000)), (6, "\n\n \n"), (7, "word"), (8, prose(4) + "\n" + prose(5)), (9, prose(4) + "x\n" + prose(6)), (10, "!!! ???")]
    return spark.createDataFrame([(i, t, ["en", None, "fr"][(i or 0) % 3], "s", None if t is None else len(t), "x", 1, 2.0, None, 7, "l") for i, t in rows], SCHEMA)


def none_of(spark):
    return spark.createDataFrame([], SCHEMA)
