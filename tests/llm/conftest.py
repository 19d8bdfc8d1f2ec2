import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score string, _key string, n_words int, "
    "target int, _from int, _salt string, `my col` string, `n-words` int, `a.b` int, _id int, copies int, node int, tags map<string, int>"
)
CLASHING = (7, 8, "clash", "spaced", 9, 10, 11, 12, 13, {"a": 1})


def corpus():
    """Documents with nulls, empty and long texts, ties, repeated rows, shared passages and clashing column names."""
    rng = random.Random(5)
    vocabulary = {"en": "the of and wing river stone blue lamp field over quick sand".split(), "de": "der und nicht straße über grün fluß stein lampe feld läuft wald".split()}
    say = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "a", "s", "ing", "9"]) for _ in range(n))
    passage, line = say("en", 60), "this very line is on many pages of one host and says nothing new"
    rows = []
    for i in range(1, 70):
        lang = "de" if i % 3 == 0 else "en"
        text = "\n".join(say(lang, rng.randint(1, 60)) for _ in range(rng.randint(1, 6)))
        if i % 6 == 0:
            text += "\n" + passage + " " + say(lang, 5)
        if i % 4 == 0:
            text = line + "\n" + text + "\n" + line
        if i % 9 == 0:
            text += "\n" + line.replace("very", "rather") + "\nshort one\nshort one"
        rows.append((i, text, lang, f"src{i % 2}"))
    rows += [(100 + i, rows[3][1], "en", "src0") for i in range(4)]  # exact copies
    rows.append((110, rows[7][1].replace("river", "brook", 1), "en", "src1"))
    rows.append(rows[10])  # a repeated row
    rows.append((120, "x" * 450 + "é" * 300 + "x" * 450, "en", "src0"))  # periodic, over 200 bytes
    rows.append((121, " ".join(["loop"] * 90), "en", None))
    rows.append((122, "word " * 30000, None, "src1"))  # very long
    rows += [(130, None, "en", "src0"), (131, "", None, None), (132, " \n\t\n ", "en", "src0"), (133, "1234 5678 !!", "en", "src1"), (None, "a row without an id but with the words of its own here", "en", "src1"), (None, None, None, None), (134, "AÉ�\x00b \x85c", "en", "src0")]
    return [(i, t, lang, s, None if t is None else len(t), "clash", "clash", -1, *CLASHING) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
