"""Small tables with every awkward row: nulls, empty and very long texts, repeats, clashing columns."""

import random

WORDS = "the of and river stone green quiet walks slowly under bright evening café naïve straße niño über".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) + r.choice(["", str(r.randrange(99))]) for _ in range(n))


BASE = prose(120, 1)
ROWS = [
    (10, BASE), (11, BASE), (12, BASE), (12, BASE), (3, BASE.replace("river", "lake", 1)), (20, None), (21, ""), (22, " \n\t "), (None, prose(40, 2)),
    (None, BASE), (30, "few words here"), (31, "Few words HERE"), (40, prose(6000, 3)), (41, "a" * 5000), (42, prose(90, 4) + "\r\n\x00 　x" + BASE),
    (50, "word " * 300), (51, "MIT License. password = hunter2secret AKIA" + "Z9" * 10 + " deadbeef" * 4 + " x:deadbeef00112233445566778899aabb"),
    (52, prose(50, 5) + "\nReleased under the MIT Licence.\n" + prose(30, 6)), (10, prose(20, 7)),
]
#: Column names that operators use inside.
CLASHES = "row id digest n kept set_id label signature band place key part start length shard slot text_crc32 symbols least spans first".split()


def documents(spark, rows=ROWS):
    columns = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES)
    data = [(d, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", *[f"{c}{i}" for c in CLASHES]) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, columns)


def tuples(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
