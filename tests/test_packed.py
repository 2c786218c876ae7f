import random

from quire.operators.packed import split_packed

NAMES = ["Table", "Chart", "Plain text", "Table (continued)", "Layout, two-column", "Footnote; margin", "Form/Checklist", "Reader's note", 'Panel "B"']


def rows(df):
    return sorted((r[0], r.field_name, r.item_no, r.item_text) for r in df.collect())


def write(values, sep, quote, brackets, rng):
    def one(v):
        if quote == '"' or any(c in v for c in ",;/|") or "'" in v:
            return '"' + v.replace('"', '""') + '"'
        return f"'{v}'" if quote == "'" and "'" not in v else v
    return brackets[0] + sep.join(one(v) for v in values) + brackets[1]


def test_round_trip_of_random_dialects(spark):
    rng = random.Random(5)
    data, want = [], []
    for i in range(600):
        pages = [str(rng.randint(1, 60)) for _ in range(rng.randint(1, 5))]
        names = [rng.choice(NAMES) for _ in range(rng.randint(1, 3))]
        p = rng.choice(["", "[", "{"])
        b = (p, {"": "", "[": "]", "{": "}"}[p])
        a = write(pages, rng.choice([",", ", ", "; ", " | ", "/", "\t", "\n", " & ", " and "]), rng.choice(["", '"', "'"]), b, rng)
        s = write(names, rng.choice([",", ", ", ";", " | ", "\t"]), rng.choice(["", '"', "'"]), b, rng)
        data.append((i, a, s))
        want += [(i, "pages", k, v) for k, v in enumerate(pages)] + [(i, "names", k, v) for k, v in enumerate(names)]
    df = spark.createDataFrame(data, "id int, pages string, names string")
    assert rows(split_packed(df, "id", ["pages", "names"])) == sorted(want)


def test_defined_cases(spark):
    data = [(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, "[]", "x"), (5, "3,,4,", "x"), (6, "[7, 7]", "x"), (6, "[7, 7]", "x"), (7, "12-15", "x"), (8, '"a ""b"""', "x"), (9, "9," * 3000 + "9", "x")]
    data += [(100 + i, f"{i}, {i + 1}", "x") for i in range(1, 40)]
    df = spark.createDataFrame(data, "id int, pages string, item_text string")
    got = [r for r in rows(split_packed(df, "id", ["pages"])) if r[0] < 100]
    assert [r for r in got if r[0] < 9] == [(5, "pages", 0, "3"), (5, "pages", 1, "4"), (6, "pages", 0, "7"), (6, "pages", 1, "7"), (7, "pages", 0, "12-15"), (8, "pages", 0, 'a "b"')]
    assert len([r for r in got if r[0] == 9]) == 3001
    assert rows(split_packed(df.limit(0), "id", ["pages"])) == []
