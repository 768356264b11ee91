"""Small documents with the awkward cases: nulls, ties, copies, long texts, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key string, fp string, node string, len string, spans string, size string, shard string, component string"


def texts(seed=7):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgéñ") for _ in range(r.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = prose(300)
    words = base.split()
    near = [*words]
    near[150] = "changed"
    passage = prose(60)
    rows = [
        base, base, " ".join(near), None, None, "", "  \t\n ", "Word", "WORD", "a b c d", "A B C D e",
        prose(80) + " " + passage + " " + prose(40),
        passage, passage + " " + prose(30), prose(10) + "\n" + passage + " " + passage, prose(49), prose(50),
        passage[: len(passage) // 2], "the " * 700, "the " * 650, prose(9000), "É é \x00   x\x0by", "İstanbul ſecret=abcdefgh",
        "token: token: abcdefgh SECRET = 'q1w2e3r4t5' api_key=xx apikey:zz_top99",
        "AKIA" + "A1B2C3D4E5F6G7H8" + " user: alice at https://db.example.org:5432/x AKIASHORT",
        "0123456789abcdef01234567 deadbeef " + "f" * 40 + "g" + "é" * 5 + "ab" * 12,
        "user=bob " + prose(120) + " password: hunter22",
        "account: carol_x then Zq9" + "aB3" * 11 + " end",
    ]
    return [*rows, *(prose(r.randint(5, 200)) for _ in range(12))], vocabulary, passage


def documents(seed=7):
    """(doc_id, text) with a repeated row."""
    t, _, _ = texts(seed)
    rows = [(i * 3 % 101 + 1, x) for i, x in enumerate(t)]
    return [*rows, rows[0], rows[3], rows[11]]


def benchmark(seed=7):
    t, vocabulary, passage = texts(seed)
    w = passage.split()
    return [
        (1, passage), (2, " ".join(w[5:18]).upper()), (3, " ".join(w[20:30])), (4, None), (5, ""), (6, "!!! ..."), (10, passage),
        (7, "the the the the the the the the the the the the the the the"), (8, "word"), (None, passage), (9, t[0][:400]),
    ]


def frame(spark, rows):
    extra = ("en", "s", 1, "x", "y", "z", "w", "v", "u", "t", "c")
    return spark.createDataFrame([(d, t, *extra) for d, t in rows], SCHEMA)


def write(spark, folder, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
