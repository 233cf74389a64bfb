"""Fixtures with everything that can go wrong in a table."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, ids string, cell int, digest binary, items string, k bigint, epoch string, __gone string"
LONG = "lorem ipsum dolor sit amet " * 9000


def rows():
    extra = (7, "x", 1, b"d", "i", 3, "e", "g")
    base = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from it again today", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog and runs away from it again today", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog and runs away from it again today", "en", "a"),
        (3, None, "en", "a"),
        (4, "", None, "b"),
        (5, "   \n\t ", "fr", None),
        (None, "Ein Text ohne Nummer steht hier zwischen den anderen", "de", "b"),
        (6, LONG, "en", "b"),
        (7, "écoute é 中文 😀 mail a.b@c.example.org now", "fr", None),
        (8, "%%% $$$ ###", None, "c"),
        (9, "a", "en", "c"),
    ]
    return [(i, t, lang, s, len(t) if t is not None else None, *extra) for i, t, lang, s in base]


def nasty(spark):
    return spark.createDataFrame(rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
