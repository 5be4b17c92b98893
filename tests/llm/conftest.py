import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RESULTS = "keep label quality shard position token_ids n_tokens round_trip decoded predicted margin rejected lines_dropped char_js word_js n_words flagged item_id group_id group_size license coverage windows".split()
#: Names that operators give to columns of their own on the way.
WORKING = "t _t s _s h _h n _n r _at _r _b part _before before stand stretch ahead drop _drop _doc doc lid _lid d _d q _q bpe _bpe gone _later again _again rank _rank dropped Dropped_ e a b id root band text_ a.b `c`".split()
SYLLABLES = {"en": "the and ing er on th re tion ly of", "de": "der und sch ein ung lich ge keit zu ber", "fr": "le de eau tion ment oi que les an re"}


def prose(rng, lang="en", n=80):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def words():
    return prose


@pytest.fixture(scope="session")
def edges(spark):
    """Rows that operators must survive: nulls, blanks, a long text, repeats, ties, and columns named like results."""
    rng = random.Random(5)
    long = prose(rng, "en", 40_000)
    rows = [(i, prose(rng, "en", 60), "en", "s1", 1) for i in range(12)]
    rows += [(20, None, "en", "s1", None), (21, "", "de", "s1", 0), (22, " \n\t ", None, None, 4), (23, "a", "en", "s2", 1), (24, long, "en", "s2", len(long)), (25, "\U0001f600 é中 ***", "fr", None, 9), (None, "no id here at all", "en", "s1", 3), (0, rows[0][1], "en", "s1", 1), (26, rows[1][1], "en", "s2", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in RESULTS})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Rows whose further columns are named like results and working columns, each with a value of the row's own."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    boiler = prose(rng, "en", 9)
    rows = [(f"d{i:02}", "\n".join([prose(rng, lang, 60), *([boiler] if i % 2 else [])]), lang, "s1", 7) for i, lang in enumerate(["en", "de", "fr"] * 6)]
    rows += [("d90", rows[2][1], "fr", "s2", 7), ("d91", rows[1][1] + " x", "de", None, 7), ("d91", rows[1][1] + " x", "de", None, 7), (None, None, None, "s1", None), (None, "", "en", "s1", 0), ("d92", prose(rng, "en", 30_000), "en", "s1", 7)]
    df = spark.createDataFrame(rows, SCHEMA.replace("doc_id long", "doc_id string"))
    return df.select("*", *[F.concat(F.coalesce("doc_id", F.lit("?")), F.lit(":" + c)).alias(c) for c in [*RESULTS, *WORKING]])
