import os
import sys
import tempfile
from pathlib import Path

import pytest
from hypothesis import settings

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # Python workers import the package too


settings.register_profile("spark", deadline=None)
settings.load_profile("spark")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return session


SMALL = "/root/testdata/sf0.001"

#: Nulls, empty and odd texts, ties and repeated rows; an extra column and one that clashes with results' names.
HARD = [
    (1, "one two three four five six seven eight nine ten", "en", "b", 1, "x"),
    (1, "one two three four five six seven eight nine ten", "en", "b", 1, "x"),
    (2, "ONE two three four five six seven eight nine ten", "en", None, 2, "x"),
    (3, None, None, "a", None, None),
    (4, "", "en", "a", 0, ""),
    (5, " \t\n", "en", "c", 3, "y"),
    (6, "\u00e9\u00fc\U0001f600 na\u00efve\u00a0text\u3000here \x0b\x0c end", "fr", "\u00e9", 4, "z"),
    (None, "no id here but text enough to count as a text", "en", "b", 5, None),
    (7, "word " * 3000 + "\n" + "longer line again " * 900, "en", "b", 6, "w"),
    (8, "one two", "en", "b", 7, "v"),
]
HARD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
#: Columns whose names operators use inside, and one of a type that cannot be hashed or compared.
CLASHING = {"copies": "long", "target": "double", "finish": "string", "source_size": "long", "number": "int", "size": "long", "node": "long", "root": "long", "key": "string", "row": "long", "spans": "string"}


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({**{c: F.lit(3).cast(t) for c, t in CLASHING.items()}, "extra": F.create_map(F.lit("a"), F.col("lang"))})


@pytest.fixture(scope="session")
def hard(spark):
    return with_clashes(spark.createDataFrame(HARD, HARD_SCHEMA))


@pytest.fixture(scope="session")
def nothing(spark):
    return with_clashes(spark.createDataFrame([], HARD_SCHEMA))


@pytest.fixture(scope="session")
def huge(spark):
    """A text of four megabytes in one line, one of three in many, and short ones around them."""
    import random

    rng = random.Random(1)
    words = [f"w{rng.randrange(10**5)}" for _ in range(600_000)]
    lines = "\n".join(" ".join(words[i : i + 9]) for i in range(0, 450_000, 9))
    rows = [(1, " ".join(words), "en", "a", 1, "x"), (2, "a few words here", "en", "a", 1, "x"), (3, lines, "en", "b", 1, "x"), (4, " ".join(words), "en", "b", 1, "x")]
    return with_clashes(spark.createDataFrame(rows, HARD_SCHEMA))
