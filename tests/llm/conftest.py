import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rows import ROWS, clashing  # noqa: E402

@pytest.fixture(scope="session")
def awkward(spark):
    return clashing(spark, ROWS)


@pytest.fixture(scope="session")
def nothing(spark):
    return clashing(spark, [])


@pytest.fixture(scope="session")
def awkward_dir(spark, awkward, tmp_path_factory):
    """The awkward rows as tables, with conversations to match; no row without id, which SQL's order leaves open."""
    folder = tmp_path_factory.mktemp("awkward")
    awkward.toPandas().to_parquet(folder / "documents.parquet")
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "[ROLE] x [/ROLE]"), (2, None, None, "\\<s>"), (2, 1, "user", "a \\"),
             (2, 1, "user", "a \\"), (3, 0, "system </s>", ""), (None, 0, "assistant", "<s></s>[INST] "), (4, 2, "tool", "é\n<"), (4, 1, "assistant", "</s")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").toPandas()
    frame.to_parquet(folder / "conversations.parquet")
    vectors = [(0, [.5, .25], 1), (0, [.5, .25], 1), (50, [.5, .2, .1], 2), (100, [-.5], 1), (150, [], 2), (200, None, 1), (1, [.4, .3], 1), (2, [.4, .3], 2), (3, [.3], 2),
               (None, [.4, .3], 2), (4, [.5, None], 1), (5, [float("inf")], 1), (6, [.1, .1], None), (8, [.35, .2, .05, .0, .0, .0, .0, .0, 3.], 3)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    frame.coalesce(1).write.parquet(str(folder / "vectors"))
    next((folder / "vectors").glob("*.parquet")).rename(folder / "embeddings.parquet")
    return str(folder)
