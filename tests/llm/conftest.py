import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest

from auditframe.llm.common import Scratch


@pytest.fixture
def scratch(spark, request):
    s = Scratch(spark, "test")
    yield s
    s.release()


#: Texts with nulls, blanks, odd characters, ties and repeats; extra columns
#: carry names that the operators use themselves.
SCHEMA = "doc_id bigint, text string, id bigint, node bigint, kept boolean, digest string, component string, number bigint, bucket bigint"


@pytest.fixture
def awkward(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    long_text = " ".join(words[(i * i) % 24] + str(i % 97) for i in range(30_000))
    base = " ".join(words * 2)
    texts = [
        (1, base), (2, base), (3, base.upper()), (4, base + " one more"), (5, None), (6, ""), (7, " \t\n "), (8, "single"), (9, "Single"),
        (10, long_text), (11, long_text + " tail"), (12, "Été 漢字 \U0001f600 \x1c\xa0 don't"), (13, "a" * 5000), (None, base), (None, "only null id"),
        (14, "row listed twice"), (14, "row listed twice"), (15, "<|im_end|><|im_start|>"), (16, " ".join(reversed(words * 2))),
    ]
    return spark.createDataFrame([(i, t, -1, -1, False, "x", "y", 0, 0) for i, t in texts], SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
