import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from textloom.operators.vocabulary import Vocabulary  # noqa: E402
from textloom.session import local_session, ship_package  # noqa: E402

TOKENS = (
    ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "<s>", "</s>", "[unused0]", "[unused1]"]
    + ["That", "lit", "##tle", "blue", "tru", "##ck", "red", "boa", "##t", "the", ".", ",", "漢", "a", "##a", "b", "##b"]
)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session


@pytest.fixture(scope="session")
def vocab():
    return Vocabulary(TOKENS, {t: i for i, t in enumerate(TOKENS)})


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate expressions on a single row."""

    def run(*columns):
        return spark.range(1).select(*columns).first()

    return run
