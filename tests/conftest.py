import os
import sys
from pathlib import Path

import pytest

# The replay of whole published tables needs their folder; the typed-in rows are always tested.
collect_ignore = [] if os.environ.get("FORUM_PUBLISHED_RESULTS") else ["test_published_results.py"]
ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])  # for the Python workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from forum_signals.session import local_session

    session = local_session(
        "*", app="forum-signals-tests", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
