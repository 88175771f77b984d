import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lintlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", app="tests", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()


SAMPLE = '''"""A small service."""
import shelve
import requests
from web import App, incoming as inc

service = App(name)

# Check one: runs a tool
@service.route('/lookup')
def lookup():
    return shelve.open(inc.args)

# Check two: fixed login
ADMIN = 'root'
SECRET_WORD = 'hunter2'

@service.route('/enter')
def enter(a: int, b=None, *rest) -> str:
    import pickle
    if a == ADMIN:
        return SECRET_WORD

class Box:
    def size(self):
        def inner():
            return 1
        return inner

async def later():
    return requests

if __name__ == '__main__':
    service.run()
'''


@pytest.fixture(scope="session")
def sample():
    return SAMPLE
