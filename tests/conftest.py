import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([sys.path[0], *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")

from kinelake.session import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session("local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__driver__host="127.0.0.1")


@pytest.fixture(scope="session")
def sf():
    return SF
