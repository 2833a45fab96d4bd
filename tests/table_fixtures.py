"""Table folders and small helpers of the tests (a module of its own name: ``conftest``
is also the name of the one in ``tests/llm``)."""

import datetime as dt

SF_SMOKE = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


def ts(s):
    return dt.datetime.fromisoformat(s)
