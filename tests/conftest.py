import pytest

from quillspark.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4, shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def small():
    return SMALL
