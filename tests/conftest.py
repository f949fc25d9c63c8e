import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from skein.session import local

    return local(4, 4, "4g")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not there")
    return SF


@pytest.fixture
def rows():
    """Sorted tuples of a DataFrame; None sorts first."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, str(v)) for v in r])
