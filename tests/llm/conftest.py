import pytest


@pytest.fixture(scope="session")
def llm(spark):
    """The session, with the package where Python workers can import it."""
    from feedweave.llm.queries import shipped

    shipped(spark)
    return spark
