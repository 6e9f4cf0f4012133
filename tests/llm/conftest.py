import pytest


@pytest.fixture(autouse=True)
def _text_settings(spark):
    from netloom.llm.common import prepare

    prepare(spark)
