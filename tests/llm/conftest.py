import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from samples import SAMPLES  # noqa: E402
from textloom.llm.language import LanguageModel  # noqa: E402

@pytest.fixture(scope="session")
def model():
    return LanguageModel.of_texts({k: [v] for k, v in SAMPLES.items()})
