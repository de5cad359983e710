import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from conftest_llm import corpus, empty, odd  # noqa: E402, F401
