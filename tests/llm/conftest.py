import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[i]) for i in (0, 1, 2)]
