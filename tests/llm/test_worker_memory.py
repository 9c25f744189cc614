import subprocess
import sys
from pathlib import Path

CODE = """
import pyarrow as pa
from platelens.llm import packing
from platelens.llm.common import release_memory
from platelens.llm.queries import tokenizer_path

def mb():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

def load():
    encoder = packing.WordEncoder(tokenizer_path())
    release_memory()
    before = mb()
    for k in range(16):
        encoder.encode_array(pa.array([" ".join(f"w{chr(97 + k)}{i:x}z" for i in range(j * 200, j * 200 + 200)) for j in range(100)]), 2)
    return before, mb(), len(encoder.parts)

before, full, parts = load()
release_memory()
print(parts, full - before, mb() - before)
"""


def test_a_worker_gives_back_the_encoders_memory():
    """320,000 distinct words: the memory holds a bounded number of them, and a worker keeps nothing for later stages."""
    root = str(Path(__file__).resolve().parent.parent.parent)
    out = subprocess.run([sys.executable, "-c", CODE], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    parts, grown, kept = int(out[-3]), float(out[-2]), float(out[-1])
    assert parts < 200_000 and kept < 20
