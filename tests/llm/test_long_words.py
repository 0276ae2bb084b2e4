"""Texts of one unbroken word each: a worker's tables stay small, whatever the words' length."""

import subprocess
import sys

from conftest import ROOT

SCRIPT = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np, pyarrow as pa, public_tokenizers as P
from viewlens.llm.{module}
rng = np.random.default_rng(1)
def texts():
    for _ in range(40):  # 400 words of 100 KB, in batches
        yield pa.array([bytes(rng.integers(97, 123, 100_000, np.uint8)).decode() for _ in range(10)])
def peak():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
{make}
before = peak()
for t in texts():
    {use}
print(peak() - before)
"""
CASES = {
    "codec": ("sentencepiece_codec import Codec", "c = Codec(P.path('piece_bpe_32k.model'))",
              "cut = c.cut(t); c.both_ways(cut.vocabulary)"),
    "byte level": ("byte_level import ByteLevel", "c = ByteLevel(P.path('byte_bpe_50k.json'))", "c.encode(t)"),
    "words": ("packing import Tokens", "c = Tokens(P.path('word_bpe_49k.json'))", "c.encode_all(t)"),
    "shingles": ("shingles import Shingler", "c = Shingler()", "[c.set_of(x) for x in t.to_pylist()]"),
}
# Megabytes that a worker may grow by: what a batch takes, not what all words do.
BOUND = 150


def test_unbroken_words_do_not_fill_a_worker():
    for name, (module, make, use) in CASES.items():
        code = SCRIPT.format(root=ROOT, module=module, make=make, use=use)
        out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
        assert out.returncode == 0, out.stderr
        assert float(out.stdout) < BOUND, (name, out.stdout)
