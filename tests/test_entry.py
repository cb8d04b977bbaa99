"""The driver contract holds whatever the optional part misses."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def keys_without(*modules):
    hide = "".join(f"sys.modules[{m!r}] = None; " for m in modules)
    code = f"import sys, warnings; warnings.simplefilter('ignore'); {hide}import __spark_entry__ as e; print(' '.join(e.queries()), '|', ' '.join(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout
    names, twins = out.strip().splitlines()[-1].split("|")
    return set(names.split()), set(twins.split())


def test_core_queries_load_when_a_dependency_or_the_subpackage_is_missing():
    names, twins = keys_without("spendgrid.llm", "corpus_pipeline")
    core = {n for n in names if not n.startswith("op")}
    assert names == core and len(core) >= 136 and len(twins) >= 126 and twins <= core
    for missing in ("xxhash", "zstandard", "public_tokenizers", "sentencepiece", "spendgrid.llm.queries", "corpus_pipeline"):
        found, _ = keys_without(missing)
        assert core <= found, missing
