"""The pipeline stage by stage on the smallest tables, and that nothing else needs this package."""

import os
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from palimpsest.llm import mixing, quality, toxicity
from palimpsest.llm.common import materialize, table
from palimpsest.llm.tokens import ids_from, tokenizer_path

from test_shingles import plain_groups


def test_stages(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    names = docs.columns
    predicted = {r.doc_id: r.predicted for r in quality.quality(docs, docs, labels).collect()}
    steps = dict(corpus_pipeline.STAGES)
    good = materialize(steps["quality"](spark, docs, data), "t")
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, p in predicted.items() if p)
    predicted = {r.doc_id: r.predicted for r in toxicity.toxicity(good, docs, labels).collect()}
    clean = materialize(steps["toxicity"](spark, good, data), "t")
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, p in predicted.items() if not p)
    rows = sorted((r.doc_id, r.text) for r in clean.collect())
    firsts = {rows[i][0] for i in plain_groups([t for _, t in rows]).values()}
    unique = materialize(steps["near_duplicates"](spark, clean, data), "t")
    assert sorted(r.doc_id for r in unique.collect()) == sorted(firsts)
    mixed = materialize(steps["mixing"](spark, unique, data), "t")
    assert good.columns == clean.columns == unique.columns == mixed.columns == names
    want = {r.doc_id: r.copies for r in mixing.mix(unique).collect() if r.copies}
    got: dict = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    total = sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    pieces = steps["packing"](spark, mixed, data).collect()
    assert sum(len(ids_from(bytes(r.ids))) for r in pieces) == total


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(out.columns)


def test_the_rest_stands_alone(tmp_path):
    root = Path(__file__).resolve().parents[2]
    for p in ("palimpsest", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(root / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "palimpsest" / "llm")], check=True)
    (tmp_path / "tests").mkdir()
    for p in ("conftest.py", "test_log_file.py", "test_encode.py"):
        subprocess.run(["cp", str(root / "tests" / p), str(tmp_path / "tests")], check=True)
    code = "import __spark_entry__ as e; n = set(e.queries()); assert n and not any(x.startswith('op') and x[2].isdigit() for x in n) and 'pipeline' not in n; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-m", "pytest", "-q", "tests"], cwd=tmp_path, env=env, check=True)
