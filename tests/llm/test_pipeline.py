"""The pipeline on planted cases, stage by stage, and without its folders."""

from __future__ import annotations

import os
import random
import shutil
import subprocess
import sys

import corpus_pipeline
from slotwatch.llm.common import stage
from slotwatch.llm.mixing import mix

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_planted_cases(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: rng.choice("bcdfghjk") + rng.choice("aeiou") + rng.choice("lmnrst") + rng.choice("aeiou")
    text = lambda n: [word() for _ in range(n)]
    items = [text(n) for n in (12, 30, 45)]
    docs, toxic, copies, leaks, pii = {}, set(), set(), set(), set()
    for i in range(600):
        w = text(rng.randint(20, 90))
        if i % 5 == 1:
            toxic.add(i)
            for bad in ("zugvex", "zugvex", "qwarn"):
                w.insert(rng.randrange(len(w)), bad)
        elif i % 50 == 2:
            leaks.add(i)
            w[7:7] = items[i // 50 % 3]
        elif i % 50 == 3:
            pii.add(i)
            w[4:4] = ["me@site.org"]
        docs[i] = " ".join(w)
    for i in range(40):  # exact and near copies of clean documents
        source = docs[5 * i].split()
        if i % 2:
            source[len(source) // 2] = "changed"
        docs[1000 + i] = " ".join(source)
        copies.add(1000 + i)
    long = {d for d in copies if len(docs[d].split()) >= 60 or d % 2 == 0}  # one changed word leaves 0.75 or more
    sf = str(tmp_path / "sf")
    row = lambda d, t: (d, t, "xx", f"s{(d or 0) % 4}", len(t) if t is not None else None, 1.0, 7)
    rows = [row(d, t) for d, t in docs.items()] + [row(2000, None), row(2001, ""), row(None, "a row without an id")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, mix_copies int"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    labels = [(d, 0, int(d in toxic)) for d in range(600)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    kept = set(docs) | {2000, 2001, None}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for name, make in corpus_pipeline.STAGES:
        before, frame = frame, stage(make(spark, frame, sf), f"test-{name}")
        got = ids(frame)
        if name == "toxicity":
            assert got == kept - toxic
        elif name == "near_dups":
            assert got <= kept - toxic - long and kept - toxic - copies <= got
        elif name == "decontaminate":
            assert got == ids(before) - leaks
        elif name == "pii":
            texts = {r.doc_id: r for r in frame.collect()}
            assert got == ids(before)
            assert all(("<EMAIL>" in (texts[d].text or "")) == (d in pii) for d in got)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in texts.values())
        else:
            taken = {r.doc_id: r.copies for r in mix(before).collect() if r.copies}
            assert {r.doc_id: r.mix_copies for r in frame.collect()} == taken
        assert frame.columns == before.columns
    assert ids(corpus_pipeline.run(spark, sf)) == ids(frame)


def test_the_rest_works_without_these_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(copy / "slotwatch" / "llm")
    shutil.rmtree(copy / "tests" / "llm")
    os.remove(copy / "corpus_pipeline.py")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'slots' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
