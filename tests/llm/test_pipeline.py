"""The pipeline against a plain version of all its stages on a small corpus."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from meetloom.llm import packing

from .test_dedup import brute_components, brute_sets, lower


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_stages_keep_columns(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def md5(s: str) -> str:
    return hashlib.md5(s.encode()).hexdigest()


def plain_run(rows: list[tuple]) -> Counter:
    """All stages (no labels, so nothing is toxic) in Python."""
    from tokenizers import Tokenizer

    best: dict[str, tuple] = {}
    for r in rows:
        key = lower(r[1])
        if key not in best or (-1 if r[0] is None else r[0]) > (-1 if best[key][0] is None else best[key][0]):
            best[key] = r
    left = list(best.values())
    component = brute_components(brute_sets(left))
    left = [r for r in left if r[0] is None or component[r[0]] == r[0]]
    sizes = Counter(r[3] for r in left)
    shares = {s: n**0.5 for s, n in sizes.items()}
    mixed = []
    for r in left:
        rate = shares[r[3]] * len(left) / sum(shares.values()) / sizes[r[3]]
        u = (int(md5(":".join(["mix-1", "" if r[0] is None else str(r[0]), md5(r[1] or "")]))[:13], 16) + 0.5) / 2**52
        copies, term, total = 0, math.exp(-rate), math.exp(-rate)
        while total < u:
            copies += 1
            term *= rate / copies
            total += term
        mixed += [r] * copies
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces, at = Counter(), 0
    for r in sorted(mixed, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        start = 0
        while start < len(ids):
            n = min(2048 - at % 2048, len(ids) - start)
            crc = zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
            pieces[r[0], start, n, crc, len(ids), at // 2048, at % 2048] += 1
            at, start = at + n, start + n
    return pieces


def test_run_against_plain_version(spark, docs, corpus, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == plain_run(corpus)


def test_run_on_very_long_texts(spark, tmp_path):
    """Texts of a megabyte and more: prose, one word, white space, and runs that end tiktoken's pattern matcher."""
    rng = np.random.default_rng(1)
    prose = " ".join(f"w{i}" for i in rng.integers(0, 50_000, 200_000))
    texts = [prose, prose + " end", prose.upper(), "x" * 1_000_000, " " * 600_000, "a" + " \n" * 400_000 + "b", "\t" * 700_000, "plain text of some words", None]
    rows = [(i, t, "en", "s" if i % 2 else "r", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == plain_run(rows)


def test_run_on_nothing_and_more_columns(spark, docs, no_docs, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, table in (("none", no_docs), ("more", docs.selectExpr("*", "doc_id AS rate", "text AS copy_no"))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/more").count() > 0


def test_stage_tables_go(spark, docs, tmp_path):
    import os

    from meetloom.llm.common import remove_table, shared_folder, stage_table

    table = stage_table(docs, "gone")
    folder = shared_folder(spark).removeprefix("file:")
    assert any(f.startswith("gone-") for f in os.listdir(folder))
    remove_table(table)
    assert not any(f.startswith("gone-") for f in os.listdir(folder))


def test_toxic_documents_go(spark, tmp_path):
    from .test_models import labelled

    docs, labels = labelled(spark, "toxic")
    docs = docs.withColumnRenamed("score", "n_chars")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    left = {r.doc_id for r in corpus_pipeline.without_toxic(spark, docs, str(tmp_path)).collect()}
    toxic = {i for i in range(700) if i % 4 == 0}
    assert len(toxic & left) <= 5
    assert len(set(range(700)) - toxic - left) <= 5
