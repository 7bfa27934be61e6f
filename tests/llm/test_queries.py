"""The registered queries and the pipeline over the smallest tables, against brute force."""

from __future__ import annotations

import hashlib
import zlib

import brute
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from gridlake.llm import queries


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def result(spark):
    done = {}

    def run(name):
        if name not in done:
            done[name] = {r[0]: r for r in queries.QUERIES[name](spark, SF).collect()}
        return done[name]

    return run


def test_every_operator_has_a_query():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))


def test_tokens(result, docs):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(queries.PIECE_MODEL))
    got = result("op1_sentencepiece")
    assert all(got[i].ids == lib.encode(t or "") and got[i].n_tokens == len(got[i].ids) and got[i].round_trip for i, t in docs)


def test_quality(result, docs):
    got = result("op2_quality_rules")
    assert all(tuple(got[i])[1:7] == brute.quality_base(t) for i, t in docs)
    assert not any(r.kept and r.base_failed for r in got.values())


def test_shards(result, docs):
    got = result("op3_sharding")
    assert all(got[i].size == len((t or "").encode()) + 8 and got[i].text_crc32 == zlib.crc32((t or "").encode()) for i, t in docs)
    assert {r.law for r in got.values()} == {"rows"} and {r.grown_shard for r in got.values()} == {None}


def test_benchmark(result, docs, spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = result("op4_decontamination")
    for (i, _), (n, hit, found) in zip(docs, brute.decontaminated([t for _, t in docs], items)):
        assert tuple(got[i])[1:] == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0)


def test_secrets(result, docs):
    got = result("op5_secret_scan")
    for i, t in docs:
        spans = brute.base_spans(t)
        assert got[i].base_sha256 == brute.digest(spans)
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]


def test_lines(result, docs):
    got = result("op6_line_dedup")
    assert [got[i].text for i, _ in docs] == brute.dedup_lines([t for _, t in docs])


def test_the_token_query_reads_and_fills_a_cache(spark, docs, tmp_path):
    """Misses are stored below the checkpoint folder, and what is stored is not counted again."""
    from pathlib import Path

    from gridlake.llm import token_counts
    from gridlake.session import ensure_checkpoint_dir

    distinct = len({t or "" for _, t in docs})
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("token_counts-*"))
    expected = sorted(map(tuple, queries.op9_token_counts(spark, SF).collect()))
    new, = set(folder.glob("token_counts-*")) - before
    stored = spark.read.parquet(str(new))
    assert stored.count() == distinct and {r.tokenizer for r in stored.collect()} == {token_counts.tokenizer_digest(queries.TOKENIZER)}
    spark.conf.set("spark.gridlake.tokenCache", str(tmp_path / "cache"))
    try:
        held = stored.withColumn("n_tokens", F.col("n_tokens") + 1_000_000)
        held.withColumn("tokenizer", F.lit("another")).union(held.filter("n_tokens % 2 = 0")).write.parquet(str(tmp_path / "cache"))
        even = stored.filter("n_tokens % 2 = 0").count()
        for _ in range(2):
            got = sorted(map(tuple, queries.op9_token_counts(spark, SF).collect()))
            assert [g[2] for g in got] == [e[2] + 1_000_000 * (e[2] % 2 == 0) for e in expected]  # hits come from the cache, misses are counted
            assert spark.read.parquet(str(tmp_path / "cache")).count() == distinct + even + (distinct - even)
    finally:
        spark.conf.unset("spark.gridlake.tokenCache")


def test_pages(result, spark):
    import html
    import re

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        lines = re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:h1|p)>", "\n", article))).split("\n")
        text = "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in lines) if x)
        assert tuple(result("op7_html_extraction")[r.page_id])[2:] == (text, len(text))


def test_scores(result, docs):
    from gridlake.llm import lm_score

    got = result("op8_lm_score")
    for (i, _), e in zip(docs, brute.lm_scores(docs, lm_score.MASS)):
        assert tuple(got[i])[1:5] == e[:4] and tuple(got[i])[5:] == pytest.approx(e[4:], abs=1e-6)


def test_counts(result, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    for i, t in docs:
        n = len(lib.encode(t or "", add_special_tokens=False))
        assert tuple(result("op9_token_counts")[i])[1:] == (len((t or "").encode()), n, n > queries.TOKEN_LIMIT)


def test_near_duplicates(result, docs):
    got = result("op10_jaccard_join")
    assert {tuple(r) for r in got.values()} == set(brute.components(docs))


def test_pipeline(spark, docs, tmp_path):
    """Each stage against brute force on its own input."""
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = frame.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before = sorted((r.doc_id, r.text) for r in frame.collect())
        if name == "sentencepiece":
            assert sorted(r.doc_id for r in out.collect()) == [i for i, _ in before] and out.filter("not round_trip").isEmpty()
            kept.append(out.count())
            break
        assert out.columns == columns and out.filter(F.col("n_chars") != F.length("text")).isEmpty()
        after = sorted((r.doc_id, r.text) for r in out.collect())
        if name == "quality_rules":
            assert set(after) <= set(before) and not any(brute.quality_base(t)[-1] for _, t in after)
        elif name == "line_dedup":
            assert after == [(i, t) for (i, _), t in zip(before, brute.dedup_lines([t for _, t in before]))]
        elif name == "jaccard_join":
            stay = {c for _, n, c in brute.components(before) if n} | {i for i, n, _ in brute.components(before) if not n}
            assert after == [(i, t) for i, t in before if i in stay]
        else:
            hits = brute.decontaminated([t for _, t in before], items)
            assert after == [r for r, (_, h, _) in zip(before, hits) if not h]
        kept.append(len(after))
        frame = out
    assert corpus_pipeline.run(spark, SF).count() == kept[-1] and kept[0] < len(docs)


def test_stages_stand_odd_rows(spark):
    import samples

    docs = spark.createDataFrame(samples.documents(), samples.SCHEMA).withColumn("key", F.lit("k")).withColumn("row", F.lit(1))
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            if name == "line_dedup":
                assert out.count() == rows.count()
            if name != "sentencepiece":
                assert out.columns == docs.columns
            out.count()
