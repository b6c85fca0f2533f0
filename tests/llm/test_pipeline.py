"""Every stage against a plain version, on a small corpus with planted cases."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from caseweave.llm import byte_bpe, mixing, toxicity

INSULTS = ["idiot", "scoundrel", "rotter"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(11)
    word = lambda: "".join(random.choices(["ta", "re", "mi", "son", "lu", "ven"], k=random.randint(1, 4)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n // 12))
    rows, passage = [], " ".join(word() for _ in range(70))
    for i in range(300):
        body = text(random.choice([24, 60, 120]))
        if i % 6 == 0:
            body = body.replace(" ", f" {random.choice(INSULTS)} ", 1) + f" {random.choice(INSULTS)}"
        rows.append([i, body, "en" if i % 3 else "de", "big" if i % 2 else f"s{i % 5}", len(body)])
    for i in range(5):  # exact and near copies, and a passage that repeats
        rows.append([400 + i, rows[1][1], "en", "big", 1])
        rows.append([500 + i, rows[2][1].rsplit(" ", 1)[0] + f" {word()}x{i}", "en", "big", 1])
        rows.append([600 + i, f"{text(24)}\n{passage}\n{text(24)}", "en", "s1", 1])
    rows += [[700, None, None, None, None], [701, "", "en", "s1", 0], [None, "no id at all", "en", "s1", 12], [3, rows[3][1], *rows[3][2:]]]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_follow_each_other(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs.collect()
        before = {(r.doc_id, r.text): r for r in given}
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        rows = after.collect()
        seen.append(name)
        if name != "byte_bpe":
            assert after.columns == columns
        if name == "toxicity":
            kept = {r.doc_id for r in rows}
            assert not {i for i in range(0, 300, 6)} & kept and {i for i in range(300) if i % 6} <= kept and {None, 700, 701} <= kept
        if name == "line_dedup":
            assert len(rows) == docs.count()
            texts = {r.doc_id: r for r in rows}
            whole = {k[0]: k[1] for k in before}
            assert texts[600].text == whole[600] and texts[601].text == "\n".join(x for x in whole[601].split("\n") if len(x.split()) < 70)
            assert texts[601].n_chars == len(texts[601].text) and texts[4].n_chars == before[4, whole[4]].n_chars
        if name == "jaccard_join":
            sets = {k: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for k in before for w in [(k[1] or "").split()] if w}
            ids = {r.doc_id for r in rows}
            gone = {k for k in sets if k[0] is not None and any(o[0] is not None and o[0] < k[0] and 5 * len(sets[k] & sets[o]) >= 4 * len(sets[k] | sets[o]) for o in sets)}
            assert gone and not {k[0] for k in gone} & ids and {k[0] for k in before} - {k[0] for k in gone} == ids
        if name == "mixing":
            drawn = {(r.doc.doc_id, r.doc.text) for r in mixing.draw(docs, budget_share=corpus_pipeline.BUDGET_SHARE).filter("drawn").collect()}
            assert {(r.doc_id, r.text) for r in rows} == drawn and 0 < len(rows) < len(before)
        if name == "byte_bpe":
            ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
            plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            want = sorted(str((r.doc_id, plain.encode_ordinary(r.text or ""))) for r in given)
            assert sorted(str((r.doc_id, list(r.token_ids))) for r in rows) == want and all(r.n_tokens == len(r.token_ids) for r in rows)
        docs = after
    assert seen == ["toxicity", "line_dedup", "jaccard_join", "mixing", "byte_bpe"]


def test_empty_tables(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scorer_without_features():
    assert 0 < toxicity.Scorer().score({"any"}) < 0.3 and np.isfinite(toxicity.Scorer().score(set()))
