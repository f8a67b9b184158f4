"""The pipeline as a whole, on rows with nulls, empties, repeats and columns whose names clash."""

import base64
import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, words string, sum int, shard int, id int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Forty plain texts with a menu, copies, a near copy, a contaminated text and odd rows; no label is toxic."""
    at = str(tmp_path_factory.mktemp("sf"))
    passage = " ".join(f"bench{k}" for k in range(12))
    texts = [(k, "menu line\n" + " ".join(f"w{k}x{j}" for j in range(40))) for k in range(40)]
    texts += [(50, texts[3][1]), (51, texts[3][1] + " and"), (52, f"before {passage} after"), (60, None), (61, ""), (62, "\n \n"), (None, "no id here"), (7, texts[7][1])]
    rows = [(i, t, "en", "a", len(t or ""), 1, "w", 2, 3, 4) for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(60, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, texts


def test_pipeline(spark, folder):
    at, texts = folder
    got = sorted(((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, at).collect()), key=repr)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    code = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in [*texts[:40], (60, None), (61, ""), (62, "\n \n"), (None, "no id here")]:
        left = (t or "").removeprefix("menu line\n")
        ids = code.encode_ordinary(left)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder[0])
        assert docs.columns == columns, name
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dup", "decontaminate", "bpe"]


def test_pipeline_over_no_rows(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
