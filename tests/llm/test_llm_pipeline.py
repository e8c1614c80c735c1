"""The pipeline's stages on a small corpus, in order, and its registration."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from test_llm_operators import prose, table  # noqa: E402


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    clean = [(i, prose(rng, 80).capitalize() + ".") for i in range(120)]
    copies = [(500 + i, clean[0][1]) for i in range(40)]
    junk = [(600 + i, " | ".join(prose(rng, 60).split())) for i in range(15)]
    item = prose(random.Random(77), 40)
    leaks = [(700, prose(rng, 60) + " " + item), (701, item)]
    secret = [(800, "Notes of today. password = hunter2222 " + prose(rng, 40))]
    words = clean[1][1].split()
    near = [(550 + i, " ".join(words[:k] + ["changed"] + words[k + 1 :])) for i, k in enumerate((3, 40, 77))]
    docs = table(spark, clean + copies + near + junk + leaks + secret + [(900, None), (901, "")])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns, ids = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    good = {i for i, _ in clean}
    assert good <= ids[-1] and not {600 + i for i in range(15)} & ids[0] and not {*range(500, 540), 550, 551, 552} & ids[1] and not {700, 701} & ids[2] and 800 in ids[-1]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/secrets").collect()}
    assert "hunter2222" not in texts[800] and texts[1] == clean[1][1]


def test_one_of_each_tells_rows_apart(spark):
    """Texts of one identifier or of none are documents like others: unlike ones stay, copies go."""
    rng = random.Random(4)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    docs = table(spark, [(1, a), (1, b), (2, b), (None, c), (None, c), (3, c), (None, d), (4, None), (4, None)])
    left = corpus_pipeline.one_of_each(spark, docs, "")
    assert left.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert sorted(t or "" for _, t in got) == sorted([a, b, c, d, ""]) and {(1, a), (2, b), (3, c), (None, d)} <= set(got)


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len([n for n in names if n.startswith("op")]) == 10 and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]
