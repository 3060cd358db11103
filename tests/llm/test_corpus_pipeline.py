"""The pipeline: each stage's decisions take effect on what the last one kept, and all but the last return documents."""

import random

import corpus_pipeline
from calltide.llm.common import DOCUMENT_COLUMNS
from test_corpus_operators import brute_components, brute_contamination, brute_fingerprint, brute_lines


def write_tables(spark, at, rng):
    words = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in "nrst"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = prose(30), "all rights are reserved by us"
    docs, marks = [], []
    for i in range(300):
        text = prose(120)
        toxic = i % 6 == 1
        if toxic:
            own = text.split()
            for _ in range(10):
                own[rng.randrange(len(own))] = rng.choice(["xylvok", "qezzig"])
            text = " ".join(own)
        if i % 10 == 2:
            text += "\n" + line
        if i % 50 == 3:
            text += " " + passage
        docs.append((i, text, "en", "s", len(text)))
        marks.append((i, 1, int(toxic)))
    docs += [(1000, docs[0][1], "en", "s", 1), (1001, docs[4][1] + " extra", "en", "s", 1), (1002, None, None, None, None), (1003, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, passage)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return docs, passage, line


def test_stages(spark, tmp_path):
    """Each stage's result from its own input, by brute force where the stage isn't a trained model."""
    at = f"file://{tmp_path}"
    docs, passage, line = write_tables(spark, at, random.Random(11))
    now, kept = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, at).cache()
        assert now.columns == DOCUMENT_COLUMNS
        kept[name] = {r["doc_id"]: r["text"] or "" for r in now.collect()}
    toxic = {i for i in range(300) if i % 6 == 1}
    assert len(toxic & set(kept["toxicity"])) <= 3
    assert len((set(range(300)) - toxic) - set(kept["toxicity"])) <= 3
    assert kept["line_dedup"] == {i: text for i, (_, _, text) in brute_lines(kept["toxicity"]).items()}
    assert sum(line in t for t in kept["line_dedup"].values()) == 1
    # 1000 copies the lines of 0, so it is empty by now, as 1002 and 1003 are: the smallest of them stands for all.
    assert [kept["line_dedup"][i] for i in (1000, 1002, 1003)] == [""] * 3
    smallest = brute_components({i: brute_fingerprint(t) for i, t in kept["line_dedup"].items()})
    assert kept["near_dedup"] == {i: t for i, t in kept["line_dedup"].items() if smallest[i] == i}
    assert sorted(kept["near_dedup"].keys() & {0, 1000, 1002, 1003}) == [0, 1000]
    hits = brute_contamination(kept["near_dedup"], [(0, passage)])
    assert kept["decontamination"] == {i: t for i, t in kept["near_dedup"].items() if not hits[i][1]}
    assert any(n for _, n, _ in hits.values())
    packed = corpus_pipeline.run(spark, at)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(kept["decontamination"])


def test_near_copies_leave_one(spark, tmp_path):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in "nrst"]
    own = [" ".join(rng.choice(words) for _ in range(600)) for _ in range(20)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(own)] + [(100 + i, t + " last", "en", "s", 1) for i, t in enumerate(own)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, rows, "").collect()}
    smallest = brute_components({i: brute_fingerprint(t) for i, t, *_ in docs})
    assert got == set(smallest.values())
    assert len(got) < len(docs)
