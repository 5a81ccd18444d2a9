"""The stages of corpus_pipeline on a small table with nulls, empty and repeated texts, copies, shared passages and extra columns."""

import numpy as np

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, doc string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "k", "r", "d") for i, t, lang in rows], KIND)


def rows():
    rng = np.random.default_rng(4)
    words = {x: [f"{a}{b}{x}" for a in "bdfgklm" for b in "aeiou"] for x in ("in", "os")}
    out = []
    for i in range(60):
        x = "in" if i % 2 else "os"
        out.append((i, " ".join(rng.choice(words[x], 60)), x))
    passage = " ".join(f"p{i}in" for i in range(30))
    out += [(100 + i, f"{out[i][1]} {passage}", out[i][2]) for i in range(20, 24)]  # shared passage
    out += [(200, out[0][1].upper(), "os"), (201, out[1][1], "in")]  # exact copies
    near = out[2][1].split()
    out += [(300, " ".join([*near[:59], "changed"]), "os")]
    out += [(400, None, "in"), (401, "", None), (402, "123 456 !", "in"), (403, "é", None), (404, "x" * 5000, None)]
    return out


def test_each_stage_does_its_part(spark):
    docs = table(spark, rows())
    found, kept = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
        found[name] = kept = spark.createDataFrame(kept.collect(), kept.schema)
    ids = {n: {r["doc_id"] for r in df.collect()} for n, df in found.items()}
    before = {r[0] for r in rows()}
    assert before - ids["language_id"] == {400, 401, 402}
    assert ids["language_id"] - ids["exact_dedup"] == {0, 1}  # of equal texts the largest id stays
    assert ids["exact_dedup"] - ids["near_dedup"] == {300}
    # 120 to 123 repeat the texts of 20 to 23 with a passage behind them: the first keeps the passage, the others nothing
    assert ids["near_dedup"] - ids["substring_dedup"] == {121, 122, 123}
    texts = {r["doc_id"]: r["text"] for r in found["substring_dedup"].collect()}
    assert texts[120] == " ".join(f"p{i}in" for i in range(30)) and texts[20] == rows()[20][1]
    packed = found["best_fit_packing"].collect()
    assert {r["doc_id"] for r in packed} == ids["substring_dedup"]
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_empty_and_repeated_rows_pass_all_stages(spark):
    for given in ([], [(1, "some words of a text, said once", "in")] * 2 + [(2, "others", "in")]):
        kept = table(spark, given)
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, "")
            kept = spark.createDataFrame(kept.collect(), kept.schema)
        assert kept.count() == len(given)
