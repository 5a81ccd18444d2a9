"""Odd input of every operator: empty tables, nulls, repeated rows and ids, ties, long and hostile texts, extra columns."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barquarry.llm import exact_dedup, html_extraction, language_id, near_dedup, packing, sentencepiece_fst, substring_dedup, topk, toxicity, warc
from barquarry.llm.queries import vocabulary
from barquarry.llm.words import SECOND, spans, words

DOC = "doc_id long, text string, row string, key string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOC)


def twins(levels):
    """Two different words of 2 ** levels letters that every polynomial modulo 2 ** 64 with an odd base takes for one, from 1024 letters on."""
    a = [bin(i).count("1") % 2 for i in range(2**levels)]
    return "".join("ab"[x] for x in a), "".join("ba"[x] for x in a)


def test_word_hashes_tell_the_twins_apart():
    x, y = twins(11)
    w = words(pa.array([f"{x} {y} {x}"]))
    assert w.hash[0] != w.hash[1] and w.hash[0] == w.hash[2]
    assert w.second()[0] != w.second()[1] and w.second()[0] == w.second()[2] and w.second()[0] != w.hash[0]


def test_spans_do_not_depend_on_what_stands_around_them():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 700_000, np.uint8)
    cuts = np.unique(rng.integers(0, len(data), 4000))
    cuts = cuts[(cuts < 100_000) | (cuts > 600_000)]  # one span is longer than a slab
    whole = spans(data, cuts[:-1], cuts[1:])
    for i in [*range(0, len(cuts) - 1, 97), int(np.diff(cuts).argmax())]:
        own = data[cuts[i] : cuts[i + 1]]
        assert whole[i] == spans(own, np.array([0]), np.array([len(own)]))[0]
        assert spans(own, np.array([0]), np.array([len(own)]), seed=SECOND)[0] != whole[i]


def test_grams_are_equal_just_where_the_words_are():
    rng = np.random.default_rng(1)
    text = [str(x) for x in rng.integers(0, 2, 3000)]
    w = words(pa.array([" ".join(text), " ".join(text[::-1])]))
    flat = [*text, *text[::-1]]
    for n in (1, 2, 3, 5, 8, 20):
        h, whole = w.grams(n)
        seen = {}
        for i in np.flatnonzero(whole):
            assert seen.setdefault(tuple(flat[i : i + n]), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)


def test_substring_and_packing_tell_the_twins_apart(spark):
    x, y = twins(11)
    tail = " ".join(f"w{i}" for i in range(19))
    two = docs(spark, [(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{x} {tail}")])
    got = {r["row"]["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(two).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
    path = vocabulary("word_bpe_49k.json")
    tokenizer = packing.WordIds(path).tokenizer
    column = pa.array([x, y, f"{x} {y}"])
    flat, begin = packing.token_ids(column, path)
    for text, a, b in zip(column.to_pylist(), begin, begin[1:]):
        assert flat[a:b].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_that_share_a_hash_get_their_own_ids():
    class Lengths(packing.Known):
        def encode(self, surfaces):
            return np.array([len(x) for x in surfaces], np.int32), np.ones(len(surfaces), np.int64)

    known, data = Lengths(), np.frombuffer(b"aa bbb aa", np.uint8)
    start, end = np.array([0, 3, 7]), np.array([2, 6, 9])
    text = lambda i: "x" * int(end[i] - start[i])
    for keys in ([7, 8, 7], [7, 7, 7], [8, 8, 8]):
        assert known.look_up(data, start, end, np.array(keys, np.uint64), data, text)[0].tolist() == [2, 3, 2]


def test_tokenizers_that_need_whole_texts_get_them():
    path = vocabulary("byte_bpe_50k.json")
    known = packing.WordIds(path)
    assert not known.apart and packing.WordIds(vocabulary("word_bpe_49k.json")).apart
    column = pa.array(["It's  A test;of\nsigns, and CASE", "", None])
    flat, begin = packing.token_ids(column, path)
    assert flat[: begin[1]].tolist() == known.tokenizer.encode(column[0].as_py(), add_special_tokens=False).ids and begin[1:].tolist() == [begin[1]] * 3


EMPTY = {
    "exact": lambda d: exact_dedup.exact_dedup(d),
    "near": lambda d: near_dedup.near_dedup(d),
    "substring": lambda d: substring_dedup.substring_dedup(d),
    "language": lambda d: language_id.predict(d, language_id.train(d.withColumn("lang", F.lit("x")))),
    "packing": lambda d: packing.pack(d, vocabulary("word_bpe_49k.json")),
    "pieces": lambda d: sentencepiece_fst.encode_documents(d, sentencepiece_fst.Transducer(vocabulary("piece_bpe_32k.model"))),
    "toxicity": lambda d: toxicity.predict(d, toxicity.train(d, d.select("doc_id", F.lit(1).alias("toxic")), ["toxic"])),
    "pages": lambda d: html_extraction.extract(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("row").alias("url"))),
    "warc": lambda d: warc.round_trip(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("row").alias("url"))),
    "topk": lambda d: topk.search(d.select(F.col("doc_id").alias("vec_id"), F.expr("cast(array() as array<float>)").alias("embedding")), F.lit(True)),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables_give_empty_results(spark, name):
    assert EMPTY[name](docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["exact", "near", "substring", "language", "packing", "pieces", "toxicity", "pages"])
def test_nulls_repeated_rows_and_long_texts_all_come_back(spark, name):
    rows = [(1, "some words that are here, and here " * 3), (1, "some words that are here, and here " * 3), (2, None), (3, ""), (None, "no id at all"), (None, None), (4, "x" * 300_000), (5, "the same words again and again " * 20_000)]
    out = EMPTY[name](docs(spark, rows)).collect()
    got = [(r["row"] if "row" in r.asDict() else r)[{"pages": "page_id"}.get(name, "doc_id")] for r in out]
    if name == "packing":
        assert set(got) == {None, 1, 2, 3, 4, 5} and sum(r["piece"] == 0 for r in out) == len(rows)
    else:
        assert sorted(got, key=str) == sorted((i for i, _ in rows), key=str)


def test_near_dedup_of_texts_that_share_an_id(spark):
    base = [f"v{i}" for i in range(80)]
    near = [*base[:79], "other"]
    rows = [(3, " ".join(base)), (5, " ".join(near)), (5, "quite another text of seven words"), (6, None), (None, "a b c d e f"), (7, " ".join(base)), (7, " ".join(base))]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(docs(spark, rows)).collect() if r["doc_id"] is not None)
    assert got == [(3, 76, 3, True), (5, 2, 5, True), (5, 76, 3, False), (6, 0, 6, True), (7, 76, 3, False), (7, 76, 3, False)]


def test_a_long_text_is_labelled_as_a_whole():
    rng = np.random.default_rng(2)
    model = language_id.Model(["a", "b", "c"])
    model.weights = rng.normal(size=model.weights.shape).astype(np.float32)
    model.transitions = rng.normal(size=(3, 3))
    text = " ".join("".join(rng.choice(list("abcdefg é1"), 7)) for _ in range(4000))
    known = language_id.Scores(model)
    post, _, lettered = model.label(pa.array([text]), known)
    parts = [*model.label_long(np.frombuffer(text.encode(), np.uint8), language_id.Scores(model), 3000)]
    assert len(parts) > 5
    assert np.allclose(np.concatenate([p for p, _ in parts]), post, atol=1e-9) and np.array_equal(np.concatenate([x for _, x in parts]), lettered)


def test_an_index_is_reopened_where_it_was_left(spark, tmp_path):
    line = " ".join(f"w{i}" for i in range(30))
    path = str(tmp_path / "index")
    removed = []
    for k in range(5):
        index = substring_dedup.FingerprintIndex(spark, path, shards=4, fanout=2)
        removed.append([r["n_removed"] for r in index.ingest(docs(spark, [(k, f"{line} own{k}")])).collect()])
        assert 1 <= len(index.runs) <= 2
    assert removed == [[0], [30], [30], [30], [30]]
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark, path, window=10)


HOSTILE = {
    "open tags": "<a" * 50_000, "odd quotes": '<a "' * 25_000 + ">x", "open values": '<a ="' * 20_000 + "> text", "nested": "<blockquote>x," * 8_000, "stray ends": "<div>" * 4_000 + "</section>" * 10_000,
    "half comments": "<!--" * 25_000, "open apostrophes": "<a b='" * 20_000, "named": "<div>" + '<div class="share">x</div>' * 4_000 + "</div>", "less than": "a < b " * 20_000, "lists": "<ul>" * 3_000 + "<li>x" * 9_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_html_takes_time_in_proportion(name):
    began = time.process_time()
    html_extraction.main_text(HOSTILE[name])
    assert time.process_time() - began < 2  # a tenth of a second here; minutes if it grew with the square


def test_html_of_odd_pages():
    text = "A sentence, and one more, with enough words to count as text. " * 4
    page = lambda body: html_extraction.main_text(f"<html><body>{body}</body></html>")
    assert page(f"<form><p>{text}</p></form>") == text.strip()
    for name in ("share-price", "promotion-news", "footer-note"):
        assert text.strip() in page(f"<article><p>First, the head.</p><div class='{name}'><p>{text}</p></div></article>")
    assert "tweet" not in page(f"<article><p>{text}</p><div class='share-buttons'>tweet this</div></article>")
    assert page(f"<article><p>{text}<a title=\"it's 5\" tall\">x</a></p></article>") == f"{text}x"
    assert page(f"<article><p>{text}R&amp<b>;x</b></p></article>").endswith("R&;x")


def points(node):
    """Readability points by plain recursion: (total of every element, its text, its linked text)."""
    out = {}

    def walk(x, ancestors):
        text = "".join(walk(c, [*ancestors, x]) if not isinstance(c, str) else c.strip() for c in x.children)
        if x.name == "p" and text:
            worth = (1 + text.count(",") + min(len(text) / 100, 3)) * min(1, len(text) / 25)
            for a, share in zip([a for a in reversed(ancestors) if a.name not in ("#root", "html")], (1, 2, 6, 9, 12)):
                out[a] = out.get(a, 0) + worth / share
        return text

    walk(node, [])
    return out


def test_html_points_against_plain_recursion():
    rng = np.random.default_rng(5)
    for _ in range(60):
        parts, depth = [], 0
        for _ in range(25):
            k = rng.integers(4)
            if k == 0 and depth < 7:
                parts.append("<div>")
                depth += 1
            elif k == 1 and depth:
                parts.append("</div>")
                depth -= 1
            else:
                parts.append(f"<p>{'word, ' * int(rng.integers(0, 5))}{'x' * int(rng.integers(0, 200))}</p>")
        root = html_extraction.parse("<html><body>" + "".join(parts))
        nodes = html_extraction._ordered(root)
        html_extraction._score(nodes)
        expected = points(root)
        for node in nodes:
            assert node.points == pytest.approx(expected.get(node, 0))
