import hashlib
import itertools
import os
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barquarry.llm import exact_dedup, html_extraction, language_id, near_dedup, packing, sentencepiece_fst, storage, substring_dedup, topk, toxicity, warc
from barquarry.llm.queries import vocabulary
from barquarry.llm.words import words

DOC = "doc_id long, text string, row string, key string"  # extra columns with clashing names
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "x", "y") for i, t in enumerate(texts)], DOC)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def corpus(n=60, seed=3):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = [" ".join(rng.choice(vocab, rng.integers(3, 120))) for _ in range(n)]
    for i in range(0, n, 4):  # near copies, and a passage that many share
        t = out[i].split()
        t[len(t) // 2] = "changed"
        out.append(" ".join(t))
    shared = " ".join(rng.choice(vocab, 60))
    out += [f"{x} {shared} {y}" for x, y in zip(out[:8], out[8:16])]
    return out + [None, "", " \t\n", "a b", "A  B", out[0].upper(), out[0], "é́ ü", "x " * 5000]


def test_words_match_pattern():
    texts = corpus() + ["\x0b\x0ca\x1cb", "日本 語"]
    w = words(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        s = slice(w.first[i], w.first[i + 1])
        assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start[s], w.end[s])] == WORD.findall(t or "")


def test_exact_dedup(spark):
    texts = corpus()
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(low(t), []).append(i)
    for hashed in (exact_dedup.content_hash, lambda t: F.lit(b"same")):  # the second makes every two texts collide
        for r in exact_dedup.exact_dedup(docs(spark, texts), hashed=hashed).collect():
            own = want[low(texts[r["doc_id"]])]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
            assert r["text_sha256"] == hashlib.sha256(low(texts[r["doc_id"]]).encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (3, "A"), (None, "b")], "doc_id long, text string")
    assert sorted((r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(nulls).collect()) == [(1, True), (2, False), (2, True)]


def removed(texts, window=20):
    seen, out = set(), []
    for t in texts:
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - window + 1):
            g = tuple(w[s : s + window])
            if g in seen:
                gone.update(range(s, s + window))
            seen.add(g)
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def test_substring_dedup(spark):
    texts = corpus()
    got = substring_dedup.substring_dedup(docs(spark, texts).repartition(3)).collect()
    want = removed(texts)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["row"]["doc_id"]]
    assert substring_dedup.substring_dedup(docs(spark, [])).count() == 0


def shard(n_docs: int, n_words: int, kinds: int, pieces: int = 4) -> pa.Table:
    """Runs of one shard, cut from texts of random words."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, kinds, n_words)) for _ in range(n_docs)]
    texts = [t if i % 3 else f"{t} {texts[i // 2]}" for i, t in enumerate(texts)]
    ids = np.array_split(np.arange(n_docs), pieces)
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(own), "key": pa.array(own), "text": [texts[i] for i in own]}) for own in ids]
    return pa.Table.from_batches(list(substring_dedup.cut_runs(1)(iter(batches))))


def test_a_shard_merges_alike_in_one_range_of_anchors_and_in_many():
    table = shard(60, 100, 1000)
    said = []
    for size in (1 << 30, 50, 1):
        out = substring_dedup.merge_shard(1, True, size)(table)
        rows = out.to_pylist()
        gone = {(k, s + i) for r in rows if r["kind"] == substring_dedup._ANSWER for k, s, n in np.frombuffer(r["seg"], substring_dedup._HIT).tolist() for i in range(n)}
        kept = sorted(x for r in rows if r["kind"] == substring_dedup._RUN for x in np.frombuffer(r["win"], np.uint64).tolist())
        said.append((gone, kept))
        # what replaces the old runs is merged again with them: nothing is new, all of it is found
        again = pa.concat_tables([out.filter(pa.array([r["kind"] == substring_dedup._RUN for r in rows])), table])
        found = [r for r in substring_dedup.merge_shard(1, True, size)(again).to_pylist() if r["kind"] == substring_dedup._RUN]
        assert sorted(x for r in found for x in np.frombuffer(r["win"], np.uint64).tolist()) == kept
    assert said[0] == said[1] == said[2] and len(said[0][0]) > 1000


def test_a_worker_holds_little_more_than_the_shard_it_merges():
    table = shard(3000, 300, 1 << 20)
    merge = substring_dedup.merge_shard(1, False, 1 << 15)
    tracemalloc.start()
    try:
        merge(table)
        assert tracemalloc.get_traced_memory()[1] < 3 * table.nbytes  # all windows' columns at once took over 8 times the shard
    finally:
        tracemalloc.stop()


def test_arrow_batches_are_bounded_by_bytes(spark):
    storage.small_batches(spark)
    long = spark.range(0, 100, 1, 1).select(F.lit(1).alias("g"), F.repeat(F.lit("x"), 200_000).alias("text"))
    sizes = long.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    groups = long.groupBy("g").applyInArrow(lambda t: pa.table({"n": [b.nbytes for b in t.to_batches()]}), "n long").collect()
    for found in (sizes, groups):  # all 20 MB came at once before
        assert sum(r["n"] for r in found) > 20_000_000 and max(r["n"] for r in found) < 1 << 23


def test_windows_of_one_anchor_are_told_apart_by_64_bits():
    def batch(i, text):
        return pa.RecordBatch.from_pydict({"doc_id": pa.array([i], pa.int64()), "key": pa.array([i], pa.int64()), "text": [text]})

    run = substring_dedup.cut_runs(1)
    tables = [t for i in range(2) for t in run(iter([batch(i, " ".join(f"w{j}" for j in range(20 + i)))]))]
    merge = substring_dedup.merge_shard(1, True)
    table = pa.Table.from_batches(tables)
    seg, win = (table.column(c).to_pylist() for c in ("seg", "win"))
    assert [len(w) for w in win] == [8 * sum(np.frombuffer(s, substring_dedup._SEG)["n"]) for s in seg]
    hits = [np.frombuffer(s, substring_dedup._HIT).tolist() for k, s in zip(*(merge(table).column(c).to_pylist() for c in ("kind", "seg"))) if k == substring_dedup._ANSWER]
    assert hits == [[(1, 0, 1)]]
    # the second document's copy differs in the upper half of the hash only: a 32-bit hash called that a repeat
    other = np.frombuffer(win[1], np.uint64) ^ np.uint64(1 << 40)
    table = table.set_column(table.column_names.index("win"), "win", pa.array([win[0], other.tobytes()], pa.binary()))
    out = merge(table)
    assert substring_dedup._ANSWER not in out.column("kind").to_pylist()
    assert sum(len(w) for w in out.column("win").to_pylist()) == 8 * 3


def test_index_over_batches_equals_one_batch(spark, tmp_path):
    texts = corpus()
    index = substring_dedup.FingerprintIndex(spark, str(tmp_path), shards=4, fanout=2)
    got = {}
    for a in range(0, len(texts), 20):
        for r in index.ingest(docs(spark, texts[a : a + 20], a)).collect():
            got[r["row"]["doc_id"]] = (r["n_words"], r["n_removed"], r["kept_sha256"])
    assert len(index.runs) <= 3
    assert [got[i] for i in range(len(texts))] == removed(texts)


def sets(texts):
    out = []
    for t in texts:
        w = WORD.findall(low(t))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    return out


def test_near_dedup(spark):
    texts = corpus()
    rng = np.random.default_rng(9)
    base = [f"v{i}" for i in range(150)]
    for _ in range(60):  # a family of copies with random edits, many of them below the threshold
        t = base.copy()
        for i in rng.integers(0, 150, rng.integers(1, 14)):
            t[i] = f"u{rng.integers(1_000_000)}"
        texts.append(" ".join(t))
    texts += [" ".join(base[: 100 + k]) for k in range(0, 50, 4)]  # copies that only lack something
    s = sets(texts)
    low_of = list(range(len(texts)))

    def find(i):
        while low_of[i] != i:
            i = low_of[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            low_of[y] = x
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(docs(spark, texts)).collect()}
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s[i]), find(i), find(i) == i)
    assert near_dedup.near_dedup(docs(spark, [])).count() == 0


def test_packing(spark):
    path = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    texts = corpus() + ["don't <|endoftext|> J̌ʼ it's,100%"]
    rows = packing.pack(docs(spark, texts), path, length=256).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["start"] == 256 * r["piece"] and len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack(docs(spark, []), path).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(0)
    for _ in range(30):
        sizes = sorted(rng.integers(1, 65, 200).tolist(), reverse=True)
        gaps = []
        for s in sizes:
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - s)
            else:
                gaps.append(64 - s)
        counts = {s: sizes.count(s) for s in set(sizes)}
        used, rows = {}, sorted(packing.plan(counts, 64))
        for s, n in counts.items():
            for rank in range(n):
                _, first, each, seq, offset = [r for r in rows if r[0] == s and r[1] <= rank][-1]
                d = rank - first
                used.setdefault(seq + d // each, []).append((offset + d % each * s, s))
        assert len(used) == len(gaps)
        for own in used.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:])) and sum(n for _, n in own) <= 64


def test_sentencepiece():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    fst = sentencepiece_fst.Transducer(path)
    texts = corpus() + ["Hello  wörld 日本\n x 𓀀\x00", "   lead", "aaaaaaaaaaaaaaaa bbbbbb", "été\tfoo  \n\n"]
    flat, begin = sentencepiece_fst.encode(pa.array(texts, pa.string()), fst, sentencepiece_fst.ChunkIds(fst))
    assert [flat[a:b].tolist() for a, b in zip(begin, begin[1:])] == [sp.encode(t or "") for t in texts]
    assert sentencepiece_fst.decode(flat, begin, fst) == [(t or "").encode() for t in texts]


def test_marginals_against_plain_recursion():
    rng = np.random.default_rng(0)
    scores, first, t = rng.normal(size=(210, 3)), np.array([0, 7, 207, 207, 210]), rng.normal(size=(3, 3))
    got, expected = language_id.marginals(scores, first, t)
    for a, b in zip(first, first[1:]):
        alpha, p = [], np.ones(3) / 3
        for x in scores[a:b]:
            p = (p @ np.exp(t)) * np.exp(x)
            p /= p.sum()
            alpha.append(p)
        beta, p = [], np.ones(3)
        for x in scores[a:b][::-1]:
            beta.append(p)
            p = np.exp(t) @ (np.exp(x) * p)
            p /= p.sum()
        for i in range(b - a):
            want = alpha[i] * beta[b - a - 1 - i]
            assert got[a + i] == pytest.approx(want / want.sum())
    assert expected.sum() == pytest.approx(210)


def test_language_id(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    table = spark.read.parquet(path)
    model = language_id.train(table, per_language=60)
    out = language_id.predict(table, model, with_spans=True).where(language_id.held_out(F.col("row.doc_id")))
    hits = out.agg(F.avg((F.col("lang_pred") == F.col("row.lang")).cast("double")), F.min("score"), F.max("score")).first()
    assert hits[0] >= 0.98 and 0 <= hits[1] <= hits[2] <= 1
    odd = language_id.predict(docs(spark, [None, "", "123 $$"]), model).collect()
    assert {(r["lang_pred"], r["score"]) for r in odd} == {("und", 0.0)}


def test_toxicity(spark):
    root = "/root/testdata/sf0.1"
    if not os.path.exists(root):
        pytest.skip("no test data")
    table, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    rest = labels.where("doc_id % 3 = 0")
    chain = toxicity.train(table, labels.where("doc_id % 3 != 0").withColumn("low", 1 - F.col("quality")), ["low", "toxic"])
    out = toxicity.predict(table, chain).join(rest, "doc_id").select((F.col("p_toxic") >= 0.5).alias("p"), (F.col("toxic") == 1).alias("y")).collect()
    caught = sum(r["p"] and r["y"] for r in out)
    assert caught >= 0.8 * sum(r["y"] for r in out) and sum(r["p"] and not r["y"] for r in out) <= 0.03 * len(out)
    assert toxicity.predict(docs(spark, [None, ""]), chain).count() == 2


def test_toxicity_learns_from_few_rows_of_a_rare_class(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocab, 12)) for _ in range(4000)]
    toxic = np.zeros(4000, int)
    toxic[::700] = 1  # 6 rows, 0.15 %
    texts = [f"{t} vileinsult" if y else t for t, y in zip(texts, toxic)]
    table = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    fresh = docs(spark, ["w1 vileinsult w2 w3", "w1 w2 w3", *(" ".join(rng.choice(vocab, 12)) for _ in range(200))])
    for sample in (8000, 1000):  # the whole table, and a draw in which chance alone would leave 1 or 2 rows of the class
        chain = toxicity.train(table, labels, ["toxic"], sample=sample)
        p = [r["p_toxic"] for r in toxicity.predict(fresh, chain).orderBy("doc_id").collect()]
        assert p[0] >= 0.5 and max(p[1:]) < 0.5
    assert toxicity.quotas([990_000, 10, 9_990], 8000) == [5293, 10, 1372] and toxicity.quotas([5, 3], 8) == [5, 3]


def test_html():
    page = "<html><head><title>T</title><script>x='<p>no</p>'</script></head><body><nav><a href=/>menu</a></nav><div class='sidebar'>side, bar, text</div><article><h1>Head</h1><p>One, two &amp; three<br>four.<p><b>Five</b>, six.</article><div id=comments><p>A reader, says, something, long enough to count.</p></div><footer>&copy; me</footer>"
    assert html_extraction.main_text(page) == "Head\n\nOne, two & three four.\n\nFive, six."
    assert html_extraction.main_text(None) == "" and html_extraction.main_text("<p") == ""
    plain = "<body><div class=content><p>" + "Long text, with commas, and more words. " * 5 + "</p><p>Short.</p></div><ul class=menu><li><a href=x>link, link, link</a></ul></body>"
    assert html_extraction.main_text(plain).endswith("\n\nShort.") and "link" not in html_extraction.main_text(plain)


ARTICLE = "<p>" + "Long text, with commas, and more words. " * 5 + "</p><p>" + "A second paragraph, also long enough. " * 4 + "</p>"


@pytest.mark.parametrize("marks", ["id='wrap' class='content has-sidebar'", "class=no-sidebar", "class='content-sidebar-wrap'", "class='page-with-footer'", "id='sidebar-layout'", "class='sidebar content'"])
def test_html_keeps_what_a_layout_class_wraps(marks):
    page = f"<body><div {marks}><h1>Head</h1>{ARTICLE}<div class='sidebar'>side, bar</div><div class=site-footer>foot, er</div></div></body>"
    got = html_extraction.main_text(page)
    assert "Long text" in got and "A second" in got and "side" not in got and "foot" not in got
    assert html_extraction.main_text(f"<body><form id=aspnetForm>{ARTICLE}</form></body>").startswith("Long text")


def test_html_reads_attributes_by_name():
    sentence = "<p>Some words, then <a href='/the-hidden-cost'>one</a>, <a title='a hidden gem'>two</a>, <span data-hidden='false'>three</span>, <a href=\"post.php?id=form\">four</a>, <a href=/x?class=sidebar>five</a>, <b hidden>gone</b><i STYLE='display: none'>gone</i> and the end.</p>"
    assert html_extraction.main_text(f"<body><div>{sentence}{ARTICLE}</div></body>").startswith("Some words, then one, two, three, four, five, and the end.")
    assert "Long text" in html_extraction.main_text(f"<body><div><p title='form hidden role=menu'>{ARTICLE[3:]}</div></body>")


def test_html_self_closed_drawings_are_empty():
    for tag in ("<svg viewBox='0 0 1 1'/>", "<svg href='a?b=c'/>", "<math />", "<svg/>"):
        got = html_extraction.main_text(f"<body><div><p>Before, it.</p>{tag}{ARTICLE}<svg><text>drawn</text></svg><p>After, it all.</p></div></body>")
        assert got.startswith("Before, it.\n\nLong text") and got.endswith("After, it all.") and "drawn" not in got
    assert "drawn" not in html_extraction.main_text(f"<body><div>{ARTICLE}<svg width=1/><text>drawn</text></svg></div></body>")


def test_html_still_cuts_named_parts():
    for name in ("sidebar", "site-footer", "main-nav", "comment-list", "post-comments", "ad1", "cookie-banner"):
        got = html_extraction.main_text(f"<body><div><div>{ARTICLE}</div><div class='x {name}'><p>{'Unwanted, text, it is. ' * 4}</p></div></div></body>")
        assert "Long text" in got and "Unwanted" not in got, name
    assert "Unwanted" not in html_extraction.main_text(f"<body><article><p>Short, it is.</p></article><div class=related><p>{'Unwanted, text. ' * 40}</p></div></body>")


def test_warc(spark, tmp_path):
    big = "é" * 600
    mark = "a\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb" + "z" * 1200
    html = [None, "", "small", "small", big, big, big, mark, "WARC/1.1\r\nstart", "ends\r\n\r\n"]
    pages = spark.createDataFrame([(i, f"http://h{i}.example.org/p", t) for i, t in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(html)
    for i, t in enumerate(html):
        raw = (t or "").encode()
        lead = 6 if i in (4, 5) else None
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["refers_to"]) == (len(raw), hashlib.sha1(raw).hexdigest(), lead)
    for gzip in (True, False):
        at = str(tmp_path / f"w{gzip}")
        warc.write(warc.decide(pages), at, gzip)
        whole = warc.captures(warc.read(spark, at))
        assert whole.where("response.digest_ok").count() == len(html) - 2 and whole.where("request is null or metadata is null").count() == 0


def test_topk(spark):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    v += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (400, v[5][1]), (401, v[5][1])]
    table = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    ok = {i: np.floor(1024 * np.array(x)).astype(int) for i, x in v if i < 300 or i >= 400}
    got = {}
    for r in topk.search(table, F.pmod("vec_id", F.lit(100)) == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {0, 100, 200, 400}
    for q, found in got.items():
        want = sorted(((-int(ok[q] @ x), i) for i, x in ok.items() if i != q))[:10]
        assert [found[k + 1] for k in range(10)] == [(i, -s) for s, i in want]


def test_topk_of_components_beyond_32_bits(spark):
    rng = np.random.default_rng(6)
    v = [(i, [float(x) for x in rng.normal(size=3) * 100]) for i in range(120)]
    v += [(120, [2_097_152.0, 0.0, 5.0]), (121, [-4_000_000.5, 3.0, 0.0]), (122, [0.0, 1e9, 0.0]), (123, [0.0, 0.0, -9e9])]
    ok = [[int(np.floor(1024 * y)) for y in x] for _, x in v]
    table = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.search(table, F.col("vec_id").isin(0, 40, 120, 122)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 40, 120, 122}
    for q, found in got.items():
        want = sorted((-sum(a * b for a, b in zip(ok[q], x)), i) for i, x in enumerate(ok) if i != q)[:10]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    far = spark.createDataFrame([(0, [1e9]), (1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="(?i)beyond 64 bits|overflow|out of range"):
        topk.search(far, F.lit(True)).collect()


def test_warc_returns_every_row_and_refuses_damage(spark, tmp_path):
    big = "q" * 1500
    rows = [(1, "http://a.example.org/x", "same")] * 3 + [(2, "http://b.example.org/y", big)] * 2 + [(1, "http://c.example.org/z", big), (None, None, None), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(i or 0, len(t or ""), sha(t), "revisit" if (i, t) == (1, big) else "response", 2 if (i, t) == (1, big) else None) for i, _, t in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    at = str(tmp_path / "w")
    warc.write(warc.decide(pages).coalesce(1), at, gzip=False)
    whole = warc._whole(warc.read(spark, at, with_payload=False))
    assert whole.count() == len(rows)
    (name,) = [f"{at}/{x}" for x in os.listdir(at) if x.startswith("part-")]
    with open(name, "rb") as f:
        raw = f.read()
    for damaged, why in ((raw.replace(b"qqqq", b"qqQq", 1), "damaged record"), (raw[:-40], "breaks off"), (raw.replace(b"WARC-Type: request", b"WARC-Type: removed", 1), "without its request")):
        os.makedirs(str(tmp_path / why))
        with open(str(tmp_path / why / "part"), "wb") as f:
            f.write(damaged)
        with pytest.raises(Exception, match=why):
            warc._whole(warc.read(spark, str(tmp_path / why), with_payload=False)).collect()
