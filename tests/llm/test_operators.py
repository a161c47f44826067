"""Each operator against a plain version: odd texts, nulls, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import time
import zlib
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

from quadlens.llm import html_crf, jaccard_join, knn_voronoi, lang_hd, line_dedup, packing, piece_codec, quality_rules, suffix_dedup, token_counts
from quadlens.llm.queries import BYTE_BPE, BYTE_RANKS, PIECE_MODEL

from . import brute

DOC = "doc_id long, text string"


def odd_texts():
    rng = random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "é", "É", "A", "<|endoftext|>", "▁", " ", "\xa0", "!", "12", "'s", "日本", "\x1c", " \n", "😀", "the", "\x00", "#"]
    base = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 200))) for _ in range(12)]
    out = [None, "", " ", "  ", "abc ", " abc", "a  b", "▁", "a▁ b", "\n", "\n\n", "x" * 49, "x" * 50, "x" * 300, "word " * 3000]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(80)]
    for _ in range(60):
        a, b = rng.choice(base), rng.choice(base)
        out.append(a[: rng.randint(0, len(a))] + b[rng.randint(0, len(b)) :])
    for k in range(12):
        words = ("one two three four five six seven eight nine ten " * 4 + f"tail{k % 5}").split()
        words[k % 40] = f"w{k % 6}"
        out.append(" ".join(words).upper() if k % 3 else " ".join(words))
    return out


@pytest.fixture(scope="module")
def odd(spark):
    rows = dict(enumerate(odd_texts()))
    return rows, spark.createDataFrame(list(rows.items()), DOC).repartition(3).cache()


def by_doc(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_piece_codec(odd, spark):
    import sentencepiece

    rows, docs = odd
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    got = by_doc(piece_codec.round_trip_report(docs, PIECE_MODEL))
    for i, t in rows.items():
        ids = model.encode(t or "") + [2]
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), brute.sha(model.decode(ids).encode()))
    back = by_doc(piece_codec.decode(piece_codec.encode(docs, PIECE_MODEL), PIECE_MODEL))
    assert all(back[i][0] == model.decode(model.encode(t or "")) for i, t in rows.items())


def test_token_counts(odd):
    from tokenizers import Tokenizer

    rows, docs = odd
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = {i: (len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False)), n > 30) for i, t in rows.items()}
    assert by_doc(token_counts.token_counts(docs, BYTE_BPE, 30)) == want


def test_packing(odd):
    from tokenizers import Tokenizer

    rows, docs = odd
    for ranks in (None, BYTE_RANKS):
        packed = packing.pack(docs, BYTE_BPE, 64, ranks=ranks).toPandas()
        got, least = brute.check_packing(rows, packed, Tokenizer.from_file(BYTE_BPE), 64)
        assert least <= got <= least + 2


def test_minimum_bin_slack():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 300))]
        histogram = {x: sizes.count(x) for x in sizes}
        patterns = packing.minimum_bin_slack(histogram, 100)
        used = {}
        for bins, chosen in patterns:
            assert bins > 0 and sum(x * n for x, n in chosen) <= 100
            for x, n in chosen:
                used[x] = used.get(x, 0) + bins * n
        assert used == histogram
        assert sum(b for b, _ in patterns) <= 1.25 * -(-sum(sizes) // 100) + 1


def test_line_dedup(odd):
    rows, docs = odd
    want = {i: (len(a), len(a) - len(s), brute.sha("\n".join(s).encode())) for i, (a, s) in brute.kept_lines(rows).items()}
    assert by_doc(line_dedup.line_dedup_report(docs, batches=5)) == want


def test_quality_rules(odd):
    rows, docs = odd
    got = by_doc(quality_rules.quality_report(docs))
    for i, t in rows.items():
        base = brute.quality(t)
        assert got[i][:5] == base
        assert got[i][5] == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (got[i][5] and got[i][6])


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard(odd, n, percent):
    rows, docs = odd
    assert by_doc(jaccard_join.jaccard_components(docs, n, percent)) == brute.jaccard(rows, n, percent)


def test_jaccard_family(spark):
    """A large family of near copies, and chains through it."""
    rng, words = random.Random(4), [f"w{i}" for i in range(60)]
    rows = {}
    for i in range(150):
        w = list(words)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows[3 * i] = " ".join(w)
    docs = spark.createDataFrame(list(rows.items()), DOC)
    assert by_doc(jaccard_join.jaccard_components(docs, 4, 85)) == brute.jaccard(rows, 4, 85)
    kept = {r.doc_id for r in jaccard_join.keep_one(docs, 4, 85).collect()}
    assert kept == {c for _, c in brute.jaccard(rows, 4, 85).values()}


@pytest.mark.parametrize("limit", [256, 3, 0])
def test_jaccard_matches(spark, limit):
    """Texts put together from shared passages and one phrase in all: whatever the limit sends to longer prefixes, components are the same."""
    rng = random.Random(10)
    passages = [" ".join(f"p{i}_{k}" for k in range(20)) for i in range(12)]
    rows = {i: "one phrase that all of them begin with " + " ".join(passages[j] for j in rng.sample(range(12), 6)) for i in range(120)}
    rows |= {200 + i: rows[i] + " end" for i in range(0, 120, 9)}
    docs = spark.createDataFrame(list(rows.items()), DOC).repartition(3)
    assert by_doc(jaccard_join.jaccard_components(docs, 4, 85, limit)) == brute.jaccard(rows, 4, 85)


def test_jaccard_pairs_grow_with_documents(spark, monkeypatch):
    """One phrase in all documents and the rest drawn from passages that 150 documents share each: candidates grow in
    proportion to the documents. (From a pool of fixed size also the pairs that share most passages grow with the square.)"""
    seen, verified = [], jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *a: seen.append(pairs.count()) or verified(pairs, *a))

    def pairs(n):
        rng, pool = random.Random(n), n // 25
        passages = [" ".join(f"p{i}_{k}" for k in range(40)) for i in range(pool)]
        rows = [(i, "one phrase that all of them begin with " + " ".join(passages[j] for j in rng.sample(range(pool), 6))) for i in range(n)]
        seen.clear()
        jaccard_join.jaccard_components(spark.createDataFrame(rows, DOC).repartition(4), 4, 85).count()
        return sum(seen)

    small, large = pairs(1000), pairs(2000)
    assert large < 2.3 * small and large < 0.1 * 2000 * 1999 / 2


def test_jaccard_pairs_that_cannot_link_are_not_made(spark, monkeypatch):
    """Texts that share up to five of six passages share prefix tokens, but what their sketches tell apart leaves no room
    for a link: after the leaders hardly any pair but the planted near copies is verified."""
    seen, verified = [], jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *a: seen.append(pairs.count()) or verified(pairs, *a))
    rng = random.Random(3)
    passages = [" ".join(f"p{i}_{k}" for k in range(40)) for i in range(16)]
    rows = {i: " ".join(passages[j] for j in rng.sample(range(16), 6)) for i in range(400)}
    rows |= {1000 + i: rows[i] + " end" for i in range(0, 400, 20)}
    docs = spark.createDataFrame(list(rows.items()), DOC).repartition(3)
    assert by_doc(jaccard_join.jaccard_components(docs, 4, 85)) == brute.jaccard(rows, 4, 85)
    assert sum(seen[1:]) < 100


def test_jaccard_ships_sets_of_pairs_only(spark):
    """Verifying three pairs of 2,000 sets must not shuffle all sets."""
    rng = random.Random(5)
    rows = [(i, 60, [rng.randrange(1 << 48) for _ in range(60)]) for i in range(2000)]
    rows[1] = (1, 60, rows[0][2][:58] + [1, 2])
    reps = jaccard_join.checkpointed(spark.createDataFrame(rows, "rep long, n long, shared array<long>"))
    pairs = jaccard_join.checkpointed(spark.createDataFrame([(0, 1), (0, 2), (3, 4)], "a long, b long"))
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def shuffled():
        none = jvm.jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, jvm.new_array(jvm.jvm.double, 0), none)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before, least = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # bytes; the sets have a million
    try:
        assert [tuple(r) for r in jaccard_join.verified(pairs, reps, 85).collect()] == [(0, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert sum(n for k, n in shuffled().items() if k not in before) < 50


def test_jaccard_half_prints_collide(spark, monkeypatch):
    """Sets with the same first half of their hash are told apart."""
    rows = {i: " ".join(f"w{(i % 9) * 3 + k}" for k in range(30)) + (f" x{i}" if i % 2 else "") for i in range(40)} | {90: "", 91: None}
    docs = spark.createDataFrame(list(rows.items()), DOC).repartition(2)
    told, info = (f(jaccard_join.document_sets(docs, 4, 85)) for f in (lambda t: t, lambda t: t.where("doc_id IS NOT NULL").drop("shared")))
    lost = told.where("doc_id IS NULL").selectExpr("CAST(NULL AS BIGINT) AS doc_id", "n_shingles", "fp1", "fp2", "CAST(NULL AS array<long>) AS shared")
    monkeypatch.setattr(jaccard_join, "document_sets", lambda *a: info.selectExpr("*", "CAST(NULL AS array<long>) AS shared").unionByName(lost).select(*told.columns))
    assert by_doc(jaccard_join.jaccard_components(docs, 4, 85)) == brute.jaccard(rows, 4, 85)


def test_suffix_dedup(odd):
    rows, docs = odd
    want = {i: (n, r, s, brute.sha(k)) for i, (n, r, s, k) in brute.suffix_kept(rows).items()}
    assert by_doc(suffix_dedup.suffix_dedup_report(docs)) == want


def test_keys_in_two_steps(odd, monkeypatch):
    """Past FAN buckets keys travel by ranges; the results are the same."""
    rows, docs = odd
    monkeypatch.setattr(suffix_dedup.K, "FAN", 4)
    want = {i: (n, r, s, brute.sha(k)) for i, (n, r, s, k) in brute.suffix_kept(rows).items()}
    assert by_doc(suffix_dedup.suffix_dedup_report(docs)) == want
    assert by_doc(jaccard_join.jaccard_components(docs, 4, 85)) == brute.jaccard(rows, 4, 85)


def test_suffix_dedup_splits_a_hot_anchor(spark, monkeypatch):
    """A phrase under 50 bytes in every document, and a passage over 50: no task gets the contexts of all documents."""
    rng = random.Random(7)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = own(90)
    rows = {5 * i: own(60) + "\nReleased under the MIT License.\n" + own(60) + (passage if i % 3 else "") + own(20) for i in range(900)}
    rows |= {10_000 + i: rows[5 * i][30:200] for i in range(0, 900, 7)}  # equal windows over the edges too
    docs = spark.createDataFrame(list(rows.items()), DOC).repartition(6)
    dealt, seen = suffix_dedup.dealt, []
    monkeypatch.setattr(suffix_dedup, "PART_WINDOWS", 2000)
    monkeypatch.setattr(suffix_dedup, "dealt", lambda *a: seen.append(dealt(*a)) or seen[-1])
    want = {i: (n, r, s, brute.sha(k)) for i, (n, r, s, k) in brute.suffix_kept(rows).items()}
    assert by_doc(suffix_dedup.suffix_dedup_report(docs, many=100)) == want
    load, sorted_together = Counter(), Counter()
    for r in seen[0].where(f"kind = {suffix_dedup.CONTEXTS}").collect():
        key = suffix_dedup.K.unpacked(bytes(r.blob))[0].tolist()
        load[r.part] += len(key)
        sorted_together.update((r.part, k) for k in key)
    assert max(sorted_together.values()) <= 100 and max(load.values()) < 0.1 * sum(load.values())
    # kept texts, too
    docs = docs.selectExpr("doc_id", "text", "length(text) AS n_chars")
    kept = {r.doc_id: r.text for r in suffix_dedup.dedup_documents(docs, many=100).collect()}
    assert {i: brute.sha(t.encode()) for i, t in kept.items()} == {i: w[3] for i, w in want.items()}


def test_induced_sort(monkeypatch):
    """All suffixes in order with their common prefixes, whatever goes through files: queues, arrays, recursion on names."""
    import numpy as np

    from quadlens.llm import induced_sort

    rng, spills = random.Random(3), 0
    for _ in range(80):
        alphabet = rng.choice([b"ab", b"abc", b"a", bytes(range(97, 123))])
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 12))]
        text = b"".join(bytes(x + 1 for x in s) + b"\0" for s in strings * 2)
        monkeypatch.setattr(induced_sort, "CHUNK", rng.choice([4, 16, 1 << 18]))
        monkeypatch.setattr(induced_sort, "RUNS", rng.choice([2, 24]))
        depth, scratch = rng.choice([3, 7, 50]), induced_sort.Scratch(rng.choice([3, 10, 1 << 20]), rng.choice([5, 1 << 20]))
        sa, lcp = induced_sort.sorted_suffixes(np.frombuffer(text, np.uint8), depth, scratch.memory, scratch)
        spills += scratch.spills
        assert sorted(sa) == [i for i, c in enumerate(text) if c]
        cut = [text[i : text.index(b"\0", i)][:depth] for i in sa]
        assert cut == sorted(cut)
        for k in range(1, len(cut)):
            n = next((j for j, (x, y) in enumerate(zip(cut[k - 1], cut[k])) if x != y), min(len(cut[k - 1]), len(cut[k])))
            assert lcp[k] == n
    assert spills > 100


def test_shard_beyond_memory():
    """A shard several times what its queues hold, through the function the query runs in its tasks: queues spill, owners are those of brute force."""
    import numpy as np

    rng = random.Random(9)
    pool = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(50, 79))) for _ in range(4000)]
    pool += [x[:20] + pool[k + 1][:50] for k, x in enumerate(pool[:2000])]
    blobs, rows = [], []
    for block in range(4):
        part = [rng.choice(pool) for _ in range(5000)]
        ids = [rng.randrange(10**6) for _ in part]
        rows.append((part, ids))
        blobs.append((7, block, suffix_dedup.CONTEXTS, suffix_dedup.K.packed(np.array([k % 5 for k in range(5000)], np.uint64), np.array(ids), np.array([len(x) for x in part], np.uint8), np.frombuffer(b"".join(part), np.uint8), np.array([7], np.uint32))))
    spills, queue = [], 1 << 15
    assert sum(len(x) for x in pool) > 8 * queue
    got = list(suffix_dedup.solve_shard(iter([suffix_dedup.K.as_batch(blobs)]), 50, queue, spills))
    assert sum(spills) >= 8
    owner = {}
    for part, ids in rows:
        for x, i in zip(part, ids):
            for k in range(len(x) - 49):
                owner[x[k : k + 50]] = min(i, owner.get(x[k : k + 50], i))
    for batch in got:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist()):
            told = suffix_dedup.K.unpacked(blob)[2]
            assert told.tolist() == [owner[x[k : k + 50]] for x in rows[block][0] for k in range(len(x) - 49)]


def test_top_k(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    vectors += [(300 + i, [0.5] * 6) for i in range(60)] + [(360, None), (361, [1.0, None] + [0.0] * 4), (362, [float("nan")] * 6), (363, [float("inf")] * 6), (None, [0.1] * 6), (20, vectors[20][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    import math

    q = {i: [math.floor(64 * x) for x in v] for i, v in vectors if i is not None and i < 360}
    want = set()
    for i in q:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:20]
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    for options in ({}, {"n_pivots": 7, "block": 16}):
        assert {tuple(r) for r in knn_voronoi.top_k(df, **options).collect()} == want
    assert knn_voronoi.top_k(df.limit(0)).count() == 0
    assert knn_voronoi.top_k(df.where("vec_id = 20")).count() == 0


def test_top_k_extremes(spark):
    """Finite components of any size take part, scores are exact; mixed dimensions are an error."""
    rng = random.Random(6)
    base = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(90)]
    base += [(100, [1e8] * 4), (101, [-1e8, 1.0, 2.0, 3.0]), (120, [1e16, 3.0, 0.0, 1.0]), (121, [-1e16] * 4), (140, [1e308, 0.0, 0.0, 0.0]), (141, [-1e308, 1e-300, 0.0, 0.0]), (160, [])]
    q = {i: [int(x) * 64 if abs(x) >= 2**53 else int((64 * x) // 1) for x in v] for i, v in base if v}
    want = set()
    for i in q:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:20]
            want |= {(i, r + 1, j, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, j) in enumerate(best)}
    schema = "vec_id long, embedding array<double>, u array<double>, grp int"
    rows = [(i, v, None, 1) for i, v in base]
    assert {tuple(r) for r in knn_voronoi.top_k(spark.createDataFrame(rows, schema), slice_rows=40).collect()} == want
    with pytest.raises(ValueError, match="components"):
        knn_voronoi.top_k(spark.createDataFrame([*rows, (200, [1.0], None, 1)], schema))


#: Pages written and labelled by hand, in markup that the training layouts do not use: html, main text.
PAGES = [
    ("<body><div id=top-nav><a href=/>Start</a> | <a href=/b>Blog</a></div><div id=content><h1>Spring tides</h1><p>The sea rose by two metres on Monday, higher than in any year since records began.</p><p>Harbour staff moved the boats in time, and nobody was hurt.</p></div><div id=footer>Copyright 2021 The Harbour Post</div></body>",
     "Spring tides\nThe sea rose by two metres on Monday, higher than in any year since records began.\nHarbour staff moved the boats in time, and nobody was hurt."),
    ("<html><body><header><h2>Daily Notes</h2><nav><ul><li><a href='/1'>One</a><li><a href='/2'>Two</a></ul></nav></header><main><article><h1>On bread</h1><p>Flour, water and salt are all it takes, and a little patience.</p><aside class='related'><a href='/c'>Cakes we love</a></aside><p>Let the dough rest overnight, then bake it in a very hot oven.</p></article></main><footer><p>&copy; Daily Notes</p></footer></body></html>",
     "On bread\nFlour, water and salt are all it takes, and a little patience.\nLet the dough rest overnight, then bake it in a very hot oven."),
    ("<body><div class=cookie>We use cookies. <button>OK</div><div class='post'><h1>A walk</h1><p>We set out at dawn, when the fields were still white with frost.</p><img alt=\"5\" wide\"><p>By noon we had reached the old mill &amp; its pond.</p></div><section class=comments><h3>Comments</h3><div class=comment>Nice walk!</div><div class=comment>Where is it?</div></section></body>",
     "A walk\nWe set out at dawn, when the fields were still white with frost.\nBy noon we had reached the old mill & its pond."),
    ("<body><script src=/a/>var menu = '<p>no</p>';</script><article><h1>Clocks</h1><p>A clock that is wrong by a minute a day is right twice in two years.</p><ul><li>Wind it in the morning.</li><li>Keep it dry.</li></ul></article><div class='ad banner'>Buy a watch today, only 9.99!</div></body>",
     "Clocks\nA clock that is wrong by a minute a day is right twice in two years.\nWind it in the morning.\nKeep it dry."),
]


def test_html_by_hand():
    model = html_crf.default_model()
    want = [block for _, text in PAGES for block in text.split("\n")]
    got = [block for page, _ in PAGES for block in html_crf.main_text(page, model).split("\n")]
    right, found = Counter(want) & Counter(got), Counter(got)
    assert right.total() >= 0.9 * len(want) and right.total() >= 0.8 * found.total()


def test_html_odd_markup():
    blocks = lambda page: [x[0] for x in html_crf.leaf_blocks(page)]
    assert blocks('<p>x</p><img alt="5" wide"><p>y</p>') == ["x", "y"]
    assert blocks("<p>x</p><script src=/a/>var x = '<p>';</script><p>y</p>") == ["x", "y"]
    assert blocks("<p>x</p><button>go<p>the rest of the page") == ["x", "go", "the rest of the page"]
    assert blocks("<p>x</p><button>go</button><p>y") == ["x", "y"]
    assert blocks("a < b and <3 &lt;b&gt; <svg/>after <svg><path/></svg>end<!-- c --><!doctype html>") == ["a < b and <3 <b> after end"]
    assert blocks("<style>p{}") == [] and blocks("</ ><p>x") == ["x"] and blocks("<title>t</title>x") == ["x"]
    start = time.time()
    for part in ('<a "', "<a x='", '<a x="', "<button>", "<head>", "<!--", "<div>t", "<svg><svg></svg>", "&amp"):
        html_crf.leaf_blocks(part * (160_000 // len(part)))
    assert time.time() - start < 60


def test_html():
    model = html_crf.default_model()
    pages = html_crf.labelled_pages(120, 99)
    right = total = 0
    for page, labels in pages:
        got = model.viterbi(html_crf.features(html_crf.leaf_blocks(page)))
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.97
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>Some  text\n here, <b>bold</b>.<script>var t='</p>';</script><p>And more of it.</article><footer>&copy; 2020</footer>"
    assert html_crf.main_text(page, model) == "A & B\nSome text here, bold.\nAnd more of it."
    assert html_crf.main_text(None, model) == html_crf.main_text("<!-- x -->", model) == ""


def test_html_table(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").withColumnRenamed("url", "url")
    rows = html_crf.extract(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)


def test_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = lang_hd.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 !", "en"), (None, "the", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in lang_hd.predict(odd, docs).orderBy("doc_id").collect()][1:] == [("und", 0.0), ("und", 0.0)]
    assert {r.lang_pred for r in lang_hd.language_report(odd.where("doc_id = 2")).collect()} == {"und"}


def test_language_of_other_scripts(spark):
    """Two languages in one script, for scripts beyond Latin; a letter from U+30000 on is a letter."""
    rng = random.Random(8)
    words = {"ru": "что это было они для очень когда если между который", "uk": "що це було вони для дуже коли якщо між який", "el": "και είναι αυτό για όταν πολύ μεταξύ που", "zh": "我们的 这个时候 因为 所以 没有人 什么样 学习的 国家", "ja": "わたしは このとき なぜなら だから ひとは どんな 勉強する 国の"}
    text = lambda x: ("" if x in ("zh", "ja") else " ").join(rng.choice(words[x].split()) for _ in range(12))
    rows = [(i, text(x), x) for i, x in enumerate(list(words) * 40)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    asked = spark.createDataFrame([(i, text(x), x) for i, x in enumerate(list(words) * 20)], learn.schema)
    got = {r.doc_id: r.lang_pred for r in lang_hd.predict(asked, learn).collect()}
    assert sum(got[i] == x for i, x in enumerate(list(words) * 20)) >= 98
    assert all(lang_hd._codes()[ord(c)] for c in "\U00030000\U00031350жΩ中") and lang_hd._codes()[ord("Ж")] == lang_hd._codes()[ord("ж")]
    assert len({int(lang_hd._codes()[ord(c)]) for c in "абвгдежзαβγδ中国学"}) == 15


def test_language_against_plain_vectors(spark):
    """The same profiles from letters one by one: cosines agree; and pieces of a text make no difference."""
    import math

    import numpy as np

    rng = random.Random(12)
    words = {"en": "the house and garden were quiet", "de": "das haus und der garten waren still", "ru": "дом и сад были тихими"}
    rows = [(i, " ".join(rng.choice(words[x].split()) for _ in range(8)), x) for i, x in enumerate(list(words) * 8)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def profile(text):
        codes = [0] + [int(lang_hd._codes()[ord(c)]) for c in text] + [0]
        codes = [c for k, c in enumerate(codes) if c or not k or codes[k - 1]]
        counts = Counter(zip(codes, codes[1:], codes[2:]))
        total = np.zeros(lang_hd.DIMENSIONS)
        norm = math.sqrt(sum(n * n for (_, b, _), n in counts.items() if b))
        for (a, b, c), n in counts.items():
            if b:
                va, vb, vc = lang_hd.symbol_vectors(np.array([a, b, c])).astype(int)
                total += n * np.roll(va, 2) * np.roll(vb, 1) * vc
        return total, norm

    prototypes = {}
    for _, text, lang in rows:
        total, norm = profile(text)
        prototypes[lang] = prototypes.get(lang, 0) + total / norm
    asked = spark.createDataFrame([(i, t, None) for i, t, _ in rows] + [(99, "dom сад house", None)], learn.schema)
    for r in lang_hd.predict(asked, learn).collect():
        total, _ = profile(dict((i, t) for i, t, _ in [*rows, (99, "dom сад house", None)])[r.doc_id])
        cosines = {x: float(total @ p / np.linalg.norm(total) / np.linalg.norm(p)) for x, p in prototypes.items()}
        assert r.lang_pred == max(sorted(cosines), key=cosines.get) and abs(r.score - max(cosines.values())) < 1e-4


def test_long_language_text(monkeypatch):
    rng = random.Random(0)
    text = "".join(rng.choice("ab 1éжЖ中 ") for _ in range(3000))
    whole = lang_hd.trigrams_of(text)
    for piece in (1, 2, 7, 100):
        monkeypatch.setattr(lang_hd, "PIECE", piece)
        assert all((x == y).all() for x, y in zip(lang_hd.trigrams_of(text), whole))


REPORTS = {
    "piece_codec": lambda d: piece_codec.round_trip_report(d, PIECE_MODEL),
    "token_counts": lambda d: token_counts.token_counts(d, BYTE_BPE),
    "packing": lambda d: packing.pack(d, BYTE_BPE, 64),
    "line_dedup": line_dedup.line_dedup_report,
    "quality": quality_rules.quality_report,
    "jaccard": jaccard_join.jaccard_components,
    "suffix": suffix_dedup.suffix_dedup_report,
    "language": lang_hd.language_report,
}


LINE = "a line that is long enough to be a key, and to hold a window of fifty bytes"
#: By operator: what a test row of doc_id 1, 2 (twice, the same text as 1) and 3 (null) must say.
VALUES = {
    "piece_codec": {3: (1, brute.sha(b"2"), brute.sha(b""))},
    "token_counts": {3: (0, 0, False)},
    "line_dedup": {1: (1, 0, brute.sha(LINE.encode())), 2: (1, 1, brute.sha(b"")), 3: (1, 0, brute.sha(b""))},
    "quality": {1: (*brute.quality(LINE), True, False), 3: (0, 0, 0, 0, 0, True, False)},
    "jaccard": {1: (len(brute.shingles(LINE, 5)), 1), 2: (len(brute.shingles(LINE, 5)), 1), 3: (0, 3)},
    "suffix": {1: (75, 0, 0, brute.sha(LINE.encode())), 2: (75, 75, 1, brute.sha(b"")), 3: (0, 0, 0, brute.sha(b""))},
    "language": {3: (zlib.crc32(b"3") % 3 == 1, "und", 0.0)},
}


@pytest.mark.parametrize("name", REPORTS)
def test_defined_cases(spark, name):
    """Empty tables, null columns, repeated rows and extra columns with names the operators use themselves."""
    schema = "doc_id long, text string, lang string, n_tokens long, h1 string, key string, block int, rep long, task int, row int, gone int, lines int"
    extra = (1, "x", "y", 1, 1, 1, 1, 1, 1)
    assert REPORTS[name](spark.createDataFrame([], schema)).count() == 0
    rows = [(1, LINE, "en", *extra), (2, LINE, None, *extra), (2, LINE, *([None] * 10)), (None, LINE, "en", *extra), (3, *([None] * 11))]
    got = REPORTS[name](spark.createDataFrame(rows, schema)).collect()
    assert {r.doc_id for r in got} >= {1, 2, 3}
    for doc, want in VALUES.get(name, {}).items():
        assert {tuple(r)[1:] for r in got if r.doc_id == doc} == {want}


def test_long_text(spark):
    """A text of over a megabyte beside short ones."""
    rng = random.Random(13)
    words = [f"w{k}" for k in range(5000)]
    long = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(18_000))
    rows = {1: "short text of a few words only", 2: long, 3: long[: len(long) // 2] + " and another end", 4: long}
    docs = spark.createDataFrame(list(rows.items()), DOC)
    assert len(long) > 1 << 20
    assert by_doc(jaccard_join.jaccard_components(docs, 4, 85)) == {1: (4, 1), 2: (len(brute.shingles(long, 4)), 2), 3: (len(brute.shingles(rows[3], 4)), 3), 4: (len(brute.shingles(long, 4)), 2)}
    got = by_doc(suffix_dedup.suffix_dedup_report(docs))
    assert got[2][1] == 0 and got[4][1] == len(long) and got[3][1] == len(long) // 2
    got = by_doc(line_dedup.line_dedup_report(docs))
    want = brute.kept_lines(rows)
    assert {i: (len(a), len(a) - len(s)) for i, (a, s) in want.items()} == {i: v[:2] for i, v in got.items()}
    assert by_doc(quality_rules.quality_report(docs))[2][:5] == brute.quality(long)
    assert {r.doc_id for r in lang_hd.language_report(docs.selectExpr("*", "'en' AS lang")).collect()} == {1, 2, 3, 4}


def test_stages_keep_clashing_columns(spark):
    """The pipeline's stages over documents whose columns have the names that operators use, and without n_chars."""
    names = ["n_words", "kept", "_gone", "_id", "gone", "lines", "row", "text_", "runs", "_runs", "cut_id", "_drop", "rep", "_w", "_l", "changed", "lost_id", "version"]
    text = " ".join(["the house and the garden of a man who was not there with us"] * 1 + [f"word{k} is in the text" for k in range(12)])
    rows = [(i, f"{text} number {i % 2}\n{LINE} {i}", *range(len(names))) for i in (1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{x}` int" for x in names))
    for stage in (quality_rules.keep_good, line_dedup.dedup_documents, jaccard_join.keep_one, suffix_dedup.dedup_documents):
        got = stage(docs)
        assert got.columns == docs.columns
        found = got.collect()
        assert found and all(tuple(r)[2:] == tuple(range(len(names))) for r in found), stage
        assert stage(docs.limit(0)).count() == 0


def test_rows_of_one_id_lose_their_own_lines(spark):
    docs = spark.createDataFrame([(1, LINE), (2, f"{LINE}\nother"), (2, f"other\n{LINE} again")], DOC)
    got = sorted((r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.line_dedup_report(docs).where("doc_id = 2").collect())
    assert got == sorted([(2, 1, brute.sha(b"other")), (2, 0, brute.sha(f"other\n{LINE} again".encode()))])


def test_pipeline_stages_keep_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"] + ["the", "of", "and"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(40)
    rows = [(i, text(60) + ".\n" + (shared if i % 4 == 0 else text(30)) + ".\n" + text(20) + ".", "en", "s", None) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s", 5) for i in range(10)] + [(200 + i, rows[i][1] + " extra", None, None, None) for i in range(10)] + [(300, None, None, None, None), (301, "### *** $$$", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    texts = {r[0]: r[1] for r in rows}
    # stage by stage against the plain versions
    kept = {r.doc_id for r in quality_rules.judged(docs).where("kept").select("doc_id").collect()}
    texts = {i: t for i, t in texts.items() if i in kept}
    assert set(range(40)) <= set(texts) and 300 not in texts and 301 not in texts
    lines = brute.kept_lines(texts)
    texts = {i: "\n".join(s) for i, (_, s) in lines.items()}
    comp = brute.jaccard(texts, 5, 80)
    texts = {i: t for i, t in texts.items() if comp[i][1] == i}
    texts = {i: k.decode("utf-8", "ignore") for i, (_, _, _, k) in brute.suffix_kept(texts).items()}
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        at = at.cache()
    assert {r.doc_id: r.text for r in at.collect()} == texts
    from tokenizers import Tokenizer

    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    brute.check_packing(texts, packed, Tokenizer.from_file(BYTE_BPE))
