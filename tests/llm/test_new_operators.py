"""Archives, vector codes and alignments against plain versions: odd rows, nulls, ties, repeated rows, empty tables."""

import gzip
import hashlib
import io
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import groupby

import duckdb
import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from quadlens.llm import alignment, vector_codes, warc
from quadlens.llm.queries import BYTE_BPE, PIECE_MODEL

from .test_operators import DOC, by_doc, odd_texts

PAGE = "url string, page_id long, html string, payload string"


# Alignment


def plain_alignment(rows):
    """doc_id -> the contract's columns, one token at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    a_tok.encode_special_tokens = True
    letters, entry = alignment.byte_letters(), {i: x for x, i in a_tok.get_vocab().items()}
    links, count, out = {}, Counter(), {}
    for i, t in rows.items():
        out[i] = [0, 0, 0, 0, 0, 0, ""]
        if not t:
            continue
        a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
        a_bytes = [bytes(letters[c] for c in entry[x]) for x in a]
        pieces = [b_tok.id_to_piece(x) for x in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for ids, ends, side in ((a, ends_a, 0), (b, ends_b, 1)):
            for x, e in zip(ids, ends):
                groups[next(k for k, c in enumerate(cuts) if c >= e)][side].append(x)
        links[i] = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        count.update(links[i].keys())
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[i] = [len(a), len(b), len(cuts), sum(links[i].values()), 0, 0, hashlib.sha256(text.encode()).hexdigest()]
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    for i, found in links.items():
        out[i][4] = sum(n for p, n in found.items() if count[p] == top[p[0]])
        out[i][5] = sum(n * count[p] for p, n in found.items())
    return {i: tuple(x) for i, x in out.items()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out = [x for x in odd_texts() if x is None or len(x) < 3000]
    out += ["=" * 700, " " * 90 + "x", "naïve café 日本語 текст " * 3, "a<|endoftext|>b <|endoftext|>", "tab\there  two", " x \x85y \x1cz", "foo\n bar baz \nqux", "<0x41> <s> </s> <unk>"]
    out += [" ".join(rng.choice(["unbelievably", "internationalisation", "the", "zqxjk", "€5.00", "don't", "x_y_z"]) for _ in range(30)) for _ in range(8)]
    return dict(enumerate(out))


@pytest.mark.parametrize("block", [alignment.BLOCK, 500, 1])
def test_alignment(spark, texts, block):
    docs = spark.createDataFrame(list(texts.items()), DOC).repartition(3)
    assert by_doc(alignment.alignment_report(docs, BYTE_BPE, PIECE_MODEL, block)) == plain_alignment(texts)


def test_alignment_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = {i: t for i, t in rows.items() if len(t or "") < 20_000}
    docs = docs.where(docs.doc_id.isin(list(rows)))
    assert by_doc(alignment.alignment_report(docs, BYTE_BPE, PIECE_MODEL)) == plain_alignment(rows)


def test_alignment_defined_cases(spark):
    rows = [(None, "same words here", "x"), (1, None, "x"), (2, "", None), (3, "same words here", "x"), (3, "same words here", "y"), (4, "a▁b", None), (5, "ab " * 40_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string")
    got = alignment.alignment_report(docs, BYTE_BPE, PIECE_MODEL).collect()
    assert len(got) == len(rows)
    same = [r for r in got if r.doc_id in (None, 3)]
    assert len({tuple(r)[1:] for r in same}) == 1 and same[0].count_sum == 3 * same[0].n_links == 3 * same[0].n_best
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in got if r.doc_id in (1, 2, 4))
    assert next(r for r in got if r.doc_id == 5).n_a >= 40_000
    assert alignment.alignment_report(docs.limit(0), BYTE_BPE, PIECE_MODEL).count() == 0


def test_aligned_spans(spark):
    docs = spark.createDataFrame([(1, "unbelievably naïve"), (2, None), (3, "▁")], DOC)
    got = {r.doc_id: r for r in alignment.aligned(docs, BYTE_BPE, PIECE_MODEL).collect()}
    assert got[1].cuts[-1] == len(" unbelievably naïve".encode()) and got[1].overlaps[0] == (0, 0)
    assert [k for k, _ in groupby(o.a for o in got[1].overlaps)] == list(range(len(got[1].a_ids)))
    assert got[2].a_ids == got[3].a_ids == []


# Vector codes


def plain_codes(rows, entries=256, rounds=4, scale=1024, parts=4):
    """(vec_id, label, code, error) of kept rows in order, and the digest of the codebooks, with whole numbers only."""
    good = [r for r in rows if r[1] and all(e is not None and math.isfinite(e) for e in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(Fraction(x) * scale) for x in r[1]] for r in good]
    w = len(whole[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in whole]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return min(d), d.index(min(d))

    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for v in cut:
                got[near(v[p], books[p])[1]].append(v[p])
            for e, members in got.items():
                books[p][e] = [sum(x) // len(members) for x in zip(*members)]
    out = []
    for r, v in zip(good, cut):
        found = [near(v[p], books[p]) for p in range(parts)]
        out.append((r[0], r[2], "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def told(rows, entries=256):
    """The report's rows from the plain version."""
    found, sha = plain_codes(rows, entries)
    within = lambda x: min(x, (1 << 63) - 1)
    total = Counter()
    for _, label, _, error in found:
        total[label] += within(error)
    return sorted(((i, code, within(error), within(total[label]), sha) for i, label, code, error in found), key=str)


VEC = "label int, vec_id long, embedding array<double>, code string, n int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(label, i, v, "clash", 1) for i, v, label in rows], VEC).repartition(3)


def test_vector_codes(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice([None, 0, 1])) for i in range(300)]
    rows += [(300 + i, rows[0][1], 0) for i in range(60)] + [(400 + i, [float(round(x)) for x in rows[i][1]], 1) for i in range(40)]
    rows += [(7, rows[9][1], 1), (None, rows[4][1], 1), (None, rows[4][1], 1), (500, None, 1), (501, [], 1), (502, [0.0] * 7 + [None], 1), (503, [0.0] * 7 + [math.nan], 1), (504, [0.0] * 7 + [math.inf], 1)]
    for entries in (256, 16, 1):
        got = sorted(map(tuple, vector_codes.code_report(vectors_of(spark, rows), entries=entries).collect()), key=str)
        assert got == told(rows, entries)
    few = rows[:5]
    assert sorted(map(tuple, vector_codes.code_report(vectors_of(spark, few)).collect()), key=str) == told(few)
    assert vector_codes.code_report(vectors_of(spark, rows).where("vec_id >= 500")).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.code_report(vectors_of(spark, [*few, (9, [1.0] * 4, 0)]))
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.code_report(vectors_of(spark, [(9, [1.0] * 6, 0)]))


def test_vector_codes_wide(spark):
    """Components of any finite size: floors and sums of whole numbers, errors that end at 64 bits."""
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randint(0, 30) * rng.random() for _ in range(8)], i % 3) for i in range(80)]
    rows += [(100, [1.7e308] * 8, 0), (101, [-1.7e308] * 8, 0), (102, [5e-324] * 8, 1), (103, [-5e-324] * 8, 1)]
    got = sorted(map(tuple, vector_codes.code_report(vectors_of(spark, rows), entries=16).collect()), key=str)
    assert got == told(rows, 16)


def test_approximation_file():
    """Bounds hold, keep the nearest entry and leave few others."""
    rng = np.random.default_rng(2)
    book, q = rng.integers(-3000, 3000, (256, 16)), rng.integers(-4000, 4000, (500, 16))
    exact = ((q[:, None].astype(float) - book[None]) ** 2).sum(2)
    for bits in (1, 2, 4, 8):
        f = vector_codes.ApproximationFile(book, bits)
        low, high = f.bounds(q)
        unit = max(f.unit, abs(q).max()) ** 2
        assert (low * unit <= exact * 1.0001 + 1).all() and (high * unit >= exact * 0.9999 - 1).all()
        entry, dist = f.nearest(q)
        assert (entry == exact.argmin(1)).all() and (dist == exact.min(1)).all()
    assert len(vector_codes.ApproximationFile(book, 4).candidates(q)[0]) < 20 * len(q)


# Archives


def pages_of(spark, rows):
    return spark.createDataFrame([(u, i, h, "clash") for i, u, h in rows], PAGE).repartition(3)


def plain_pages(rows):
    out, most = [], {}
    for i, _, h in rows:
        most.setdefault(h or "", []).append(i)
    for i, _, h in rows:
        b, owner = (h or "").encode(), max((x for x in most[h or ""] if x is not None), default=None)
        again = len(b) >= 1000 and owner is not None and i != owner
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", owner if again else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/", "x" * 1000), (2, "http://b/ c\r\nX: y", "x" * 1000), (9, None, "x" * 1000), (9, None, "x" * 1000), (None, "http://n/", "x" * 1000),
    (3, "http://c/", "x" * 999), (4, "http://d/", "x" * 999), (5, "é", None), (6, "", ""), (7, "u", "é" * 500), (8, "u", "é" * 500), (10, "u", "é" * 499),
    (11, "q", "WARC/1.1\r\nWARC-Type: revisit\r\n\r\n" * 50), (12, "q", "\r\n\r\n" * 400), (13, "q", "\x00\n" * 700), (None, "z", "n" * 2000), (14, "l", "long " * 300_000), (-15, "l", "long " * 300_000),
]


def test_archive_report(spark, small):
    got = sorted(map(tuple, warc.archive_report(pages_of(spark, ROWS)).collect()), key=str)
    assert got == plain_pages(ROWS)
    assert warc.archive_report(pages_of(spark, ROWS).limit(0)).count() == 0
    pages = spark.read.parquet(f"{small}/pages.parquet")
    want = duckdb.execute(warc.ORACLE.replace("FROM pages", f"FROM '{small}/pages.parquet'")).fetchall()
    assert sorted(map(tuple, warc.archive_report(pages).collect())) == sorted(want)


@pytest.mark.parametrize("options", [{}, {"compression": "none"}, {"file_bytes": "3000"}])
def test_warc_source(spark, tmp_path, options):
    path = str(tmp_path / "a")
    warc.archive(pages_of(spark, ROWS), path, date="2026-01-02T03:04:05Z", **options)
    assert not [x for x in (tmp_path / "a").iterdir() if x.is_dir()]
    rows = warc.read(spark, path).where("warc_type <> 'warcinfo'").collect()
    assert len(rows) == len(ROWS)
    assert sorted(len(r.payload) for r in rows if r.warc_type == "response") == sorted(n for _, n, _, t, _ in plain_pages(ROWS) if t == "response")
    assert all(r.payload_digest == hashlib.sha1(r.payload).hexdigest() and r.payload_length == len(r.payload) for r in rows if r.warc_type == "response")
    assert {r.target_uri for r in rows} >= {"http://b/%20c%0D%0AX:%20y", None, "é"} and {r.date for r in rows} == {"2026-01-02T03:04:05Z"}
    names = "record_id string, warc_type string, refers_to string"
    assert warc.read(spark, path, names, "warc_type = 'revisit' AND refers_to = '<urn:page:9>'").count() == 3
    assert warc.read(spark, path, names, "record_id IN ('<urn:page:3>', '<urn:page:4>') OR refers_to LIKE '%page:8>'").count() == 3
    assert warc.read(spark, path, names, "concat(warc_type, 'x') = 'responsex' AND record_id IS NULL").count() == 0
    first = warc.read(spark, path, names, "warc_type = 'response'")
    n = first.count()
    plan = warc.pushed_filters(first.where("record_id LIKE '<urn:page:1%'"))
    assert "EqualTo(warc_type,response)" in plan and "StringStartsWith(record_id" in plan
    assert first.where("record_id LIKE '<urn:page:1%'").count() < n == first.count()  # what was pushed once is not kept
    warc.register(spark)
    pages_of(spark, ROWS[:2]).selectExpr("html AS payload").write.format("warc").mode("overwrite").save(path)
    assert warc.read(spark, path).where("warc_type = 'response'").count() == 2


def test_payloads_are_passed_over():
    """Where a header rules a record out, its payload is neither read nor inflated."""
    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            out = super().read(n)
            self.taken += len(out)
            return out

        def size(self):
            return len(self.getvalue())

    noise = random.Random(1).randbytes(3_000_000)
    raw = warc.record_bytes("response", {"WARC-Record-ID": "<urn:a>", "Content-Type": "application/http"}, warc._http(len(noise)) + noise)
    small = warc.record_bytes("revisit", {"WARC-Record-ID": "<urn:b>", "Content-Type": "application/http"}, warc._http(77))
    wanted = lambda row: row["warc_type"] == "revisit"
    for data in (raw + small + raw, b"".join(map(warc.gzip_member, (raw, small, raw)))):
        f = Counted(data)
        got = list(warc.records(f, wanted, {"record_id", "payload", "payload_length"}))
        assert [(r["record_id"], r["payload_length"], r["payload"]) for r in got] == [("<urn:b>", 77, None)]
        assert f.taken < 400_000
        assert [len(r["payload"]) for r in warc.records(Counted(data), lambda r: r["warc_type"] == "response", {"payload"})] == [len(noise)] * 2
    for data in (gzip.compress(raw + small) + gzip.compress(raw), gzip.compress(raw) + gzip.compress(b"") + gzip.compress(small + raw)):  # members of other writers
        assert [r["record_id"] for r in warc.records(Counted(data), lambda r: True, {"record_id"})] == ["<urn:a>", "<urn:b>", "<urn:a>"]
    for broken in (raw[:-3000], warc.gzip_member(raw)[:-3000], b"no archive", gzip.compress(raw)[:-3000]):
        for columns in ({"payload"}, {"record_id"}):
            with pytest.raises(ValueError, match="at byte"):
                list(warc.records(Counted(broken), lambda r: True, columns))


def test_foreign_headers():
    raw = b"WARC/1.0\r\nwarc-type: response\r\nX-Long: a\r\n b\r\nWARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\nContent-Type: text/plain\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    got = list(warc.records(pa.BufferReader(raw), lambda r: True, {"payload", "payload_length"}))
    assert (got[0]["payload"], got[0]["payload_length"], got[0]["payload_digest"], got[0]["warc_type"]) == (b"abc", 3, "00" * 20, "response")
    assert warc.bare_digest("sha256:AB") == "sha256:AB" and warc.bare_digest("sha1:" + "AB" * 20) == "ab" * 20 and warc.bare_digest(None) is None
