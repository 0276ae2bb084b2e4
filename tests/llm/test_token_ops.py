"""Token files, filter interaction audit and cross-tokenizer alignment against plain versions."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from oracle.compare import connect
from viewlens.llm import alignment, filter_audit, token_files
from viewlens.llm import queries as Q
from viewlens.llm.byte_level import ByteLevel
from viewlens.llm.chunks import Chunks, sections
from viewlens.llm.csr import Csr
from viewlens.llm.frame_of_reference import BLOCK, Stream, pack

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "a", "a  b\tc\n d", " x", "  x ", "x\n  y", "x \n y", "▁x y", "<|endoftext|> <s> <0x0A>",
       "é́ ﬁ①  　z", "it's we'll DON'T 's", "word\x1cword\x85 word", "\U0001F600 z​", "a\0b c", "x" * 3000,
       "the cat " * 500, "Ünïcode, Straße! 12ab34 ***a***", "\n", " \n", "日本語 のテスト ②³", "ab́c,d e", "the cat"]


def documents(spark, texts, ids=None, lang="en"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, "s", 0) for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall())


def random_texts(n, seed=5, alphabet=" \n\t'abcsteI é½²ßÿ1.,!  \x1c　́日<|>"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(n)]


# ------------------------------------------------------------- chunks and byte-level ids
@pytest.mark.parametrize("lead", ["", " "])
def test_chunks_put_together_are_the_text(lead):
    texts = [t or "" for t in ODD] + random_texts(500)
    cut = Chunks(pa.array(texts), lead)
    words = cut.vocabulary.to_pylist()
    for k, t in enumerate(texts):
        assert "".join(words[c] for c in cut.codes[cut.begin[k]:cut.end[k]]) == lead + t or not t
    n = cut.occurrences(np.arange(len(texts)) % 2 == 0)
    assert n.sum() == (cut.end - cut.begin)[::2].sum()


def test_sections_keep_the_text_and_begin_with_words():
    text = "ab  cd \n ef " * 200
    parts = list(sections(text, 50))
    assert "".join(parts) == text and len(parts) > 20
    assert all(p[0] == " " and not p[1].isspace() for p in parts[1:])


@pytest.mark.parametrize("special", [True, False])
def test_byte_level_ids_equal_the_library(special, monkeypatch):
    from viewlens.llm import chunks
    monkeypatch.setattr(chunks, "SECTION", 200)  # long texts are cut
    own = ByteLevel(Q.BYTE_BPE, special)
    assert own.ranked
    tok = Tokenizer.from_file(Q.BYTE_BPE)
    tok.encode_special_tokens = not special
    texts = [t or "" for t in ODD] + random_texts(2000) + ["a" + chr(c) + " " + chr(c) + "b" for c in range(1, 0x600)]
    for _ in range(2):  # the second time many chunks are known
        for t, ids in zip(texts, own.encode(pa.array(texts))):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


# ------------------------------------------------------------- token files
@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 1.0])
def test_packed_streams_round_trip(share):
    r = np.random.default_rng(1)
    for v in ([], [5], [-1, 2**62, -2**62], r.integers(0, 50000, 1000), r.integers(-2**63, 2**63 - 1, 777),
              [-2**63, 2**63 - 1] * 100, [*range(300), 2**40, *[0] * 200]):
        v = np.array(v, np.int64)
        data = pack(v, share)
        s = Stream(b"xx" + data, 2)
        assert (s.get() == v).all() and len(s.get()) == len(v) and s.end == len(data) + 2
        for _ in range(20):
            i, j = sorted(r.integers(0, len(v) + 1, 2).tolist())
            assert (s.get(i, j) == v[i:j]).all()


def test_outliers_do_not_widen_a_block():
    v = np.arange(10 * BLOCK) % 16
    v[::BLOCK] = 2**40
    s = Stream(pack(v))
    assert set(s.width.tolist()) == {4} and len(s.high) == 10


def brute_files(rows):
    tok, at, out = Tokenizer.from_file(Q.BYTE_BPE), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_equal_the_library(spark, texts, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_SEGMENTS", 2)
    rows = [*texts.items(), *enumerate(ODD, 10_000), (None, "no id")]
    random.Random(2).shuffle(rows)
    df = documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(3).withColumn("part", F.lit("x"))
    path = token_files.write(df, Q.BYTE_BPE)
    got = token_files.read(spark, path)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    found = {tuple(r)[:4]: r.ids for r in got.collect()}
    assert sorted(found, key=lambda r: r[1]) == brute_files(rows)
    assert all(zlib.crc32(np.array(ids, "<u4").tobytes()) == r[3] and len(ids) == r[2] for r, ids in found.items())


def test_single_documents_are_read_from_their_blocks(spark):
    texts = ["the cat sat on the mat " * k for k in range(1, 60)]
    path = token_files.write(documents(spark, texts).coalesce(1), Q.BYTE_BPE)
    tok = Tokenizer.from_file(Q.BYTE_BPE)
    found = {}
    for content, in spark.read.format("binaryFile").load(path).select("content").collect():
        for s in token_files.segments(content):
            found.update({i: s.document(k).tolist() for k, i in enumerate(s.doc_ids)})
    assert found == {i: [*tok.encode(t).ids, 2] for i, t in enumerate(texts)}


def test_token_files_of_repeats_empty_tables_and_bad_ids(spark):
    rows = [(7, "same")] * 40 + [(7, "other"), (None, None), (None, None)]
    df = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    got = token_files.read(spark, token_files.write(df, Q.BYTE_BPE), with_ids=False).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((r[0], r[3]) for r in brute_files(rows))
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in starts] == np.cumsum([0, *[n for _, n in starts[:-1]]]).tolist()
    assert token_files.read(spark, token_files.write(df.limit(0), Q.BYTE_BPE)).count() == 0
    with pytest.raises(TypeError):
        token_files.write(df.withColumn("doc_id", F.lit("a")), Q.BYTE_BPE)


def test_damaged_token_files_are_noticed():
    data = bytearray(token_files.segment(0, 0, [1, 2], [3, 2], np.array([5, 6, 2, 7, 2], "<u4")) + b"\n")
    (s,) = token_files.segments(bytes(data))
    assert s.doc_ids == [1, 2] and s.document(1).tolist() == [7, 2]
    data[-6] ^= 1
    with pytest.raises(ValueError):
        list(token_files.segments(bytes(data)))


# ------------------------------------------------------------- filter audit
def brute_audit(rows, labels):
    """Every document through every order, one step after another."""
    good, toxic = ({i for i, q, t in labels if i is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    space = " \t\n\x0b\x0c\r"
    docs = []
    for i, t, lang in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in space else c for c in t).split(" ") if w]
        docs.append((i, lang or "", {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and i > least[t]}))
    out, shapley = {}, Counter()
    for part in {d[1] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            left = mine = [d for d in docs if d[1] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[2][f]]
                kept = [d for d in left if not d[2][f]]
                out[part, order, step] = [len(kept), len(gone), sum(d[2][f] for d in mine) - len(gone),
                                          sum(d[2][f] and sum(d[2].values()) == 1 for d in mine),
                                          sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
                shapley[part, f] += len(gone)
                left = kept
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_filter_audit_matches_brute_force(spark, monkeypatch):
    r = random.Random(4)
    words = ["cat", "Dog", "THE", "a#b", "of", "sat|", "run", "ünï"] + [f"w{k}" for k in range(400)]
    some = [" ".join(r.choice(words[:r.choice([3, 8, 400])]) for _ in range(r.choice([0, 3, 199, 200, 201, 500])))
            for _ in range(60)]
    rows = [(i, r.choice(some), r.choice(["en", "de", None, ""])) for i in range(200)]
    rows += [(None, some[0], "en"), (None, None, "fr"), (3, rows[3][1], "de"), (3, rows[3][1], "de"), (900, "\x0b x\x85", "fr")]
    labels = [(r.randrange(300), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(200)] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {"n": F.lit(1), "mask": F.lit(2), "digest": F.lit("x")})
    of = {"documents": docs, "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int")}
    monkeypatch.setattr(Q, "table", lambda s, d, name: of[name])
    got = Q.op12_filter_audit(spark, "")
    assert got.dtypes[:3] == [("part", "string"), ("filter_order", "string"), ("step", "int")]
    assert {k for _, k in got.dtypes[3:]} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)
    of["documents"] = docs.limit(0)
    assert Q.op12_filter_audit(spark, "").count() == 0


def test_filter_audit_matches_sql(spark):
    sql = connect(SF_SMALL).sql(Q.ORACLE_SQL["op12_filter_audit"])
    got = Q.op12_filter_audit(spark, SF_SMALL).select(*sql.columns)
    assert sorted(map(tuple, got.collect())) == sorted(sql.fetchall())


def test_wide_counters_hold_large_counts_and_refuse_larger_ones():
    import pandas as pd
    o = filter_audit.Outcomes("AB")
    n = 2**61
    rows = o.rows("p", pd.DataFrame({"mask": [3], "n": [n], "good": [1]}), ["good"])
    assert rows["removed"].tolist() == [n, 0, n, 0] and rows["redundant"].tolist() == [0, n, 0, n]
    assert rows["good_lost"].tolist() == [n, 0, n, 0] and rows["shapley"].tolist() == [n] * 4
    with pytest.raises(OverflowError):
        o.rows("p", pd.DataFrame({"mask": [3, 0], "n": [n, 2**61], "good": [1, 0]}), ["good"])
    with pytest.raises(ValueError):
        filter_audit.Outcomes("AA")


# ------------------------------------------------------------- alignment
def test_row_products_equal_dense_products():
    r = np.random.default_rng(3)
    for n, k, m in ((5, 7, 6), (1, 1, 1), (20, 3, 20), (4, 9, 0), (0, 3, 2)):
        x, y = r.integers(0, 3, (n, k)) * (r.random((n, k)) < 0.4), r.integers(0, 3, (k, m)) * (r.random((k, m)) < 0.4)

        def csr(d):
            return Csr(np.concatenate([[0], np.cumsum((d != 0).sum(axis=1))]), np.nonzero(d)[1], d.shape[1], d[d != 0])
        for most in (1, 4, 1000):
            got = csr(x).product(csr(y), most)
            dense = np.zeros((n, m), np.int64)
            dense[got.row_of_entries(), got.indices] = got.values
            assert (dense == x @ y).all() and (got.indices.size == np.count_nonzero(x @ y))
        t = csr(x).transpose()
        back = np.zeros((k, n), np.int64)
        back[t.row_of_entries(), t.indices] = t.values
        assert (back == x.T).all()


def brute_alignment(rows):
    """Tokens, groups and links of every whole text, and the corpus counts of linked id pairs."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=Q.PIECE_BPE)
    own = ByteLevel(Q.BYTE_BPE, special=False)

    def piece(i):
        return bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs, pairs = [], Counter()
    for i, t in rows:
        wanted = (" " + (t or "")).encode()
        a = own.tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        sides = [[(x, own.bytes[x]) for x in a], [(x, piece(x)) for x in b]]
        if not t or any(b"".join(y for _, y in side) != wanted for side in sides):
            docs.append((i, 0, 0, "", [], 0))
            continue
        spans = []
        for side in sides:
            at, mine = 0, []
            for x, y in side:
                mine.append((x, at, at + len(y)))
                at += len(y)
            spans.append(mine)
        cuts = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
        groups = ["|".join(",".join(str(x) for x, _, e in side if lo < e <= hi) for side in spans)
                  for lo, hi in zip([0, *cuts], cuts)]
        links = [(x, y, p, q, min(e, f) - max(s, r)) for p, (x, s, e) in enumerate(spans[0])
                 for q, (y, r, f) in enumerate(spans[1]) if max(s, r) < min(e, f)]
        pairs.update((x, y) for x, y, *_ in links)
        shared = sum(len(g.split("|")[0].split(",")) * len(g.split("|")[1].split(",")) for g in groups)
        docs.append((i, len(a), len(b), ";".join(groups), links, shared))
    most = Counter()
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    full = {i: (g, [(p, q, n) for _, _, p, q, n in links]) for i, _, _, g, links, _ in docs}
    return full, sorted((i, n_a, n_b, g.count(";") + 1 if g else 0, len(links), shared,
                         sum(pairs[x, y] == most[y] for x, y, *_ in links), sum(pairs[x, y] for x, y, *_ in links),
                         hashlib.sha256(g.encode()).hexdigest() if g else "") for i, n_a, n_b, g, links, shared in docs)


@pytest.mark.parametrize("blocks", [2, 30])
def test_alignment_matches_brute_force(spark, texts, blocks):
    short = [(i, t) for i, t in texts.items() if t and len(t) < 1500][:40]
    rows = [*short, *enumerate(ODD, 10_000), *enumerate(random_texts(200, 8), 20_000),
            *enumerate(["the cat sat", "the cat sat", "the dog"], 30_000)]
    df = documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(blocks).withColumns(
        {"block": F.lit(1), "pairs": F.lit("x")})
    full, wanted = brute_alignment(rows)
    got = alignment.linked_counts(df, Q.BYTE_BPE, Q.PIECE_BPE)
    assert sorted(map(tuple, got.collect())) == [w[:9] for w in wanted]
    plain = alignment.alignments(df, Q.BYTE_BPE, Q.PIECE_BPE).collect()
    assert {r.doc_id: (r.groups, sorted(tuple(x) for x in r.links)) for r in plain} == \
        {i: (g, sorted(x)) for i, (g, x) in full.items()}
    assert all(r.a_ends[-1:] == r.b_ends[-1:] for r in plain)


def test_alignment_of_repeats_null_ids_and_empty_table(spark):
    rows = [(1, "the cat"), (1, "the cat"), (None, "the cat"), (None, None)]
    df = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    got = [tuple(r) for r in alignment.linked_counts(df, Q.BYTE_BPE, Q.PIECE_BPE).collect()]
    assert sorted(got, key=str) == sorted(brute_alignment_any(rows), key=str)
    assert alignment.linked_counts(df.limit(0), Q.BYTE_BPE, Q.PIECE_BPE).count() == 0


def brute_alignment_any(rows):
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    return [(rows[r[0]][0], *r[1:]) for r in brute_alignment(numbered)[1]]


def test_alignment_of_a_model_whose_pieces_cross_words(spark, monkeypatch):
    rows = list(enumerate(t for t in ODD if t))[:12]
    tools = alignment.Aligner(Q.BYTE_BPE, Q.PIECE_BPE)
    tools.codec.by_chunk = False
    cut = tools.cut(pa.array([t for _, t in rows]))
    found = tools.align(cut.vocabulary)
    wanted = {i: g for i, (g, _) in brute_alignment(rows)[0].items()}
    got = [str(x[:-1], "ascii") for x in cut.of_texts(found.groups())]
    assert {i: g if found.spelt[cut.codes[i]] else "" for i, g in enumerate(got)} == wanted
